"""Operators on small tables: defined results for ties, nulls and edges; twins of streams; kernels on drawn pages."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineleaf.functions import geometry as G
from lineleaf.functions import text as T
from lineleaf.operators import document as D
from lineleaf.operators import kernels as K
from lineleaf.operators import ocr as O  # noqa: E741
from lineleaf.operators import relational as R
from lineleaf.operators import sequence as S
from lineleaf.plans import steps as P
from lineleaf.sources import readers
from lineleaf.streaming import stateful as ST


def one(spark, column, *values):
    """A column over one row of values v0, v1 and so on."""
    row = spark.createDataFrame([values], [f"v{i}" for i in range(len(values))]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def texts(spark, f, values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(f(F.col("v"))).collect()]


def test_line_predicates(spark):
    assert texts(spark, T.is_terminated, ["End.", "He said \"so.\" ", "no", "", "wait…", None]) == [True, True, False, True, True, None]
    assert texts(spark, T.ends_hyphen, ["exam-", "a -", "soft¬ ", "12-"]) == [True, False, True, False]
    assert texts(spark, T.looks_continuation, ["and so", "And", "  ; x", "élan", ""]) == [True, False, True, True, False]
    assert texts(spark, T.looks_bold, ["THE END", "THE", "The END", "A" * 70 + " B"]) == [True, False, False, False]
    assert texts(spark, T.looks_heading, ["CHAPTER ONE", "CHAPTER ONE.", "chapter", "12"]) == [True, False, False, False]
    assert texts(spark, T.is_page_number, ["12", "- xiv -", "page 3", "12345", "", " [12] ", "(...)", "1234567890123"]) == [True, True, False, True, False, True, False, False]
    assert texts(spark, T.list_marker, ["• one", "1. two", "a) three", "IV. four", "- five", "six"]) == ["one", "two", "three", "four", None, None]
    assert texts(spark, T.norm_running, ["The  Life, 12", "— 3 —"]) == ["the life", ""]
    assert texts(spark, T.is_lone_token, ["no no no no", "a b", None, "x", "1,234.5", " 12 "]) == [False, False, True, True, True, True]
    assert texts(spark, lambda c: T.has_unexpected_script(c, ["fr", "el"]), ["ок да", "λόγος", "français", "я", None]) == [True, False, False, False, False]
    assert texts(spark, lambda c: T.has_unexpected_script(c, ["auto"]), ["ок да"]) == [False]


def test_joining_and_notes(spark):
    assert one(spark, T.join_lines(F.col("v0"), F.col("v1")), "exam-", "ple is") == "example is"
    assert one(spark, T.join_lines(F.col("v0"), F.col("v1")), "Jean-", "Paul") == "Jean- Paul"
    assert one(spark, T.join_all(F.col("v0")), ["one", "two-", "fold", ""]) == "one twofold"
    assert one(spark, T.norm_superscripts(F.col("v0")), "x¹² y") == "x$^{12}$ y"
    assert one(spark, T.superscript_refs(F.col("v0")), "a¹ b² c¹") == ["1", "2"]
    assert one(spark, T.note_entries(F.col("v0")), "text (3) no\n(4) yes\n⁵ too") == ["4", "5"]
    text = O.convert_notes("A claim¹ and (2) and x⁹.\n¹ First note.\n(2) Second¹", {"1": "1", "2": "2-2"})
    assert text == "A claim[^1] and [^2-2] and x^9^.\n[^1]: First note.\n[^2-2]: Second[^1]"
    df = spark.createDataFrame([("d", 1, ["1", "2", "1"]), ("d", 2, ["1"]), ("e", 1, ["1"])], "d string, p int, m array<string>")
    got = {(r.d, r.p, r.number): r.anchor for r in O.note_mapping(df, "d", "p", "m").collect()}
    assert got == {("d", 1, "1"): "1", ("d", 1, "2"): "2", ("d", 2, "1"): "1-2", ("e", 1, "1"): "1"}
    pages = spark.createDataFrame([("x¹", {"1": "7"}), (None, None)], "t string, m map<string,string>")
    assert [r.t for r in O.with_notes(pages, "t", "m").collect()] == ["x[^7]", None]


def test_rendering_columns(spark):
    cells = [(0, 0, "a"), (0, 1, "b|c"), (1, 1, "d\ne")]
    df = spark.createDataFrame([(cells,)], "c array<struct<row:int,col:int,text:string>>")
    assert df.select(T.table_markdown(F.col("c"))).first()[0] == "| a | b\\|c |\n| --- | --- |\n|  | d e |"
    df = spark.createDataFrame([("abcdef", [(2, "<x>"), (4, "<y>")])], "t string, m array<struct<at:int,mark:string>>")
    assert df.select(T.inline_marks(F.col("t"), F.col("m"))).first()[0] == "ab <x> cd <y> ef"
    assert one(spark, T.split_block_text(F.col("v0"), F.lit(2)), "a\nb") == ["a", "b"]
    assert one(spark, T.split_block_text(F.col("v0"), F.lit(3)), "a\nb") == ["a b", "", ""]
    assert one(spark, T.fmt_counts(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(3)))) == "b=3 a=1"
    assert one(spark, T.html_to_markdown(F.col("v0")), '<h2>T</h2><p>a <b>b</b> &amp; c</p><ul><li>x</li></ul><script>y</script>') == "## T\na **b** & c\n- x"
    assert one(spark, T.slug_of_file(F.col("v0")), "/a/b/Book.pdf") == "Book"
    df = spark.createDataFrame([([("title", "<b>T</b>", 2), ("table", "<table>", 1), ("text", "first", None), ("footer", "no", 0)],)], "b array<struct<label:string,html:string,reading_order:int>>")
    assert df.select(O.structure_markdown(F.col("b"))).first()[0] == "first\n\n<table>\n\n# T"


def test_times_round_by_their_exact_value(spark):
    r = np.random.default_rng(4)
    ms = [69_000.0, 75_000.0, 117_000.0, 1_005.0, 1_015.0, 59_999.0, 0.5, 1.5, *(r.integers(0, 10**6, 300) * 30.0).tolist(), *(r.random(200) * 1e7).tolist()]
    want = [f"{v:.0f}ms" if v < 1000 else f"{v / 1000:.2f}s" if v < 60_000 else f"{v / 60_000:.1f}m" for v in ms]
    assert spark.createDataFrame([(v,) for v in ms], "v double").select(T.fmt_ms(F.col("v"))).toPandas().iloc[:, 0].tolist() == want
    assert one(spark, T.fmt_ms(F.lit(None).cast("double"))) is None
    odd = [0.0, -0.0, -0.04, 0.05, 0.15, 0.25, 0.35, -2.5, 1.25, 1.375, 0.0625, 9.9995, 0.9999999, 1e-300, 123456789.0625, 1e13 + 0.125, 4e15, *(r.integers(0, 10**7, 300) / 2e4).tolist()]
    for digits in (1, 2, 3):
        assert spark.createDataFrame([(v,) for v in odd], "v double").select(T.fixed(F.col("v"), digits)).toPandas().iloc[:, 0].tolist() == [f"{v:.{digits}f}" for v in odd]


def test_geometry_columns(spark):
    quad = ([0.0, 4.0, 4.0, 0.0], [0.0, 0.0, 3.0, 3.0])
    assert one(spark, G.polygon_area(F.col("v0"), F.col("v1")), *quad) == 12
    assert one(spark, G.is_convex(F.col("v0"), F.col("v1")), *quad) is True
    line = G.line_through(*(F.lit(float(v)) for v in (0, 0, 4, 4)))
    assert one(spark, F.round(G.line_angle(line), 6)) == 45 and one(spark, F.round(G.point_line_distance(F.lit(0.0), F.lit(2.0), line), 6)) == 1.414214
    assert one(spark, G.warp_extent(G.scaling(F.lit(2.0), F.lit(3.0)), F.lit(10.0), F.lit(5.0))) == [0, 0, 20, 15]
    assert one(spark, G.mm_to_px(F.lit(10.0), F.lit(300))) == 118 and one(spark, G.margin_sides(F.lit("1,2,3"))) is None
    assert one(spark, G.scale_box(F.array(*map(F.lit, (0, 0, 999, 999))), F.lit(1000), F.lit(500))) == [0, 0, 1000, 500]
    assert one(spark, G.pick_bucket(F.lit(33), F.lit(1126))) == 1 and one(spark, G.pick_bucket(F.lit(121), F.lit(1))) is None


def test_relational_edges(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 3, "z"), (None, 1, "n")], "k string, v int, t string")
    assert {(r.k, r.v, r.t) for r in R.newest(df, ["k"], ["v", "t"]).collect()} == {("a", 3, "z"), (None, 1, "n")}
    assert R.newest(df.limit(0), ["k"], ["v", "t"]).count() == 0
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 4), (6, 1)], "n int, p int")
    got = {(r.node, r.ancestor): r.distance for r in R.closure(tree, "n", "p").collect()}
    assert got[(5, 1)] == 4 and got[(5, 3)] == 2 and len(got) == 1 + 2 + 3 + 4 + 1
    assert R.closure(tree.limit(0), "n", "p").count() == 0
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, v string, kept int")
    new = spark.createDataFrame([(2, "c", None), (3, "d", 9)], "k int, v string, kept int")
    assert {tuple(r) for r in R.upsert(old, new, ["k"], keep=["kept"]).collect()} == {(1, "a", 5), (2, "c", 6), (3, "d", 9)}
    numbers = S.numbered(spark.range(50).select(F.col("id"), (F.col("id") % 7).alias("m")).repartition(5), ["m", "id"], "no")
    assert [r.no for r in numbers.orderBy("m", "id").collect()] == list(range(50))


@pytest.mark.parametrize("parts", [1, 5])
def test_sequences_do_not_depend_on_partitions(spark, parts):
    rows = [("a", i, v) for i, v in enumerate([1, 2, 3, 10, 11, 30])]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(parts)
    assert [r.session for r in S.gap_sessions(df, ["k"], "v", ["v"], F.lit(5)).orderBy("v").collect()] == [0, 0, 0, 1, 1, 2]
    assert [r.cluster for r in S.split_at_largest(df, ["k"], "v", ["v"], 2).orderBy("v").collect()] == [0, 0, 0, 0, 0, 1]
    iv = spark.createDataFrame([("a", 0, 5), ("a", 5, 8), ("a", 7, 9), ("a", 20, 21)], "k string, x0 int, x1 int").repartition(parts)
    assert sorted((r.x0, r.x1) for r in S.merged_intervals(iv, ["k"], "x0", "x1").collect()) == [(0, 5), (5, 9), (20, 21)]
    assert sorted((r.x0, r.x1) for r in S.merged_intervals(iv, ["k"], "x0", "x1", F.lit(1)).collect()) == [(0, 9), (20, 21)]
    chunks = S.chunks_by_caps(df, ["k"], ["i"], "v", 13, 3).orderBy("i").collect()
    assert [r.chunk for r in chunks] == [0, 0, 0, 1, 2, 3]


def test_batcher_and_gate():
    b = ST.Batcher(4, 40, 3)
    assert [b.add(i, 0) for i in range(3)] == [[], [], []]
    assert b.add(3, 1) == [(0, 0, 3, 4, "full", "batch")]
    assert b.add(9, 5) == [] and b.poll(44) == [] and b.poll(45) == [(1, 9, 9, 1, "timeout", "single")]
    b.add(1, 50)
    assert b.flush() == [(2, 1, 1, 1, "flush", "single")] and b.flush() == []
    gate = ST.ClickGate()
    fired = [t for t, s in [(0, 0.9), (1, 0.9), (2, 0.1), (2.7, 0.1), (3, 0.9), (3.2, 0.1), (3.3, 0.9), (4, 0.1), (5, 0.8)] if gate.feed(s, t)]
    assert fired == [3, 5]


def test_stream_equals_twin(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else the timeout keeps the query going
    rows = [(f"b{i % 3}", i, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "bucket string, item long, at double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = ST.stream_batches(stream, "bucket", "item", "at", 4, 1e7).writeStream.format("memory").queryName("batched").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    got = {(r.bucket, r.batch, r.n) for r in spark.sql("select * from batched where why = 'full'").collect()}
    assert got == {(r.bucket, r.batch, r.n) for r in ST.batches(df, "bucket", "item", "at", 4, 1e7).where("why = 'full'").collect()} and len(got) == 15
    share = df.select("bucket", (F.abs(F.sin("item"))).alias("share"), "at")
    share.coalesce(1).write.parquet(str(tmp_path / "in2"))
    q = ST.stream_clicks(spark.readStream.schema(share.schema).parquet(str(tmp_path / "in2")), "bucket", "share", "at").writeStream.format("memory").queryName("fired").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    twin = ST.clicks(share, "bucket", "share", "at", ["at"])
    assert sorted(map(tuple, spark.sql("select * from fired").collect())) == sorted(map(tuple, twin.collect()))


def page(lines=12, width=300):
    a = np.full((lines * 14 + 20, width), 235, np.uint8)
    rng = np.random.default_rng(0)
    for i in range(lines):
        a[10 + i * 14 : 16 + i * 14, 20 : width - 20 - int(rng.integers(0, 40))] = 30
    return a


def test_kernels():
    a = page()
    assert K.otsu(a) in range(30, 235) and not K.is_binary(np.arange(9, dtype=np.uint8).reshape(3, 3)) and K.is_binary(K.to_bw(a))
    bw = K.wolf(a, None, 21)
    assert ((bw == 0) == (a == 30)).mean() > 0.9
    mask = np.zeros(a.shape, bool)
    mask[:50] = True
    assert (K.wolf(a, mask, 21)[50:] == 255).all() and (K.wolf(a, np.zeros(a.shape, bool), 9) == 255).all()
    labels, n = K.components(np.array([[1, 0, 1], [0, 1, 0], [0, 0, 0], [1, 1, 0]], bool))
    assert n == 2 and labels[0, 0] == labels[0, 2] == labels[1, 1] != labels[3, 0]
    m = np.array([[np.cos(0.05), -np.sin(0.05), 10], [np.sin(0.05), np.cos(0.05), -5], [0, 0, 1]])
    turned = K.warp(a, m, (a.shape[1], a.shape[0]))
    assert abs(abs(K.skew_angle(turned, 6, 0.1)) - np.degrees(0.05)) < 0.5
    assert K.resize(a, 150, 94).shape == (94, 150) and abs(K.resize(a, 150, 94).mean() - a.mean()) < 2
    assert K.merge_rects([(0, 0, 100, 400), (110, 0, 130, 400)], 2, 1000, 1400) == [(0, 0, 130, 400)]
    assert len(K.merge_rects([(0, 0, 400, 900), (600, 0, 1000, 900)], 2, 1000, 1400)) == 2
    assert len(K.merge_rects([(0, 0, 100, 900), (300, 0, 400, 900), (600, 0, 700, 900), (900, 0, 905, 9)], 2, 1000, 1400)) == 2
    square = np.array([[0, 0], [2, 0], [2, 2], [0, 2]], float)
    assert abs(K.quad_iou(square, square + [1, 0]) - 1 / 3) < 1e-9 and K.quad_iou(square, square + 5) == 0
    h = K.homography(square, square * 2 + 1)
    assert np.allclose(K.homography(square * 2 + 1, square) @ h / (K.homography(square * 2 + 1, square) @ h)[2, 2], np.eye(3), atol=1e-6)
    pts = np.array([[i, 2 * i + (50 if i == 5 else 0)] for i in range(20)], float)
    line = K.fit_line_ransac(pts, eps=1)
    assert abs(-line[0] / line[1] - 2) < 0.01 and abs(K.theil_sen(np.array([[0.05 * y, y] for y in range(20)])) - 0.05) < 1e-9
    basis = K.spline_basis(np.linspace(0, 1, 11), 4)
    assert basis.shape == (11, 4) and (basis >= -1e-12).all() and (basis.sum(1) <= 1 + 1e-9).all()
    coefficients = K.span_baseline(np.arange(40.0), 3 + 0.5 * np.arange(40), 10)
    assert np.allclose(coefficients[:2], [3, 0.5], atol=1e-6) and K.span_baseline(np.arange(4.0), np.arange(4.0), 10) is None


def test_pipeline_and_planner(spark):
    steps = P.bind({"steps": [{"operator": "dpi_fix", "low": "100", "unknown": 1}, "deskew", "split", {"operator": "binarize", "options": {"k": 0.2}}, "margins"]})
    assert [s.name for s in steps] == ["00_dpi", "01_deskew", "02_split", "03_binarize", "04_margins"] and steps[0].options["low"] == 100.0
    assert [[s.operator for s in g] for g in P.segments(steps)] == [["dpi", "deskew", "split"], ["binarize", "margins"]]
    with pytest.raises(KeyError):
        P.bind(["nothing"])
    stamped = [{"operator": "margins", "idx": 0, "kind": "x"}, {"operator": "binarize", "idx": 1, "kind": "pixel"}, {"operator": "deskew", "idx": 2, "kind": "affine"}, {"operator": "dpi", "idx": 3, "kind": None}]
    assert [s["operator"] for s in P.replay_order(stamped)] == ["deskew", "binarize", "margins"]
    rng = np.random.default_rng(1)
    ms = [rng.normal(size=(3, 3)) for _ in range(4)]
    (kind, got), = P.fuse([("affine", m) for m in ms])
    assert kind == "affine" and np.allclose(got, ms[3] @ ms[2] @ ms[1] @ ms[0])
    assert [k for k, _ in P.fuse([("affine", ms[0]), ("map", "f"), ("affine", ms[1])])] == ["map", "affine"]
    df = spark.createDataFrame([(1, i, m.reshape(-1).tolist()) for i, m in enumerate(ms)], "k int, i int, m array<double>")
    assert np.allclose(np.array(P.fused_matrices(df, "k", "i", "m").first()["m"]).reshape(3, 3), got)
    a = page()
    a[12::14, 30:40] = 90  # not bitonal
    two = np.concatenate([a, np.full((a.shape[0], 80), 235, np.uint8), a], axis=1)
    rows = [(1, "", two.tobytes(), *two.shape, 1, 150.0, "{}"), (2, "", a.tobytes(), *a.shape, 1, 90.0, "{}")]
    pages = spark.createDataFrame(rows, K.PAGES)
    out = K.run_pipeline(pages, steps).collect()
    assert sorted((r.page, r.branch) for r in out) == [(1, "A"), (1, "B"), (2, "A")]
    for r in out:
        got = np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width)
        assert K.is_binary(got) and json.loads(r.meta)["stamps"]
    kept = K.run_pipeline(pages, P.bind(["binarize"]), frozenset({("", 0)})).where("page = 2").first()
    assert bytes(kept.pixels) == a.tobytes()
    assert K.run_pipeline(pages.limit(0), steps).count() == 0
    assert "binarize" in P.operator("binarize").describe()


def test_command_line_languages():
    assert P.parse_spec("MD:numeric,title='a:b'") == ("md", ["numeric"], {"title": "a:b"})
    assert P.parse_exports("pdf:g4+md") == [("pdf", "g4"), ("md", None)]
    with pytest.raises(ValueError):
        P.parse_exports("pdf:no")
    assert P.parse_languages("fr+auto") == [] and P.parse_dpi("force:300") == (300.0, True) and P.parse_dpi("0") == (None, False)
    assert P.classify_inputs(["a.PDF", "b.pdf"]) == "pdfs" and P.normalize_engine(" mistral ") == "mistral:batch"
    with pytest.raises(ValueError):
        P.classify_inputs(["a.pdf", "b.png"])


def test_sources(spark, tmp_path):
    a = page()
    (tmp_path / "B.png").write_bytes(readers.png_bytes(a, 200))
    (tmp_path / "a.png").write_bytes(readers.png_bytes(K.to_bw(a)))
    (tmp_path / "c.png").write_bytes(b"broken")
    files = readers.image_files(spark, str(tmp_path))
    assert [(r["name"], round(r.dpi)) for r in files.orderBy("name").collect()] == [("a.png", 120), ("b.png", 200), ("c.png", 120)]
    assert {(r.height, r.width) for r in readers.pages_of(files).collect()} == {a.shape} and readers.pages_of(files).count() == 2
    assert (readers.png_pixels(readers.png_bytes(a)) == a).all()
    color = np.stack([a, a, 255 - a], axis=2)
    assert (readers.png_pixels(readers.png_bytes(color)) == color).all()
    folder = tmp_path / "bundle"
    (folder / "img").mkdir(parents=True)
    (folder / "img" / "p.png").write_bytes(readers.png_bytes(a))
    (folder / "manifest.json").write_text('{"format_version": 1, "project": "p", "dpi": 150}')
    (folder / "pages.jsonl").write_text('{"index": 0, "file": "img/p.png", "w": 300, "h": 188}\n\n')
    assert readers.read_bundle(spark, str(folder)).first()["dpi"] == 150
    (folder / "pages.jsonl").write_text('{"index": 0, "file": "img/q.png", "w": 1, "h": 1}\n')
    with pytest.raises(ValueError):
        readers.read_bundle(spark, str(folder))
    (tmp_path / "out.jsonl").write_text('{"custom_id": "j", "response": {"body": {"pages": [{"markdown": "# a", "header": "h"}, "plain"]}}}\n\n')
    got = readers.read_batch_output(spark, str(tmp_path / "out.jsonl")).orderBy("place").collect()
    assert [(r.markdown, r.header) for r in got] == [("# a", "h"), ("plain", None)]


def test_recognition(spark):
    a = page(5)
    pages = spark.createDataFrame([(1, "", a.tobytes(), *a.shape, 1, 150.0, "{}"), (2, "", b"xx", 5, 5, 1, 150.0, "{}")], K.PAGES)
    out = {r.page: r for r in O.recognize(pages, "rows", ["en"]).collect()}
    assert out[1].status == "done" and out[2].status == "error" and out[2].error
    lines = O.lines_of(O.recognize(pages, "rows", ["en"]))
    assert D.usable_lines(lines, "page", "lines").count() == 5
    rows = [(1, i, "some words here", float(10 * i), 0.9 if i else 0.2) for i in range(8)] + [(2, i, "some words", float(90 * i), 0.1) for i in range(2)]
    df = spark.createDataFrame(rows, "page int, pos int, line string, y0 double, confidence double").withColumns({"x0": F.lit(0.0), "x1": F.lit(9.0), "h": F.lit(8.0)})
    plan = O.complement_plan(df, "page", ["en"])
    assert {(r.page, r.again) for r in plan.collect()} == {(1, "block"), (1, "no"), (2, "page")}
    assert O.low_blocks(plan, "page").count() == 1
    raw = "<|ref|>Title<|/ref|><|det|>[[0, 0, 500, 500]]<|/det|>\nbody"
    clean, spans = O.grounded(F.lit(raw), F.lit(200), F.lit(100))
    row = spark.range(1).select(clean.alias("c"), spans.alias("s")).first()
    assert row.c == "Title\nbody" and row.s[0].text == "Title" and row.s[0].box == [0, 0, 100, 50]
    assert one(spark, O.loops(F.lit("\n".join(["1. same"] * 9)), F.lit(9))) is True
    refined = O.refine(spark.createDataFrame([(1, "x"), (2, None), (3, "y" * 20_000)], "k int, t string"), "k", "t", lambda t: t.upper())
    assert [r.t and r.t[0] for r in refined.orderBy("k").collect()] == ["X", None, "y"]


def test_assembly(spark):
    lines = [("d", 1, 0, "CHAPTER ONE", 90, 200, 5, 40), *[("d", 1, i, t, 10, 290, 35 + 25 * i, 20) for i, t in enumerate(["The first line of a para-", "graph goes on and on until", "it reaches the foot of"], 1)], *[("d", 2, i, t, 10, 290, 100 + 25 * i, 20) for i, t in enumerate(["the page and the next one.", "• an item", "• another item"])]]
    df = spark.createDataFrame(lines, "document string, page int, pos int, line string, x0 int, x1 int, y0 int, h int")
    text = D.assemble(df, "document").first()["markdown"]
    assert text == "# CHAPTER ONE\n\nThe first line of a paragraph goes on and on until it reaches the foot of the page and the next one.\n\n- an item\n- another item"


def test_job_ticks(spark):
    jobs = spark.createDataFrame([(1, "ocr_pending", 0, None), (2, "ocr_pending", 3, None), (3, "ocr_pending", 10, None), (4, "done", 1, None)], "id long, status string, attempt int, next_check_at timestamp")
    polled = spark.createDataFrame([(1, "done"), (2, "pending"), (3, "pending")], "id long, state string")
    got = {r.id: (r.status, r.attempt) for r in ST.job_step(jobs, polled, F.lit("2024-01-01 00:00:00").cast("timestamp")).collect()}
    assert got == {1: ("done", 0), 2: ("ocr_pending", 4), 3: ("failed", 10), 4: ("done", 1)}
