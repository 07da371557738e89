"""Projective geometry, shared margins, curled sheets, Markdown of typed blocks and log lines, on the driver's tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import logs as L
from ..functions import markup as M
from ..functions import projective as P
from ..operators import margins as A
from ..operators import sheet as S
from ..runtime import ship_package
from ..sources import pdf as D
from .catalog import load
from .texts import LINES_SQL, lines

KINDS = ("raw", "heading", "list", "quote", "footnote", "para")


def pick(values, index):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (index % len(values) + 1).cast("int"))


def document_tree(s, d):
    kind = pick(("block", "list", "table"), F.floor(F.col("turn") / 2))
    block = F.struct("turn", kind.alias("type"), "text", F.array("text", "role").alias("items"), F.concat(F.lit("| "), "role", F.lit(" |")).alias("markdown"))
    x = load(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(block)).alias("b"))  # turns of one conversation
    return x.select("conv_id", M.document_markdown(F.col("b")).alias("markdown"))


def typed_blocks(s, d):
    x = lines(s, d).withColumn("kind", pick(KINDS, F.col("pos")))
    return x.select("doc_id", "pos", M.typed_block(F.col("kind"), F.col("line"), F.col("pos") % 4 + 1).alias("block"))


def origin_markers(s, d):
    return load(s, d, "events").select("event_id", M.origin_marker(F.col("user_id"), pick(("A", "", None, "A.B"), F.col("event_id"))).alias("marker"))


def engine_tags(s, d):
    e = F.col("event_id")
    tag = M.engine_tag(pick(("apple_docs", "apple_vision", "surya", "mistral"), e), pick((None, "", "surya"), e))
    return load(s, d, "events").select("event_id", tag.alias("tag"))


def notes_in_order(s, d):
    n, q = F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("long").cast("string")
    text = F.concat(F.lit("see ("), n, F.lit(") and $^{"), q, F.lit("}$, not 5.\n"), q, F.lit(". note\n "), n, F.lit(". note"))
    marks = F.array(*map(F.lit, ("1", "2", "3", "17", "40")))
    x = load(s, d, "lineitem").select("l_linenumber", "l_quantity", M.ordered_notes(text, marks).alias("a"))
    return x.groupBy("l_linenumber", "l_quantity").agg(F.count("*").alias("n"), F.array_join(F.first("a"), ",").alias("notes"))


def whole_pages(s, d):
    footer = F.concat(F.lit("[^1]: "), "source", F.lit("\n"), "lang")
    return load(s, d, "documents").select("doc_id", M.whole_page(F.col("text"), F.col("lang"), footer, wrap=True).alias("page"))


def step_log(s, d):
    size = lambda k, dpi: F.struct((F.col("p_size") * k).alias("w"), (F.col("p_size") * 2).alias("h"), dpi.alias("dpi"))
    first = F.when((F.col("p_partkey") % 7 > 0) & F.col("p_size").isNotNull(), size(1, F.col("p_size") * 10))
    last = F.when(F.col("p_partkey") % 3 > 0, size(F.when(F.col("p_partkey") % 3 == 1, 1).otherwise(3), F.col("p_size") * 10))
    x = load(s, d, "part").select("p_partkey", "p_brand", "p_size", first.alias("first"), last.alias("last"))  # computed once, used many times
    chain = L.size_chain(F.col("first"), F.lit(None).cast("struct<w:bigint,h:bigint,dpi:bigint>"), F.col("last"))
    line = L.op_line(F.concat(F.lit("step."), "p_brand"), {"scan": F.col("p_partkey"), "layout": F.lit(None)}, chain, F.col("p_partkey") * 10, {"size": F.col("p_size")})
    return x.select("p_partkey", line.alias("line"))


def layer_strings(s, d):
    return load(s, d, "part").select("p_partkey", F.hex(L.layer_bytes(F.concat("p_name", F.lit("é(€☃)\\")))).alias("bytes"))


def box_baselines(s, d):
    x = load(s, d, "part").select("p_partkey", P.box_baseline(F.col("p_partkey") % 100, F.col("p_partkey") % 77, F.col("p_size"), F.lit(9)).alias("b"))
    return x.select("p_partkey", P.homogeneous(F.col("b")[0], F.col("b")[1]).alias("l"), P.homogeneous(F.col("b")[2], F.col("b")[3]).alias("r")).select(
        "p_partkey", *(F.col(c)[i].cast("long").alias(f"{c}{i}") for c in "lr" for i in range(3))
    )


def crossings(s, d):
    k = F.col("p_partkey")
    p, u, q, v = (F.array(a.cast("double"), b.cast("double")) for a, b in ((k % 10, k % 7), (k % 3 + 1, k % 5), (k % 11, k % 13), (k % 4 + 1, F.col("p_size") % 6)))
    x = load(s, d, "part").select("p_partkey", P.crossing(p, u, q, v).alias("c"))
    return x.select("p_partkey", F.round(F.col("c")[0], 6).alias("x"), F.round(F.col("c")[1], 6).alias("y"))


def rectifications(s, d):
    k = F.col("p_partkey")
    point = F.array((k % 500).cast("double"), (k % 301 + 1).cast("double"), F.when(k % 5 > 0, k % 5 / 10.0).otherwise(0.0))
    x = load(s, d, "part").select("p_partkey", P.rectification(P.vanishing_line(point)).alias("h"))
    return x.select("p_partkey", *(F.round(F.col("h")[i], 9).alias(f"h{i}") for i in (0, 4, 6, 7, 8)))


def aspects(s, d):
    k = F.col("p_partkey")
    xs = [k % 30, 400 + k % 50, 420 + k % 90, -(k % 40)]
    ys = [k % 20, k % 25 - 10, 300 + k % 60, 320 + k % 35]
    a = P.aspect_and_focal(F.array(*(c.cast("double") for c in xs)), F.array(*(c.cast("double") for c in ys)), F.lit(400.0), F.lit(300.0))
    x = load(s, d, "part").select("p_partkey", a.alias("a"))
    return x.select("p_partkey", F.round("a.aspect", 4).alias("aspect"), F.round("a.focal", 2).alias("focal"))


def boxes(s, d):
    x = load(s, d, "lineitem")
    return x.select("l_suppkey", "l_orderkey", "l_linenumber", F.floor("l_extendedprice").alias("left"), (F.floor("l_extendedprice") + F.col("l_partkey") % 97).alias("right"))


def justified_lines(s, d):
    x = A.justified(boxes(s, d), ["l_suppkey"], "left", "right", 150, 3)
    return x.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if("justified").alias("justified"))


def left_margin_runs(s, d):
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "left", "right"))
    return A.left_runs(boxes(s, d).select("l_orderkey", place.cast("long").alias("place"), "left"), ["l_orderkey"], "place", "left", 5000.0)


def margin_anchors(s, d):
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "left", "right")).alias("place")
    x = boxes(s, d).select("l_orderkey", place, "left", (F.col("right") + 40_000).alias("right"))
    return A.anchors(x, ["l_orderkey"], "place", "left", "right", 0.3).select("l_orderkey", "place", "at_left", "at_right", "full")


def outer_edges(s, d):
    x = load(s, d, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"))
    edge = lambda sign: F.round(P.outer_edge(F.col("x"), F.col("y"), F.lit(0.5), sign), 4)
    return x.groupBy("l_suppkey").agg(edge(1).alias("right"), edge(-1).alias("left"))


def assembled_answers(s, d):
    c = load(s, d, "conversations").select("conv_id", "turn", "role", "text").dropDuplicates(["conv_id", "turn"])
    dims = c.select("conv_id", "turn", (F.col("turn") * 100).alias("w"), F.lit(50).alias("h"))
    return A.assembled(dims, c.where("turn <> 1").select("conv_id", "turn", F.col("role").alias("said")), "conv_id", "turn", F.lit(3), "w", "h", "said")


PAGES_A_TASK = 2048
CURVE = S.Sheet(S.SINES, (0.2, -0.1, 0.05), twist=0.5, width=100.0, height=50.0)


def sheet_heights(s, d):
    """Heights and slopes of one curled page at the points of the table."""
    ship_package(s)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x, y = f["x"].to_numpy(float), f["y"].to_numpy(float)
            yield pd.DataFrame({"p_partkey": f["p_partkey"], "z": CURVE.z(x, y).round(6) + 0.0, "slope": CURVE.slope(x).round(6) + 0.0})

    x = load(s, d, "part").select("p_partkey", F.expr("p_partkey % 97").alias("x"), F.col("p_size").alias("y"))
    return x.mapInPandas(run, "p_partkey long, z double, slope double")


def sheet_fits(s, d):
    """A curled page a supplier: its points are projected, its parameters disturbed, and the fit must find the points."""
    ship_package(s)
    sheet = S.Sheet(S.SPLINE, (0.0,) * 4)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        span = np.repeat(np.arange(5), 6)
        fixed = [0.05, -0.03, 0.02, -0.5, -0.4, 1.4, 0, 0, *np.linspace(0.1, 0.9, 5), *np.tile(np.linspace(0.05, 0.95, 6), 5)]
        for f in frames:
            for first in range(0, len(f), S.TOGETHER):
                few = f.iloc[first : first + S.TOGETHER]
                random = [np.random.default_rng(int(seed) % 2**64) for seed in few["seed"]]
                true = np.array([[*fixed, *r.normal(size=4) * 0.05, 0.3] for r in random])
                seen = S.Pages(np.tile(span, (len(true), 1)), sheet).project(true).reshape(len(true), -1)
                params = true + [r.normal(size=true.shape[1]) * 0.01 for r in random]
                yield pd.DataFrame({"key": few["key"], "targets": list(seen), "span": [span] * len(true), "params": list(params)})

    suppliers = load(s, d, "supplier").select(F.col("s_suppkey").alias("key"), F.coalesce("s_suppkey", F.lit(0)).alias("seed"))
    tasks = max(s.sparkContext.defaultParallelism, suppliers.count() // PAGES_A_TASK)  # a small file is one task, a page is milliseconds
    problems = suppliers.repartition(tasks).mapInPandas(run, "key long, targets array<double>, span array<int>, params array<double>")
    return S.fit_sheets(problems, sheet).select("key", (F.col("cost") < 1e-8).alias("found"))


def pdf_round_trip(s, d):
    """Every supplier as a file of one page a line; pages and dark pixels are read back."""
    place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_extendedprice")).alias("page")
    dark = F.repeat(F.lit("\0"), F.floor("l_quantity").cast("int"))
    x = load(s, d, "lineitem").select(F.col("l_suppkey").alias("document"), place, F.rpad(dark, 64, "~").cast("binary").alias("pixels"))
    pages = x.select("*", F.lit(4).alias("height"), F.lit(16).alias("width"), F.lit(1).alias("channels"), F.lit(144.0).alias("dpi"))
    texts = x.select("document", "page", F.lit(2.0).alias("size"), F.lit(1.0).alias("x"), F.lit(0.5).alias("y"), L.layer_bytes(F.concat(F.lit("endobj ("), F.col("page").cast("string"))).alias("layer"))
    found = D.pdf_images(D.document_pdfs(pages, texts))
    n_dark = F.length(F.regexp_replace(F.decode("pixels", "US-ASCII"), "~", ""))
    return found.groupBy("document").agg(F.count("*").alias("pages"), F.sum(n_dark).alias("dark"), F.max("page").alias("last"), F.round(F.max("dpi")).alias("dpi"))


QUERIES = {
    f.__name__: f
    for f in (
        document_tree, typed_blocks, origin_markers, engine_tags, notes_in_order, whole_pages, step_log, layer_strings, box_baselines,
        crossings, rectifications, aspects, justified_lines, left_margin_runs, margin_anchors, outer_edges, assembled_answers, sheet_heights, sheet_fits,
        pdf_round_trip,
    )
}

BLANKS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
BOLD = "length(b) <= 60 and not regexp_matches(b, '\\p{Ll}') and len(regexp_extract_all(b, '\\S+')) >= 2 and len(regexp_extract_all(b, '\\p{Lu}')) >= 2"
HEADING = "length(b) <= 60 and len(regexp_extract_all(b, '\\S+')) <= 8 and not regexp_matches(b, '[.!?…:;,]$') and len(regexp_extract_all(b, '\\p{L}')) > 0 and 10 * len(regexp_extract_all(b, '\\p{Lu}')) > 7 * len(regexp_extract_all(b, '\\p{L}'))"
BOXES = "(select l_suppkey, floor(l_extendedprice)::bigint as l, floor(l_extendedprice)::bigint + l_partkey % 97 as r from lineitem)"


def supported(value: str) -> str:
    """Values that lie in runs of three and more."""
    return f"(select distinct l_suppkey, {value} from (select *, count(*) over (partition by l_suppkey, run) as size from (select *, sum(starts) over (partition by l_suppkey order by {value} range unbounded preceding) as run from (select l_suppkey, {value}, case when {value} - lag({value}) over (partition by l_suppkey order by {value}) <= 150 then 0 else 1 end as starts from {BOXES}))) where size >= 3)"


ORACLE_SQL = {
    "document_tree": f"""with t as (select *, ['block', 'list', 'table'][(turn // 2) % 3 + 1] as type, trim(coalesce(text, ''), {BLANKS}) as b from conversations),
      m as (select conv_id, turn, type = 'list' as is_list, role, text, case type when 'table' then '| ' || role || ' |' when 'list' then case when b <> '' then '- ' || b || chr(10) else '' end || '- ' || role else case when {HEADING} then '## ' || b else b end end as body from t),
      k as (select *, coalesce(lag(is_list) over (partition by conv_id order by turn, text), false) as was from m where body <> '')
      select conv_id, coalesce(rtrim(string_agg(case when is_list <> was then chr(10) else '' end || body || case when is_list then '' else chr(10) end, chr(10) order by turn, text), chr(10)), '') as markdown from (select distinct conv_id from conversations) left join k using (conv_id) group by 1""",
    "typed_blocks": f"select doc_id, pos, case pos % 6 when 0 then line when 1 then repeat('#', (pos % 4 + 1)::int) || ' ' || line when 2 then '- ' || line when 3 then '> ' || line when 4 then '> ' || line else case when {BOLD} then '**' || line || '**' else line end end as block from (select *, trim(line, ' ') as b from {LINES_SQL})",
    "origin_markers": "select event_id, case event_id % 4 when 0 then '<!-- branch ' || user_id || '.A -->' when 3 then '<!-- branch ' || user_id || '.A.B -->' else '<!-- scan #' || user_id || ' -->' end as marker from events",
    "engine_tags": "select event_id, case event_id % 4 when 0 then case when event_id % 3 = 2 then '_apple_docs_suryaOCR' else '_apple_docsOCR' end when 1 then '_appleOCR' when 2 then '_suryaOCR' else '_mistralOCR' end as tag from events",
    "notes_in_order": "select l_linenumber, l_quantity, count(*) as n, concat_ws(',', case when l_linenumber in (1, 2, 3, 17, 40) then l_linenumber end, case when l_quantity in (1, 2, 3, 17, 40) and l_quantity <> l_linenumber then l_quantity::bigint end) as notes from lineitem group by all",
    "whole_pages": "select doc_id, concat_ws(chr(10) || chr(10), case when trim(lang) <> '' then '<header class=\"page-header\">' || chr(10) || chr(10) || lang || chr(10) || chr(10) || '</header>' end, text, case when source is not null and lang is not null then '[^1]: ' || source end, case when source is not null and trim(lang) <> '' then '<footer class=\"page-footer\">' || chr(10) || chr(10) || lang || chr(10) || chr(10) || '</footer>' end) as page from documents",
    "step_log": """select p_partkey, concat_ws('  ', rpad('[step.' || p_brand || ']', greatest(24, length(p_brand) + 7)::int, ' '), 'scan=' || p_partkey,
      case when p_partkey % 7 > 0 then case when p_partkey % 3 < 2 then '(' || a || ')' else '(' || a || '—' || a || '->' || 3 * p_size || '×' || 2 * p_size || '@' || 10 * p_size || ')' end end,
      case when 10 * p_partkey < 1000 then 10 * p_partkey || 'ms' when 10 * p_partkey < 60000 then printf('%.2fs', p_partkey / 100) else printf('%.1fm', p_partkey / 6000) end, 'size=' || p_size) as line
      from (select *, p_size || '×' || 2 * p_size || '@' || 10 * p_size as a from part)""",
    "layer_strings": "select p_partkey, hex(regexp_replace(p_name, '([\\\\()])', '\\\\\\1', 'g')) || 'E95C28805C295C5C' as bytes from part",
    "box_baselines": "select p_partkey, p_partkey % 100 as l0, p_partkey % 77 + 8 as l1, 1::bigint as l2, p_partkey % 100 + p_size - 1 as r0, p_partkey % 77 + 8 as r1, 1::bigint as r2 from part",
    "crossings": "select p_partkey, round(px + t * ux, 6) as x, round(py + t * uy, 6) as y from (select *, case when ux * vy <> uy * vx then ((qx - px) * vy - (qy - py) * vx) / (ux * vy - uy * vx)::double end as t from (select p_partkey, p_partkey % 10 as px, p_partkey % 7 as py, p_partkey % 3 + 1 as ux, p_partkey % 5 as uy, p_partkey % 11 as qx, p_partkey % 13 as qy, p_partkey % 4 + 1 as vx, p_size % 6 as vy from part))",
    "rectifications": "select p_partkey, 1.0::double as h0, 1.0::double as h4, 0.0::double as h6, case when p_partkey % 5 = 0 then 0.0 else round(-(p_partkey % 5) / (10.0 * (p_partkey % 301 + 1)), 9) end::double as h7, 1.0::double as h8 from part",
    "aspects": """with q as (select p_partkey, p_partkey % 30 - 200 as x0, p_partkey % 20 - 150 as y0, 200 + p_partkey % 50 as x1, p_partkey % 25 - 160 as y1, 220 + p_partkey % 90 as x2, 150 + p_partkey % 60 as y2, -(p_partkey % 40) - 200 as x3, 170 + p_partkey % 35 as y3 from part),
      g as (select *, ((x0 - x1 + x2 - x3) * (y3 - y2) - (x3 - x2) * (y0 - y1 + y2 - y3))::double / ((x1 - x2) * (y3 - y2) - (x3 - x2) * (y1 - y2)) as g, ((x1 - x2) * (y0 - y1 + y2 - y3) - (x0 - x1 + x2 - x3) * (y1 - y2))::double / ((x1 - x2) * (y3 - y2) - (x3 - x2) * (y1 - y2)) as h from q),
      v as (select p_partkey, g, h, x1 - x0 + g * x1 as ux, y1 - y0 + g * y1 as uy, x3 - x0 + h * x3 as vx, y3 - y0 + h * y3 as vy from g),
      f as (select *, case when abs(g * h) >= 1e-9 and -(ux * vx + uy * vy) / (g * h) > 0 then -(ux * vx + uy * vy) / (g * h) end as f2 from v)
      select p_partkey, round(sqrt(((ux * ux + uy * uy) / f2 + g * g) / ((vx * vx + vy * vy) / f2 + h * h)), 4) as aspect, round(sqrt(f2), 2) as focal from f""",
    "justified_lines": f"select l_suppkey, count(*) as n, count(*) filter (where a.l is not null and c.r is not null) as justified from {BOXES} b left join {supported('l')} a using (l_suppkey, l) left join {supported('r')} c using (l_suppkey, r) group by 1",
    "margin_anchors": """with b as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l, r) as place, count(*) over (partition by l_orderkey) as n from (select l_orderkey, l_linenumber, floor(l_extendedprice)::bigint as l, floor(l_extendedprice)::bigint + l_partkey % 97 as r from lineitem)),
      w as (select *, row_number() over (partition by l_orderkey order by r - l desc, place) as k from b), m as (select l_orderkey, median(l) as ml, median(r) as mr, median(r - l + 40000) as mw from w where k <= greatest(3, floor(n * 0.4)) group by 1)
      select l_orderkey, place::int as place, n < 3 or abs(l - ml) <= 0.3 * mw as at_left, n < 3 or abs(r - mr) <= 0.3 * mw as at_right, n < 3 or (abs(l - ml) <= 0.3 * mw and abs(r - mr) <= 0.3 * mw) as full from b join m using (l_orderkey)""",
    "outer_edges": "select l_suppkey, round(quantile_cont(l_extendedprice - 0.5 * l_quantity, 0.98) + 2, 4) as right, round(quantile_cont(l_extendedprice - 0.5 * l_quantity, 0.02) - 2, 4) as left from lineitem group by 1",
    "assembled_answers": "select conv_id, turn, any_value(turn * 100) as w, 50 as h, case when turn < 3 then case when turn = 1 then '' else any_value(role) end end as said, turn >= 3 as truncated from conversations group by conv_id, turn",
    "sheet_heights": """select p_partkey, round((1 + 0.5 * (p_size / 50.0 - 0.5)) * (0.2 * sin(t) - 0.1 * sin(2 * t) + 0.05 * sin(3 * t)), 6) + 0.0 as z,
      round((0.2 * cos(t) - 0.2 * cos(2 * t) + 0.15 * cos(3 * t)) * pi() / 100, 6) + 0.0 as slope from (select *, (p_partkey % 97) * pi() / 100 as t from part)""",
    "pdf_round_trip": "select l_suppkey as document, count(*) as pages, sum(floor(l_quantity))::bigint as dark, count(*) - 1 as last, 144.0::double as dpi from lineitem group by 1",
    "sheet_fits": "select s_suppkey as key, true as found from supplier",
}
