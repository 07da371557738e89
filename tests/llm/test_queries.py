"""The registered queries against their SQL on the smallest tables, and the pipeline's stages."""

import glob
import os

import duckdb
import pytest

from lineleaf.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    df = queries.QUERIES[name](spark, DATA)
    want = con.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = ", ".join(f'"{c}"' for c in sorted(df.columns))
    expected = sorted(map(str, con.sql(f"select {cols} from ({queries.ORACLE_SQL[name]})").fetchall()))
    assert sorted(str(tuple(r)) for r in df.select(*sorted(df.columns)).collect()) == expected


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_has_a_row_for_each_input_row(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    read = {"op1_chat_format": "conversations", "op6_embedding_dedup": "embeddings"}.get(name, "documents")
    rows = spark.read.parquet(f"{DATA}/{read}.parquet")
    if name == "op1_chat_format":
        assert df.count() == rows.select("conv_id").distinct().count() + 1
    elif name != "op4_mixing":
        assert df.count() == rows.count()


def test_pipeline_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from tokenizers import Tokenizer

    from lineleaf.llm import common, ngram_join, pii, quality

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, before, DATA).write.parquet(path)
        seen[name] = (before, spark.read.parquet(path))
        before = seen[name][1]
        if name != "bpe":
            assert before.columns == columns
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    given, out = seen["quality_rules"]
    assert ids(out) == ids(quality.judge_documents(given).where("kept"))
    given, out = seen["ngram_join"]
    low = lambda t: (t or "").encode().lower().decode().split()
    sets = {r.doc_id: {tuple(w[i : i + 5]) for w in [low(r.text)] for i in range(max(1, len(w) - 4))} for r in given.collect()}
    kept = set(ids(out))
    alike = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and alike(sets[a], sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    assert kept == {find(i) for i in sets}
    given, out = seen["pii"]
    model, texts = pii.model(), {r.doc_id: r.text for r in out.collect()}
    assert texts == {r.doc_id: pii.redacted(r.text, model.spans(r.text)[1]) for r in given.collect()}
    given, out = seen["mixing"]
    assert set(ids(out)) <= set(ids(given)) and len(ids(out)) == len(set(ids(out)))
    assert len(ids(out)) >= 0.85 * len(ids(given))
    given, out = seen["bpe"]
    library = Tokenizer.from_file(common.tokenizer_path("word_bpe_49k.json"))
    library.no_padding()
    library.no_truncation()
    assert {r.doc_id: list(r.ids) for r in out.collect()} == {r.doc_id: library.encode(r.text, add_special_tokens=False).ids for r in given.collect()}
    assert ngram_join.BLOCK > 0
