"""Registered queries against brute force on small tables made so that a query that leaves rows out is seen."""

import json
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from lineleaf import catalogue
from lineleaf.operators import document as D
from lineleaf.queries import pages


def table(tmp_path, name, columns, rows):
    pd.DataFrame(rows, columns=columns).to_parquet(tmp_path / f"{name}.parquet")
    return str(tmp_path)


def glued(lines):
    """The lines of a text as one, a pair at a time."""
    text = ""
    for line in lines:
        left, right = text.rstrip(" "), line.lstrip(" ")
        if text == "":
            text = line
        elif re.search(r"[^\W\d_][-¬]\s*$", left) and right[:1].islower():
            text = re.sub("[-¬]$", "", left) + right
        else:
            text = " ".join(x for x in (left, right) if x)
    return text


def test_joined_lines_take_the_whole_text(spark, tmp_path):
    long = [f"line {i} of exam-" if i % 3 == 0 else f"ples and {i} " for i in range(40)]
    texts = {1: long, 2: ["one", "two-", "fold"], 3: ["", "a", "", "b¬", "c", "d", "", "e-", "f"], 4: [""], 5_000_000: long[::-1]}
    d = table(tmp_path, "documents", ["doc_id", "source", "text"], [*((k, "web", "\n".join(v)) for k, v in texts.items()), (6, "web", None)])
    got = {r.doc_id: r.joined for r in catalogue.QUERIES["joined_lines"](spark, d).collect()}
    assert got == {k: glued(v) for k, v in texts.items()}
    assert "line 39 of exam-" in got[1]


PAGED = {1: ["x" * (i % 230) for i in range(130)], 2: ["x" * 450, "", "x" * 200, "x" * 201], 3: [""], 4: ["x" * 12_345] + ["x"] * 3, 5_000_000: ["short"] * 61}


@pytest.fixture
def paged(tmp_path):
    return table(tmp_path, "documents", ["doc_id", "source", "text"], [(k, "web", "\n".join(v)) for k, v in PAGED.items()])


def rows_of(lines):
    """Rows a text takes on pages: a line has one for every 200 characters begun."""
    return [min(200, len(x) - k) for x in lines for k in range(0, max(1, len(x)), 200)]


def test_every_line_is_drawn(spark, paged):
    ink, numbers = {}, {}
    for r in pages.drawn(spark, paged).collect():
        a = np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width)
        ink[r.page] = ink.get(r.page, 0) + int((a == 40).sum()) // 6
        numbers.setdefault(r.page, []).append(json.loads(r.meta)["number"])
        assert r.height <= 624
    assert ink == {k: sum(map(len, v)) for k, v in PAGED.items()}
    assert {k: sorted(v) for k, v in numbers.items()} == {k: list(range(1, -(-len(rows_of(v)) // 60) + 1)) for k, v in PAGED.items()}


def test_page_queries_take_every_document(spark, paged):
    got = {r.page: r.n_lines for r in catalogue.QUERIES["recognized_lines"](spark, paged).collect()}
    assert got == {k: sum(x != "" for x in v) for k, v in PAGED.items()}
    out = catalogue.QUERIES["page_pipeline"](spark, paged).collect()
    assert {(r.page, r.number) for r in out} == {(k, n + 1) for k, v in PAGED.items() for n in range(-(-len(rows_of(v)) // 60))}
    glyphs = {r.page: r.n for r in catalogue.QUERIES["glyph_scales"](spark, paged).collect()}
    sized = {k: sum(5 <= n - 1 <= 80 for n in rows_of(v)) for k, v in PAGED.items()}
    assert {k: n for k, n in glyphs.items() if n} == {k: n for k, n in sized.items() if n}


def test_pair_score_takes_every_pair(spark, tmp_path):
    orders = {1: range(1, 8), 2: (3, 5, 6), 3: (2,), 4: (1, 2)}
    rows = [(k, n, 1000.0 + 37 * k * n + 0.5, float(n + k), 11 * n + k) for k, v in orders.items() for n in v]
    d = table(tmp_path, "lineitem", ["l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_partkey"], rows)
    boxes = {(k, n): (int(p) % 800, int(p) % 800 + int(q) + 1, i % 50, i % 50 + 20) for k, n, p, q, i in rows}

    def score(a, c):
        def fit(a0, a1, c0, c1, length, p0, p1, q0, q1):
            overlap = max(0, min(p1, q1) - max(p0, q0)) / (max(p1, q1) - min(p0, q0))
            near = max(0.0, 1 - max(0, max(a0, c0) - min(a1, c1)) / length / 0.15)
            return overlap * (0.4 * near + 0.6 * (1 - min(a1 - a0, c1 - c0) / max(a1 - a0, c1 - c0)))

        beside = fit(*a[:2], *c[:2], 1000, *a[2:], *c[2:])
        stacked = fit(*a[2:], *c[2:], 100, *a[:2], *c[:2])
        return math.floor(max(beside, stacked) * 10_000 + 1e-6)

    want = {(k, a, c): score(boxes[k, a], boxes[k, c]) for k, v in orders.items() for a in v for c in v if a < c}
    got = catalogue.QUERIES["pair_score"](spark, d).collect()
    assert len(got) == len(want) == 25 and {tuple(r)[:3]: r.score for r in got} == want


def test_case_insensitive_order_has_every_row(spark, tmp_path):
    rows = [(i, ("Supplier {}" if i % 2 else "SUPPLIER {}").format(i * 7 % 31)) for i in range(90)]
    d = table(tmp_path, "supplier", ["s_suppkey", "s_name"], rows)
    got = [tuple(r) for r in catalogue.QUERIES["case_insensitive_order"](spark, d).collect()]
    assert got == [(i, n.lower()) for i, n in sorted(rows, key=lambda r: (r[1].lower(), r[0]))]


def test_boxed_queries_take_every_id(spark, tmp_path):
    say = ["CHAPTER ONE", "The first line of a para-", "graph goes on until it", "reaches its end here.", "• an item", "Яблоко и груша на столе", "x" * 34 + " y"]
    ids = [7, 999_999, 1_000_000, 3_000_000_000, None]
    docs = [(i, f"s{k % 2}", "\n".join([*say, f"Words of its own {k}"][k:])) for k, i in enumerate(ids)]
    pd.DataFrame(docs, columns=["doc_id", "source", "text"]).astype({"doc_id": "Int64"}).to_parquet(tmp_path / "documents.parquet")
    boxes = [
        (i, source, p, t, p * 40 + p // 7 * 25, 20 + len(t) % 9, p % 5 * 10, p % 5 * 10 + 8 * min(len(t), 90))
        for i, source, text in docs for p, t in enumerate(text.split("\n")) if t.strip()
    ]
    want = D.assemble(spark.createDataFrame(boxes, "page long, source string, pos int, line string, y0 long, h int, x0 int, x1 int"), "source")
    got = {r.source: r.markdown for r in catalogue.QUERIES["assembled_markdown"](spark, str(tmp_path)).collect()}
    assert got == {r.source: r.markdown for r in want.collect()}
    assert all(f"Words of its own {k}" in got[f"s{k % 2}"] for k in range(len(ids)))
    plan = Counter()
    for i in ids:
        own = [b[3] for b in boxes if b[0] == i]
        low = [" " in t and (len(t) % 50 / 50 < 0.7 or len(re.findall("[а-яА-Я]", t)) >= 2) for t in own]
        plan.update((i, "page" if sum(low) / len(low) > 0.3 else "block" if x else "no") for x in low)
    assert {(r.page, r.again): r.n for r in catalogue.QUERIES["complement_plan"](spark, str(tmp_path)).collect()} == plan
