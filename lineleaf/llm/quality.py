"""Quality rules with cross-document line frequency.

Base rules look at a document alone. The method then normalises every line (A-Z lowered, digits to 0, white
space joined), counts for each host the distinct documents that hold it, and removes lines that more than
``most_documents`` of them hold, except in the document of the smallest id (so that a text which many
documents share stays once). A document that loses more than ``most_lost`` of its words is rejected.

Defined cases: a null text has no words and fails the base rule; a null host is a host of its own; rows
with a null id are judged but not counted as documents; repeated rows give repeated results and count
once; an empty table gives an empty one; texts are read whole; further columns are carried through by
``clean_documents`` and ignored by ``judge_documents``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, map_texts, window_hashes, word_hashes

MOST_DOCUMENTS = 50
MOST_LOST = 0.8
LEAST_WORDS = 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)} | {d: "0" for d in "0123456789"})
RUNS = re.compile(f"[{SPACES}]+")


def normal_line(line: str) -> str:
    return RUNS.sub(" ", line.translate(LOWER)).strip(" ")


def line_hash(normal: str) -> int:
    return xxhash.xxh64_intdigest(normal.encode()) - (1 << 63)


def measures(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeated = 0
    if len(words) >= 4:
        windows = window_hashes(word_hashes(words), 3)
        order = np.argsort(windows)
        equal = windows[order[1:]] == windows[order[:-1]]
        if equal.any():
            twice = np.zeros(len(words), bool)
            for at in (order[1:][equal], order[:-1][equal]):
                for i in range(3):
                    twice[at + i] = True
            repeated = int(twice.sum())
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
    )


def base_failed(n_words: int, n_repeat_words: int, least_words: int = LEAST_WORDS) -> bool:
    return n_words < least_words or 100 * n_repeat_words > 50 * n_words


def key_columns(id_col: str, text_col: str, host_col: str) -> list:
    """What a verdict depends on: equal rows share it, so it can join results to rows."""
    return [
        F.col(id_col).alias("id"),
        F.coalesce(F.col(host_col), F.lit("\0")).alias("host"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"),
    ]


def removed_lines(
    df: DataFrame, id_col: str, text_col: str, host_col: str, most_documents: int, id_type: str
) -> DataFrame:
    """Rows (id, host, mark, lost words, hashes of removed lines) of the documents that lose lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hashes, words = [], [], []
            for i, text in enumerate(batch.column(3).to_pylist()):
                own: dict[int, int] = {}
                for line in (text or "").split("\n"):
                    if normal := normal_line(line):
                        h = line_hash(normal)
                        own[h] = own.get(h, 0) + normal.count(" ") + 1
                rows += [i] * len(own)
                hashes += own.keys()
                words += own.values()
            at = pa.array(rows, pa.int64())
            yield batch_of(
                {k: batch.column(j).take(at) for j, k in enumerate(("id", "host", "mark"))} | {"h": hashes, "w": words},
                {"h": pa.int64(), "w": pa.int64()},
            )

    lines = map_texts(
        df.select(*key_columns(id_col, text_col, host_col), F.col(text_col).alias("text")),
        run,
        f"id {id_type}, host string, mark long, h long, w long",
    )
    frequent = (
        lines.groupBy("host", "h")
        .agg(F.count_distinct("id").alias("n"), F.min("id").alias("first"))
        .where(F.col("n") > most_documents)
        .select("host", "h", "first")
    )
    return (
        lines.join(frequent, ["host", "h"])
        .where(~F.col("id").eqNullSafe(F.col("first")))
        .groupBy("id", "host", "mark", "h")
        .agg(F.max("w").alias("w"))
        .groupBy("id", "host", "mark")
        .agg(F.sum("w").alias("n_lost_words"), F.collect_list("h").alias("lost_lines"))
    )


def judge_documents(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    most_documents: int = MOST_DOCUMENTS,
    most_lost: float = MOST_LOST,
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """One row per input row: the base measures, base_failed, n_lost_words, kept."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        for batch in batches:
            found = [measures(t or "") for t in batch.column(3).to_pylist()]
            yield batch_of(
                {k: batch.column(j) for j, k in enumerate(("id", "host", "mark"))}
                | dict(zip(names, map(list, zip(*found))))
                | {"base_failed": [base_failed(x[0], x[4], least_words) for x in found]},
                dict.fromkeys(names, pa.int64()) | {"base_failed": pa.bool_()},
            )

    measured = map_texts(
        df.select(*key_columns(id_col, text_col, host_col), F.col(text_col).alias("text")),
        run,
        f"id {id_type}, host string, mark long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, base_failed boolean",
    ).alias("m")
    lost = removed_lines(df, id_col, text_col, host_col, most_documents, id_type).alias("r")
    same = F.expr("m.id <=> r.id and m.host = r.host and m.mark = r.mark")
    words = F.coalesce("r.n_lost_words", F.lit(0).cast("long"))
    return measured.join(lost, same, "left").select(
        F.col("m.id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        words.alias("n_lost_words"),
        (~F.col("base_failed") & (words <= F.lit(most_lost) * F.col("n_words"))).alias("kept"),
    )


def clean_documents(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    chars_col: str | None = "n_chars",
    most_documents: int = MOST_DOCUMENTS,
    most_lost: float = MOST_LOST,
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """The kept rows with all their columns, their texts without the removed lines."""
    id_type = df.schema[id_col].dataType.simpleString()
    names = df.columns
    lost = removed_lines(df, id_col, text_col, host_col, most_documents, id_type).select(
        F.col("id").alias("_id"), F.col("host").alias("_host"), F.col("mark").alias("_mark"), "n_lost_words", "lost_lines"
    )
    keyed = df.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        *key_columns(id_col, text_col, host_col),
    )
    same = F.expr("id <=> _id and host = _host and mark = _mark")
    joined = keyed.join(lost, same, "left").select(
        "row", F.coalesce("n_lost_words", F.lit(0).cast("long")).alias("n_lost_words"), F.coalesce("lost_lines", F.array().cast("array<bigint>")).alias("lost_lines")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            texts = row.field(names.index(text_col)).to_pylist()
            keep, new = [], []
            for i, (text, words, lines) in enumerate(zip(texts, batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                n_words, _, _, _, repeated = measures(text or "")
                if base_failed(n_words, repeated, least_words) or words > most_lost * n_words:
                    continue
                if lines:
                    gone = set(lines)
                    text = "\n".join(
                        x for x in text.split("\n") if not (n := normal_line(x)) or line_hash(n) not in gone
                    )
                keep.append(i)
                new.append(text)
            at = pa.array(keep, pa.int64())
            fields = {c: row.field(j).take(at) for j, c in enumerate(names)} | {text_col: pa.array(new, pa.string())}
            if chars_col in fields:
                fields[chars_col] = pa.array([len(t) for t in new], fields[chars_col].type)
            yield pa.RecordBatch.from_arrays(list(fields.values()), names=list(fields))

    return map_texts(joined, run, df.schema)
