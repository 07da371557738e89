"""Token counts with a whole-token shortcut.

A pre-token that is itself a vocabulary string which encodes as one token counts one; that set is proved
beforehand by encoding every vocabulary string alone. Only the other pre-tokens are merged.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); special strings inside a text are one
token each, as the file's library treats them; texts of any length are counted whole in time
n log n; repeated rows give repeated results; an empty table gives an empty one.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import FAR, SPACE, Vocabulary
from .common import batch_of, map_texts, tokenizer_path

PRETOKEN_CACHE, UNIT_CACHE = 400_000, 400_000
#: Symbols from which on merging keeps a heap of pairs.
LONG = 48


class TokenCounter:
    PRETOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    #: White space with what follows it: no pre-token reaches over the end of such a unit.
    UNITS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")

    def __init__(self, path: str):
        self.vocabulary = v = Vocabulary(path)
        self.specials = re.compile("|".join(map(re.escape, v.special))) if v.special else None
        self.single = frozenset(piece for piece, i in v.pieces.items() if v.merged(piece) == [i])
        outer = self

        class Pretokens(dict):
            def __missing__(self, word):
                out = outer.tokens_of(word)
                if len(word) <= 64:
                    if len(self) >= PRETOKEN_CACHE:
                        self.clear()
                    self[word] = out
                return out

        class Units(dict):
            def __missing__(self, unit):
                out = sum([pretokens[w] for w in TokenCounter.PRETOKENS.findall(unit)])
                if len(unit) <= 64:
                    if len(self) >= UNIT_CACHE:
                        self.clear()
                    self[unit] = out
                return out

        pretokens = Pretokens()
        self.units = Units()

    def tokens_of(self, word: str) -> int:
        symbols = self.vocabulary.spelled(word)
        if symbols in self.single:
            return 1
        return self.merge_long(symbols) if len(symbols) >= LONG else len(self.vocabulary.merged(symbols))

    def merge_long(self, symbols: str) -> int:
        """The same merges, with the pairs in a heap by rank and place."""
        v = self.vocabulary
        ids: list[int] = [v.pieces[s] for s in symbols]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(v.rank[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in v.rank]
        heapq.heapify(heap)
        count = len(ids)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= len(ids) or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = v.joined[pair], -1
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            count -= 1
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(ids) and (rank := v.rank.get((ids[a], ids[b]), FAR)) < FAR:
                    heapq.heappush(heap, (rank, a, (ids[a], ids[b])))
        return count

    def count(self, text: str) -> int:
        total, units = 0, self.units.__getitem__
        if self.specials and "<|" in text:
            parts = self.specials.split(text)
            total += len(parts) - 1
        else:
            parts = (text,)
        return total + sum([sum(map(units, self.UNITS.findall(part))) for part in parts])


LOADED: dict[str, TokenCounter] = {}


def loaded(path: str) -> TokenCounter:
    if path not in LOADED:
        LOADED[path] = TokenCounter(path)
    return LOADED[path]


def count_tokens(
    df: DataFrame, path: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit), one per input row. One narrow stage: no shuffle."""
    path = path or tokenizer_path("byte_bpe_50k.json")
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(path)
        types = {"n_bytes": pa.int64(), "n_tokens": pa.int64(), "over_limit": pa.bool_()}
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = [counter.count(t) for t in texts]
            yield batch_of(
                {
                    "id": batch.column(0),
                    "n_bytes": [len(t.encode()) for t in texts],
                    "n_tokens": tokens,
                    "over_limit": [n > limit for n in tokens],
                },
                types,
            )

    return map_texts(
        df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")),
        run,
        f"id {id_type}, n_bytes long, n_tokens long, over_limit boolean",
    ).withColumnRenamed("id", id_col)
