"""Byte-pair encoding by per-prefix dynamic programming, and decoding.

For every prefix of a pre-token there is exactly one token that ends its encoding. An automaton over
the vocabulary lists the tokens that end at each position; the one that may follow the last token of
the prefix before it (the pair test below) is stored as back-pointer, and the back-pointers from the
end give the ids.

Defined cases: a null text counts as empty and gives no tokens; texts of any length are encoded whole
(time linear in the length); repeated rows give repeated results; an empty table gives an empty one.
Columns of the input other than the two named ones are carried along only where asked for.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, map_texts, tokenizer_path

FAR = 1 << 40
#: Entries that a worker keeps of words and of white-space delimited chunks.
WORD_CACHE, CHUNK_CACHE, PAIR_CACHE = 400_000, 400_000, 200_000
#: White space of Unicode; Python's own \s has four control characters more.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


class Vocabulary:
    """A vocabulary file: tokens as symbol strings, and the merges that build them.

    Where the model marks word ends, the last character together with the mark is one symbol.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.mark = model.get("end_of_word_suffix") or ""
        self.names = {i: t for t, i in model["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names.update({i: t for t, i in self.special.items()})
        self.pieces = {self.symbols(t): i for t, i in model["vocab"].items() if t not in self.special}
        self.rank: dict[tuple[int, int], int] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = (self.symbols(x) for x in (merge if isinstance(merge, list) else merge.split(" ")))
            pair, whole = (self.pieces[left], self.pieces[right]), self.pieces[left + right]
            if pair not in self.rank:
                self.rank[pair], self.joined[pair] = rank, whole
                self.parts.setdefault(whole, (rank, *pair))
        self.bytes = byte_symbols()

    def symbols(self, token: str) -> str:
        if self.mark and token.endswith(self.mark) and len(token) > len(self.mark):
            body = token[: -len(self.mark)]
            return body[:-1] + chr(0xF0000 + ord(body[-1]))
        return token

    def spelled(self, word: str) -> str:
        """The symbols of a pre-token."""
        out = "".join(map(self.bytes.__getitem__, word.encode()))
        return out[:-1] + chr(0xF0000 + ord(out[-1])) if self.mark else out

    def merged(self, symbols: str) -> list[int]:
        """Encoding by the definition: of all pairs the lowest-ranked first, of equals the leftmost."""
        rank, joined = self.rank, self.joined
        ids = [self.pieces[s] for s in symbols]
        ranks = [rank.get(p, FAR) for p in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) != FAR:
            i = ranks.index(low)
            ids[i] = joined[ids[i], ids[i + 1]]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank.get((ids[i - 1], ids[i]), FAR)
            if i < len(ranks):
                ranks[i] = rank.get((ids[i], ids[i + 1]), FAR)
        return ids


class PrefixEncoder:
    """Exact encoding of one pre-token from stored back-pointers."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.ends = ahocorasick.Automaton()
        for piece, i in vocabulary.pieces.items():
            if len(piece) == 1 or vocabulary.merged(piece) == [i]:  # others never come out of an encoding
                self.ends.add_word(piece, (i, len(piece)))
        self.ends.make_automaton()
        self.may_follow: dict[tuple[int, int], bool] = {}

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether two tokens side by side are encoded as these two.

        Undoes the merges of both from the latest one on, along the border. The pieces at the border
        at each moment would have been joined if their merge came before both were taken up by what
        they belong to; of equal ranks, the merge further left came first.
        """
        rank, parts = self.vocabulary.rank, self.vocabulary.parts
        left_until = right_until = FAR
        while True:
            join = rank.get((left, right), FAR)
            if join < left_until and join <= right_until and join != FAR:
                return False
            made_left, made_right = parts.get(left), parts.get(right)
            if made_left is None and made_right is None:
                return True
            if made_right is None or made_left is not None and made_left[0] > made_right[0]:
                left_until, left = made_left[0], made_left[2]
            else:
                right_until, right = made_right[0], made_right[1]

    def __call__(self, symbols: str) -> list[int]:
        last, size = [-1] * (len(symbols) + 1), [0] * (len(symbols) + 1)
        may_follow, done = self.may_follow, -1
        for end, (token, length) in self.ends.iter(symbols):
            if end == done:
                continue
            start = end + 1 - length
            if start:
                before = last[start]
                if before < 0:
                    continue
                pair = (before, token)
                fits = may_follow.get(pair)
                if fits is None:
                    if len(may_follow) >= PAIR_CACHE:
                        may_follow.clear()
                    fits = may_follow[pair] = self.stays_apart(before, token)
                if not fits:
                    continue
            last[end + 1], size[end + 1], done = token, length, end
        ids, at = [], len(symbols)
        while at:
            ids.append(last[at])
            at -= size[at]
        return ids[::-1]


class WordBpe:
    """The whole tokenizer: special strings, normalisation, pre-tokens, ids, and the text back."""

    WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    CHUNKS = re.compile(f"[^{SPACE}]+")
    ODD = re.compile("[\x1c-\x1f]")

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.encode_symbols = PrefixEncoder(self.vocabulary)
        self.packs = {i: i.to_bytes(4, "little") for i in self.vocabulary.names}
        self.spoken = [self.vocabulary.names.get(i, "") for i in range(max(self.vocabulary.names) + 1)]
        self.specials = re.compile("(" + "|".join(map(re.escape, self.vocabulary.special)) + ")")
        outer = self

        class Words(dict):
            def __missing__(self, word):
                out = outer.packed(outer.encode_symbols(outer.vocabulary.spelled(word)))
                if len(word) <= 64:
                    if len(self) >= WORD_CACHE:
                        self.clear()
                    self[word] = out
                return out

        class Chunks(dict):
            def __missing__(self, chunk):
                if chunk.isalpha():
                    out = words[chunk]
                else:
                    out = b"".join([words[w] for w in WordBpe.WORDS.findall(chunk)])
                if len(chunk) <= 64:
                    if len(self) >= CHUNK_CACHE:
                        self.clear()
                    self[chunk] = out
                return out

        words = Words()
        self.chunks = Chunks()

    def packed(self, ids: list[int]) -> bytes:
        return b"".join([self.packs[i] for i in ids])

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # a final sigma is not treated apart
                return "".join(c.lower() for c in text)
        return text.lower()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        ids = []
        for part in self.specials.split(text) if "<|" in text else (text,):
            if part in self.vocabulary.special:
                ids.append(self.vocabulary.special[part].to_bytes(4, "little"))
                continue
            part = self.normal(part)
            ids += [self.chunks[c] for c in (self.CHUNKS.findall(part) if self.ODD.search(part) else part.split())]
        return b"".join(ids)

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens' names side by side; the file names no decoder."""
        return " ".join(map(self.spoken.__getitem__, ids))


LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    if path not in LOADED:
        LOADED[path] = WordBpe(path)
    return LOADED[path]


def encode_documents(
    df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True
) -> DataFrame:
    """Rows (id, n_tokens, ids array or null, ids_sha256, decoded_sha256), one per input row.

    ``path`` is the vocabulary's place, the same on all executors. One narrow stage: no shuffle.
    """
    path = path or tokenizer_path("word_bpe_49k.json")
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        bpe = loaded(path)
        types = {"n": pa.int64(), "ids": pa.list_(pa.int32()), "i": pa.string(), "d": pa.string()}
        for batch in batches:
            out: dict[str, list] = {"n": [], "ids": [], "i": [], "d": []}
            for text in batch.column(1).to_pylist():
                packed = bpe.encode(text or "")
                ids = np.frombuffer(packed, "<i4")
                out["n"].append(len(ids))
                out["ids"].append(ids if with_ids else None)
                out["i"].append(hashlib.sha256(packed).hexdigest())
                out["d"].append(hashlib.sha256(bpe.decode(ids.tolist()).encode()).hexdigest())
            yield batch_of({"id": batch.column(0)} | out, types)

    schema = f"id {id_type}, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string"
    return map_texts(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, schema).withColumnRenamed(
        "id", id_col
    )


def decode_documents(df: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (id, text) from arrays of ids; null for a null array."""
    path = path or tokenizer_path("word_bpe_49k.json")
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            texts = [None if ids is None else bpe.decode(ids) for ids in batch.column(1).to_pylist()]
            yield batch_of({"id": batch.column(0), "text": texts}, {"text": pa.string()})

    return map_texts(
        df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")), run, f"id {id_type}, text string"
    ).withColumnRenamed("id", id_col)
