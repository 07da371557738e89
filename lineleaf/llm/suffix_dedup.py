"""Removal of repeated byte strings by distributed prefix doubling.

A position's rank at one length and the rank at an offset from it are its pair; Spark sorts the pairs, equal pairs get
one new rank, that of the longer string, and positions whose pair only one document has leave. Offsets grow until
the ranks reach the threshold (50 bytes); the last offset may overlap. First ranks are names made from 8, 16 or 32
bytes, so at 50 bytes the pair at offset 18 is the last one.

Only positions that can matter enter the rounds: of the names at 16 bytes inside each window of the threshold's
length the smallest one is its anchor, and equal windows have equal anchors, so a window whose anchor's name is
unique is unique. Neighbouring windows of one anchor form a run; runs (and texts) that recur as a whole are settled
by one pair, and a window needs that the 32 bytes around its anchor recur. These tests go over packed arrays of names,
documents staying in their buckets: a bucket asks with the sorted names of its positions, and the names' partitions
answer with the smallest document of each name that is not unique.

Defined cases: a null text counts as empty; texts shorter than the threshold lose nothing; texts are read
whole, in overlapping pieces of ``PIECE`` bytes; rows with a null id neither lose bytes nor take part; rows with equal
ids are no smaller than each other and don't clean each other; an empty table gives an empty one; further columns
are ignored. A bucket's questions and pairs hold each name once, so a string that very many documents share is asked
for once a bucket. The number of buckets follows the bytes of the input. Names are 64-bit hashes that only sort
positions out; what is removed rests on pairs of 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, batch_of, mixed, prepare, written

U = np.uint64
FIRST = 16
BUCKET_BYTES = 16_000_000
ODD, ODD_2, TOP = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(1 << 63)
#: Bytes of text whose names are made at once, and of a longer text's pieces.
BATCH, PIECE = 120_000, 1 << 20
ANCHOR, HALF, RUN, ROUNDS = 0, 1, 2, 3  # what a row is about; rounds are numbered from ROUNDS on
QUESTIONS = "b int, p int, t int, blob binary"
#: A pair with the least and the greatest document of a bucket, and a number of its own; or a question (blob).
PAIRS = "b int, p int, t int, blob binary, a long, z long, low long, high long, q long"


def pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(left * ODD + right)


def levels(size: int) -> list[tuple[int, int]]:
    """Lengths of ranks and the offsets that pair them, until ``size`` is reached."""
    length = 8 if size < 2 * FIRST else FIRST if size < 3 * FIRST else 2 * FIRST
    out = []
    while length < size:
        out.append((length, min(length, size - length)))
        length += out[-1][1]
    return out


class Part:
    """A piece of a document: row and document, the piece's place in it, its bytes, the document's two names."""

    __slots__ = ("row", "doc", "at", "raw", "whole")

    def __init__(self, row: int, doc: int, at: int, raw: bytes, whole: tuple[int, int]):
        self.row, self.doc, self.at, self.raw, self.whole = row, doc, at, raw, whole


class Texts:
    """Names and runs of some pieces of at least ``size`` bytes each, laid end to end.

    No name or window that counts reaches over the end of its piece.
    """

    def __init__(self, parts: list[Part], size: int):
        self.size, self.parts = size, parts
        self.docs = np.array([x.doc for x in parts], np.int64).view(U) ^ TOP  # unsigned values in the order of the signed ids
        self.whole = tuple(np.array([x.whole[i] for x in parts], U) for i in (0, 1))
        lengths = np.array([len(x.raw) for x in parts])
        self.tail = np.cumsum(lengths)
        self.head = self.tail - lengths
        self.bytes = np.frombuffer(b"".join([x.raw for x in parts]), np.uint8)
        a = self.bytes.astype(U)
        a = a[:-1] | (a[1:] << U(8))
        a = a[:-2] | (a[2:] << U(16))
        self.eights = a = a[:-4] | (a[4:] << U(32))
        self.names = mixed(a[:-8] * ODD + a[8:] * ODD_2)  # of the 16 bytes from each position on
        width, low = size - FIRST + 1, U((1 << 28) - 1)
        least = (self.names & ~low) | np.arange(len(self.names), dtype=U)
        reach = 1
        while 2 * reach <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < width:
            least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
        anchors = (least & low).astype(np.int64)
        for t in self.tail[:-1]:  # windows over an end
            anchors[t - size + 1 : t] = -1
        self.start = np.flatnonzero(np.diff(anchors, prepend=-2))
        self.end = np.append(self.start[1:], len(anchors)) - 1  # the last window of the run
        self.anchor = anchors[self.start]
        real = self.anchor >= 0
        self.start, self.end, self.anchor = self.start[real], self.end[real], self.anchor[real]
        self.of = np.searchsorted(self.tail, self.start, side="right")  # each run's piece

    def marks(self) -> np.ndarray:
        """Names of the anchors, scrambled: the least of many names crowd at the low end of their range."""
        return mixed(self.names[self.anchor] ^ ODD)

    def spans(self, chosen: np.ndarray) -> Iterator[np.ndarray]:
        """Places of 16 bytes each that make up what the windows of each chosen run cover together."""
        start, last = self.start[chosen], self.end[chosen] + self.size - FIRST
        for offset in range(0, 2 * self.size, FIRST):
            yield np.minimum(start + offset, last)

    def runs(self, chosen: np.ndarray) -> np.ndarray:
        """Names of the bytes that the windows of each chosen run cover together."""
        out = mixed((self.end[chosen] - self.start[chosen]).astype(U) + U(self.size))
        for at in self.spans(chosen):
            out = pairs(out, self.names[at])
        return out

    def others(self, chosen: np.ndarray) -> np.ndarray:
        """Second names of the same bytes, made in another way."""
        out = mixed((self.end[chosen] - self.start[chosen]).astype(U) + ODD)
        for at in self.spans(chosen):
            out = pairs(out, mixed(self.eights[at] * ODD_2 + mixed(self.eights[at + 8])))
        return out

    def halves(self) -> tuple[np.ndarray, np.ndarray]:
        """Names of 32 bytes: those that end and those that start with the anchor; where they leave the text, of 16."""
        at, most = self.anchor, len(self.names) - 1
        left, right = at - FIRST, at + FIRST
        return (
            np.where(left >= self.head[self.of], pairs(self.names[np.maximum(left, 0)], self.names[at]), mixed(self.names[at])),
            np.where(
                right + FIRST <= self.tail[self.of],
                pairs(self.names[at], self.names[np.minimum(right, most)]),
                mixed(self.names[at] + U(1)),
            ),
        )

    def windows(self, runs: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and documents of the runs' windows that can recur, given which of their halves do."""
        count = self.end[runs] - self.start[runs] + 1
        own = np.repeat(np.arange(len(runs)), count)
        at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.start[runs], count)
        if self.size >= 3 * FIRST:
            before = self.anchor[runs][own] - at
            fits = (left[own] | (before < FIRST)) & (right[own] | (before > self.size - 2 * FIRST))
            at, own = at[fits], own[fits]
        return at, self.docs[self.of[runs[own]]]

    def first_ranks(self, at: np.ndarray) -> np.ndarray:
        """Names of the bytes that the first ranks are of."""
        length = levels(self.size)[0][0]
        if length == 8:
            return self.eights[at]
        return self.names[at] if length == FIRST else pairs(self.names[at], self.names[at + FIRST])

    def paired(self, known: Known, turn: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs of a round at the positions, as two keys, and which positions are still in."""
        h = levels(self.size)[turn][1]
        left, in_left = self.ranked(known, turn, at)
        right, in_right = self.ranked(known, turn, at + h)
        return pairs(left, right), right, in_left & in_right  # for a given right, the first key tells the left apart

    def ranked(self, known: Known, turn: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks that a round pairs, and which positions have one."""
        if turn == 0:
            return self.first_ranks(at), np.ones(len(at), bool)
        a, z, still = self.paired(known, turn - 1, at)
        found, rank = known.pair(ROUNDS + turn - 1, a, z)
        return rank, found & still


def planes(x: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones, and so on: this compresses well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), 8).T).tobytes()


def packed(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=U(0))) + planes(low) + planes(high - low)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(blob, np.uint8).reshape(3, 8, -1).transpose(0, 2, 1)
    keys, low, more = (np.ascontiguousarray(y).view(U).reshape(-1) for y in x)
    return np.cumsum(keys, dtype=U), low, low + more


def joined(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key once, sorted, with the least and the greatest of its values."""
    if not len(keys):
        return keys, low, high
    order = np.argsort(keys, kind="stable")
    keys, low, high = keys[order], low[order], high[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)


def asked(b: int, t: int, parts: int, keys: list[np.ndarray], values: list[np.ndarray]) -> list[tuple]:
    """Question rows of one bucket, one for each partition of the names."""
    if not keys:
        return []
    k, v = np.concatenate(keys), np.concatenate(values)
    k, low, high = joined(k, v, v)
    cuts = np.searchsorted(k, np.arange(1, parts, dtype=U) * U((1 << 64) // parts)) if parts > 1 else []
    bounds = [0, *map(int, cuts), len(k)]
    return [
        (b, p, t, packed(k[x:y], low[x:y], high[x:y])) for p, (x, y) in enumerate(zip(bounds, bounds[1:])) if y > x
    ]


def question_table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [(), (), (), ()]
    return pa.table(
        {
            "b": pa.array(cols[0], pa.int32()),
            "p": pa.array(cols[1], pa.int32()),
            "t": pa.array(cols[2], pa.int32()),
            "blob": pa.array(cols[3], pa.binary()),
        }
    )


def answers(questions: DataFrame) -> DataFrame:
    """To each question the names with more than one value, among all buckets, with the least and the greatest."""

    def run(group: pa.Table) -> pa.Table:
        kinds, rows = group["t"].to_pylist(), []
        for t in set(kinds):
            at = [i for i, x in enumerate(kinds) if x == t]
            parts = [unpacked(group["blob"][i].as_py()) for i in at]
            keys, low, high = joined(*(np.concatenate(x) for x in zip(*parts)))
            many = low < high
            keys, low, high = keys[many], low[many], high[many]
            if not len(keys):
                continue
            for i, (own, _, _) in zip(at, parts):
                place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                place = place[keys[place] == own]
                if len(place):
                    blob = packed(keys[place], low[place], low[place])
                    rows.append((group["b"][i].as_py(), group["p"][i].as_py(), t, blob))
        return question_table(rows)

    return questions.groupBy("p").applyInArrow(run, QUESTIONS)


class Known:
    """The answers to one bucket: names with their least document, and pairs with a value each."""

    def __init__(self, table: pa.Table | None = None):
        self.of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.pairs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        if table is None or not table.num_rows:
            return
        kinds = table["t"].to_numpy()
        packs = np.flatnonzero(kinds <= HALF)
        places = table["p"].to_numpy()
        for t in set(kinds[packs].tolist()):
            at = packs[kinds[packs] == t]
            parts = [unpacked(table["blob"][int(i)].as_py()) for i in at[np.argsort(places[at], kind="stable")]]
            self.of[t] = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
        for t in set(kinds[kinds > HALF].tolist()):
            own = table.filter(pa.array(kinds == t))
            a, z, value = (own[c].to_numpy().view(U) for c in ("a", "z", "low"))
            order = np.lexsort((z, a))
            self.pairs[t] = a[order], z[order], value[order] ^ TOP

    def find(self, t: int, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the names are known, and the least value of each."""
        keys, low = self.of.get(t, (np.empty(0, U), np.empty(0, U)))
        if not len(keys) or not len(names):
            return np.zeros(len(names), bool), np.zeros(len(names), U)
        at = np.minimum(np.searchsorted(keys, names), len(keys) - 1)
        return keys[at] == names, low[at]

    def first(self, t: int, a: np.ndarray) -> np.ndarray:
        """Which of the first keys some known pair has."""
        keys = self.pairs[t][0] if t in self.pairs else np.empty(0, U)
        return keys[np.minimum(np.searchsorted(keys, a), len(keys) - 1)] == a if len(keys) else np.zeros(len(a), bool)

    def pair(self, t: int, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs are known, and the value of each."""
        found, value = np.zeros(len(a), bool), np.zeros(len(a), U)
        if t not in self.pairs:
            return found, value
        first, second, values = self.pairs[t]
        at = np.searchsorted(first, a)
        left = np.flatnonzero(at < len(first))
        while len(left):  # once, but for first keys that two pairs share
            left = left[first[at[left]] == a[left]]
            hit = left[second[at[left]] == z[left]]
            found[hit], value[hit] = True, values[at[hit]]
            left = left[~found[left]]
            at[left] += 1
            left = left[at[left] < len(first)]
        return found, value


def documents_of(table: pa.Table) -> Iterator[tuple[int | None, bytes, tuple[int, int]]]:
    """Id, bytes and two names of each document of a bucket, in an order that its rows alone decide."""
    unzip = zstandard.ZstdDecompressor()
    for i in table.sort_by([("id", "ascending"), ("mark", "ascending")]).to_batches():
        for doc, raw in zip(i.column("id").to_pylist(), i.column("raw")):
            data = unzip.decompress(raw.as_py())
            yield doc, data, divmod(xxhash.xxh3_128_intdigest(data), 1 << 64)


def batches_of(table: pa.Table, size: int) -> Iterator[Texts]:
    """The documents of a bucket that have an id and at least ``size`` bytes, some at a time."""
    parts, total = [], 0
    for row, (doc, data, whole) in enumerate(documents_of(table)):
        if doc is None or len(data) < size:
            continue
        piece = max(PIECE, 2 * size)
        for at in range(0, max(1, len(data) - size + 1), piece):  # every window starts in one piece and lies in it
            parts.append(Part(row, doc, at, data[at : at + piece + size - 1], whole))
            total += len(parts[-1].raw)
            if total >= BATCH:
                yield Texts(parts, size)
                parts, total = [], 0
    if parts:
        yield Texts(parts, size)


def settled(known: Known, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which pieces are of a document with an equal one of a smaller id; of the others' runs which recur as a whole in a
    smaller document, and the runs that are open, with which of their halves recur."""
    found, low = known.pair(RUN, *t.whole)
    copy = found & (low < t.docs)
    apart = np.flatnonzero(~copy[t.of])
    names = t.runs(apart)
    maybe = np.flatnonzero(known.first(RUN, names))
    found, low = known.pair(RUN, names[maybe], t.others(apart[maybe]))
    gone = np.zeros(len(t.start), bool)
    gone[apart[maybe[found & (low < t.docs[t.of[apart[maybe]]])]]] = True
    apart = apart[~gone[apart]]
    if t.size < 3 * FIRST:
        return copy, gone, apart, np.ones(len(apart), bool), np.ones(len(apart), bool)
    left, right = (known.find(HALF, x[apart])[0] for x in t.halves())
    either = left | right
    return copy, gone, apart[either], left[either], right[either]


def pair_rows(b: int, t: int, a: list[np.ndarray], z: list[np.ndarray], docs: list[np.ndarray]) -> dict[str, object]:
    """Each pair of a bucket once, with its least and greatest document."""
    x, y, v = (np.concatenate([np.empty(0, U), *c]) for c in (a, z, docs))
    order = np.lexsort((y, x))
    x, y, v = x[order], y[order], v[order]
    first = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))) if len(x) else np.empty(0, int)
    low = np.minimum.reduceat(v, first) if len(x) else v
    high = np.maximum.reduceat(v, first) if len(x) else v
    n = len(first)
    return {
        "b": np.full(n, b, np.int32), "p": np.zeros(n, np.int32), "t": np.full(n, t, np.int32), "blob": pa.nulls(n, pa.binary()),
        "a": x[first].view(np.int64), "z": y[first].view(np.int64), "low": (low ^ TOP).view(np.int64), "high": (high ^ TOP).view(np.int64),
        "q": np.arange(n, dtype=np.int64) + (b << 32),
    }


PAIR_TYPES = {"b": pa.int32(), "p": pa.int32(), "t": pa.int32(), "blob": pa.binary(), **dict.fromkeys(("a", "z", "low", "high", "q"), pa.int64())}


def pair_table(columns: dict[str, object]) -> pa.Table:
    return pa.table([pa.array(columns[k], t) for k, t in PAIR_TYPES.items()], names=list(PAIR_TYPES))


def ranked_pairs(rows: DataFrame, last: bool) -> DataFrame:
    """Spark sorts the pairs; each of those that more than one document has gets its answer.

    In the last round that is the least document, for the buckets that hold a greater one; before, it is the new
    rank, for all.
    """
    same = Window.partitionBy("a", "z")
    if last:
        found = rows.select("b", "p", "t", "a", "z", "high", F.min("low").over(same).alias("value")).where("value < high")
    else:
        found = rows.select(
            "b", "p", "t", "a", "z", F.min("low").over(same).alias("least"), F.max("high").over(same).alias("most"), F.min("q").over(same).alias("value")
        ).where("least < most")
    return found.select("b", "p", "t", F.lit(None).cast("binary").alias("blob"), "a", "z", F.col("value").alias("low"))


def repeated_strings(df: DataFrame, size: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, n_bytes, n_removed, n_spans, kept_sha256). ``size`` is at least 16."""
    if size < FIRST:
        raise ValueError(f"size is at least {FIRST}")
    spark, rounds = prepare(df.sparkSession), len(levels(size))
    given = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    total = given.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = int(-(-total // BUCKET_BYTES)) or 1

    def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            raws = [pack.compress(t.encode()) for t in batch.column(3).to_pylist()]
            yield batch_of({"b": batch.column(0), "id": batch.column(1), "mark": batch.column(2), "raw": raws}, {"raw": pa.binary()})

    mark = F.xxhash64("id", "text")
    bucket = F.pmod(mark, F.lit(parts)).cast("int").alias("b")
    documents = given.select(bucket, "id", mark.alias("mark"), "text").mapInArrow(zipped, "b int, id long, mark long, raw binary")

    def anchors(group: pa.Table) -> pa.Table:
        keys, values = [], []
        for t in batches_of(group, size):
            keys += [t.marks(), t.whole[0]]
            values += [t.docs[t.of], t.docs]
        return question_table(asked(group["b"][0].as_py(), ANCHOR, parts, keys, values))

    def runs(group: pa.Table, replies: pa.Table) -> pa.Table:
        if not group.num_rows:
            return pair_table(pair_rows(0, RUN, [], [], []))
        known, b = Known(replies), group["b"][0].as_py()
        a, z, docs, half_keys, half_values = [], [], [], [], []
        for t in batches_of(group, size):
            same, low = known.find(ANCHOR, t.whole[0])
            a.append(t.whole[0][same])
            z.append(t.whole[1][same])
            docs.append(t.docs[same])
            at = np.flatnonzero(known.find(ANCHOR, t.marks())[0] & ~(same & (low < t.docs))[t.of])
            own = t.runs(at)
            a.append(own)
            z.append(t.others(at))
            docs.append(t.docs[t.of[at]])
            for half in t.halves() if size >= 3 * FIRST else ():
                half_keys.append(half[at])
                half_values.append(own)
        halves = question_table(asked(b, HALF, parts, half_keys, half_values))
        none = pa.nulls(halves.num_rows, pa.int64())
        for name in ("a", "z", "low", "high", "q"):
            halves = halves.append_column(name, none)
        return pa.concat_tables([halves, pair_table(pair_rows(b, RUN, a, z, docs))])

    def of_round(turn: int):
        """The pairs of a round: of all positions that windows which are open need at its length."""
        offsets = np.zeros(1, np.int64)
        for _, h in levels(size)[:turn:-1]:
            offsets = np.union1d(offsets, offsets + h)

        def windows(group: pa.Table, replies: pa.Table) -> pa.Table:
            if not group.num_rows:
                return pair_table(pair_rows(0, ROUNDS, [], [], []))
            known, a, z, docs = Known(replies), [], [], []
            for t in batches_of(group, size):
                _, _, *still = settled(known, t)
                at, _ = t.windows(*still)
                if turn + 1 < rounds:
                    at = np.unique(at[:, None] + offsets)
                x, y, stays = t.paired(known, turn, at)
                a.append(x[stays])
                z.append(y[stays])
                docs.append(t.docs[np.searchsorted(t.tail, at[stays], side="right")])
            return pair_table(pair_rows(group["b"][0].as_py(), ROUNDS + turn, a, z, docs))

        return windows

    def cleaned(group: pa.Table, replies: pa.Table) -> pa.Table:
        known, open_ = Known(replies), {}
        out: dict[int, list] = {}
        for t in batches_of(group, size):
            copy, gone, *still = settled(known, t)
            at, docs = t.windows(*still)
            a, z, stays = t.paired(known, rounds - 1, at)
            found, low = known.pair(ROUNDS + rounds - 1, a, z)
            at = at[found & stays & (low < docs)]
            change = np.zeros(len(t.bytes) + 1, np.int32)
            for x, step in ((t.start[gone], 1), (at, 1), (t.head[copy], 1)):
                np.add.at(change, x, step)
            for x in (t.end[gone] + size, at + size, t.tail[copy]):
                np.add.at(change, x, -1)
            covered = np.cumsum(change[:-1]) > 0
            for k, part in enumerate(t.parts):
                own = covered[t.head[k] : t.tail[k]]
                if own.any():
                    open_.setdefault(part.row, []).append((part.at, np.packbits(own), len(own)))
        rows = []
        for row, (doc, data, _) in enumerate(documents_of(group)):
            if row not in open_:
                rows.append((doc, len(data), 0, 0, hashlib.sha256(data).hexdigest()))
                continue
            covered = np.zeros(len(data), bool)
            for x, bits, n in open_[row]:
                covered[x : x + n] |= np.unpackbits(bits, count=n).astype(bool)
            starts = int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum())
            kept = np.frombuffer(data, np.uint8)[~covered].tobytes()
            rows.append((doc, len(data), len(data) - len(kept), starts, hashlib.sha256(kept).hexdigest()))
        types = {"id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
        cols = list(zip(*rows)) if rows else [()] * len(types)
        return pa.table({k: pa.array(c, x) for (k, x), c in zip(types.items(), cols)})

    replies = "b", "p", "t", "blob", "a", "z", "low"
    buckets = documents.groupBy("b")
    with Scratch(spark) as scratch:
        first = answers(buckets.applyInArrow(anchors, QUESTIONS))
        with Scratch(spark) as brief:
            asked_runs = brief.table(buckets.cogroup(first.groupBy("b")).applyInArrow(runs, PAIRS))
            halves = answers(asked_runs.where(f"t = {HALF}").select("b", "p", "t", "blob"))
            halves = halves.select("*", *(F.lit(None).cast("long").alias(c) for c in ("a", "z", "low")))
            known = scratch.table(halves.unionByName(ranked_pairs(asked_runs.where(f"t = {RUN}"), True)).select(*replies))
        for turn in range(rounds):
            rows = buckets.cogroup(known.groupBy("b")).applyInArrow(of_round(turn), PAIRS)
            known = known.unionByName(scratch.table(ranked_pairs(rows, turn + 1 == rounds)))  # a query of its own: its shuffle files go
        done = buckets.cogroup(known.groupBy("b")).applyInArrow(
            cleaned, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
        )
        return written(done).withColumnRenamed("id", id_col)
