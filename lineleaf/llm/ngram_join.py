"""Self-join of documents on the Jaccard similarity of their sets of word n-grams.

The verification is a T-occurrence search with DivideSkip: per task an inverted index over the documents it
holds; a query merges its short lists in a heap, and probes its long ones by binary search for what the merge
found, keeping documents that reach the required overlap.

Which documents meet in a task is found exactly, not by sampling. Documents with equal sets are one. For
each size class the hash space is cut into more ranges than two linked sets can differ in, so at least
one range holds the same n-grams of both: the hashes of the ranges' contents are signatures, and
linked documents share one. The groups of documents that signatures hold together are closed under
links. A group is dealt in blocks of about ``BLOCK`` documents and ``BLOCK_SHINGLES`` n-grams at most (a hash deals them): first each block by itself, then one
document of each component found, then what is still apart block by block. Documents that are
connected already aren't compared again, so a group of many alike documents costs in proportion to its size.

Defined cases: a null text counts as empty; documents without words have an empty set and link with
nothing; with fewer words than n the whole sequence is the one n-gram; texts are read whole; rows with
equal ids and different texts are told apart, and the component of a row is the smallest id it reaches;
rows with a null id link with nothing (component null); an empty table gives an empty one; further columns
are ignored by ``similar_documents`` and carried through by ``one_of_each``. Sets and n-grams are
known by 64-bit hashes.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, batch_of, components, map_texts, mixed, prepare, window_hashes, word_hashes, written

BLOCK, BLOCK_SHINGLES = 1024, 4_000_000
U = np.uint64


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams."""
    words = (text or "").encode().lower().split()  # of bytes: only A-Z, and only ASCII white space
    if not words:
        return np.empty(0, U)
    h = word_hashes(words)
    if len(h) < n:
        total = mixed(h[:1] + U(len(h)))
        for x in h[1:]:
            total = mixed(total * U(0x9E3779B97F4A7C15) + x)
        return total
    return np.unique(window_hashes(h, n))


def set_id(s: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    total = mixed(s).sum(dtype=U, keepdims=True) + U(len(s))
    return int(mixed(total).astype(np.int64)[0])


class Scheme:
    """Size classes and cuts for a similarity of at least percent / 100."""

    def __init__(self, percent: int):
        self.percent = percent
        self.tops: list[int] = [1]
        while self.tops[-1] < 1 << 31:
            self.tops.append(max(self.tops[-1] + 1, (self.tops[-1] + 1) * 100 // percent))

    def differ(self, both: int) -> int:
        """Most elements that two linked sets with so many elements together have apart."""
        return both * (100 - self.percent) // (100 + self.percent)

    def cuts(self, tag: int) -> tuple[int, int]:
        """Ranges, and how many of them can differ at most, for sets up to the tag's size."""
        most = self.differ(2 * self.tops[tag])
        return (0, 0) if most == 0 else (most + 2 + most // 3, most)

    def signatures(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Names of the filled ranges under the tags of the set's class and of the next, one of which two linked
        sets share; and for each how many of the tag's most frequent names the set can do without.

        Of its ranges two linked sets have all but the cut's most alike, so each needs to look only at as many of
        its rarest names as that most and one more; empty ranges count as the most frequent names.
        """
        at = bisect_left(self.tops, len(s))
        names, spared = [], []
        sums = np.concatenate([np.zeros(1, U), np.cumsum(mixed(s ^ U(0x5851F42D4C957F2D)), dtype=U)])
        for tag in (at, at + 1):
            parts, most = self.cuts(tag)
            if not parts:
                continue
            step = U((1 << 64) // parts)
            ends = np.searchsorted(s, np.arange(1, parts, dtype=U) * step)
            bounds = np.concatenate([[0], ends, [len(s)]])
            own = mixed(sums[bounds[1:]] - sums[bounds[:-1]] + mixed(np.arange(parts, dtype=U) + U(tag << 40)))
            filled = bounds[1:] > bounds[:-1]
            rest = parts - most - 1 - (parts - int(filled.sum()))
            if rest >= 0:  # else even an empty range may be the one that is alike
                own = own[filled]
            names.append(own)
            spared.append(np.full(len(own), 2 * max(0, rest) + tag % 2, np.int64))
        if not names:
            return np.empty(0, U), np.empty(0, np.int64)
        return np.concatenate(names), np.concatenate(spared)


class Forest:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while (y := up.get(x, x)) != root:
            up[x] = root
            x = y
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def merged_lists(lists: list[np.ndarray], least: int) -> list[tuple[int, int]]:
    """(entry, times) of the entries that stand in at least so many of the sorted lists, by a heap of their heads.

    With ``least`` above 1 the least - 1 smallest heads are popped together whenever the smallest entry can't make it,
    and their lists skip by binary search to what the next head allows.
    """
    whole = [x.tolist() for x in lists if len(x)]
    places = [0] * len(whole)
    heap = [(x[0], i) for i, x in enumerate(whole)]
    heapify(heap)
    out = []
    while len(heap) >= least and heap:
        low, times = heap[0][0], 0
        popped = []
        while heap and heap[0][0] == low:
            popped.append(heap[0][1])
            times += 1
            i = popped[-1]
            places[i] += 1
            if places[i] < len(whole[i]):
                heapreplace(heap, (whole[i][places[i]], i))
            else:
                heappop(heap)
        if times >= least:
            out.append((low, times))
        elif len(heap) >= least > 1:
            # no entry before the least-th smallest head can still reach the count
            aside = [heappop(heap) for _ in range(least - 1)]
            bound = heap[0][0]
            for head, i in aside:
                if head < bound:
                    places[i] = bisect_left(whole[i], bound, places[i])
                if places[i] < len(whole[i]):
                    heappush(heap, (whole[i][places[i]], i))
    return out


def divide_skip(
    sets: list[np.ndarray], percent: int, apart: np.ndarray | None = None, known: list[int] | None = None
) -> list[tuple[int, int]]:
    """Links that connect what isn't connected yet, as pairs of places.

    ``known`` are the components so far; with ``apart``, places of the same value aren't compared.
    """
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    out: list[tuple[int, int]] = []
    label = np.arange(len(sets)) if known is None else np.unique(np.array(known), return_inverse=True)[1]
    grams, tokens = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    docs = np.repeat(np.arange(len(sets)), sizes)
    keys = np.sort(tokens.astype(np.int64) * len(sets) + docs)  # the lists one after another, each in order
    heads = np.searchsorted(keys, np.arange(len(grams) + 1) * len(sets))
    places, lengths = keys % len(sets), np.diff(heads)
    rank = np.empty(len(sets), np.int64)
    rank[order] = np.arange(len(sets))
    latest: dict[int, int] = {}  # of each component the last document that was a query

    def held(grams_of_q: np.ndarray, c: int) -> int:
        probe = grams_of_q.astype(np.int64) * len(sets) + c
        at = np.searchsorted(keys, probe)
        return int((keys[np.minimum(at, len(keys) - 1)] == probe).sum())

    def join(c: int, q: int) -> None:
        latest.pop(int(label[c]), None)
        label[label == label[c]] = label[q]
        out.append((c, q))

    for q in map(int, order):
        own = tokens[ends[q] : ends[q + 1]]
        n = len(own)
        # a group of many alike documents is one component soon: then one probe does for a document
        for c in list(latest.values())[:-9:-1]:
            if label[c] != label[q] and (apart is None or apart[c] != apart[q]):
                shared = held(own, c)
                if 100 * shared >= percent * (n + int(sizes[c]) - shared):
                    join(c, q)
        wanted = (label != label[q]) & (rank < rank[q]) & (100 * sizes >= percent * n)
        if apart is not None:
            wanted &= apart != apart[q]
        if wanted.any():
            least = -(-percent * n // 100)  # the smallest overlap with any linked set
            by_length = own[np.argsort(lengths[own], kind="stable")]
            longest = int(lengths[by_length[-1]])
            n_long = min(least - 1, int(least / (0.01 * math.log2(max(2, longest)) + 1)))
            short, long = by_length[: n - n_long], by_length[n - n_long :]
            lists = [x[wanted[x]] for x in (places[heads[t] : heads[t + 1]] for t in short)]
            for c, times in merged_lists(lists, least - n_long):
                if label[c] != label[q]:
                    shared = times + held(long, c)
                    if 100 * shared >= percent * (n + int(sizes[c]) - shared):
                        join(c, q)
        latest.pop(int(label[q]), None)
        latest[int(label[q])] = q
    return out


def signature_rows(df: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """Rows (g, s) of signatures and set names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme, done = Scheme(percent), set()
        for batch in batches:
            owners, signatures = [], []
            for text in batch.column(0).to_pylist():
                s = shingles(text, n)
                own = set_id(s) if len(s) else None
                if own is None or own in done:
                    continue
                if len(done) < 200_000:  # equal sets of one task; the others meet in the aggregation
                    done.add(own)
                signatures.append(scheme.signatures(s)[0].astype(np.int64))
                owners.append(np.full(len(signatures[-1]), own, np.int64))
            if owners:
                yield batch_of(
                    {"g": np.concatenate(signatures), "s": np.concatenate(owners)}, {"g": pa.int64(), "s": pa.int64()}
                )

    return map_texts(df.where(F.col(id_col).isNotNull()).select(F.col(text_col).alias("text")), run, "g long, s long")


#: Bits of the filter that spares rows which meet no other; its size is fixed, with more rows it spares fewer.
FILTER_BITS = 1 << 25


def filter_places(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mixed(g.astype(np.int64).view(U))
    return (h & U(FILTER_BITS - 1)).astype(np.int64), (h >> U(39)).astype(np.int64)


def filter_of(shared: DataFrame) -> np.ndarray:
    """One bit array of the shared signatures, from at most eight parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            for at in filter_places(batch.column(0).to_numpy(zero_copy_only=False)):
                bits[at] = True
        yield batch_of({"bits": [np.packbits(bits, bitorder="little").tobytes()]}, {"bits": pa.binary()})

    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in shared.select("g").coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(bytes(row["bits"]), np.uint8)
    return out


def named_sets(df: DataFrame, bits: np.ndarray, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """Rows (id, n_shingles, s, null), one per input row, s the set's name or null for an empty set, and rows
    (null, k, s, g) of the signatures that pass the filter; k holds how many the set can do without, and the tag's parity."""
    shared = df.sparkSession.sparkContext.broadcast(bits)  # FILTER_BITS / 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme, done, filled = Scheme(percent), set(), shared.value
        types = {"id": pa.int64(), "n_shingles": pa.int64(), "s": pa.int64(), "g": pa.int64()}
        for batch in batches:
            ids, sizes, names, owners, signatures, spared = batch.column(0).to_pylist(), [], [], [], [], []
            for i, text in zip(ids, batch.column(1).to_pylist()):
                s = shingles(text, n)
                sizes.append(len(s))
                own = set_id(s) if len(s) else None
                names.append(own)
                if own is None or i is None or own in done:
                    continue
                if len(done) < 200_000:
                    done.add(own)
                g, k = scheme.signatures(s)
                g = g.astype(np.int64)
                x, y = filter_places(g)
                passed = ((filled[x >> 3] >> (x & 7)) & (filled[y >> 3] >> (y & 7)) & 1).astype(bool)
                signatures.append(g[passed])
                spared.append(k[passed])
                owners.append(np.full(len(signatures[-1]), own, np.int64))
            none = [None] * len(ids)
            yield batch_of({"id": ids, "n_shingles": sizes, "s": names, "g": none}, types)
            if owners:
                g = np.concatenate(signatures)
                gone = pa.nulls(len(g), pa.int64())
                yield batch_of({"id": gone, "n_shingles": np.concatenate(spared), "s": np.concatenate(owners), "g": g}, types)

    return map_texts(
        df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")),
        run,
        "id long, n_shingles long, s long, g long",
    )


def verified(rows: DataFrame, n: int, percent: int, cross: bool) -> DataFrame:
    """Edges (a, b) of set names from rows (task, block, comp, s, text); each task's rows go to one place in order."""
    dealt = rows.repartition("task").sortWithinPartitions("task", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, blocks, comps, sets = None, [], [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if len(sets) > 1:
                links = divide_skip(sets, percent, np.array(blocks) if cross else None, comps)
                if links:
                    yield batch_of({"a": [names[i] for i, _ in links], "b": [names[j] for _, j in links]}, {"a": pa.int64(), "b": pa.int64()})

        for batch in batches:
            for task, block, comp, s, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if task != now:
                    yield from flush()
                    now, names, blocks, comps, sets = task, [], [], [], []
                own = shingles(text, n)
                if set_id(own) == s and (not names or names[-1] != s):
                    names.append(s)
                    blocks.append(block)
                    comps.append(comp)
                    sets.append(own)
        yield from flush()

    return dealt.select("task", "block", "comp", "s", "text").mapInArrow(run, "a long, b long")


def links(df: DataFrame, rows: DataFrame, shared: DataFrame, scratch: Scratch, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """Components (id, component) of the sets that link with others, by set names."""
    sets = rows.where("g is null")
    known = rows.where("g is not null").select("g", "s", F.col("n_shingles").alias("k")).distinct().join(shared, "g")
    rarity = Window.partitionBy("s", F.col("k") % 2).orderBy(F.desc("n"), "g")
    needed = scratch.table(known.withColumn("rank", F.row_number().over(rarity)).where("rank > k div 2").select("g", "s"))
    firsts_of = needed.groupBy("g").agg(F.min("s").alias("a"), F.max("s").alias("z")).where("a < z").select("g", "a")
    pairs = needed.join(firsts_of, "g").where("s <> a").select("a", F.col("s").alias("b")).distinct()
    groups = components(pairs).select(F.col("id").alias("s"), F.col("component").alias("group"))
    firsts = sets.where("id is not null and s is not null").groupBy("s").agg(F.min("id").alias("id"), F.max("n_shingles").alias("n"))
    most = F.greatest(F.count("*") / F.lit(BLOCK), F.sum("n") / F.lit(BLOCK_SHINGLES))
    sizes = groups.join(firsts, "s").groupBy("group").agg(F.ceil(most).cast("int").alias("blocks"))
    chosen = (
        groups.join(sizes, "group")
        .join(firsts, "s")
        .select("s", "group", "blocks", "id", F.pmod(F.xxhash64("s"), F.col("blocks")).cast("int").alias("block"))
    )
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    held = texts.join(chosen, "id").select("s", "group", "blocks", "block", "text")
    held = scratch.table(held)
    task = lambda *c: F.xxhash64("group", *c).alias("task")

    inner = verified(held.select(task("block"), "block", F.col("s").alias("comp"), "s", "text"), n, percent, False)
    edges = scratch.table(inner)
    found = components(edges)
    large = held.where("blocks > 1")
    if large.isEmpty():
        return found

    def labelled(found: DataFrame) -> DataFrame:
        """The documents of groups that hold more than one component still."""
        rows = large.join(found.select(F.col("id").alias("s"), "component"), "s", "left").withColumn("comp", F.coalesce("component", "s"))
        open_ = rows.groupBy("group").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("group")
        return rows.join(open_, "group").select("s", "group", "blocks", "block", "comp", "text")

    def crossed(rows: DataFrame) -> DataFrame:
        """Every pair of blocks of a group is a task; a document goes to the tasks of its block."""
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        both = rows.select("*", other).where("other <> block")
        return both.select(task(F.least("block", "other"), F.greatest("block", "other")), "block", "comp", "s", "text")

    heads = labelled(found)
    heads = heads.join(heads.groupBy("comp").agg(F.min("s").alias("s")), ["comp", "s"])
    again = heads.groupBy("group").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("parts"))
    heads = heads.join(again, "group").select(task(F.pmod(F.xxhash64("s"), "parts")), "block", "comp", "s", "text")
    edges = edges.union(scratch.table(verified(heads, n, percent, False)))
    found = components(edges)
    rest = verified(crossed(labelled(found)), n, percent, True)
    return components(edges.union(rest))


def similar_documents(
    df: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: (id, n_shingles, component_id)."""
    with Scratch(prepare(df.sparkSession)) as scratch:
        least = signature_rows(df, id_col, text_col, n, percent).groupBy("g").agg(
            F.min("s").alias("a"), F.max("s").alias("z"), F.count("*").alias("n")
        )
        shared = scratch.table(least.where("a < z").select("g", "n"))
        rows = scratch.table(named_sets(df, filter_of(shared), id_col, text_col, n, percent))
        sets = written(rows.where("g is null").select("id", "n_shingles", "s"))
        found = links(df, rows, shared, scratch, id_col, text_col, n, percent)
    found = found.select(F.col("id").alias("s"), F.col("component").alias("c"))
    named = sets.join(found, "s", "left").select("id", "n_shingles", F.coalesce("c", "s").alias("c"))
    least = named.where("id is not null and c is not null").groupBy("c").agg(F.min("id").alias("least"))
    return named.join(least, "c", "left").select(
        F.col("id").alias(id_col),
        "n_shingles",
        F.when(F.col("id").isNotNull(), F.coalesce("least", "id")).alias("component_id"),
    )


def one_of_each(df: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose id is the smallest of their component, with all columns; rows with a null id stay."""
    kept = similar_documents(df, n, percent, id_col, text_col).where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("_kept")).distinct()
    return df.join(kept, F.col(id_col) == F.col("_kept"), "left_semi").unionByName(df.where(F.col(id_col).isNull()))
