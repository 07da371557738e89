"""Near-duplicate vectors by an inverted multi-index.

Two independent codebooks on the halves of the unit vectors span a grid of cells. Each vector lies in one
cell; as a query it visits cells in the order of their lower distance bound (multi-sequence traversal of
the two sorted lists of centroids) up to a bound that is calibrated for the target recall: sample vectors
are moved to the cosine limit in random directions, and the bound is what the target share of them needs
to be met, widened by ``WIDER``; a target of 1 takes the bound beyond which no vector within the limit can
lie. Every meeting is verified in double precision.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, rows with a null
label or a null id link with nothing (n_links 0, component their own id, kept); vectors of other
lengths never link; equal vectors are one class that is looked up once and counts by its size; repeated
rows count as vectors of their own; an empty table gives an empty one; further columns are ignored.
The codebooks are fitted on at most ``SAMPLE`` vectors chosen by hash; every vector is indexed. A cell
with more than ``BLOCK`` vectors is split into blocks which all its queries visit, so a task holds a
bounded number of vectors; links are counted where they are found and only a spanning forest leaves the
task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, components, prepare

SAMPLE, BLOCK, PER_CELL, MOST_CENTROIDS, ROUNDS = 10_000, 2048, 200, 256, 12
PROBES, WIDER = 20_000, 1.5


def unit(raw: bytes) -> np.ndarray | None:
    v = np.frombuffer(raw, "<f8")
    if not len(v) or not np.isfinite(v).all():
        return None
    top = np.abs(v).max()
    if top == 0:
        return None
    v = v / top
    return v / np.sqrt(v @ v)


def k_means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = squares(x, centres).argmin(1)
        for i in range(len(centres)):
            if (own := x[near == i]).size:
                centres[i] = own.mean(0)
    return np.unique(centres, axis=0)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1))


class Grid:
    """The two codebooks of one vector length."""

    def __init__(self, sample: np.ndarray, k: int):
        self.half = sample.shape[1] // 2
        parts = (sample[:, : self.half], sample[:, self.half :])
        self.books = [k_means(x, k, s) if x.shape[1] else np.zeros((1, 0)) for s, x in enumerate(parts)]
        self.apart = [np.sqrt(squares(c, c)) for c in self.books]

    def bounds(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half: nearest centroid, and squared lower bounds of the distance to each centroid's region."""
        out = []
        for book, apart, part in zip(self.books, self.apart, (x[:, : self.half], x[:, self.half :])):
            d = squares(part, book)
            near = d.argmin(1)
            least = d[np.arange(len(x)), near][:, None]
            low = (d - least) / np.maximum(2 * apart[near], 1e-300)  # the distance to the bisector
            low[np.arange(len(x)), near] = 0
            out.append((near, np.maximum(0, low) ** 2))
        return out

    def radius(self, sample: np.ndarray, least_cosine: float, target_recall: float) -> float:
        """The bound up to which cells are visited."""
        most = 2 * (1 - least_cosine) + 1e-9
        if target_recall >= 1:
            return most
        rng = np.random.default_rng(1)
        x = sample[rng.integers(len(sample), size=PROBES)]
        aside = rng.standard_normal(x.shape)
        aside -= (aside * x).sum(1)[:, None] * x
        aside /= np.maximum(np.sqrt((aside * aside).sum(1)), 1e-300)[:, None]
        moved = least_cosine * x + np.sqrt(1 - least_cosine**2) * aside
        (_, b1), (_, b2) = self.bounds(x)
        (n1, _), (n2, _) = self.bounds(moved)
        at = np.arange(len(x))
        return min(most, WIDER * float(np.quantile(b1[at, n1] + b2[at, n2], target_recall)) + 1e-9)

    def visits(self, first: np.ndarray, second: np.ndarray, most: float) -> list[int]:
        """Cells in the order of their bound until it passes ``most``."""
        a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
        heap, seen, out = [(float(first[a[0]] + second[b[0]]), 0, 0)], {(0, 0)}, []
        while heap:
            bound, i, j = heapq.heappop(heap)
            if bound > most:
                break
            out.append(int(a[i]) * len(second) + int(b[j]))
            for p in ((i + 1, j), (i, j + 1)):
                if p[0] < len(a) and p[1] < len(b) and p not in seen:
                    seen.add(p)
                    heapq.heappush(heap, (float(first[a[p[0]]] + second[b[p[1]]]), *p))
        return out


def linked(members: np.ndarray, ids: np.ndarray, sizes: np.ndarray, queries: np.ndarray, q_ids: np.ndarray, least: float):
    """Links of the queries to the members: (query id, count) and forest edges."""
    label = np.arange(len(ids))
    counts, edges = [], []
    for at in range(0, len(queries), 1024):
        hits = queries[at : at + 1024] @ members.T >= least
        own = q_ids[at : at + 1024]
        hits &= own[:, None] != ids[None, :]
        for i in np.flatnonzero(hits.any(1)):
            found = np.flatnonzero(hits[i])
            counts.append((int(own[i]), int(sizes[found].sum())))
            labels = np.unique(label[found])
            if len(labels) > 1:
                label[np.isin(label, labels)] = labels[0]
            edges.append((int(own[i]), int(ids[labels[0]])))
    edges += [(int(ids[i]), int(ids[j])) for i, j in enumerate(label) if i != j]
    return counts, edges


def near_duplicates(
    df: DataFrame,
    least_cosine: float = 0.98,
    target_recall: float = 0.9999,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """One row per input row: (id, n_links, component_id, kept)."""
    spark = prepare(df.sparkSession)
    label_type = df.schema[label_col].dataType.simpleString()
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = []
            for i, label, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = None
                if i is not None and label is not None and v and None not in v:
                    raw = np.asarray(v, "<f8") + 0.0  # one zero
                    raw = raw.tobytes()
                    raw = raw if unit(raw) is not None else None
                raws.append(raw)
            yield batch_of({"id": batch.column(0), "label": batch.column(1), "raw": raws}, {"raw": pa.binary()})

    packed = rows.mapInArrow(pack, f"id long, label {label_type}, raw binary")
    classes = packed.where("raw is not null").groupBy("label", "raw").agg(F.min("id").alias("c"), F.count("*").alias("size")).checkpoint()
    n = classes.count()
    sample = classes.select("raw").orderBy(F.xxhash64("raw"), "raw").limit(SAMPLE).collect()
    by_length: dict[int, list[np.ndarray]] = {}
    for r in sample:
        v = unit(bytes(r["raw"]))
        by_length.setdefault(len(v), []).append(v)
    k = int(min(MOST_CENTROIDS, max(2, round((n / PER_CELL) ** 0.5))))
    grids = {d: Grid(np.array(x), min(k, len(x))) for d, x in by_length.items()}
    radius = {d: grids[d].radius(np.array(x), least_cosine, target_recall) for d, x in by_length.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"cell": pa.int64(), "own": pa.bool_()}
        for batch in batches:
            raws = [bytes(x) for x in batch.column(1).to_pylist()]
            rows, cells, own = [], [], []
            for d in {len(x) for x in raws}:
                at = [i for i, x in enumerate(raws) if len(x) == d]
                x = np.array([unit(raws[i]) for i in at])
                grid = grids.get(d // 8)
                if grid is None:  # a length that the sample lacks: one cell for all
                    for i in at:
                        rows += [i, i]
                        cells += [-d, -d]
                        own += [True, False]
                    continue
                (n1, b1), (n2, b2) = grid.bounds(x)
                for j, i in enumerate(at):
                    rows.append(i)
                    cells.append(int(n1[j]) * b2.shape[1] + int(n2[j]) + d * 10**6)
                    own.append(True)
                    seen = grid.visits(b1[j], b2[j], radius[d // 8])
                    rows += [i] * len(seen)
                    cells += [c + d * 10**6 for c in seen]
                    own += [False] * len(seen)
            take = pa.array(rows, pa.int64())
            cols = {name: batch.column(j).take(take) for j, name in enumerate(("label", "raw", "c", "size"))}
            yield batch_of(cols | {"cell": cells, "own": own}, types)

    placed = classes.select("label", "raw", "c", "size").mapInArrow(place, f"label {label_type}, raw binary, c long, size long, cell long, own boolean")
    blocks = placed.where("own").groupBy("label", "cell").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    dealt = placed.join(blocks, ["label", "cell"]).select(
        "*",
        F.explode(
            F.when(F.col("own"), F.array(F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
        ).alias("block"),
    )
    dealt = dealt.repartition("label", "cell", "block").sortWithinPartitions("label", "cell", "block", F.col("own").desc())

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"a": pa.int64(), "b": pa.int64(), "n": pa.int64()}
        now, members, queries = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if members and queries:
                counts, edges = linked(
                    np.array([m[0] for m in members]), np.array([m[1] for m in members]), np.array([m[2] for m in members]),
                    np.array([q[0] for q in queries]), np.array([q[1] for q in queries]), least_cosine,
                )
                if counts or edges:
                    out = [(a, None, n) for a, n in counts] + [(a, b, None) for a, b in edges]
                    yield batch_of(dict(zip(types, map(list, zip(*out)))), types)

        for batch in batches:
            for label, cell, block, own, raw, c, size in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if (label, cell, block) != now:
                    yield from flush()
                    now, members, queries = (label, cell, block), [], []
                if own:
                    members.append((unit(bytes(raw)), c, size))
                else:
                    queries.append((unit(bytes(raw)), c))
                    if len(queries) >= BLOCK:
                        yield from flush()
                        queries = []
        yield from flush()

    met = dealt.select("label", "cell", "block", "own", "raw", "c", "size").mapInArrow(meet, "a long, b long, n long").checkpoint()
    links = met.where("n is not null").groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("others"))
    groups = components(met.where("b is not null").select("a", "b")).withColumnRenamed("id", "c")
    known = (
        classes.join(links, "c", "left")
        .join(groups, "c", "left")
        .select("label", "raw", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "c").alias("component_id"))
    )
    return packed.join(known, ["label", "raw"], "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"),
    )
