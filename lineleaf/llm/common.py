"""Shared pieces: checkpoints, batch sizes, row keys, word hashes and connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship_package

#: Rows that go to a Python worker at once. Texts may be long, so batches are also bounded in bytes.
BATCH_ROWS = 256
BATCH_BYTES = 8 * 1024 * 1024


def prepare(spark: SparkSession) -> SparkSession:
    """Ships the package, bounds the Arrow batches, and makes sure that there is a checkpoint folder.

    The folder named by ``spark.checkpoint.dir`` is used where it is set; only without it (single
    machine, tests) a temporary one is made.
    """
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    # shuffle files go when the query that made them ends, and not when the driver happens to collect garbage
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lineleaf-checkpoint-"))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_texts(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """mapInArrow on the given columns only, so that the scan reads no other."""
    prepare(df.sparkSession)
    return df.mapInArrow(function, schema)


def batch_of(columns: dict[str, object], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [x if isinstance(x, pa.Array) else pa.array(x, types[k]) for k, x in columns.items()], names=list(columns)
    )


class WordHash(dict):
    """Bytes of a word -> 64-bit hash. Forgets everything when full, so its size is bounded."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value


WORDS = WordHash()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word windows, from the words' hashes."""
    if len(words) < n:
        return words[:0]
    count = len(words) - n + 1
    total = mixed(words[:count])
    for i in range(1, n):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + words[i : i + count])
    return total


def written(df: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The rows written as a table into the checkpoint folder and read again; smaller than checkpoint()."""
    spark = prepare(df.sparkSession)
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{folder}/lineleaf-{uuid.uuid4().hex}"
    if scratch is not None:
        scratch.folders.append(path)
    else:  # results are read until the application ends
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables that go when the block ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, []

    def __enter__(self) -> Scratch:
        return self

    def table(self, df: DataFrame) -> DataFrame:
        return written(df, self)

    def __exit__(self, *_: object) -> None:
        context = self.spark.sparkContext
        for path in self.folders:
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


#: Edges that one task joins to a forest in memory.
FOREST_EDGES = 400_000


def local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars (a, b), b the smallest id, of the components of a partition's edges."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (y := up.setdefault(root, root)) != root:
            root = y
        while (y := up[x]) != root:
            up[x] = root
            x = y
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    stars = [(x, find(x)) for x in list(up)]
    stars = [s for s in stars if s[0] != s[1]]
    for at in range(0, len(stars), 100_000):
        a, b = zip(*stars[at : at + 100_000])
        yield batch_of({"a": a, "b": b}, {"a": pa.int64(), "b": pa.int64()})


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (id, component) with the smallest id reachable.

    Partitions of at most ``FOREST_EDGES`` edges are joined to forests each, which shrinks the edges; if
    there was more than one partition, large-star and small-star rounds follow: each is a few shuffles on
    the edges that are left, their number is logarithmic, and the edges are written to the checkpoint
    folder after each, so a lost executor costs one round. A vertex of very high degree is the centre of a
    star, and stars are aggregated with partial minima and joined, never gathered.
    """
    spark = prepare(edges.sparkSession)
    with Scratch(spark) as scratch:
        given = scratch.table(edges.where("a is not null and b is not null and a <> b").select("a", "b"))
        parts = -(-given.count() // FOREST_EDGES)
        now = given.coalesce(max(1, parts)).mapInArrow(local_forest, "a long, b long")
        now = settled_stars(now, most_rounds) if parts > 1 else written(now)
    stars = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return stars.union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def settled_stars(edges: DataFrame, most_rounds: int) -> DataFrame:
    """Edges (a, b), b < a, each a once and no b an a, of the same components."""
    now, before = edges.checkpoint(), None
    for _ in range(most_rounds):
        mark = now.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        mark = (mark["n"], mark["x"])
        if mark == before or not mark[0]:
            return now
        before = mark
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (
            both.where("b > a")
            .join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        now = small.checkpoint()
    raise RuntimeError("the components did not settle")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; LINELEAF_TOKENIZERS names another folder."""
    if folder := os.environ.get("LINELEAF_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
