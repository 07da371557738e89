"""Catalogue operators: versions, states, lineage and rewrites, as DataFrame functions.

All of them are built from partial aggregates and equi-joins; none collects rows, and where the newest row
of a group is wanted, the greatest struct is aggregated instead of sorting the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the one with the greatest order columns (a total order is up to the caller).

    ``max_by`` of structs is combined before the shuffle, so a key with very many rows costs one row a task.
    """
    rest = [c for c in df.columns if c not in keys]
    top = F.max_by(F.struct(*rest), F.struct(*order)).alias("_top")
    return df.groupBy(*keys).agg(top).select(*keys, *(F.col(f"_top.{c}").alias(c) for c in rest)).select(*df.columns)


def next_number(df: DataFrame, keys: list[str], number: str, name: str = "next") -> DataFrame:
    """The greatest number and one; 1 for nulls only."""
    return df.groupBy(*keys).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias(name))


def status_map(branches: DataFrame, runs: DataFrame, keys: list[str], chosen: str, ran_on: str, order: list[str]) -> DataFrame:
    """State of each branch by its newest run: none, fresh (made from the chosen node) or stale."""
    top = newest(runs.select(*keys, ran_on, *[o for o in order if o != ran_on]), keys, order)
    joined = branches.join(top, keys, "left")
    state = (
        F.when(F.col(ran_on).isNull(), "none").when(F.col(ran_on) == F.col(chosen), "fresh").otherwise("stale").alias("state")
    )
    return joined.select(*[branches[c] for c in keys], state)


def needing_run(branches: DataFrame, runs: DataFrame, keys: list[str], usable: Column | None = None) -> DataFrame:
    """Branches without a (usable) run."""
    return branches.join(runs if usable is None else runs.where(usable), keys, "left_anti")


def unreferenced(df: DataFrame, key: str, *references: DataFrame) -> DataFrame:
    """Rows whose key none of the one-column references holds; null references are no references."""
    for r in references:
        df = df.join(r.select(F.col(r.columns[0]).alias(key)).where(F.col(key).isNotNull()), key, "left_anti")
    return df


def insert_absent(df: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Appends new rows whose key isn't there yet, each key once."""
    return df.unionByName(new.dropDuplicates([key]).join(df.select(key), key, "left_anti").select(*df.columns))


def upsert(df: DataFrame, new: DataFrame, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """New rows replace those of equal keys, but for the columns of ``keep``, which stay as they were."""
    old = df.select(*keys, *(F.col(c).alias(f"_old_{c}") for c in keep))
    merged = new.join(old, keys, "left").select(
        *(F.coalesce(f"_old_{c}", c).alias(c) if c in keep else F.col(c) for c in df.columns)
    )
    return df.join(new.select(*keys), keys, "left_anti").unionByName(merged)


def replace_done(runs: DataFrame, keys: list[str], done: Column, order: list[str]) -> DataFrame:
    """Of the finished rows of a key only the newest stays; unfinished ones stay."""
    return runs.where(~done | done.isNull()).unionByName(newest(runs.where(done), keys, order))


def closure(edges: DataFrame, node: str, parent: str, most_depth: int = 1 << 20) -> DataFrame:
    """All pairs (node, ancestor, distance) of a tree by pointer doubling: log(depth) joins.

    Every round is written to the checkpoint folder. Cycles are cut at ``most_depth``.
    """
    spark = edges.sparkSession
    ensure_checkpoints(spark)
    pairs = edges.where(F.col(parent).isNotNull()).select(
        F.col(node).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).alias("distance")
    ).checkpoint()
    reach = 1
    while reach < most_depth:
        onward = pairs.where(F.col("distance") <= reach).alias("b")
        far = (
            pairs.where(F.col("distance") == reach)
            .alias("a")
            .join(onward, F.col("a.ancestor") == F.col("b.node"))
            .select("a.node", "b.ancestor", (F.col("a.distance") + F.col("b.distance")).alias("distance"))
        ).checkpoint()
        if far.isEmpty():
            break
        pairs = pairs.unionByName(far)
        reach *= 2
    return pairs


def ensure_checkpoints(spark) -> None:
    import tempfile

    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="lineleaf-checkpoint-"))


def prune(nodes: DataFrame, keep: DataFrame, node: str, parent: str, root: str) -> DataFrame:
    """Only kept nodes stay; those that aren't roots hang from their root."""
    kept = nodes.join(keep.select(node).distinct(), node, "left_semi")
    return kept.withColumn(parent, F.when(F.col(node) == F.col(root), F.lit(None).cast("long")).otherwise(F.col(root)))


def positional(left: DataFrame, right: DataFrame, key: str, left_list: str, right_list: str, fill: Column) -> DataFrame:
    """Elements of two arrays side by side by place; a short right side is filled up."""
    a = left.select(key, F.posexplode(left_list).alias("place", "left_value"))
    b = right.select(key, F.posexplode(right_list).alias("place", "right_value"))
    return a.join(b, [key, "place"], "left").withColumn("right_value", F.coalesce("right_value", fill))


def dominant(df: DataFrame, value: str) -> DataFrame:
    """The most frequent value, of equals the least; one row."""
    return df.groupBy(value).count().orderBy(F.desc("count"), F.asc_nulls_last(value)).limit(1)
