"""Rewrites of catalogue tables: each takes tables and commands as DataFrames and returns the whole new table.

A command table holds one row a key (the last one, where several come). All rewrites are equi-joins and partial
aggregates; nothing is collected. A null key matches nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import ensure_checkpoints


def placed(df: DataFrame, keys: list[str], order: list, name: str = "place") -> DataFrame:
    """Rows with their place (from 1) within their keys."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def updated(df: DataFrame, commands: DataFrame, keys: list[str], fields: dict[str, Column]) -> DataFrame:
    """Rows with a command get new fields, expressions over the row's own columns and the command's; others stay."""
    told = commands.withColumn("_told", F.lit(True))
    joined = df.join(told, keys, "left")
    return joined.select(*(F.when(F.col("_told"), fields[c]).otherwise(df[c]).alias(c) if c in fields else df[c] for c in df.columns))


def started_runs(runs: DataFrame, commands: DataFrame, keys: list[str], version: str, status: str = "running") -> DataFrame:
    """Appends a run for each command, with the next version of its keys; several commands of a key go on counting."""
    top = runs.groupBy(*keys).agg(F.max(version).alias("_top"))
    w = Window.partitionBy(*keys).orderBy(*[c for c in commands.columns if c not in keys] or keys)
    new = commands.withColumn("_n", F.row_number().over(w)).join(top, keys, "left")
    new = new.withColumn(version, (F.coalesce("_top", F.lit(0)) + F.col("_n")).cast(runs.schema[version].dataType)).withColumn("status", F.lit(status))
    return runs.unionByName(new.drop("_top", "_n"), allowMissingColumns=True)


def failed_runs(runs: DataFrame, commands: DataFrame, run: str) -> DataFrame:
    """Runs named by a command (run, error) have the status error and its text."""
    return updated(runs, commands.withColumnRenamed("error", "_error"), [run], {"status": F.lit("error"), "error_text": F.col("_error")})


def restaled(runs: DataFrame, branches: DataFrame, keys: list[str], scans: DataFrame | None = None) -> DataFrame:
    """is_stale anew: 0 for runs on their branch's chosen node, 1 for all others; of the given scans only."""
    one = branches.groupBy(*keys).agg(F.min("chosen").alias("_chosen"))
    x = runs.join(one, keys, "left")
    new = F.when(F.col("node_id") == F.col("_chosen"), 0).otherwise(1)
    if scans is not None:
        name = scans.columns[0]
        x = x.join(scans.select(name).distinct().withColumn("_told", F.lit(True)), name, "left")
        new = F.when(F.col("_told"), new).otherwise(F.col("is_stale"))
    return x.withColumn("is_stale", new).select(*runs.columns)


def switched_engine(runs: DataFrame, engine: str) -> DataFrame:
    """Finished runs of other engines become stale."""
    flip = (F.col("status") == "done") & (F.col("engine") != engine)
    return runs.withColumn("is_stale", F.when(flip, 1).otherwise(F.col("is_stale")))


def upserted_nodes(nodes: DataFrame, new: DataFrame, keys: list[str], number: str, stays: list[str]) -> DataFrame:
    """New rows take over the number and the ``stays`` columns of the row with their keys; others are numbered on."""
    old = nodes.select(*keys, F.col(number).alias("_number"), *(F.col(c).alias(f"_{c}") for c in stays))
    joined = new.join(old, keys, "left")
    known = joined.where("_number is not null")
    kept = known.select(*(F.coalesce(f"_{c}", c).alias(c) if c in stays else F.col("_number").alias(c) if c == number else F.col(c) for c in nodes.columns))
    absent = joined.where("_number is null")
    top = nodes.agg(F.coalesce(F.max(number), F.lit(0)).alias("_top"))
    # numbers go on within ranges of a hash, whose sizes are added up first: no single sort of all new rows
    part = F.pmod(F.xxhash64(*keys), F.lit(64))
    absent = absent.withColumn("_part", part).withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*keys)))
    sizes = absent.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.orderBy("_part")) - F.col("_size"))  # 64 rows
    added = absent.join(F.broadcast(before), "_part").crossJoin(F.broadcast(top))  # one row
    added = added.withColumn(number, F.col("_top") + F.col("_before") + F.col("_at")).select(*nodes.columns)
    return nodes.join(new.select(*keys), keys, "left_anti").unionByName(kept).unionByName(added)


def below(nodes: DataFrame, roots: DataFrame, node: str, parent: str, most_depth: int = 100_000) -> DataFrame:
    """(node) of all rows below the given ones, level by level from these roots; each level is checkpointed."""
    ensure_checkpoints(nodes.sparkSession)
    edges = nodes.where(F.col(parent).isNotNull()).select(F.col(node).alias("_n"), F.col(parent).alias("_p"))
    found = front = roots.select(F.col(roots.columns[0]).alias("_n")).distinct().checkpoint()
    start = front
    for _ in range(most_depth):
        front = edges.join(front.select(F.col("_n").alias("_p")), "_p", "left_semi").select("_n").join(found, "_n", "left_anti").checkpoint()
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found.join(start, "_n", "left_anti").select(F.col("_n").alias(node))


def without_subtree(nodes: DataFrame, roots: DataFrame, node: str, parent: str, include_self: bool = False) -> DataFrame:
    gone = below(nodes, roots, node, parent)
    if include_self:
        gone = gone.unionByName(roots.select(F.col(roots.columns[0]).alias(node)))
    return nodes.join(gone, node, "left_anti")


def reprocessed(nodes: DataFrame, runs: DataFrame, images: DataFrame, scans: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, runs and images after the scans' derived nodes went: their runs hang from the root and are stale, and
    images that only those nodes held are gone.

    nodes (id, scan_id, parent_id, image_id), runs (run_id, scan_id, node_id, is_stale), images (image_id).
    """
    told = scans.select(F.col(scans.columns[0]).alias("scan_id")).distinct()
    derived = nodes.where("parent_id is not null").join(told, "scan_id", "left_semi")
    left = nodes.join(derived.select("id"), "id", "left_anti")
    roots = nodes.where("parent_id is null").join(told, "scan_id", "left_semi").groupBy("scan_id").agg(F.min("id").alias("_root"))
    moved = runs.join(roots, "scan_id", "left")
    moved = moved.withColumn("node_id", F.coalesce("_root", "node_id")).withColumn("is_stale", F.when(F.col("_root").isNotNull(), 1).otherwise(F.col("is_stale")))
    dropped = derived.where("image_id is not null").select("image_id").distinct().join(left.select("image_id"), "image_id", "left_anti")
    return left, moved.select(*runs.columns), images.join(dropped, "image_id", "left_anti")


def toggled(branches: DataFrame, commands: DataFrame) -> DataFrame:
    """trashed by commands (scan_id, label, hidden): the branch of that path or ending in it; an empty label means the
    root row (path empty or null) or else the scan's only branch. Commands that match nothing do nothing."""
    per_scan = branches.groupBy("scan_id").agg(F.count("*").alias("_n"), F.count_if(F.coalesce("path", F.lit("")) == "").alias("_roots"))
    x = branches.join(per_scan, "scan_id").join(commands.withColumnRenamed("label", "_label"), "scan_id", "left")
    path = F.coalesce("path", F.lit(""))
    by_label = (F.col("_label") != "") & ((path == F.col("_label")) | path.endswith(F.concat(F.lit("."), F.col("_label"))))
    by_root = (F.col("_label") == "") & ((path == "") | ((F.col("_roots") == 0) & (F.col("_n") == 1)))
    told = F.coalesce(by_label | by_root, F.lit(False))
    last = F.max(F.when(told, F.col("hidden").cast("int")))  # of several commands on a branch, hiding wins
    return x.groupBy("branch_id", "scan_id", "path", "trashed").agg(last.alias("_h")).select(
        "branch_id", "scan_id", "path", F.coalesce(F.col("_h") == 1, F.col("trashed")).alias("trashed")
    )


def dominant_mode(df: DataFrame, keys: list[str], value: str, width: int) -> DataFrame:
    """Per key the value with most values within ``width`` of it (of equals the least), their count and mean."""
    w = Window.partitionBy(*keys).orderBy(value).rangeBetween(-width, width)
    x = df.select(*keys, value, F.count("*").over(w).alias("n"), F.avg(value).over(w).alias("mean"))
    best = F.max_by(F.struct("n", "mean"), F.struct("n", (-F.col(value)).alias("v"))).alias("b")
    return x.groupBy(*keys).agg(best).select(*keys, "b.n", F.col("b.mean").alias("centre"))
