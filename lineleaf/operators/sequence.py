"""Order-sensitive operators: sessions, intervals, gaps, rolling statistics.

Windows are partitioned by the caller's key (a page, a branch, a user); a sequence without a key goes through
``numbered``, which ranks over sorted ranges instead of one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """Rows numbered over the whole table: counts of the sorted ranges first, then numbers within each.

    The counts are one row a range, so nothing but them meets in one place.
    """
    from .relational import ensure_checkpoints

    ensure_checkpoints(df.sparkSession)
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")).checkpoint()
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_low"))
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = F.broadcast(sizes.select("_part", "_low", F.coalesce(before, F.lit(0)).alias("_before")))  # one row a range
    return parts.join(offsets, "_part").select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_low") + start).alias(name))


def sessions(df: DataFrame, keys: list[str], order: list[str], breaks: Column, name: str = "session") -> DataFrame:
    """Number of breaks up to each row: gaps and islands."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_b", breaks).withColumn(name, F.sum(F.when(F.col("_b"), 1).otherwise(0)).over(w)).drop("_b")


def gap_sessions(df: DataFrame, keys: list[str], at: str, order: list[str], gap: Column, name: str = "session") -> DataFrame:
    """A new session where the step from the row before is larger than the gap."""
    w = Window.partitionBy(*keys).orderBy(*order)
    step = F.col(at) - F.lag(at).over(w)
    return sessions(df.withColumn("_step", step), keys, order, F.coalesce(F.col("_step") > gap, F.lit(False)), name).drop("_step")


def median_gap_blocks(df: DataFrame, keys: list[str], at: str, order: list[str], mult: float = 2.5, least: float = 4.0, name: str = "block") -> DataFrame:
    """Blocks cut where a step passes ``mult`` times the median positive step, at least ``least``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    stepped = df.withColumn("_step", F.col(at) - F.lag(at).over(w))
    medians = stepped.where("_step > 0").groupBy(*keys).agg(F.greatest(F.percentile("_step", F.lit(0.5)), F.lit(float(least))).alias("_med"))
    joined = stepped.join(medians, keys, "left")
    return sessions(joined, keys, order, F.coalesce(F.col("_step") > F.col("_med") * mult, F.lit(False)), name).drop("_step", "_med")


def supported(df: DataFrame, keys: list[str], at: str, order: list[str], gap: float, support: int, name: str = "supported") -> DataFrame:
    """Whether a value lies in a cluster (steps of at most ``gap``) of at least ``support`` values."""
    g = gap_sessions(df, keys, at, order, F.lit(gap), "_cluster")
    return g.withColumn(name, F.count("*").over(Window.partitionBy(*keys, "_cluster")) >= support).drop("_cluster")


def merged_intervals(df: DataFrame, keys: list[str], low: str, high: str, gap: Column | None = None) -> DataFrame:
    """Unions of intervals; touching ones stay apart without a gap, with one they join up to it."""
    w = Window.partitionBy(*keys).orderBy(low, high)
    top = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col(low) >= F.col("_top") if gap is None else F.col(low) > F.col("_top") + gap
    runs = sessions(df.withColumn("_top", top), keys, [low, high], F.coalesce(apart, F.lit(False)), "_run")
    return runs.groupBy(*keys, "_run").agg(F.min(low).alias(low), F.max(high).alias(high), F.count("*").alias("n")).drop("_run")


def true_runs(df: DataFrame, keys: list[str], order: str, flag: str, least: int = 1, gap: int = 0) -> DataFrame:
    """Runs of true rows, joined over up to ``gap`` false ones, of at least ``least`` rows from end to end."""
    true = df.where(F.col(flag))
    w = Window.partitionBy(*keys).orderBy(order)
    runs = sessions(true.withColumn("_d", F.col(order) - F.lag(order).over(w)), keys, [order], F.coalesce(F.col("_d") > gap + 1, F.lit(False)), "_run")
    out = runs.groupBy(*keys, "_run").agg(F.min(order).alias("start"), F.max(order).alias("end"))
    return out.where(F.col("end") - F.col("start") + 1 >= least).drop("_run")


def split_at_largest(df: DataFrame, keys: list[str], at: str, order: list[str], k: int, name: str = "cluster") -> DataFrame:
    """Sorted values cut at their k - 1 largest steps (of equals the first)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    stepped = df.withColumn("_step", F.col(at) - F.lag(at).over(w)).withColumn("_no", F.row_number().over(w))
    ranked = stepped.withColumn("_rank", F.when(F.col("_step") > 0, F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("_step"), "_no"))))
    return sessions(ranked, keys, ["_no"], F.coalesce(F.col("_rank") <= k - 1, F.lit(False)), name).drop("_step", "_no", "_rank")


def rolling_percentiles(df: DataFrame, keys: list[str], order: list[str], value: str, rows: int = 300) -> DataFrame:
    """p5, median and p95 of the last rows: nearest rank with half-even rounding at the ends, a true median."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(rows - 1), Window.currentRow)
    sorted_ = df.withColumn("_v", F.array_sort(F.collect_list(value).over(w)))
    n = F.size("_v")
    rank = lambda q: F.element_at("_v", (F.bround((n - 1) * F.lit(q)) + 1).cast("int"))
    mid = (F.element_at("_v", F.floor((n - 1) / 2).cast("int") + 1) + F.element_at("_v", F.floor(n / 2).cast("int") + 1)) / 2
    return sorted_.select(*df.columns, rank(0.05).alias("p5"), mid.alias("median"), rank(0.95).alias("p95"))


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The element at half the size, rounded down, of the sorted values, by rank and count."""
    w = Window.partitionBy(*keys)
    ranked = df.select(*keys, value, F.row_number().over(w.orderBy(value)).alias("_k"), F.count("*").over(w).alias("_n"))
    return ranked.where("_k = _n div 2 + 1").select(*keys, F.col(value).alias("upper_median"))


def occurrence(df: DataFrame, keys: list[str], order: list[str], name: str = "occurrence") -> DataFrame:
    """How often a key has come up to a row, itself included."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def ratio_to_max(df: DataFrame, keys: list[str], value: str, least: float) -> DataFrame:
    """Rows with at least this share of their key's greatest value; keys of one row stay."""
    w = Window.partitionBy(*keys)
    return df.withColumn("_m", F.max(value).over(w)).withColumn("_n", F.count("*").over(w)).where((F.col("_n") == 1) | (F.col(value) >= F.col("_m") * least)).drop("_m", "_n")


def trimmed_extent(df: DataFrame, keys: list[str], low: str, high: str, width: Column, share: float = 0.1, least: int = 4) -> DataFrame:
    """Extent of the boxes of a key, walked in from both ends while the step to the next is over a share of the width."""
    a, z = Window.partitionBy(*keys).orderBy(low), Window.partitionBy(*keys).orderBy(F.desc(high))
    far = lambda step: F.coalesce(step > width * share, F.lit(False))
    x = df.withColumn("_l", F.lead(low).over(a) - F.col(low)).withColumn("_h", F.col(high) - F.lead(high).over(z))
    x = x.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    x = x.withColumn("_cl", F.min(F.when(far(F.col("_l")) & (F.col("_n") >= least), 0).otherwise(1)).over(a)).withColumn("_ch", F.min(F.when(far(F.col("_h")) & (F.col("_n") >= least), 0).otherwise(1)).over(z))
    return x.groupBy(*keys).agg(F.min(F.when(F.col("_cl") == 1, F.col(low))).alias(low), F.max(F.when(F.col("_ch") == 1, F.col(high))).alias(high))


def event_batches(df: DataFrame, keys: list[str], order: list[str], batched: Column, size: int = 64) -> DataFrame:
    """Consecutive batched rows in chunks of ``size``; any other row ends the batch and stands alone."""
    w = Window.partitionBy(*keys).orderBy(*order)
    x = df.withColumn("_in", batched)
    x = sessions(x, keys, order, F.coalesce(~F.col("_in") | ~F.lag("_in").over(w), F.lit(True)), "_run")
    k = F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(*order)) - 1
    x = x.withColumn("_chunk", F.floor(k / size))
    return x.groupBy(*keys, "_run", "_chunk").agg(F.count("*").alias("n"), F.min(order[-1]).alias("first_id"), F.first("_in").alias("batched")).drop("_run", "_chunk")


def chunks_by_caps(df: DataFrame, keys: list[str], order: list[str], weight: str, most: int, most_rows: int) -> DataFrame:
    """Greedy consecutive chunks within a weight and a row limit; what alone passes the limit is a chunk.

    The cut depends on all cuts before it, so a key's rows are folded in order, streamed, not collected.
    """
    from ..runtime import ship_package

    ship_package(df.sparkSession)
    names = [*keys, order[-1], weight]
    rows = df.select(*keys, *[c for c in order if c not in keys], weight).repartition(*keys).sortWithinPartitions(*keys, *order).select(*names)

    def run(frames):
        now, chunk, total, count = None, 0, 0, 0
        for pdf in frames:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                key, w = row[: len(keys)], row[-1]
                if key != now:
                    now, chunk, total, count = key, 0, 0, 0
                elif total + w > most or count >= most_rows:
                    chunk, total, count = chunk + 1, 0, 0
                total, count = total + w, count + 1
                out.append(chunk)
            yield pdf.assign(chunk=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, schema + ", chunk long")


def capped_prefix(df: DataFrame, keys: list[str], order: list[str], weight: str, most: int) -> DataFrame:
    """The longest prefix of a key whose weights stay within the limit."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_sum", F.sum(weight).over(w)).where(F.col("_sum") <= most).drop("_sum")
