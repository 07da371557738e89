"""Lines of a page by the margins that they share, and answers put back on the pages they belong to."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ship_package


def shared(df: DataFrame, keys: list[str], value: str, gap: float, support: int, name: str) -> DataFrame:
    """Whether the value lies in a run of at least ``support`` values of its key without a gap of over ``gap``."""
    order = Window.partitionBy(*keys).orderBy(value)
    starts = df.withColumn("_new", F.coalesce(F.col(value) - F.lag(value).over(order) > gap, F.lit(True)).cast("long"))
    runs = starts.withColumn("_run", F.sum("_new").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    size = F.count(value).over(Window.partitionBy(*keys, "_run"))
    return runs.withColumn(name, F.col(value).isNotNull() & (size >= support)).drop("_new", "_run")


def justified(df: DataFrame, keys: list[str], left: str, right: str, gap: float, support: int = 3) -> DataFrame:
    """Lines whose two ends both lie on a margin that ``support`` lines of the page share: column ``justified``."""
    both = shared(shared(df, keys, left, gap, support, "_l"), keys, right, gap, support, "_r")
    return both.withColumn("justified", F.col("_l") & F.col("_r")).drop("_l", "_r")


def margin_runs(values: np.ndarray, tolerance: float) -> np.ndarray:
    """Run number of each value: the margin that most values are near to goes first, then the next of what is left.

    Of margins with as many values the one of the earliest value wins; a run holds what is near the median of its
    values. Two values or fewer are one run.
    """
    values = np.asarray(values, float)
    run = np.zeros(len(values), np.int64)
    left, number = np.arange(len(values) if len(values) > 2 else 0), 0
    while len(left):
        x = values[left]
        line = np.sort(x)
        near = np.searchsorted(line, x + tolerance, "right") - np.searchsorted(line, x - tolerance, "left")
        middle = np.median(x[np.abs(x - x[near.argmax()]) <= tolerance])
        mine = np.abs(x - middle) <= tolerance
        if not mine.any():  # an even number of values whose median is near to none of them
            mine = np.abs(x - x[near.argmax()]) <= tolerance
        run[left[mine]], left, number = number, left[~mine], number + 1
    return run


def left_runs(df: DataFrame, keys: list[str], place: str, left: str, tolerance: float) -> DataFrame:
    """Lines of a block (rows of a key, by place) with the number of the left margin that they share; a block fits a task."""
    ship_package(df.sparkSession)
    runs = F.pandas_udf(lambda blocks: blocks.map(lambda x: margin_runs(x, tolerance)), "array<long>")
    block = F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.col(left).cast("double").alias("x"))))
    x = df.where(F.col(left).isNotNull()).groupBy(*keys).agg(block.alias("_b"))
    x = x.select(*keys, "_b", runs(F.transform("_b", lambda v: v["x"])).alias("_r"))
    return x.select(*keys, F.inline(F.zip_with("_b", "_r", lambda v, r: F.struct(v["p"].alias(place), r.alias("run")))))


def anchors(df: DataFrame, keys: list[str], place: str, left: str, right: str, tolerance: float = 0.06) -> DataFrame:
    """Which lines of a page start at its left margin, end at its right one, or both: at_left, at_right, full.

    The margins are medians over the widest lines (40 %, three at least; of equal ones the first by place), the
    tolerance is a share of their median width. Pages of fewer than three lines are all anchors.
    """
    page = Window.partitionBy(*keys)
    width = F.col(right) - F.col(left)
    x = df.withColumn("_w", width).withColumn("_n", F.count("*").over(page))
    x = x.withColumn("_k", F.row_number().over(page.orderBy(F.desc("_w"), place)))
    seed = lambda c: F.median(F.when(F.col("_k") <= F.greatest(F.lit(3), F.floor(F.col("_n") * 0.4)), c)).over(page)
    few, reach = F.col("_n") < 3, seed(F.col("_w")) * tolerance
    x = x.withColumn("at_left", few | (F.abs(F.col(left) - seed(F.col(left))) <= reach))
    x = x.withColumn("at_right", few | (F.abs(F.col(right) - seed(F.col(right))) <= reach))
    return x.withColumn("full", F.col("at_left") & F.col("at_right")).drop("_w", "_n", "_k")


def pitch_vanishing_point(ys: np.ndarray, index: np.ndarray | None = None, x: float = 0.0) -> np.ndarray | None:
    """Where lines that are evenly spaced on the page crowd together: the pole of the map from height to line number.

    None with fewer than four lines, or when they are evenly spaced in the picture too.
    """
    ys = np.asarray(ys, float).ravel()
    index = np.arange(len(ys), dtype=float) if index is None else np.asarray(index, float).ravel()
    if len(ys) < 4:
        return None
    pole = np.linalg.lstsq(np.stack([ys, np.ones(len(ys)), -index * ys], 1), index, rcond=None)[0][2]
    return None if abs(pole) < 1e-10 else np.array([x, -1 / pole, 1.0])


def assembled(dims: DataFrame, answers: DataFrame, key: str, place: str, sent: Column, width: str, height: str, markdown: str) -> DataFrame:
    """Each page that was sent with the answer of its place; pages from place ``sent`` on were cut off and say so.

    Places start at 0; one answer a place. Columns: key, place, width, height, markdown (empty where the answer is
    missing), truncated.
    """
    x = dims.join(answers.select(key, place, F.col(markdown).alias("_md")), [key, place], "left")
    cut = F.col(place) >= sent
    return x.select(key, place, width, height, F.when(~cut, F.coalesce("_md", F.lit(""))).alias(markdown), cut.alias("truncated"))
