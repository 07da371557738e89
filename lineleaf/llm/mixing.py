"""Mixing sources to target weights by hierarchical budgeting.

A tree of domains, languages and sources carries weights. The token budget goes down the tree: a node's
children share its budget by weight, and what a child can't use (its documents, ``epochs`` times over,
are all it has) goes to its siblings by weight; only what all siblings together can't use is left to
the node's own siblings. Each leaf then takes whole passes over its documents, and of the next pass
the documents whose tokens before them in that pass's seeded order are below the rest of the budget.

Siblings that share a budget B by weight have a level: the largest value of (B - what the siblings before have) / (the
weights from here on), siblings ordered by what they have for each unit of weight; each gets its weight times that level,
or all it has. So a whole layer of the tree is two windows over its nodes, however many there are.

Defined cases: a null or empty text has no tokens and is never taken; a null domain, language or source is
a child of its own; a child without a weight gets ``default_weight``; weights of 0 take nothing; rows with
equal ids are documents of their own, in the order of ``tie``, and rows with a null id stand at one place of the
order in the order of ``tie``; an empty table gives an empty one; all columns of the input are carried through,
computed ones are named by the caller. Only DataFrame functions; the driver sees the sum of all tokens and the number
of leaves.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Up to so many leaves their plan is broadcast (some 100 bytes a leaf); beyond, rows are salted and shuffled to it.
BROADCAST_LEAVES, SALTS = 50_000, 32
#: Ranges of the seeded order; tokens are summed up by range before any documents are sorted.
RANGES_HEX = 3
Leaf = tuple[str | None, str | None, str | None]


@dataclass(frozen=True)
class Mixture:
    """Weights by path: (domain,), (domain, language) or (domain, language, source)."""

    weights: Mapping[tuple, float] = field(default_factory=dict)
    default_weight: float = 1.0
    epochs: int = 1
    seed: int = 0

    def weight(self, path: tuple) -> float:
        return float(self.weights.get(path, self.default_weight))


def shared_out(budget: float, most: list[float], weights: list[float]) -> list[float]:
    """Shares by weight of a budget, none above its most, what one can't use going to the others."""
    out, open_ = [0.0] * len(most), [i for i, w in enumerate(weights) if w > 0 and most[i] > 0]
    left = min(budget, sum(most[i] for i in open_))
    while open_ and left > 1e-9:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total >= most[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = most[i]
        left -= sum(most[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def budgets(available: Mapping[Leaf, float], budget: float, mixture: Mixture) -> dict[Leaf, float]:
    """Tokens for each leaf."""

    def usable(path: tuple, leaves: list[Leaf]) -> float:
        """What a node's leaves can take, leaving out what a weight of 0 shuts off."""
        if len(path) == 3:
            return available[path] * mixture.epochs
        return sum(usable(p, own) for p, own in children(path, leaves).items() if mixture.weight(p) > 0)

    def children(path: tuple, leaves: list[Leaf]) -> dict[tuple, list[Leaf]]:
        out: dict[tuple, list[Leaf]] = {}
        for leaf in leaves:
            out.setdefault(leaf[: len(path) + 1], []).append(leaf)
        return out

    result: dict[Leaf, float] = {}

    def down(path: tuple, leaves: list[Leaf], own: float) -> None:
        if len(path) == 3:
            result[path] = own
            return
        parts = children(path, leaves)
        shares = shared_out(own, [usable(p, x) for p, x in parts.items()], [mixture.weight(p) for p in parts])
        for (p, x), share in zip(parts.items(), shares):
            down(p, x, share)

    order = sorted(available, key=lambda leaf: [(x is not None, x or "") for x in leaf])
    down((), order, budget)
    return result


def planned_leaves(leaves: DataFrame, budget: int, mixture: Mixture) -> DataFrame:
    """Rows (p_d, p_l, p_s, p_whole, p_rest): whole passes and tokens of the next one, of rows (p_d, p_l, p_s, total)."""
    path = ["p_d", "p_l", "p_s"]
    weights = leaves.sparkSession.createDataFrame(
        [(len(k), *(list(k) + [None, None])[:3], float(w)) for k, w in mixture.weights.items()],
        "depth int, w_d string, w_l string, w_s string, weight double",
    )
    nodes = leaves.withColumn("most", F.col("total").cast("double") * mixture.epochs)
    for depth in (3, 2, 1):  # what each node can use, leaving out what a weight of 0 shuts off
        own, named = path[:depth], [f"w{c[1:]}" for c in path[:depth]]
        given = F.broadcast(weights.where(F.col("depth") == depth).select(*named, "weight"))  # the caller's own table
        same = F.lit(True)
        for c, w in zip(own, named):
            same &= F.col(c).eqNullSafe(F.col(w))
        weight, most = f"weight_{depth}", f"most_{depth}"
        nodes = nodes.join(given, same, "left").drop(*named)
        nodes = nodes.withColumn(weight, F.coalesce("weight", F.lit(mixture.default_weight))).drop("weight")
        if depth == 3:
            nodes = nodes.withColumn(most, F.col("most"))
        else:
            use = F.when(F.col(f"weight_{depth + 1}") > 0, F.col(f"most_{depth + 1}")).otherwise(0.0)
            first = F.row_number().over(Window.partitionBy(*path[: depth + 1]).orderBy(*path)) == 1
            nodes = nodes.withColumn("use", F.when(first, use).otherwise(0.0) if depth < 2 else use)
            nodes = nodes.withColumn(most, F.sum("use").over(Window.partitionBy(*own))).drop("use")
    nodes = nodes.withColumn("share_0", F.lit(float(budget)))
    for depth in (1, 2, 3):
        own, above = path[:depth], path[: depth - 1]
        weight, most, node = F.col(f"weight_{depth}"), F.col(f"most_{depth}"), f"node_{depth}"
        first = F.row_number().over(Window.partitionBy(*own).orderBy(*path)) == 1
        # of each node one row counts among its siblings
        nodes = nodes.withColumn(node, first & (weight > 0) & (most > 0))
        ratio = F.when(F.col(node), most / weight)
        order = Window.partitionBy(*above).orderBy(ratio.asc_nulls_last(), *path)
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        had = F.coalesce(F.sum(F.when(F.col(node), most)).over(before), F.lit(0.0))
        level = F.when(F.col(node), (F.col(f"share_{depth - 1}") - had) / F.sum(F.when(F.col(node), weight)).over(onward))
        nodes = nodes.withColumn("level", level)
        nodes = nodes.withColumn("level", F.max("level").over(Window.partitionBy(*above)))
        share = F.when((weight > 0) & (most > 0), F.least(most, F.greatest(F.lit(0.0), weight * F.col("level")))).otherwise(0.0)
        nodes = nodes.withColumn(f"share_{depth}", share).drop("level")
    share = F.col("share_3")
    whole = F.least(F.lit(mixture.epochs), F.floor(share / F.col("total"))).cast("int")
    rest = F.when(whole < mixture.epochs, F.round(share - whole * F.col("total"), 6)).otherwise(0.0)
    return nodes.select(*path, whole.alias("p_whole"), rest.alias("p_rest"))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def seeded(seed: int, epoch: Column, identity: Column) -> Column:
    """Place of a document in a pass, as hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), identity))


def mix(
    df: DataFrame,
    mixture: Mixture,
    domain: Column,
    language: Column,
    source: Column,
    tokens: Column,
    identity: Column,
    budget: int | None = None,
    budget_share: float | None = None,
    prefix: str = "mix_",
    tie: Column | None = None,
) -> DataFrame:
    """The taken rows with all their columns, and domain, language, source, tokens, epoch under the prefix.

    The budget is given in tokens or as a share of all tokens. ``identity`` (a string) orders a pass, ``tie`` (a number)
    the rows of equal identity in it.
    """
    names = [f"{prefix}{x}" for x in ("domain", "language", "source", "tokens", "identity", "tie")]
    d, l, s, t, i, e = names  # noqa: E741
    text_of = lambda c: c.cast("string")
    rows = df.select(
        "*", text_of(domain).alias(d), text_of(language).alias(l), text_of(source).alias(s), tokens.alias(t),
        F.coalesce(identity, F.lit("")).alias(i), (F.lit(0) if tie is None else tie).alias(e),
    ).where(F.col(t) > 0)
    leaves = written(rows.groupBy(F.col(d).alias("p_d"), F.col(l).alias("p_l"), F.col(s).alias("p_s")).agg(F.sum(t).alias("total")))
    size = leaves.agg(F.count("*").alias("n"), F.sum("total").alias("total")).first()
    if budget is None:
        budget = int((budget_share or 0) * float(size["total"] or 0))
    planned = written(planned_leaves(leaves, budget, mixture))
    few = size["n"] <= BROADCAST_LEAVES
    if few:
        rows, planned = rows.withColumn("p_salt", F.lit(0)), F.broadcast(planned.withColumn("q_salt", F.lit(0)))
    else:
        rows = rows.withColumn("p_salt", F.pmod(F.xxhash64(i, e), F.lit(SALTS)).cast("int"))
        planned = planned.withColumn("q_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    def to_leaf(side: DataFrame) -> DataFrame:
        """One row a leaf at most: broadcast as the plan is, or at each salt."""
        if few:
            return F.broadcast(side.withColumn("q_salt", F.lit(0)))
        return side.withColumn("q_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    leaf_is = F.col(d).eqNullSafe(F.col("p_d")) & F.col(l).eqNullSafe(F.col("p_l")) & F.col(s).eqNullSafe(F.col("p_s")) & (F.col("p_salt") == F.col("q_salt"))
    at = seeded(mixture.seed, F.col("p_whole"), F.col(i))
    known = rows.join(planned, leaf_is).drop("q_salt").select("*", at.alias("p_at")).withColumn("p_range", F.substring("p_at", 1, RANGES_HEX))
    leaf = Window.partitionBy("p_d", "p_l", "p_s")
    sums = (
        known.where("p_rest > 0")
        .groupBy("p_d", "p_l", "p_s", "p_range", "p_rest")
        .agg(F.sum(t).alias("own"))
        .withColumn("before", F.sum("own").over(leaf.orderBy("p_range")) - F.col("own"))
        .where("before < p_rest")
        .select("p_d", "p_l", "p_s", "p_range", "before", (F.col("before") + F.col("own") <= F.col("p_rest")).alias("all_in"))
    )
    border = sums.where("not all_in").select(*(F.col(c).alias(f"b{c[1:]}") for c in ("p_d", "p_l", "p_s", "p_range")), F.col("before").alias("b_before"))
    border = to_leaf(border)
    last = sums.where("all_in").groupBy("p_d", "p_l", "p_s").agg(F.max("p_range").alias("e_range"))
    last = to_leaf(last.select(*(F.col(c).alias(f"e{c[1:]}") for c in ("p_d", "p_l", "p_s")), "e_range"))
    full = known.join(last, F.expr("p_d <=> e_d and p_l <=> e_l and p_s <=> e_s and p_salt = q_salt"), "left").select(
        *known.columns, F.coalesce(F.col("p_range") <= F.col("e_range"), F.lit(False)).alias("p_in")
    )
    within = Window.partitionBy("p_d", "p_l", "p_s").orderBy("p_at", i, t, e).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = (
        known.where("p_rest > 0")
        .join(border, F.expr("p_d <=> b_d and p_l <=> b_l and p_s <=> b_s and p_range = b_range and p_salt = q_salt"))
        .withColumn("p_before", F.sum(t).over(within) - F.col(t) + F.col("b_before"))
        .where("p_before < p_rest")
    )
    passes = F.when(F.col("p_in") & (F.col("p_rest") > 0), F.sequence(F.lit(0), F.col("p_whole"))).when(
        F.col("p_whole") > 0, F.sequence(F.lit(0), F.col("p_whole") - 1)
    )
    out = [*(f"`{c}`" for c in df.columns), d, l, s, t]
    taken = full.where("p_in and p_rest > 0 or p_whole > 0").select(*out, F.explode(passes).alias(f"{prefix}epoch"))
    return taken.unionByName(edge.select(*out, F.col("p_whole").alias(f"{prefix}epoch")))


def of_documents(df: DataFrame, mixture: Mixture, budget_share: float, domains: int = 4) -> DataFrame:
    """``mix`` over the columns of documents; a source's domain is the rest of its number."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), r"(\d+)$", 1)
    domain = F.concat(F.lit("d"), F.pmod(F.coalesce(number.try_cast("long"), F.lit(0)), F.lit(domains)).cast("string"))
    return mix(
        df, mixture, domain, F.col("lang"), F.col("source"), word_count(F.col("text")), F.col("doc_id").cast("string"),
        budget_share=budget_share, tie=F.xxhash64("text"),
    )
