"""Order-sensitive queries on the driver's tables: events by type or user, boxes from lineitems, lines of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequence as S
from .catalog import load

EV = ["ts", "event_id"]


def events(s, d):
    return load(s, d, "events").withColumn("sec", F.unix_timestamp("ts"))


def sessionize_gap(s, d):
    g = S.gap_sessions(events(s, d), ["user_id"], "sec", EV, F.lit(86_400))
    return g.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("sec").alias("start"), F.max("sec").alias("end"))


def vblock_segments(s, d):
    g = S.median_gap_blocks(events(s, d), ["user_id"], "sec", EV)
    return g.groupBy("user_id", "block").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def supported_clusters(s, d):
    g = S.supported(events(s, d), ["user_id"], "sec", EV, 36_000.0, 3)
    return g.groupBy("user_id").agg(F.sum(F.col("supported").cast("long")).alias("n"))


def boxes(s, d):
    """One-dimensional intervals of each order."""
    return load(s, d, "lineitem").select(
        "l_orderkey", F.floor("l_extendedprice").alias("x0"), (F.floor("l_extendedprice") + F.floor("l_quantity") * 100).alias("x1")
    )


def merge_intervals_strict(s, d):
    return S.merged_intervals(boxes(s, d), ["l_orderkey"], "x0", "x1")


def merge_intervals_with_gap(s, d):
    return S.merged_intervals(boxes(s, d), ["l_orderkey"], "x0", "x1", F.lit(2000))


def runs_of_true(s, d):
    e = S.occurrence(events(s, d), ["user_id"], EV, "k").withColumn("flag", F.col("value") > 50)
    return S.true_runs(e.select("user_id", "k", "flag"), ["user_id"], "k", "flag", least=3, gap=1)


def largest_gap_split(s, d):
    g = S.split_at_largest(events(s, d), ["user_id"], "sec", EV, 3)
    return g.groupBy("user_id", "cluster").agg(F.count("*").alias("n"), F.min("sec").alias("start"), F.max("sec").alias("end"))


def segment_by_drops(s, d):
    """Pages cut where the value falls most: the three largest drops of each user's events."""
    e = S.occurrence(events(s, d).withColumn("fall", -F.col("value")), ["user_id"], EV, "k")
    g = S.split_at_largest(e, ["user_id"], "fall", EV, 4, "page")
    return g.groupBy("user_id", "page").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def rolling_p5_med_p95_300(s, d):
    r = S.rolling_percentiles(events(s, d).select("event_type", "ts", "event_id", "value"), ["event_type"], EV, "value")
    return r.select("event_id", F.round("p5", 6).alias("p5"), F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"))


def upper_median(s, d):
    return S.upper_median(load(s, d, "events"), ["event_type"], "value")


def step_shares(s, d):
    med = load(s, d, "events").groupBy("event_type").agg(F.percentile("value", F.lit(0.5)).alias("m"))
    return med.crossJoin(F.broadcast(med.agg(F.sum("m").alias("t")))).select("event_type", F.round("m", 6).alias("median"), F.round(F.col("m") / F.col("t"), 6).alias("share"))


def two_level_percentile_scale(s, d):
    """Median of each order, a high percentile of the medians as reference, the clamped scale to it; 1 where rows are few."""
    med = load(s, d, "lineitem").groupBy("l_suppkey").agg(F.percentile("l_quantity", F.lit(0.5)).alias("med"), F.count("*").alias("n"))
    enough = med.where("n >= 50")
    ref = enough.where("l_suppkey > 2").agg(F.percentile("med", F.lit(0.9)).alias("ref"))
    scale = F.when(F.col("n") >= 50, F.least(F.lit(1.2), F.greatest(F.lit(1.0), F.col("ref") / F.col("med")))).otherwise(F.lit(1.0))
    return med.crossJoin(F.broadcast(ref)).select("l_suppkey", F.round(F.coalesce(scale, F.lit(1.0)), 6).alias("scale"))


def area_percentiles(s, d):
    p = F.percentile(F.col("l_extendedprice") * 4, F.array(*map(F.lit, (0.0, 0.1, 0.5, 0.9, 1.0))))
    q = load(s, d, "lineitem").groupBy("l_returnflag").agg(p.alias("p"))
    return q.select("l_returnflag", *(F.round(F.col("p")[i], 4).alias(n) for i, n in enumerate(("p0", "p10", "p50", "p90", "p100"))))


def ratio_to_max_filter(s, d):
    v = load(s, d, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("top"), F.count("*").alias("n"))
    return S.ratio_to_max(v, ["user_id"], "n", 0.5).select("user_id", "event_type", "n")


def occurrence_anchor(s, d):
    """The nth coming of a note number gets a suffix from the second on."""
    e = load(s, d, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").alias("k"))
    o = S.occurrence(e, ["user_id", "k"], ["event_id"], "n")
    return o.select("event_id", F.concat("k", F.when(F.col("n") > 1, F.concat(F.lit("-"), F.col("n").cast("string"))).otherwise(F.lit(""))).alias("anchor"))


def x_tightening(s, d):
    width = F.lit(5000)
    return S.trimmed_extent(boxes(s, d), ["l_orderkey"], "x0", "x1", width, share=0.5)


def event_batches_of_64(s, d):
    return S.event_batches(load(s, d, "events"), ["user_id"], EV, F.col("event_type") == "view", 4).select("user_id", "first_id", "n", "batched")


def chunk_by_caps(s, d):
    docs = load(s, d, "documents").select("source", "doc_id", "n_chars")
    c = S.chunks_by_caps(docs, ["source"], ["doc_id"], "n_chars", 20_000, 5)
    return c.groupBy("source", "chunk").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def capped_prefix(s, d):
    docs = load(s, d, "documents").select("source", "doc_id", "n_chars")
    return S.capped_prefix(docs, ["source"], ["doc_id"], "n_chars", 30_000).groupBy("source").agg(F.count("*").alias("n"))


def windowed_markers(s, d):
    """References of a turn that have an entry within one turn."""
    from pyspark.sql import Window

    e = S.occurrence(load(s, d, "events"), ["user_id"], EV, "page").withColumn("k", F.get_json_object("props", "$.k"))
    near = Window.partitionBy("user_id").orderBy("page").rowsBetween(-1, 1)
    sets = e.select(
        "event_id", F.collect_set(F.when(F.col("event_type") == "click", F.col("k"))).over(near).alias("refs"),
        F.collect_set(F.when(F.col("event_type") != "click", F.col("k"))).over(near).alias("entries"),
    )
    return sets.select("event_id", F.size(F.array_intersect("refs", "entries")).alias("n"))


def same_step_delta(s, d):
    """Fractional order between two neighbours."""
    from pyspark.sql import Window

    w = Window.partitionBy("p_brand").orderBy("p_size", "p_partkey")
    return load(s, d, "part").select("p_partkey", ((F.col("p_size") + F.lead("p_size").over(w)) / 2).alias("between"))


def warm_start(s, d):
    """Component-wise median of the last three values of the same side."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "event_type").orderBy(*EV).rowsBetween(-3, -1)
    v = F.array_sort(F.collect_list("value").over(w))
    n = F.size(v)
    med = (F.try_element_at(v, F.floor((n - 1) / 2).cast("int") + 1) + F.try_element_at(v, F.floor(n / 2).cast("int") + 1)) / 2
    return load(s, d, "events").select("event_id", F.round(F.when(n > 0, F.least(med, F.lit(50.0))), 6).alias("seed"))


def quiescence(s, d):
    """A user is complete when ten distinct types-and-days were seen and nothing came for a day after."""
    e = events(s, d).groupBy("user_id").agg(F.count_distinct("event_type", F.to_date("ts")).alias("n"), F.max("sec").alias("last"))
    end = events(s, d).agg(F.max("sec").alias("end"))
    return e.crossJoin(F.broadcast(end)).where("n >= 10").select("user_id", "n", (F.col("end") - F.col("last") >= 86_400).alias("complete"))


def columns_of_blocks(s, d):
    """Transitive closure of 'same column': orders of one customer whose prices are close."""
    o = load(s, d, "orders").select("o_custkey", "o_orderkey", F.floor("o_totalprice").alias("x"))
    g = S.gap_sessions(o, ["o_custkey"], "x", ["x", "o_orderkey"], F.lit(20_000), "col")
    return g.groupBy("o_custkey", "col").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_id"))


def nearest_run_assign(s, d):
    """Each order's interval centre goes to the supplier-wide run that holds it, or to the nearest edge."""
    runs = S.merged_intervals(boxes(s, d), ["l_orderkey"], "x0", "x1", F.lit(2000)).select("l_orderkey", F.col("x0").alias("r0"), F.col("x1").alias("r1"))
    o = load(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.floor(F.col("o_totalprice") / 4).alias("c"))
    away = F.greatest(F.lit(0), F.col("r0") - F.col("c"), F.col("c") - F.col("r1"))
    j = o.join(runs, "l_orderkey").withColumn("away", away)
    return j.groupBy("l_orderkey").agg(F.min_by("r0", F.struct("away", "r0")).alias("run"), F.min("away").alias("away"))


def overlap_argmax(s, d):
    """For each interval the other one of its order that overlaps it most, over 0.4 of the smaller; the first of equals."""
    b = load(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("k"), F.floor("l_extendedprice").alias("x0"), (F.floor("l_extendedprice") + F.floor("l_quantity") * 500).alias("x1"))
    a, c = b.alias("a"), b.alias("c")
    shared = F.least("a.x1", "c.x1") - F.greatest("a.x0", "c.x0")
    smaller = F.least(F.col("a.x1") - F.col("a.x0"), F.col("c.x1") - F.col("c.x0"))
    score = F.floor(shared * 10_000 / smaller)
    j = a.join(c, (F.col("a.l_orderkey") == F.col("c.l_orderkey")) & (F.col("a.l_linenumber") != F.col("c.l_linenumber"))).select("a.l_orderkey", F.col("a.l_linenumber").alias("line"), F.col("c.l_linenumber").alias("other"), score.alias("score"))
    return j.where("score > 4000").groupBy("l_orderkey", "line").agg(F.min_by("other", F.struct(-F.col("score"), "other")).alias("other"), F.max("score").alias("score"))


def box_in_rect(s, d):
    b = boxes(s, d)
    rect = load(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.floor(F.col("o_totalprice") / 2).alias("r1"))
    return b.join(rect, "l_orderkey").where("x1 <= r1").groupBy("l_orderkey").agg(F.count("*").alias("n"))


E = "(select *, cast(floor(epoch(ts)) as bigint) as sec from events)"
BOX = "(select l_orderkey, cast(floor(l_extendedprice) as bigint) as x0, cast(floor(l_extendedprice) + floor(l_quantity) * 100 as bigint) as x1 from lineitem)"
W = "over (partition by user_id order by ts, event_id)"


def merged_sql(apart: str) -> str:
    return f"""with a as (select *, max(x1) over (partition by l_orderkey order by x0, x1 rows between unbounded preceding and 1 preceding) as top from {BOX}),
    b as (select *, sum(case when {apart} then 1 else 0 end) over (partition by l_orderkey order by x0, x1 rows unbounded preceding) as run, row_number() over (partition by l_orderkey order by x0, x1) from a)
    select l_orderkey, min(x0) as x0, max(x1) as x1, count(*) as n from b group by l_orderkey, run"""


def gap_sql(flag: str, source: str = E) -> str:
    return f"with a as (select *, sec - lag(sec) {W} as step from {source}), b as (select *, sum(case when {flag} then 1 else 0 end) {W} as g from a)"


ORACLE_SQL = {
    "sessionize_gap": gap_sql("step > 86400") + " select user_id, cast(g as bigint) as session, count(*) as n, min(sec) as start, max(sec) as \"end\" from b group by all",
    "vblock_segments": f"with s as (select *, sec - lag(sec) {W} as step from {E}), m as (select user_id, greatest(quantile_cont(step, 0.5), 4.0) as med from s where step > 0 group by 1), b as (select s.*, sum(case when step > med * 2.5 then 1 else 0 end) {W} as block from s left join m using (user_id)) select user_id, cast(block as bigint) as block, count(*) as n, min(event_id) as first_id from b group by all",
    "supported_clusters": gap_sql("step > 36000") + " select user_id, cast(sum(case when n >= 3 then n else 0 end) as bigint) as n from (select user_id, g, count(*) as n from b group by all) group by 1",
    "merge_intervals_strict": merged_sql("x0 >= top"),
    "merge_intervals_with_gap": merged_sql("x0 > top + 2000"),
    "runs_of_true": f"with e as (select user_id, value, row_number() {W} as k from events), t as (select *, k - lag(k) over (partition by user_id order by k) as step from e where value > 50), r as (select *, sum(case when step > 2 then 1 else 0 end) over (partition by user_id order by k) as g from t) select user_id, min(k) as start, max(k) as \"end\" from r group by user_id, g having max(k) - min(k) + 1 >= 3",
    "largest_gap_split": f"with a as (select *, sec - lag(sec) {W} as step, row_number() {W} as no from {E}), r as (select *, row_number() over (partition by user_id order by step desc nulls last, no) as rk from a), b as (select *, sum(case when step > 0 and rk <= 2 then 1 else 0 end) over (partition by user_id order by no) as cluster from r) select user_id, cast(cluster as bigint) as cluster, count(*) as n, min(sec) as start, max(sec) as \"end\" from b group by all",
    "segment_by_drops": f"with a as (select *, lag(value) {W} - value as step, row_number() {W} as no from events), r as (select *, row_number() over (partition by user_id order by step desc nulls last, no) as rk from a), b as (select *, sum(case when step > 0 and rk <= 3 then 1 else 0 end) over (partition by user_id order by no) as page from r) select user_id, cast(page as bigint) as page, count(*) as n, min(event_id) as first_id from b group by all",
    "rolling_p5_med_p95_300": "with a as (select event_id, list_sort(list(value) over (partition by event_type order by ts, event_id rows between 299 preceding and current row)) as v from events) select event_id, round(v[cast(round_even((len(v) - 1) * 0.05, 0) as bigint) + 1], 6) as p5, round((v[(len(v) - 1) // 2 + 1] + v[len(v) // 2 + 1]) / 2, 6) as median, round(v[cast(round_even((len(v) - 1) * 0.95, 0) as bigint) + 1], 6) as p95 from a",
    "upper_median": "with a as (select event_type, list_sort(list(value)) as v from events group by 1) select event_type, v[len(v) // 2 + 1] as upper_median from a",
    "step_shares": "with m as (select event_type, quantile_cont(value, 0.5) as m from events group by 1) select event_type, round(m, 6) as median, round(m / (select sum(m) from m), 6) as share from m",
    "two_level_percentile_scale": "with med as (select l_suppkey, quantile_cont(l_quantity, 0.5) as med, count(*) as n from lineitem group by 1), ref as (select quantile_cont(med, 0.9) as ref from med where n >= 50 and l_suppkey > 2) select l_suppkey, round(coalesce(case when n >= 50 then least(1.2, greatest(1.0, ref / med)) else 1.0 end, 1.0), 6) as scale from med, ref",
    "area_percentiles": "select l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice * 4, {q}), 4) as {n}" for n, q in (("p0", 0.0), ("p10", 0.1), ("p50", 0.5), ("p90", 0.9), ("p100", 1.0))) + " from lineitem group by 1",
    "ratio_to_max_filter": "select user_id, event_type, n from (select user_id, event_type, count(*) as n from events group by all) qualify count(*) over (partition by user_id) = 1 or n >= 0.5 * max(n) over (partition by user_id)",
    "occurrence_anchor": "select event_id, k || case when n > 1 then '-' || n else '' end as anchor from (select event_id, k, row_number() over (partition by user_id, k order by event_id) as n from (select *, json_extract_string(props, '$.k') as k from events))",
    "x_tightening": f"with a as (select *, lead(x0) over (partition by l_orderkey order by x0) - x0 as l, x1 - lead(x1) over (partition by l_orderkey order by x1 desc) as h, count(*) over (partition by l_orderkey) as n from {BOX}), b as (select *, min(case when coalesce(l > 2500, false) and n >= 4 then 0 else 1 end) over (partition by l_orderkey order by x0) as cl, min(case when coalesce(h > 2500, false) and n >= 4 then 0 else 1 end) over (partition by l_orderkey order by x1 desc) as ch from a) select l_orderkey, min(case when cl = 1 then x0 end) as x0, max(case when ch = 1 then x1 end) as x1 from b group by 1",
    "event_batches_of_64": f"with a as (select *, event_type = 'view' as v, lag(event_type = 'view') {W} as p from events), b as (select *, sum(case when coalesce(not v or not p, true) then 1 else 0 end) {W} as run from a), c as (select *, (row_number() over (partition by user_id, run order by ts, event_id) - 1) // 4 as chunk from b) select user_id, min(event_id) as first_id, count(*) as n, bool_and(v) as batched from c group by user_id, run, chunk",
    "capped_prefix": "select source, count(*) as n from (select source, sum(n_chars) over (partition by source order by doc_id rows unbounded preceding) as s from documents) where s <= 30000 group by 1",
    "windowed_markers": f"with e as (select *, row_number() {W} as page, json_extract_string(props, '$.k') as k from events), p as (select a.event_id, list(b.k) filter (where b.event_type = 'click') as r, list(b.k) filter (where b.event_type <> 'click') as n from e a join e b on a.user_id = b.user_id and b.page between a.page - 1 and a.page + 1 group by 1) select event_id, len(list_intersect(list_distinct(coalesce(r, [])), list_distinct(coalesce(n, [])))) as n from p",
    "fractional_order": "select p_partkey, (p_size + lead(p_size) over (partition by p_brand order by p_size, p_partkey)) / 2 as between from part",
    "warm_start": "with a as (select event_id, list_sort(list(value) over (partition by user_id, event_type order by ts, event_id rows between 3 preceding and 1 preceding)) as v from events) select event_id, round(case when len(v) > 0 then least((v[(len(v) - 1) // 2 + 1] + v[len(v) // 2 + 1]) / 2, 50.0) end, 6) as seed from a",
    "quiescence": f"select user_id, n, (select max(sec) from {E}) - last >= 86400 as complete from (select user_id, count(distinct event_type || cast(ts as date)) as n, max(sec) as last from {E} group by 1) where n >= 10",
    "columns_of_blocks": "with a as (select *, x - lag(x) over w as step from (select o_custkey, o_orderkey, cast(floor(o_totalprice) as bigint) as x from orders) window w as (partition by o_custkey order by x, o_orderkey)), b as (select *, sum(case when step > 20000 then 1 else 0 end) over (partition by o_custkey order by x, o_orderkey) as col from a) select o_custkey, cast(col as bigint) as col, count(*) as n, min(o_orderkey) as first_id from b group by all",
    "nearest_run_assign": f"with runs as ({merged_sql('x0 > top + 2000')}), j as (select o_orderkey as l_orderkey, x0, greatest(0, x0 - c, c - x1) as away from (select *, cast(floor(o_totalprice / 4) as bigint) as c from orders) join runs on l_orderkey = o_orderkey) select l_orderkey, x0 as run, away from j qualify row_number() over (partition by l_orderkey order by away, x0) = 1",
    "overlap_argmax": "with b as (select l_orderkey, l_linenumber, cast(floor(l_extendedprice) as bigint) as x0, cast(floor(l_extendedprice) + floor(l_quantity) * 500 as bigint) as x1 from lineitem), j as (select a.l_orderkey, a.l_linenumber as line, c.l_linenumber as other, cast(floor((least(a.x1, c.x1) - greatest(a.x0, c.x0)) * 10000 / least(a.x1 - a.x0, c.x1 - c.x0)) as bigint) as score from b a join b c on a.l_orderkey = c.l_orderkey and a.l_linenumber <> c.l_linenumber) select l_orderkey, line, other, score from j where score > 4000 qualify row_number() over (partition by l_orderkey, line order by score desc, other) = 1",
    "box_in_rect": f"select l_orderkey, count(*) as n from {BOX} join orders on o_orderkey = l_orderkey where x1 <= cast(floor(o_totalprice / 2) as bigint) group by 1",
}
QUERIES = {
    "sessionize_gap": sessionize_gap,
    "vblock_segments": vblock_segments,
    "supported_clusters": supported_clusters,
    "merge_intervals_strict": merge_intervals_strict,
    "merge_intervals_with_gap": merge_intervals_with_gap,
    "runs_of_true": runs_of_true,
    "largest_gap_split": largest_gap_split,
    "segment_by_drops": segment_by_drops,
    "rolling_p5_med_p95_300": rolling_p5_med_p95_300,
    "upper_median": upper_median,
    "step_shares": step_shares,
    "two_level_percentile_scale": two_level_percentile_scale,
    "area_percentiles": area_percentiles,
    "ratio_to_max_filter": ratio_to_max_filter,
    "occurrence_anchor": occurrence_anchor,
    "x_tightening": x_tightening,
    "event_batches_of_64": event_batches_of_64,
    "chunk_by_caps": chunk_by_caps,
    "capped_prefix": capped_prefix,
    "windowed_markers": windowed_markers,
    "fractional_order": same_step_delta,
    "warm_start": warm_start,
    "quiescence": quiescence,
    "columns_of_blocks": columns_of_blocks,
    "nearest_run_assign": nearest_run_assign,
    "overlap_argmax": overlap_argmax,
    "box_in_rect": box_in_rect,
}
