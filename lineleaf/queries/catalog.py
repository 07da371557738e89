"""Lineage-catalogue queries on the driver's tables.

scans are customers (deleted where the balance is negative), branches are orders (trashed where the status
is P), runs are lineitems (version, engine = return flag, done where the line status is F, made from
l_suppkey; the chosen node of a branch is its key modulo 10), nodes are documents under doc_id DIV 2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational as R

RUN_ORDER = ["l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]
SQL_ORDER = "l_linenumber desc, l_shipdate desc, l_partkey desc, l_suppkey desc, l_extendedprice desc"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def done_runs(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "lineitem").where("l_linestatus = 'F'")


def branches(s: SparkSession, d: str) -> DataFrame:
    """Active branches of active scans with their chosen node."""
    scans = load(s, d, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"))
    return (
        load(s, d, "orders").where("o_orderstatus <> 'P'").join(scans, "o_custkey", "left_semi")
        .select("o_orderkey", "o_custkey", F.pmod("o_orderkey", F.lit(10)).alias("chosen"))
    )


def latest_run_per_branch(s, d):
    runs = done_runs(s, d).select("l_orderkey", *RUN_ORDER, "l_returnflag")
    return R.newest(runs, ["l_orderkey"], RUN_ORDER)


def branch_state_map(s, d):
    runs = done_runs(s, d).select(F.col("l_orderkey").alias("o_orderkey"), *RUN_ORDER)
    return R.status_map(branches(s, d), runs, ["o_orderkey"], "chosen", "l_suppkey", RUN_ORDER)


def needing(usable=None):
    def query(s, d):
        runs = done_runs(s, d).withColumnRenamed("l_orderkey", "o_orderkey")
        if usable == "fresh":
            runs = runs.withColumn("chosen", F.pmod("o_orderkey", F.lit(10))).where("l_suppkey = chosen")
        elif usable:
            runs = runs.where(F.col("l_returnflag") == usable)
        return R.needing_run(branches(s, d), runs.select("o_orderkey"), ["o_orderkey"]).select("o_orderkey")

    return query


def never_processed(s, d):
    runs = load(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return load(s, d, "orders").join(runs, "o_orderkey", "left_anti").select("o_orderkey")


def export_set(s, d):
    top = latest_run_per_branch(s, d).select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_linenumber")
    parts = load(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_size")
    return branches(s, d).join(top, "o_orderkey").join(parts, "l_partkey").select("o_custkey", "o_orderkey", "l_linenumber", "p_name", "p_size")


def export_by_page_order(s, d):
    return export_set(s, d).orderBy("p_size", "o_custkey", "o_orderkey").select("p_size", "o_custkey", "o_orderkey")


def export_step_excluding_trashed(s, d):
    """Steps have no label, A or B by supplier; an order trashes its branch of the label that its customer gives."""
    label = lambda key: F.coalesce(F.when(key % 3 > 0, F.element_at(F.array(F.lit("A"), F.lit("B")), (key % 3).cast("int"))), F.lit("")).alias("label")
    trashed = load(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), label(F.col("o_custkey")))
    steps = load(s, d, "lineitem").where("l_linenumber = 2").select("l_orderkey", label(F.col("l_suppkey")))
    return steps.join(trashed, ["l_orderkey", "label"], "left_anti").groupBy("l_orderkey", "label").agg(F.count("*").alias("n"))


def stale_recompute(s, d):
    chosen = load(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") != "P", F.pmod("o_orderkey", F.lit(10))).alias("chosen"))
    runs = done_runs(s, d).join(chosen, "l_orderkey", "left")
    stale = F.when(F.col("l_suppkey") == F.col("chosen"), 0).otherwise(1)
    return runs.groupBy("l_orderkey").agg(F.sum(stale).alias("n_stale"), F.count("*").alias("n_runs"))


def engine_switch_stale(s, d):
    flags = F.when((F.col("l_linestatus") == "F") & (F.col("l_returnflag") != "R"), 1).otherwise(0)
    return load(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum(flags).alias("n_switched"))


def orphan_gc(s, d):
    docs = load(s, d, "documents")
    parents = docs.select((F.col("doc_id") / 2).cast("long").alias("p"))
    return R.unreferenced(docs.select("doc_id"), "doc_id", load(s, d, "labels").select("doc_id"), parents)


def available_layers(s, d):
    paths = F.count_distinct(F.pmod("l_orderkey", F.lit(7)))
    return done_runs(s, d).groupBy("l_returnflag").agg(
        F.max("l_shipdate").alias("last_at"), paths.alias("n_paths"), F.count_distinct("l_orderkey", F.pmod("l_orderkey", F.lit(7))).alias("n_branches")
    )


def dominant_engine(s, d):
    return R.dominant(latest_run_per_branch(s, d), "l_returnflag").select("l_returnflag", F.col("count").alias("n"))


def dominant_json_value(s, d):
    value = F.get_json_object("props", "$.k").try_cast("int")
    return R.dominant(load(s, d, "events").select(value.alias("k")).where("k > 0"), "k").select("k", F.col("count").alias("n"))


def max_plus_one(s, d):
    return R.next_number(load(s, d, "lineitem"), ["l_orderkey"], "l_linenumber", "next_version")


def status_counts(s, d):
    return load(s, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def jobs_per_key(s, d):
    return load(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last_at"))


def tree(s, d):
    ids = load(s, d, "documents").select("doc_id")
    return ids.withColumn("parent", F.when(F.col("doc_id") > 0, F.floor(F.col("doc_id") / 2)))


def subtree(s, d):
    pairs = R.closure(tree(s, d), "doc_id", "parent").where("ancestor = 3")
    return pairs.select(F.col("node").alias("doc_id"), F.col("distance").alias("depth"))


def root_path(s, d):
    pairs = R.closure(tree(s, d), "doc_id", "parent")
    return pairs.groupBy(F.col("node").alias("doc_id")).agg(F.max("distance").alias("depth"), F.sum("ancestor").alias("ancestor_sum"))


def leaf_flags(s, d):
    t = tree(s, d)
    inner = t.where("parent is not null").select(F.col("parent").alias("doc_id")).distinct().withColumn("inner", F.lit(True))
    return t.join(inner, "doc_id", "left").select("doc_id", F.coalesce(~F.col("inner"), F.lit(True)).alias("is_leaf"))


def siblings(s, d):
    t = tree(s, d)
    n = t.groupBy("parent").agg(F.count("*").alias("n"))
    return t.join(n, t["parent"].eqNullSafe(n["parent"])).select("doc_id", (F.col("n") - 1).alias("n_siblings"))


def keep_set_prune(s, d):
    nodes = tree(s, d).withColumn("root", F.floor(F.col("doc_id") / 64) * 64)
    keep = nodes.where("doc_id = root or doc_id % 5 = 0").select("doc_id")
    return R.prune(nodes, keep, "doc_id", "parent", "root").select("doc_id", "parent", "root")


def prune_counts(s, d):
    n = tree(s, d).withColumn("kept", (F.col("doc_id") % 64 == 0) | (F.col("doc_id") % 5 == 0))
    return n.groupBy("kept").agg(F.count("*").alias("n"))


def dedup_by_hash(s, d):
    docs = load(s, d, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), "doc_id")
    return docs.groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


def insert_absent(s, d):
    old = load(s, d, "documents").where("doc_id % 2 = 0").select(F.sha2("text", 256).alias("sha")).distinct()
    new = load(s, d, "documents").where("doc_id % 2 = 1").select(F.sha2("text", 256).alias("sha"))
    return R.insert_absent(old, new, "sha")


def upsert_keep_last(s, d):
    o = load(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    new = o.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("U")).withColumn("o_totalprice", F.col("o_totalprice") * 0)
    return R.upsert(o, new, ["o_orderkey"], keep=["o_totalprice"]).select("o_orderkey", "o_orderstatus", "o_totalprice")


def replace_per_engine(s, d):
    runs = load(s, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", *RUN_ORDER)
    left = R.replace_done(runs, ["l_orderkey", "l_returnflag"], F.col("l_linestatus") == "F", RUN_ORDER)
    return left.groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("versions"))


def assign_order(s, d):
    from ..operators.sequence import numbered

    scans = load(s, d, "customer").where("c_acctbal < 0").select("c_custkey")
    return numbered(scans, ["c_custkey"], "idx", start=1)


def pending_three_valued(s, d):
    status = F.when(F.col("event_type") == "view", F.lit(None)).otherwise(F.col("event_type"))
    e = load(s, d, "events").withColumn("status", status)
    return e.where("status is null or status not in ('error', 'purchase')").groupBy("status").agg(F.count("*").alias("n"))


def due_jobs(s, d):
    e = load(s, d, "events").withColumn("next_at", F.when(F.col("event_id") % 4 > 0, F.col("ts")))
    return e.where("event_type = 'click' and (next_at is null or next_at <= timestamp'2024-01-15 00:00:00')").select("event_id", "next_at")


def soft_delete(s, d):
    gone = F.when(F.col("c_acctbal") < 0, F.lit("2024-01-01T00:00:00"))
    return load(s, d, "customer").select("c_custkey", gone.alias("deleted_at"))


def rename_steps(s, d):
    name = F.concat_ws("_", F.lpad(F.pmod("p_partkey", F.lit(100)).cast("string"), 2, "0"), F.when(F.pmod("p_partkey", F.lit(3)) == 0, "layout").otherwise("dewarp"))
    new = F.when(F.col("step").like("%\\_layout"), F.replace("step", F.lit("layout"), F.lit("page"))).otherwise(F.col("step"))
    return load(s, d, "part").select("p_partkey", name.alias("step")).withColumn("step", new)


def nearest_dates(s, d):
    """Scans by a coalesced time, newest first."""
    o = load(s, d, "orders").select("o_orderkey", F.coalesce(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate")), F.lit("1990-01-01").cast("timestamp")).alias("opened"))
    return o.orderBy(F.desc("opened"), "o_orderkey").limit(50)


def case_insensitive_order(s, d):
    return load(s, d, "supplier").orderBy(F.lower("s_name"), "s_suppkey").select("s_suppkey", F.lower("s_name").alias("name"))


def max_over_chosen(s, d):
    chosen = branches(s, d).select("o_orderkey", "chosen")
    runs = load(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("chosen"), "l_quantity")
    return chosen.join(runs, ["o_orderkey", "chosen"]).agg(F.coalesce(F.max("l_quantity"), F.lit(0.0)).alias("max_dpi"))


def latest_json_or_null(s, d):
    top = R.newest(load(s, d, "events"), ["user_id", "event_type"], ["ts", "event_id"])
    users = load(s, d, "events").select("user_id").distinct()
    return users.join(top.where("event_type = 'error'"), "user_id", "left").select("user_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


def positional_splice(s, d):
    pages = load(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    short = pages.select("conv_id", F.slice("turns", 1, 2).alias("sent"))
    return R.positional(pages, short, "conv_id", "turns", "sent", F.lit(-1)).select("conv_id", "place", "left_value", "right_value")


LATEST = f"select * from lineitem where l_linestatus = 'F' qualify row_number() over (partition by l_orderkey order by {SQL_ORDER}) = 1"
BRANCHES = "select o_orderkey, o_custkey, o_orderkey % 10 as chosen from orders where o_orderstatus <> 'P' and o_custkey in (select c_custkey from customer where c_acctbal >= 0)"
EXPORT = f"with latest as ({LATEST}), branches as ({BRANCHES}) select o_custkey, o_orderkey, l_linenumber, p_name, p_size from branches join latest on l_orderkey = o_orderkey join part on p_partkey = l_partkey"
TREE = "select doc_id, case when doc_id > 0 then doc_id // 2 end as parent from documents"

ORACLE_SQL = {
    "latest_run_per_branch": f"select l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_returnflag from ({LATEST})",
    "branch_state_map": f"with latest as ({LATEST}), branches as ({BRANCHES}) select o_orderkey, case when l_suppkey is null then 'none' when l_suppkey = chosen then 'fresh' else 'stale' end as state from branches left join latest on l_orderkey = o_orderkey",
    "branches_needing_run": f"with branches as ({BRANCHES}) select o_orderkey from branches b where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_linestatus = 'F')",
    "branches_needing_engine": f"with branches as ({BRANCHES}) select o_orderkey from branches b where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_linestatus = 'F' and l_returnflag = 'R')",
    "branches_needing_or_stale": f"with branches as ({BRANCHES}) select o_orderkey from branches b where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_linestatus = 'F' and l_suppkey = b.chosen)",
    "never_processed": "select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)",
    "active_export_set": EXPORT,
    "export_by_page_order": f"select p_size, o_custkey, o_orderkey from ({EXPORT})",
    "export_step_excluding_trashed": "select l_orderkey, ['', 'A', 'B'][l_suppkey % 3 + 1] as label, count(*) as n from lineitem where l_linenumber = 2 and not exists (select 1 from orders where o_orderkey = l_orderkey and o_orderstatus = 'P' and o_custkey % 3 = l_suppkey % 3) group by all",
    "stale_recompute": "select l_orderkey, cast(sum(case when l_suppkey = o_orderkey % 10 and o_orderstatus <> 'P' then 0 else 1 end) as bigint) as n_stale, count(*) as n_runs from lineitem left join orders on o_orderkey = l_orderkey where l_linestatus = 'F' group by 1",
    "engine_switch_stale": "select l_returnflag, l_linestatus, cast(sum(case when l_linestatus = 'F' and l_returnflag <> 'R' then 1 else 0 end) as bigint) as n_switched from lineitem group by all",
    "orphan_gc": "select doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id) and not exists (select 1 from documents p where p.doc_id // 2 = d.doc_id)",
    "available_layers": "select l_returnflag, max(l_shipdate) as last_at, count(distinct l_orderkey % 7) as n_paths, count(distinct l_orderkey) as n_branches from lineitem where l_linestatus = 'F' group by 1",
    "dominant_engine": f"select l_returnflag, count(*) as n from ({LATEST}) group by 1 order by n desc, 1 limit 1",
    "dominant_json_value": "select k, count(*) as n from (select cast(json_extract_string(props, '$.k') as int) as k from events) where k > 0 group by 1 order by n desc, k limit 1",
    "max_plus_one": "select l_orderkey, coalesce(max(l_linenumber), 0) + 1 as next_version from lineitem group by 1",
    "status_counts": "select o_orderstatus, count(*) as n from orders group by 1",
    "jobs_per_key": "select o_custkey, count(*) as n, max(o_orderdate) as last_at from orders group by 1",
    "subtree": f"with recursive t as ({TREE}), r as (select doc_id, 1 as depth from t where parent = 3 union all select t.doc_id, depth + 1 from t join r on t.parent = r.doc_id) select doc_id, depth from r",
    "root_path": f"with recursive t as ({TREE}), r as (select doc_id, parent as ancestor, 1 as depth from t where parent is not null union all select r.doc_id, t.parent, depth + 1 from r join t on t.doc_id = r.ancestor where t.parent is not null) select doc_id, max(depth) as depth, cast(sum(ancestor) as bigint) as ancestor_sum from r group by 1",
    "leaf_flags": f"with t as ({TREE}) select doc_id, not exists (select 1 from t c where c.parent = t.doc_id) as is_leaf from t",
    "siblings": f"with t as ({TREE}) select doc_id, count(*) over (partition by parent) - 1 as n_siblings from t",
    "keep_set_prune": "select doc_id, case when doc_id % 64 = 0 then null else doc_id // 64 * 64 end as parent, doc_id // 64 * 64 as root from documents where doc_id % 64 = 0 or doc_id % 5 = 0",
    "prune_counts": "select doc_id % 64 = 0 or doc_id % 5 = 0 as kept, count(*) as n from documents group by 1",
    "dedup_by_hash": "select sha256(coalesce(text, '')) as sha, min(doc_id) as doc_id, count(*) as n from documents group by 1",
    "insert_absent": "select distinct sha256(text) as sha from documents",
    "upsert_keep_last": "select o_orderkey, case when o_orderkey % 3 = 0 then 'U' else o_orderstatus end as o_orderstatus, o_totalprice from orders",
    "replace_per_engine": f"select l_orderkey, l_returnflag, count(*) as n, cast(sum(l_linenumber) as bigint) as versions from (select *, row_number() over (partition by l_orderkey, l_returnflag, l_linestatus order by {SQL_ORDER}) as k from lineitem) where l_linestatus <> 'F' or k = 1 group by all",
    "assign_order": "select c_custkey, row_number() over (order by c_custkey) as idx from customer where c_acctbal < 0",
    "pending_three_valued": "select status, count(*) as n from (select case when event_type = 'view' then null else event_type end as status from events) where status is null or status not in ('error', 'purchase') group by 1",
    "due_jobs": "select event_id, next_at from (select *, case when event_id % 4 > 0 then ts end as next_at from events) where event_type = 'click' and (next_at is null or next_at <= timestamp '2024-01-15 00:00:00')",
    "soft_delete": "select c_custkey, case when c_acctbal < 0 then '2024-01-01T00:00:00' end as deleted_at from customer",
    "rename_steps": "select p_partkey, lpad(cast(p_partkey % 100 as varchar), 2, '0') || case when p_partkey % 3 = 0 then '_page' else '_dewarp' end as step from part",
    "recent_first": "select o_orderkey, coalesce(case when o_orderkey % 2 = 0 then o_orderdate end, timestamp '1990-01-01') as opened from orders order by opened desc, o_orderkey limit 50",
    "case_insensitive_order": "select s_suppkey, lower(s_name) as name from supplier order by name, s_suppkey",
    "max_over_chosen": f"with branches as ({BRANCHES}) select coalesce(max(l_quantity), 0.0) as max_dpi from branches join lineitem on l_orderkey = o_orderkey and l_suppkey = chosen",
    "latest_json_or_null": "with top as (select user_id, props from events where event_type = 'error' qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1) select u.user_id, cast(json_extract_string(props, '$.k') as int) as k from (select distinct user_id from events) u left join top using (user_id)",
    "positional_splice": "select conv_id, k - 1 as place, turn as left_value, case when k <= 2 then turn else -1 end as right_value from (select conv_id, turn, row_number() over (partition by conv_id order by turn) as k from conversations)",
}
QUERIES = {
    "latest_run_per_branch": latest_run_per_branch,
    "branch_state_map": branch_state_map,
    "branches_needing_run": needing(),
    "branches_needing_engine": needing("R"),
    "branches_needing_or_stale": needing("fresh"),
    "never_processed": never_processed,
    "active_export_set": export_set,
    "export_by_page_order": export_by_page_order,
    "export_step_excluding_trashed": export_step_excluding_trashed,
    "stale_recompute": stale_recompute,
    "engine_switch_stale": engine_switch_stale,
    "orphan_gc": orphan_gc,
    "available_layers": available_layers,
    "dominant_engine": dominant_engine,
    "dominant_json_value": dominant_json_value,
    "max_plus_one": max_plus_one,
    "status_counts": status_counts,
    "jobs_per_key": jobs_per_key,
    "subtree": subtree,
    "root_path": root_path,
    "leaf_flags": leaf_flags,
    "siblings": siblings,
    "keep_set_prune": keep_set_prune,
    "prune_counts": prune_counts,
    "dedup_by_hash": dedup_by_hash,
    "insert_absent": insert_absent,
    "upsert_keep_last": upsert_keep_last,
    "replace_per_engine": replace_per_engine,
    "assign_order": assign_order,
    "pending_three_valued": pending_three_valued,
    "due_jobs": due_jobs,
    "soft_delete": soft_delete,
    "rename_steps": rename_steps,
    "recent_first": nearest_dates,
    "case_insensitive_order": case_insensitive_order,
    "max_over_chosen": max_over_chosen,
    "latest_json_or_null": latest_json_or_null,
    "positional_splice": positional_splice,
}
