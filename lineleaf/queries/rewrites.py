"""Table rewrites, lookups and orders of the lineage catalogue; the SQL checks the whole new table.

runs are events (scan: user, branch: the key modulo 3, engine: type, node: the key modulo 10), nodes are documents in
trees of 64 to a scan, branches of scans are orders of customers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import logs as L
from ..functions import projective as P
from ..functions import text as T
from ..operators import rewrites as W
from .catalog import load

PATHS = ("A", "B", "A.B")


def runs(s, d):
    e = load(s, d, "events").select(
        F.col("event_id").alias("run_id"), F.col("user_id").alias("scan_id"), F.element_at(F.array(*map(F.lit, PATHS)), (F.col("event_id") % 3 + 1).cast("int")).alias("path"),
        F.col("event_type").alias("engine"), F.when(F.col("event_id") % 4 == 0, "running").when(F.col("event_id") % 4 == 1, "error").otherwise("done").alias("status"),
        (F.col("event_id") % 10).alias("node_id"), (F.col("event_id") % 2).cast("int").alias("is_stale"), F.lit(None).cast("string").alias("error_text"),
    )
    return W.placed(e, ["scan_id", "path"], ["run_id"], "version")


def run_branches(s, d):
    x = runs(s, d).select("scan_id", "path").distinct()
    return x.where((F.col("scan_id") + F.length("path")) % 4 > 0).withColumn("chosen", F.col("scan_id") % 10)


def nodes(s, d):
    k = F.col("id") % 64
    x = load(s, d, "documents").select(F.col("doc_id").alias("id"))
    return x.select(
        "id", F.floor(F.col("id") / 64).alias("scan_id"), F.when(k > 0, F.col("id") - k + F.floor(k / 2)).alias("parent_id"),
        F.when(k > 0, F.length(F.bin(k))).otherwise(0).cast("long").alias("depth"), (k >= 32).alias("is_leaf"), F.when(F.col("id") % 11 > 0, F.floor(F.col("id") / 3)).alias("image_id"),
    )


def run_start(s, d):
    new = run_branches(s, d).select("scan_id", "path", F.lit("view").alias("engine"))
    return W.started_runs(runs(s, d), new, ["scan_id", "path"], "version").select("run_id", "scan_id", "path", "engine", "version", "status")


def run_fail(s, d):
    told = load(s, d, "events").where("event_id % 7 = 0").select(F.col("event_id").alias("run_id"), F.concat(F.lit("no "), F.col("event_id").cast("string")).alias("error"))
    return W.failed_runs(runs(s, d), told, "run_id").select("run_id", "status", "error_text", "is_stale")


def run_mark_fresh(s, d):
    told = load(s, d, "events").where("event_id % 5 = 0").select(F.col("event_id").alias("run_id"))
    return W.updated(runs(s, d), told, ["run_id"], {"is_stale": F.lit(0)}).select("run_id", "is_stale", "status")


def stale_rewrite(s, d):
    even = runs(s, d).where("scan_id % 2 = 0").select("scan_id")
    return W.restaled(runs(s, d), run_branches(s, d), ["scan_id", "path"], even).select("run_id", "scan_id", "path", "is_stale")


def engine_switch_rewrite(s, d):
    return W.switched_engine(runs(s, d), "view").select("run_id", "engine", "status", "is_stale")


def node_upsert(s, d):
    n = nodes(s, d).withColumn("step", F.lit("a"))
    new = n.where("id % 3 = 0").select(
        F.lit(None).cast("long").alias("id"), F.when(F.col("id") % 2 == 0, F.col("scan_id")).otherwise(-F.col("scan_id") - 1).alias("scan_id"), "parent_id",
        (F.col("id") % 64).alias("depth"), F.lit(True).alias("is_leaf"), "image_id", F.lit("b").alias("step"), (F.col("id") % 64).alias("stem"),
    )
    out = W.upserted_nodes(n.withColumn("stem", F.col("id") % 64), new, ["scan_id", "stem"], "id", ["is_leaf"])
    # numbers of new rows depend on a hash: only how they go on is compared
    top = load(s, d, "documents").agg(F.max("doc_id").alias("top"))
    named = out.crossJoin(F.broadcast(top)).withColumn("known", F.when(F.col("id") <= F.col("top"), F.col("id")))
    return named.select("known", "scan_id", "stem", "depth", "is_leaf", "step", (F.count("id").over(W.Window.partitionBy("id")) == 1).alias("alone"))


def subtree_delete(s, d):
    roots = nodes(s, d).where("id % 64 = 3").select("id")
    return W.without_subtree(nodes(s, d), roots, "id", "parent_id").select("id", "parent_id")


def scans_reprocess(s, d):
    n = nodes(s, d)
    images = load(s, d, "documents").select(F.floor(F.col("doc_id") / 3).alias("image_id")).distinct()
    ran = runs(s, d).select("run_id", (F.col("scan_id") % 4).alias("scan_id"), F.col("node_id"), "is_stale")
    left, moved, kept = W.reprocessed(n, ran, images, n.where("scan_id % 2 = 1").select("scan_id"))
    none = F.lit(None).cast("long")
    return (
        left.select(F.lit("node").alias("kind"), F.col("id").alias("key"), F.col("parent_id").alias("node"), none.alias("stale"))
        .unionByName(moved.select(F.lit("run").alias("kind"), F.col("run_id").alias("key"), F.col("node_id").alias("node"), F.col("is_stale").cast("long").alias("stale")))
        .unionByName(kept.select(F.lit("image").alias("kind"), F.col("image_id").alias("key"), none.alias("node"), none.alias("stale")))
    )


def scans_catchup(s, d):
    return load(s, d, "customer").where("c_acctbal >= 0").join(load(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


def jobs(s, d):
    """Old jobs are even events, new ones those divisible by 3."""
    e = load(s, d, "events").select(F.col("event_id").alias("job_id"), F.col("event_type").alias("status"), F.when(F.col("event_id") % 4 == 0, F.col("ts")).alias("imported_at"), F.when(F.col("event_id") % 6 == 0, F.lit("old")).alias("error_text"))
    return e.where("job_id % 2 = 0"), e.where("job_id % 3 = 0").withColumn("status", F.lit("sent")).withColumn("imported_at", F.lit(None).cast("timestamp_ntz")).withColumn("error_text", F.lit(None).cast("string"))


def job_add(s, d):
    from ..operators import relational as R

    old, new = jobs(s, d)
    return R.upsert(old, new, ["job_id"], keep=["imported_at", "error_text"])


def job_status(s, d):
    old, new = jobs(s, d)
    told = new.select("job_id", F.when(F.col("job_id") % 9 == 0, F.lit("new")).alias("_error"))
    return W.updated(old, told, ["job_id"], {"status": F.lit("failed"), "error_text": F.coalesce("_error", "error_text")}).select("job_id", "status", "error_text")


def job_fields(s, d):
    old, new = jobs(s, d)
    return W.updated(old, new.select("job_id"), ["job_id"], {"imported_at": F.lit(None).cast("timestamp_ntz"), "status": F.concat("status", F.lit("!"))}).select("job_id", "status", "imported_at")


def visibility_toggle(s, d):
    b = W.placed(load(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus"), ["o_custkey"], ["o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus"])
    path = F.when(F.col("place") % 4 == 1, "A").when(F.col("place") % 4 == 2, "A.B").when(F.col("place") % 4 == 3, "B").otherwise("C")
    b = b.select((F.col("o_custkey") * 1000 + F.col("place")).alias("branch_id"), F.col("o_custkey").alias("scan_id"), path.alias("path"), (F.col("o_orderstatus") == "P").alias("trashed"))
    told = load(s, d, "customer").select(F.col("c_custkey").alias("scan_id"), F.element_at(F.array(F.lit("B"), F.lit(""), F.lit("A")), (F.col("c_custkey") % 3 + 1).cast("int")).alias("label"), (F.col("c_custkey") % 2 == 0).alias("hidden"))
    return W.toggled(b, told)


def nodes_of_scans(s, d):
    return W.placed(nodes(s, d), ["scan_id"], ["depth", "id"]).select("scan_id", "place", "id")


def leaves_by_depth(s, d):
    return nodes(s, d).where("depth = 6 and is_leaf").select("scan_id", "id")


def branches_of_scans(s, d):
    return W.placed(run_branches(s, d), ["scan_id"], ["path"])


def overrides(s, d):
    return load(s, d, "events").select(F.col("user_id").alias("scan_id"), (F.col("event_id") % 3).alias("path"), (F.col("event_id") % 5).alias("step"), (F.col("event_type") == "error").alias("disabled"))


def disabled_steps(s, d):
    return overrides(s, d).where("disabled").select("scan_id", "path", "step").distinct()


def step_is_disabled(s, d):
    asked = load(s, d, "customer").select("c_custkey", F.col("c_custkey").alias("scan_id"), (F.col("c_custkey") % 3).alias("path"), (F.col("c_custkey") % 5).alias("step"))
    found = asked.join(overrides(s, d).where("disabled"), ["scan_id", "path", "step"], "left_semi").select("c_custkey", F.lit(True).alias("found"))
    return asked.join(found, "c_custkey", "left").select("c_custkey", F.coalesce("found", F.lit(False)).alias("disabled"))


def active_row(s, d):
    return load(s, d, "supplier").where("s_suppkey = 3").select("s_suppkey", "s_name").limit(1)


def key_lookup(s, d):
    keys = load(s, d, "customer").select("c_custkey", F.sha2("c_name", 256).alias("hash"), (F.col("c_acctbal") >= 0).alias("active"))
    asked = load(s, d, "orders").select(F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("raw")).distinct()
    return asked.withColumn("hash", F.sha2("raw", 256)).join(keys.where("active"), "hash").select("raw", "c_custkey")


def kind_of_name(s, d):
    name = F.concat("url", F.element_at(F.array(*map(F.lit, (".pdf", ".ZIP", ".aglbundle", ".png"))), (F.col("page_id") % 4 + 1).cast("int")))
    return load(s, d, "pages").select("page_id", L.kind_of_name(name).alias("kind"))


def projects_by_opening(s, d):
    c = load(s, d, "customer").select("c_custkey", F.col("c_custkey").alias("_k"))
    last = load(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("opened"))
    x = c.join(last, "c_custkey", "left").withColumn("at", F.coalesce("opened", F.lit("1995-06-01").cast("timestamp_ntz")))
    # one order over all projects: dealt by day, days numbered on
    x = x.withColumn("day", F.to_date("at"))
    days = x.groupBy("day").agg(F.count("*").alias("n"))
    before = days.select("day", (F.sum("n").over(W.Window.orderBy(F.desc("day"))) - F.col("n")).alias("before"))  # one row a day
    x = W.placed(x, ["day"], [F.desc("at"), "c_custkey"], "within").join(F.broadcast(before), "day")
    return x.select("c_custkey", (F.col("before") + F.col("within")).alias("place"))


def jobs_listed(s, d):
    created = F.when(F.col("event_id") % 3 > 0, L.iso_seconds(F.col("event_id") * 3600)).otherwise("")
    status = F.when(F.col("event_type") == "view", "pending").otherwise(F.lower("event_type"))
    return load(s, d, "events").select("event_id", status.alias("status"), created.alias("created_at"))


def latest_by_version(s, d):
    return W.placed(runs(s, d).where("status = 'done'"), ["scan_id", "path"], [F.desc("version")]).where("place = 1")


def markdown_plan(s, d):
    """Active scans, their branches, and each branch's newest finished run, in page order."""
    scans = load(s, d, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("scan_id"), F.col("c_nationkey").alias("page_order"))
    x = scans.join(run_branches(s, d), "scan_id").join(latest_by_version(s, d).select("scan_id", "path", "run_id"), ["scan_id", "path"])
    return W.placed(x, ["page_order"], ["scan_id", "path"]).select("page_order", "place", "scan_id", "path", "run_id")


def run_dimensions(s, d):
    images = load(s, d, "part").select(F.col("p_partkey").alias("image_id"), "p_size", "p_retailprice")
    n = nodes(s, d).select(F.col("id").alias("node_id"), "image_id")
    return runs(s, d).join(n, "node_id").join(images, "image_id").select("run_id", "p_size", "p_retailprice")


def root_images(s, d):
    return nodes(s, d).where("parent_id is null").join(load(s, d, "part").select(F.col("p_partkey").alias("image_id"), "p_size"), "image_id").select("scan_id", "id", "p_size")


def scans_with_root(s, d):
    scans = load(s, d, "customer").select(F.col("c_custkey").alias("scan_id"))
    return scans.join(nodes(s, d).where("parent_id is null").select("scan_id", "id"), "scan_id", "left")


def null_label_first(s, d):
    label = F.when(F.col("event_id") % 3 > 0, F.col("event_type"))
    return W.placed(load(s, d, "events").select("user_id", "event_id", label.alias("label")), ["user_id"], [F.asc_nulls_first("label"), "event_id"]).select("event_id", "place")


def next_pending(s, d):
    return load(s, d, "events").where("event_type = 'view'").orderBy("ts", "event_id").limit(1).select("event_id")


def active_then_newest(s, d):
    x = load(s, d, "events").withColumn("active", (F.col("event_id") % 4 == 0).cast("int"))
    return W.placed(x, ["user_id"], [F.desc("active"), F.desc("event_id")]).where("place = 1").select("user_id", "event_id", "active")


def mode_of_values(s, d):
    return W.dominant_mode(load(s, d, "lineitem").select("l_suppkey", F.col("l_quantity").cast("long").alias("q")), ["l_suppkey"], "q", 3).select("l_suppkey", "n", F.round("centre", 6).alias("centre"))


def median_tilt(s, d):
    """Median absolute angle of baselines that are at least 4 long; 0 without any."""
    x = load(s, d, "lineitem").select("l_suppkey", (F.col("l_quantity") - 20).alias("dx"), (F.col("l_partkey") % 9 - 4).alias("dy"))
    return x.groupBy("l_suppkey").agg(F.round(P.median_tilt(F.col("dx"), F.col("dy")), 6).alias("tilt"))


def not_worth_reading(s, d):
    """Lines that are blank, a number but for . and , or one token."""
    lines = load(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("doc_id", "pos", T.is_lone_token(F.col("line")).alias("lone"))


RUNS = """(select event_id as run_id, user_id as scan_id, ['A', 'B', 'A.B'][event_id % 3 + 1] as path, event_type as engine, case event_id % 4 when 0 then 'running' when 1 then 'error' else 'done' end as status,
  event_id % 10 as node_id, cast(event_id % 2 as int) as is_stale, row_number() over (partition by user_id, event_id % 3 order by event_id) as version from events)"""
RUN_BRANCHES = f"(select distinct scan_id, path, scan_id % 10 as chosen from {RUNS} where (scan_id + length(path)) % 4 > 0)"
NODES = """(select doc_id as id, doc_id // 64 as scan_id, case when doc_id % 64 > 0 then doc_id - doc_id % 64 + (doc_id % 64) // 2 end as parent_id,
  cast(case when doc_id % 64 > 0 then floor(log2(doc_id % 64)) + 1 else 0 end as bigint) as depth, doc_id % 64 >= 32 as is_leaf, case when doc_id % 11 > 0 then doc_id // 3 end as image_id from documents)"""
JOBS = "(select event_id as job_id, event_type as status, case when event_id % 4 = 0 then ts end as imported_at, case when event_id % 6 = 0 then 'old' end as error_text from events where event_id % 2 = 0)"
OVERRIDES = "(select user_id as scan_id, event_id % 3 as path, event_id % 5 as step from events where event_type = 'error')"

ORACLE_SQL = {
    "run_start": f"select run_id, scan_id, path, engine, version, status from {RUNS} union all select null, scan_id, path, 'view', (select max(version) from {RUNS} r where r.scan_id = b.scan_id and r.path = b.path) + 1, 'running' from {RUN_BRANCHES} b",
    "run_fail": f"select run_id, case when run_id % 7 = 0 then 'error' else status end as status, case when run_id % 7 = 0 then 'no ' || run_id end as error_text, is_stale from {RUNS}",
    "run_mark_fresh": f"select run_id, case when run_id % 5 = 0 then 0 else is_stale end as is_stale, status from {RUNS}",
    "stale_rewrite": f"select run_id, r.scan_id, r.path, case when r.scan_id % 2 = 1 then is_stale when node_id = chosen then 0 else 1 end as is_stale from {RUNS} r left join {RUN_BRANCHES} b on b.scan_id = r.scan_id and b.path = r.path",
    "engine_switch_rewrite": f"select run_id, engine, status, case when status = 'done' and engine <> 'view' then 1 else is_stale end as is_stale from {RUNS}",
    "node_upsert": f"select id as known, scan_id, id % 64 as stem, case when id % 6 = 0 then id % 64 else depth end as depth, is_leaf, case when id % 6 = 0 then 'b' else 'a' end as step, true as alone from {NODES} union all select null, -scan_id - 1, id % 64, id % 64, true, 'b', true from {NODES} where id % 6 = 3",
    "subtree_delete": f"with recursive t as (select id from {NODES} where parent_id % 64 = 3 union all select n.id from {NODES} n join t on n.parent_id = t.id) select id, parent_id from {NODES} where id not in (select id from t)",
    "scans_reprocess": f"with n as {NODES}, l as (select * from n where parent_id is null or scan_id % 2 = 0) select 'node' as kind, id as key, parent_id as node, null::bigint as stale from l union all select 'run', run_id, coalesce(root, node_id), case when root is null then is_stale else 1 end from (select run_id, scan_id % 4 as scan_id, node_id, is_stale from {RUNS}) r left join (select scan_id, id as root from n where parent_id is null and scan_id % 2 = 1) using (scan_id) union all select distinct 'image', doc_id // 3, null::bigint, null::bigint from documents where not (doc_id // 3 in (select image_id from n where image_id is not null and parent_id is not null and scan_id % 2 = 1) and doc_id // 3 not in (select image_id from l where image_id is not null))",
    "scans_catchup": "select c_custkey from customer where c_acctbal >= 0 and c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')",
    "job_add": f"select job_id, case when job_id % 3 = 0 then 'sent' else status end as status, imported_at, error_text from {JOBS} union all select event_id, 'sent', null, null from events where event_id % 6 = 3",
    "job_status": f"select job_id, case when job_id % 3 = 0 then 'failed' else status end as status, case when job_id % 9 = 0 then 'new' else error_text end as error_text from {JOBS}",
    "job_fields": f"select job_id, case when job_id % 3 = 0 then status || '!' else status end as status, case when job_id % 3 > 0 then imported_at end as imported_at from {JOBS}",
    "visibility_toggle": "with b as (select o_custkey as scan_id, o_orderstatus = 'P' as t, row_number() over (partition by o_custkey order by o_orderkey, o_totalprice, o_orderdate, o_orderstatus) as k, count(*) over (partition by o_custkey) as n from orders), p as (select *, case k % 4 when 1 then 'A' when 2 then 'A.B' when 3 then 'B' else 'C' end as path from b) select scan_id * 1000 + k as branch_id, scan_id, path, case when c_custkey is null then t when scan_id % 3 = 0 and path in ('B', 'A.B') or scan_id % 3 = 1 and n = 1 or scan_id % 3 = 2 and path = 'A' then scan_id % 2 = 0 else t end as trashed from p left join customer on c_custkey = scan_id",
    "nodes_of_scans": f"select scan_id, row_number() over (partition by scan_id order by depth, id) as place, id from {NODES}",
    "leaves_by_depth": f"select scan_id, id from {NODES} where depth = 6 and is_leaf",
    "branches_of_scans": f"select scan_id, path, chosen, row_number() over (partition by scan_id order by path) as place from {RUN_BRANCHES}",
    "disabled_steps": f"select distinct scan_id, path, step from {OVERRIDES}",
    "step_is_disabled": f"select c_custkey, exists (select 1 from {OVERRIDES} o where o.scan_id = c_custkey and o.path = c_custkey % 3 and o.step = c_custkey % 5) as disabled from customer",
    "active_row": "select s_suppkey, s_name from supplier where s_suppkey = 3",
    "key_lookup": "select distinct c_name as raw, c_custkey from customer join orders on c_name = 'Customer#' || lpad(o_custkey::varchar, 9, '0') where c_acctbal >= 0",
    "kind_of_name": "select page_id, [ 'pdf', 'bundle', 'bundle', null ][page_id % 4 + 1] as kind from pages",
    "projects_by_opening": "select c_custkey, row_number() over (order by coalesce(opened, timestamp '1995-06-01') desc, c_custkey) as place from customer left join (select o_custkey, max(o_orderdate) as opened from orders group by 1) on o_custkey = c_custkey",
    "jobs_listed": "select event_id, case when event_type = 'view' then 'pending' else event_type end as status, case when event_id % 3 > 0 then strftime(make_timestamp(event_id * 3600000000), '%Y-%m-%dT%H:%M:%S+00:00') else '' end as created_at from events",
    "markdown_plan": f"select c_nationkey as page_order, row_number() over (partition by c_nationkey order by c_custkey, b.path) as place, c_custkey as scan_id, b.path, run_id from customer join {RUN_BRANCHES} b on b.scan_id = c_custkey join (select *, max(version) over (partition by scan_id, path) as top from {RUNS} where status = 'done') r on r.scan_id = b.scan_id and r.path = b.path and version = top where c_acctbal >= 0",
    "run_dimensions": f"select run_id, p_size, p_retailprice from {RUNS} r join {NODES} n on n.id = r.node_id join part on p_partkey = image_id",
    "root_images": f"select scan_id, id, p_size from {NODES} join part on p_partkey = image_id where parent_id is null",
    "scans_with_root": f"select c_custkey as scan_id, id from customer left join (select * from {NODES} where parent_id is null) on scan_id = c_custkey",
    "null_label_first": "select event_id, row_number() over (partition by user_id order by (event_id % 3 > 0), case when event_id % 3 > 0 then event_type end, event_id) as place from events",
    "next_pending": "select event_id from events where event_type = 'view' order by ts, event_id limit 1",
    "active_then_newest": "select user_id, event_id, cast(event_id % 4 = 0 as int) as active from events qualify row_number() over (partition by user_id order by event_id % 4 = 0 desc, event_id desc) = 1",
    "mode_of_values": "with v as (select l_suppkey, cast(l_quantity as bigint) as q from lineitem), c as (select a.l_suppkey, a.q, count(*) as n, avg(b.q) as m from (select distinct l_suppkey, q from v) a join v b on b.l_suppkey = a.l_suppkey and abs(a.q - b.q) <= 3 group by all) select l_suppkey, n, round(m, 6) as centre from c qualify row_number() over (partition by l_suppkey order by n desc, q) = 1",
    "median_tilt": "select l_suppkey, round(coalesce(quantile_cont(abs(degrees(atan2(l_partkey % 9 - 4, l_quantity - 20))), 0.5) filter (where abs(l_quantity - 20) >= 4), 0), 6) as tilt from lineitem group by 1",
    "not_worth_reading": "select doc_id, pos, t = '' or regexp_matches(replace(replace(t, '.', ''), ',', ''), '^\\p{Nd}+$') or not contains(t, ' ') as lone from (select doc_id, pos, regexp_replace(line, '^\\s+|\\s+$', '', 'g') as t from (select doc_id, generate_subscripts(l, 1) - 1 as pos, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from documents)))",
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
