"""Queries on traces, logs and dependences. In the events table a sign-up creates, a view queries, a purchase triggers, a click waits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.scalars import ieee_divide, pow2_bucket, unit_bytes
from tessera.operators import depend as D
from tessera.operators import graph, trace
from tessera.operators.ordered import running_sums
from tessera.registry import query

ACTION = "CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'click' THEN 3 ELSE 4 END"
TRACE_SQL = f"(SELECT event_id, user_id AS id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS time, event_id % 4 AS node, user_id % 4 AS owner, {ACTION} AS action FROM events)"


def events(t):
    kind = F.col("event_type")
    action = F.when(kind == "signup", 0).when(kind == "view", 1).when(kind == "purchase", 2).when(kind == "click", 3).otherwise(4)
    return t("events").select("event_id", F.col("user_id").alias("id"), F.unix_timestamp("ts").alias("time"), (F.col("event_id") % 4).alias("node"), (F.col("user_id") % 4).alias("owner"), action.alias("action"))


@query(f"SELECT event_id, id, action FROM {TRACE_SQL} WHERE action <> 0 AND id NOT IN (SELECT id FROM {TRACE_SQL} WHERE action = 0)")
def orphan_events(t, spark):
    return trace.orphans(events(t), ["id"]).select("event_id", "id", "action")


LIVES = f"""(SELECT id, min(time) FILTER (action = 0) AS created, max(time) FILTER (action = 2) AS triggered, max(time) AS last_use, count(*) FILTER (action = 1) AS n_queries, count(*) FILTER (action = 3) AS n_waits
FROM {TRACE_SQL} GROUP BY id HAVING min(time) FILTER (action = 0) IS NOT NULL)"""


@query(f"SELECT id, created, triggered, last_use, n_queries, n_waits FROM {LIVES}")
def event_lifetimes(t, spark):
    return trace.lifetimes(events(t), ["id"])


@query(f"""SELECT time, CAST(sum(sum(d)) OVER (ORDER BY time) AS BIGINT) AS live FROM (SELECT created AS time, 1 AS d FROM {LIVES} WHERE last_use > created UNION ALL SELECT last_use, -1 FROM {LIVES} WHERE last_use > created) GROUP BY time""")
def live_curve(t, spark):
    return trace.live_curve(trace.lifetimes(events(t), ["id"]), 86_400)


@query(f"""SELECT time, CAST(sum(sum(d)) OVER (ORDER BY time) AS BIGINT) AS live FROM (SELECT created AS time, 1 AS d FROM {LIVES} WHERE triggered > created UNION ALL SELECT triggered, -1 FROM {LIVES} WHERE triggered > created) GROUP BY time""")
def active_curve(t, spark):
    return trace.live_curve(trace.lifetimes(events(t), ["id"]), 86_400, end="triggered")


@query(f"SELECT event_id, CAST(sum(CASE WHEN action = 0 THEN 1 ELSE 0 END) OVER (ORDER BY time, event_id) AS BIGINT) AS dynamic FROM {TRACE_SQL}")
def created_curve(t, spark):
    e = events(t)
    return running_sums(e, F.floor(F.col("time") / 86_400), ["time", "event_id"], {"dynamic": F.when(F.col("action") == 0, 1).otherwise(0)}).select("event_id", "dynamic")


@query(f"SELECT id, owner, count(*) AS n_waiters, count(*) FILTER (node = owner) AS n_local, round(count(*) FILTER (node = owner) / count(*), 6) AS ratio FROM {TRACE_SQL} WHERE action = 3 GROUP BY id, owner")
def waiter_ratio(t, spark):
    return trace.waiter_ratio(events(t), ["id", "owner"], "owner", "node")


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (event_id % 6 = {k}) AS {n}" for k, n in enumerate(["local_requests", "remote_requests", "forwards", "local_grants", "remote_grants", "remote_releases"])) + " FROM events GROUP BY 1")
def lock_stats(t, spark):
    return trace.lock_stats(t("events").select("user_id", (F.col("event_id") % 6).alias("action")), "user_id")


@query("SELECT CASE WHEN n = 0 THEN '0' WHEN n = 1 THEN '1' WHEN n = 2 THEN '2' ELSE 'other' END AS bucket, count(*) AS locks FROM (SELECT user_id, count(*) FILTER (event_type = 'error') AS n FROM events GROUP BY 1) GROUP BY 1")
def distribution_buckets(t, spark):
    n = t("events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("n"))
    return n.groupBy(F.when(F.col("n") <= 2, F.col("n").cast("string")).otherwise("other").alias("bucket")).agg(F.count(F.lit(1)).alias("locks"))


@query("SELECT CAST(ceil(log2(n)) AS BIGINT) AS bucket, count(*) AS users FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) GROUP BY 1")
def pow2_buckets(t, spark):
    n = t("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(pow2_bucket(F.col("n")).alias("bucket")).agg(F.count(F.lit(1)).alias("users"))


@query(f"SELECT event_id, CAST(row_number() OVER (PARTITION BY id ORDER BY time, event_id) AS INTEGER) AS gen FROM {TRACE_SQL}")
def generation_numbers(t, spark):
    return events(t).select("event_id", F.row_number().over(Window.partitionBy("id").orderBy("time", "event_id")).alias("gen"))


@query("SELECT event_type AS timer, count(*) AS calls, CAST(sum(CAST(round(value * 1000) AS BIGINT)) AS BIGINT) AS ms FROM events GROUP BY 1")
def timer_rollup(t, spark):
    return t("events").groupBy(F.col("event_type").alias("timer")).agg(F.count(F.lit(1)).alias("calls"), F.sum(F.round(F.col("value") * 1000).cast("long")).alias("ms"))


@query("WITH m AS (SELECT event_type, min(value) AS best FROM events GROUP BY 1) SELECT m.event_type, m.best, round(m.best / b.best, 6) AS ratio FROM m JOIN m b ON b.event_type = 'view'")
def speedup(t, spark):
    m = t("events").groupBy("event_type").agg(F.min("value").alias("best"))
    base = m.where("event_type = 'view'").select(F.col("best").alias("b"))
    return m.crossJoin(F.broadcast(base)).select("event_type", "best", F.round(ieee_divide(F.col("best"), F.col("b")), 6).alias("ratio"))


PRIVS, COH = (0x000, 0x001, 0x010, 0x100, 0x111), range(4)
REFINED = "CASE WHEN p1 IN (0, 1) THEN 2 WHEN p2 = 16 THEN 2 ELSE {} END"
DTYPE = f"""CASE WHEN p1 IN (0, 1) AND p2 IN (0, 1) THEN 0 WHEN p1 = 256 AND p2 = 256 THEN CASE WHEN r1 = r2 THEN 0 ELSE 1 END
WHEN c1 = 0 OR c2 = 0 THEN {REFINED.format(1)} WHEN c1 = 1 AND c2 = 1 THEN {REFINED.format(3)}
WHEN c1 = 1 OR c2 = 1 THEN CASE WHEN (c1 <> 1 AND p1 IN (0, 1)) OR (c2 <> 1 AND p2 IN (0, 1)) THEN 0 ELSE {REFINED.format(1)} END ELSE {REFINED.format(4)} END"""
USAGE_SQL = "(SELECT p, c, r FROM (VALUES (0),(1),(16),(256),(273)) a(p), (VALUES (0),(1),(2),(3)) b(c), (VALUES (1),(2)) d(r))"


@query(f"SELECT p1, c1, r1, p2, c2, r2, {DTYPE} AS dtype FROM {USAGE_SQL} x(p1, c1, r1), {USAGE_SQL} y(p2, c2, r2)")
def dependence_matrix(t, spark):
    u = spark.createDataFrame([(p, c, r) for p in PRIVS for c in COH for r in (1, 2)], "p1 int, c1 int, r1 int")
    both = u.crossJoin(u.toDF("p2", "c2", "r2"))
    return both.withColumn("dtype", D.dependence_type(*map(F.col, ("p1", "c1", "r1", "p2", "c2", "r2"))))


PRIV_SQL = "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 1 WHEN 'error' THEN 256 WHEN 'signup' THEN 16 ELSE 273 END"
OPS_SQL = f"(SELECT event_id AS seq, user_id AS region, {PRIV_SQL} AS priv FROM events)"


def ops(t):
    kind = F.col("event_type")
    priv = F.when(kind.isin("view", "click"), D.READ_ONLY).when(kind == "error", D.REDUCE).when(kind == "signup", D.WRITE_ONLY).otherwise(D.READ_WRITE)
    return t("events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("region"), priv.alias("priv"))


PAIRS_SQL = f"""(SELECT region, prev, next, dtype FROM (SELECT a.region, a.seq AS prev, b.seq AS next, {DTYPE} AS dtype
FROM (SELECT region, seq, priv AS p1, 0 AS c1, 0 AS r1 FROM {OPS_SQL}) a JOIN (SELECT region, seq, priv AS p2, 0 AS c2, 0 AS r2 FROM {OPS_SQL}) b ON a.region = b.region AND a.seq < b.seq) WHERE dtype <> 0)"""


@query(f"SELECT region, dtype, count(*) AS n, CAST(sum(next - prev) AS BIGINT) AS span FROM {PAIRS_SQL} GROUP BY 1, 2")
def dependence_allpairs(t, spark):
    return D.all_pairs(ops(t), "region", "seq", "priv").groupBy("region", "dtype").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("next") - F.col("prev")).alias("span"))


@query(f"""WITH u AS (SELECT *, CASE WHEN priv IN (0, 1) THEN 'read' WHEN priv = 256 THEN 'reduce' ELSE 'write' END AS usage FROM {OPS_SQL}),
b AS (SELECT *, lag(usage) OVER (PARTITION BY region ORDER BY seq) AS before FROM u),
e AS (SELECT *, sum(CASE WHEN before IS NULL OR usage <> before OR usage = 'write' THEN 1 ELSE 0 END) OVER (PARTITION BY region ORDER BY seq) AS epoch FROM b),
s AS (SELECT region, CAST(epoch AS BIGINT) AS epoch, usage, min(seq) AS first, max(seq) AS last, count(*) AS n FROM e GROUP BY 1, 2, 3)
SELECT *, coalesce(lag(n) OVER (PARTITION BY region ORDER BY epoch), 0) AS after FROM s""")
def dependence_epochs(t, spark):
    return D.epoch_summary(ops(t), "region", "seq", "priv")


EDGE_SQL = "(SELECT DISTINCT n_nationkey AS src, n_nationkey - n_nationkey % 5 - 5 AS dst FROM nation WHERE n_nationkey >= 5 UNION SELECT n_nationkey, n_nationkey - n_nationkey % 5 FROM nation WHERE n_nationkey % 5 <> 0)"


def _edges(t):
    n = F.col("n_nationkey")
    low = n - n % 5
    return t("nation").where("n_nationkey >= 5").select(n.alias("src"), (low - 5).alias("dst")).union(t("nation").where("n_nationkey % 5 <> 0").select(n, low)).distinct()


@query(f"WITH RECURSIVE e AS {EDGE_SQL}, r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src, dst FROM r")
def dependence_reach(t, spark):
    return graph.reach(_edges(t))




@query("SELECT c_custkey AS node, c_custkey % 50 AS component FROM customer WHERE c_custkey >= 50 UNION ALL SELECT c_custkey, c_custkey FROM customer WHERE c_custkey < 50 AND EXISTS (SELECT 1 FROM customer d WHERE d.c_custkey = customer.c_custkey + 50)")
def components(t, spark):
    """Chains c -> c - 50: the component of a customer is its key modulo 50."""
    c = F.col("c_custkey")
    return graph.components(t("customer").where("c_custkey >= 50").select(c.alias("src"), (c - 50).alias("dst")))


LOG = "format('op {:d} user {:d} did {:s}', event_id, user_id, event_type)"


@query(f"SELECT CAST(regexp_extract(line, 'op (\\d+) user (\\d+) did (\\w+)', 1) AS BIGINT) AS op, CAST(regexp_extract(line, 'op (\\d+) user (\\d+) did (\\w+)', 2) AS BIGINT) AS usr, regexp_extract(line, 'op (\\d+) user (\\d+) did (\\w+)', 3) AS did FROM (SELECT {LOG} AS line FROM events)")
def log_parse(t, spark):
    line = F.format_string("op %d user %d did %s", "event_id", "user_id", "event_type")
    pattern = r"op (\d+) user (\d+) did (\w+)"
    got = t("events").select(line.alias("line"))
    return got.select(F.regexp_extract("line", pattern, 1).cast("long").alias("op"), F.regexp_extract("line", pattern, 2).cast("long").alias("usr"), F.regexp_extract("line", pattern, 3).alias("did"))


BITS = "(VALUES (0),(1),(16),(256),(273))"


@query(f"SELECT child, parent, (child & ~parent) = 0 AS allowed FROM {BITS} a(child), {BITS} b(parent)")
def privilege_subset(t, spark):
    v = spark.createDataFrame([(p,) for p in PRIVS], "child int")
    return v.crossJoin(v.withColumnRenamed("child", "parent")).withColumn("allowed", D.subset(F.col("child"), F.col("parent")))


@query(f"SELECT side, count(*) AS n FROM (SELECT 'missing' AS side, prev, next FROM {PAIRS_SQL} WHERE next % 3 = 0 AND NOT prev % 2 = 0 UNION ALL SELECT 'extra', prev, next FROM {PAIRS_SQL} WHERE prev % 2 = 0 AND NOT next % 3 = 0) GROUP BY 1")
def missing_edges(t, spark):
    """Edges of one log that another lacks, both ways; the logs are two filters of the computed dependences."""
    pairs = D.all_pairs(ops(t), "region", "seq", "priv").select("prev", "next")
    a, b = pairs.where("next % 3 = 0"), pairs.where("prev % 2 = 0")
    lack = a.join(b, ["prev", "next"], "left_anti").select(F.lit("missing").alias("side")).union(b.join(a, ["prev", "next"], "left_anti").select(F.lit("extra")))
    return lack.groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, (p_size || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'k' WHEN 2 THEN 'm' ELSE 'g' END) AS text, CAST(p_size AS BIGINT) * CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 ELSE 1073741824 END AS bytes FROM part")
def unit_suffix(t, spark):
    unit = F.element_at(F.array(*map(F.lit, ["", "k", "m", "g"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t("part").select("p_partkey", F.concat(F.col("p_size").cast("string"), unit).alias("text")).withColumn("bytes", unit_bytes(F.col("text")))


@query("SELECT s_suppkey, s_nationkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS INTEGER) AS rank FROM supplier")
def memory_rank(t, spark):
    return t("supplier").select("s_suppkey", "s_nationkey", F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")).alias("rank"))


@query("""WITH k AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders), s AS (SELECT o_orderkey FROM k WHERE rn <= 2)
SELECT l_suppkey, count(DISTINCT l_orderkey) AS stolen FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM s) GROUP BY 1""")
def steal_limits(t, spark):
    first = t("orders").withColumn("rn", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).where("rn <= 2").select(F.col("o_orderkey").alias("l_orderkey"))
    return t("lineitem").join(first, "l_orderkey", "left_semi").groupBy("l_suppkey").agg(F.countDistinct("l_orderkey").alias("stolen"))
