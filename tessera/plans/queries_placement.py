"""Queries on placement and logs: orders are tasks in their customer's queue, nations are memories, suppliers are processors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import placement as P
from tessera.registry import query
from tessera.sources import text


@query("""WITH f AS (SELECT o_custkey, o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS leader FROM orders WHERE o_orderkey % 4 < 2),
r AS (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY leader, o_orderkey) AS INTEGER) AS rank FROM f)
SELECT * FROM r WHERE rank <= 4""")
def permitted_steals(t, spark):
    tasks = t("orders").select("o_custkey", "o_orderkey", F.array("o_orderpriority").alias("regions"), (F.col("o_orderkey") % 4).alias("thefts"))
    return P.permitted_steals(tasks, "o_custkey", "o_orderkey", "regions", "thefts")


@query("""WITH b AS (SELECT DISTINCT l_suppkey % 10 AS thief, l_partkey % 10 AS proc FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 50 = 7), p AS (SELECT DISTINCT s_suppkey % 10 AS proc FROM supplier),
c AS (SELECT a.proc AS thief, v.proc AS victim, row_number() OVER (PARTITION BY a.proc ORDER BY v.proc) - 1 AS i, count(*) OVER (PARTITION BY a.proc) AS n
FROM p a JOIN p v ON a.proc <> v.proc AND NOT EXISTS (SELECT 1 FROM b WHERE b.thief = a.proc AND b.proc = v.proc))
SELECT p.proc AS thief, c.victim FROM p LEFT JOIN c ON c.thief = p.proc AND c.i = 3 % c.n""")
def steal_targets(t, spark):
    """The blacklist is what a part of the line items names."""
    barred = t("lineitem").where("l_linenumber = 1 AND l_orderkey % 50 = 7").select((F.col("l_suppkey") % 10).alias("thief"), (F.col("l_partkey") % 10).alias("proc"))
    return P.steal_targets(t("supplier").select((F.col("s_suppkey") % 10).alias("proc")).distinct(), barred, 3)


@query("""WITH p AS (SELECT n_nationkey AS proc, CASE n_regionkey WHEN 0 THEN 'gpu' WHEN 1 THEN 'cpu' ELSE 'other' END AS kind FROM nation),
v AS (SELECT * FROM (VALUES ('F', 'cpu'), ('F', 'gpu'), ('O', 'cpu'), ('O', 'other'), ('P', 'none')) x(fn, kind)),
k AS (SELECT kind, list(proc ORDER BY proc) AS procs FROM p WHERE kind <> 'other' GROUP BY kind),
b AS (SELECT fn, arg_min(procs, CASE kind WHEN 'gpu' THEN 1 ELSE 2 END) AS procs FROM v JOIN k USING (kind) GROUP BY fn),
h AS (SELECT DISTINCT fn, proc FROM v JOIN p USING (kind))
SELECT o_orderkey, coalesce(h.proc, procs[o_orderkey % len(procs) + 1]) AS proc FROM orders LEFT JOIN h ON h.fn = o_orderstatus AND h.proc = o_custkey % 25 LEFT JOIN b ON b.fn = o_orderstatus""")
def target_processors(t, spark):
    kind = F.when(F.col("n_regionkey") == 0, "gpu").when(F.col("n_regionkey") == 1, "cpu").otherwise("other")
    variants = spark.createDataFrame([("F", "cpu"), ("F", "gpu"), ("O", "cpu"), ("O", "other"), ("P", "none")], "fn string, kind string")
    tasks = t("orders").withColumn("local", (F.col("o_custkey") % 25).cast("int"))
    return P.target_processors(tasks, variants, t("nation").select(F.col("n_nationkey").alias("proc"), kind.alias("kind")), ["gpu", "cpu"], "local", "o_orderstatus", "o_orderkey")


HELD = "(SELECT DISTINCT l_partkey AS region, l_suppkey % 25 AS memory FROM lineitem)"


@query(f"""WITH i AS {HELD}, q AS (SELECT p_partkey AS request, p_partkey % 300 AS region, p_size % 5 AS processor FROM part),
s AS (SELECT n_regionkey AS processor, n_nationkey AS memory, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey % 3 DESC, n_nationkey) AS rank FROM nation)
SELECT request, memory, 'reuse' AS action, CAST(NULL AS INTEGER) AS rank FROM q JOIN i USING (region)
UNION ALL SELECT request, memory, 'create', CAST(rank AS INTEGER) FROM q JOIN s USING (processor) WHERE region NOT IN (SELECT region FROM i)""")
def copy_targets(t, spark):
    held = t("lineitem").select(F.col("l_partkey").alias("region"), (F.col("l_suppkey") % 25).alias("memory")).distinct()
    wanted = t("part").select(F.col("p_partkey").alias("request"), (F.col("p_partkey") % 300).alias("region"), (F.col("p_size") % 5).alias("processor"))
    near = t("nation").select(F.col("n_regionkey").alias("processor"), F.col("n_nationkey").cast("long").alias("memory"), (F.col("n_nationkey") % 3).alias("bandwidth"))
    return P.copy_targets(wanted, held, P.memory_stack(near))


@query(f"""WITH i AS {HELD}, c AS (SELECT o_orderkey AS copy, o_custkey % 200 AS region, o_orderkey % 25 AS destination FROM orders),
a AS (SELECT n_nationkey AS memory, (n_nationkey + k) % 25 AS destination, (n_nationkey * 7 + k) % 11 AS bandwidth FROM nation, (VALUES (1), (2), (3)) x(k)),
h AS (SELECT copy, memory, memory = c.destination AS there, bandwidth FROM c JOIN i USING (region) LEFT JOIN a USING (memory, destination)),
r AS (SELECT *, row_number() OVER w AS rank, first_value(there) OVER w AS best FROM h WINDOW w AS (PARTITION BY copy ORDER BY there DESC, bandwidth DESC NULLS LAST, memory))
SELECT copy, memory, CAST(rank AS INTEGER) AS rank FROM r WHERE rank = 1 OR (NOT best AND bandwidth IS NOT NULL)""")
def copy_sources(t, spark):
    held = t("lineitem").select(F.col("l_partkey").alias("region"), (F.col("l_suppkey") % 25).alias("memory")).distinct()
    copies = t("orders").select(F.col("o_orderkey").alias("copy"), (F.col("o_custkey") % 200).alias("region"), (F.col("o_orderkey") % 25).alias("destination"))
    n, k = F.col("n_nationkey").cast("long"), F.col("k")
    links = t("nation").withColumn("k", F.explode(F.array(*map(F.lit, (1, 2, 3))))).select(n.alias("source"), ((n + k) % 25).alias("destination"), ((n * 7 + k) % 11).alias("bandwidth"))
    return P.copy_sources(copies, held, links)


@query("SELECT event_id AS prev_id, event_id % 7 AS pidx, user_id AS next_id, user_id % 5 AS nidx, event_id % 4 AS dtype FROM events")
def operation_log(t, spark):
    """Dependences and tasks written as lines of an operation log; the dependences read back."""
    e = t("events")
    deps = e.select(F.lit(1).alias("pid"), F.lit(0).alias("ctx"), F.col("event_id").alias("prev_id"), (F.col("event_id") % 7).alias("pidx"), F.col("user_id").alias("next_id"), (F.col("user_id") % 5).alias("nidx"), (F.col("event_id") % 4).alias("dtype"))
    tasks = e.select(F.col("event_id").alias("uid"), F.col("user_id").alias("tid"), F.lit(1).alias("pid"), F.lit(0).alias("ctx"))
    lines = text.log_lines(deps, "mapping_dep").union(text.log_lines(tasks, "task")).withColumnRenamed("value", "line")
    return text.split_log(lines)["mapping_dep"].drop("pid", "ctx")


@query("SELECT event_id AS uid, lower(to_hex(event_id * 7919)) AS handle, lower(to_hex(user_id)) AS parent, event_id % 2 AS privilege, event_id % 4 AS coherence FROM events WHERE event_id % 3 = 0")
def legacy_log(t, spark):
    """Usages of regions and of partitions written as lines of an older log; those of regions read back."""
    e = t("events").select(
        F.lit(1).alias("context"), F.col("event_id").alias("uid"), F.lit(0).alias("index"), F.lower(F.hex(F.col("event_id") * 7919)).alias("handle"), F.lower(F.hex("user_id")).alias("parent"),
        (F.col("event_id") % 2).alias("privilege"), (F.col("event_id") % 4).alias("coherence"))
    lines = text.log_lines(e.where("uid % 3 = 0"), "region_usage", text.LEGACY).union(text.log_lines(e.where("uid % 3 <> 0"), "partition_usage", text.LEGACY))
    return text.split_log(lines.withColumnRenamed("value", "line"), text.LEGACY)["region_usage"].drop("context", "index")
