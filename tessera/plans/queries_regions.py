"""Queries on colorings, launches, reductions, joins and index spaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import coloring as C
from tessera.operators import launch as L
from tessera.operators.ordered import running_sums, runs
from tessera.registry import query

RANGES = [(0, 1, 5000), (1, 4000, 9000), (2, 9001, 9001), (3, 12000, 100000)]
RANGE_SQL = "(VALUES (0,1,5000),(1,4000,9000),(2,9001,9001),(3,12000,100000)) AS r(color, low, high)"
SHARED_SQL = "(SELECT o_orderstatus AS color, o_orderkey AS ptr FROM orders UNION ALL SELECT o_orderpriority, o_orderkey FROM orders WHERE o_orderkey % 3 = 0)"


def aliased(t):
    o = t("orders")
    return C.color_by(o, "o_orderkey", F.col("o_orderstatus")).union(C.color_by(o.where("o_orderkey % 3 = 0"), "o_orderkey", F.col("o_orderpriority")))


@query("SELECT o_custkey % 8 AS color, count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders GROUP BY 1")
def coloring_hash(t, spark):
    c = C.color_by(t("orders"), "o_orderkey", F.col("o_custkey") % 8)
    return c.groupBy("color").agg(F.count(F.lit(1)).alias("n"), F.min("ptr").alias("low"), F.max("ptr").alias("high"))


@query(f"SELECT CAST(color AS BIGINT) AS color, o_orderkey AS ptr FROM orders JOIN {RANGE_SQL} ON o_orderkey BETWEEN low AND high")
def coloring_ranges(t, spark):
    return C.color_ranges(t("orders"), "o_orderkey", RANGES)


@query(f"SELECT count(*) AS n_points, count(*) FILTER (k > 1) AS n_shared, count(*) FILTER (k > 1) = 0 AS disjoint FROM (SELECT ptr, count(DISTINCT color) AS k FROM {SHARED_SQL} GROUP BY ptr)")
def partition_disjoint_check(t, spark):
    k = aliased(t).groupBy("ptr").agg(F.countDistinct("color").alias("k"))
    return k.agg(F.count(F.lit(1)).alias("n_points"), F.count_if(F.col("k") > 1).alias("n_shared")).withColumn("disjoint", F.col("n_shared") == 0)


@query(f"SELECT a.color AS a, b.color AS b, count(*) AS n FROM (SELECT DISTINCT * FROM {SHARED_SQL}) a JOIN (SELECT DISTINCT * FROM {SHARED_SQL}) b ON a.ptr = b.ptr AND a.color < b.color GROUP BY 1, 2")
def partition_overlap_pairs(t, spark):
    return C.overlap_pairs(aliased(t))


@query(f"SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM {RANGE_SQL} WHERE o_orderkey BETWEEN low AND high)")
def partition_completeness(t, spark):
    o = t("orders")
    return C.uncolored(o, "o_orderkey", C.color_ranges(o, "o_orderkey", RANGES)).select("o_orderkey", "o_custkey")


@query(f"SELECT o_orderkey, o_totalprice FROM orders JOIN {RANGE_SQL} ON color = 1 AND o_orderkey BETWEEN low AND high")
def logical_subregion(t, spark):
    o = t("orders")
    return C.subregion(o, "o_orderkey", C.color_ranges(o, "o_orderkey", RANGES), 1).select("o_orderkey", "o_totalprice")


@query(f"SELECT CAST(color AS BIGINT) AS color, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS keys FROM orders JOIN {RANGE_SQL} ON o_orderkey BETWEEN low AND high GROUP BY 1")
def logical_partition(t, spark):
    o = t("orders")
    return C.partition(o, "o_orderkey", C.color_ranges(o, "o_orderkey", RANGES)).groupBy("color").agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("keys"))


GHOST_SQL = """WITH t AS (SELECT DISTINCT l_suppkey % 4 AS piece, l_partkey AS node, l_partkey % 4 AS owner FROM lineitem),
f AS (SELECT node, owner, max(CASE WHEN piece <> owner THEN 1 ELSE 0 END) AS far FROM t GROUP BY 1, 2)
SELECT node, owner AS piece, CASE far WHEN 1 THEN 'shared' ELSE 'private' END AS kind FROM f
UNION ALL SELECT node, piece, 'ghost' FROM t WHERE piece <> owner"""


def _ghosts(t):
    return C.ghost_split(t("lineitem").select((F.col("l_suppkey") % 4).alias("piece"), "l_partkey"), "piece", "l_partkey", F.col("node") % 4)


@query(GHOST_SQL)
def ghost_split(t, spark):
    return _ghosts(t)


@query(f"WITH g AS ({GHOST_SQL}), p AS (SELECT DISTINCT l_suppkey % 4 AS piece, l_partkey AS node FROM lineitem) SELECT kind AS place, count(*) AS n FROM p JOIN g USING (piece, node) GROUP BY 1")
def find_location(t, spark):
    p = t("lineitem").select((F.col("l_suppkey") % 4).alias("piece"), F.col("l_partkey").alias("node")).distinct()
    return p.join(_ghosts(t), ["piece", "node"]).groupBy(F.col("kind").alias("place")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT c_custkey, c_name FROM customer WHERE c_nationkey < 15 OR c_acctbal > 5000")
def region_union(t, spark):
    c = t("customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    return C.region_union(c.where("c_nationkey < 15"), c.where("c_acctbal > 5000"), "c_custkey").select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 3 = 1 THEN o_custkey END AS \"cast\" FROM orders")
def safe_cast(t, spark):
    coloring = C.color_by(t("customer"), "c_custkey", F.col("c_custkey") % 3)
    return C.safe_cast(t("orders").select("o_orderkey", "o_custkey"), "o_custkey", coloring, 1)


@query("SELECT o_orderkey AS ptr, CAST(ntile(7) OVER (ORDER BY o_orderkey) AS INTEGER) AS slice FROM orders")
def slice_ntile(t, spark):
    return C.ntile_slices(t("orders"), "o_orderkey", 7)


@query("""WITH h AS (SELECT CAST(floor(l_quantity) AS BIGINT) AS bucket, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT sum(n) AS total FROM h)
SELECT bucket, n, CAST(least(3, floor(CAST(coalesce(sum(n) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 4 AS DOUBLE) / total)) AS INTEGER) AS piece FROM h, s""")
def balanced_split(t, spark):
    return C.balanced_split(t("lineitem"), F.floor("l_quantity"), 4)


@query("SELECT o_custkey % 8 AS color, o_orderstatus AS part, count(*) AS n FROM orders GROUP BY 1, 2")
def hierarchical_partition(t, spark):
    return t("orders").groupBy((F.col("o_custkey") % 8).alias("color"), F.col("o_orderstatus").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey % 8 AS color, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY 1")
def index_launch_map(t, spark):
    o = t("orders").withColumn("color", F.col("o_custkey") % 8)
    return L.launch(o, {"n": F.count(F.lit(1)), "cents": F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))})


@query("SELECT CAST(1000 + sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS value FROM orders")
def index_launch_reduce(t, spark):
    o = t("orders").withColumn("color", F.col("o_custkey") % 8)
    points = L.launch(o, {"cents": F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))})
    return L.launch_reduced(points, F.col("cents"), "sum", 1000)


CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
APPLY_SQL = f"SELECT c_custkey, CAST(CAST(round(c_acctbal * 100) AS BIGINT) + coalesce(s, 0) AS BIGINT) AS balance FROM customer LEFT JOIN (SELECT o_custkey, sum({CENTS}) AS s FROM orders GROUP BY 1) ON c_custkey = o_custkey"


@query(APPLY_SQL)
def reduce_apply(t, spark):
    c = t("customer").select("c_custkey", F.round(F.col("c_acctbal") * 100).cast("long").alias("balance"))
    return L.reduce_into(c, "c_custkey", "balance", t("orders"), "o_custkey", F.round(F.col("o_totalprice") * 100).cast("long"))


@query("SELECT o_custkey AS ptr, count(*) AS entries, CAST(sum(s) AS BIGINT) AS s FROM (SELECT o_custkey, " + CENTS + " AS s FROM orders UNION ALL SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) FROM customer) GROUP BY 1")
def reduce_list(t, spark):
    log = t("orders").select(F.col("o_custkey").alias("ptr"), F.round(F.col("o_totalprice") * 100).cast("long").alias("rhs")).union(
        t("customer").select("c_custkey", F.round(F.col("c_acctbal") * 100).cast("long")))
    return log.groupBy("ptr").agg(F.count(F.lit(1)).alias("entries"), F.sum("rhs").alias("s"))


@query("SELECT c_custkey, greatest(CAST(round(c_acctbal * 100) AS BIGINT), coalesce(s, CAST(round(c_acctbal * 100) AS BIGINT))) AS top FROM customer LEFT JOIN (SELECT o_custkey, max(" + CENTS + ") AS s FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def reduce_max(t, spark):
    c = t("customer").select("c_custkey", F.round(F.col("c_acctbal") * 100).cast("long").alias("top"))
    return L.reduce_into(c, "c_custkey", "top", t("orders"), "o_custkey", F.round(F.col("o_totalprice") * 100).cast("long"), "max")


@query("""WITH q AS (SELECT CAST(l_quantity AS BIGINT) AS q, * FROM lineitem)
SELECT kind, node, CAST(sum(q) AS BIGINT) AS charge FROM (SELECT 'in' AS kind, l_partkey AS node, -q AS q FROM q UNION ALL SELECT 'out', l_suppkey, q FROM q) GROUP BY 1, 2""")
def charge_distribution(t, spark):
    q = F.col("l_quantity").cast("long")
    deltas = t("lineitem").select(F.explode(F.array(F.struct(F.lit("in").alias("kind"), F.col("l_partkey").alias("node"), (-q).alias("q")), F.struct(F.lit("out").alias("kind"), F.col("l_suppkey").alias("node"), q.alias("q")))).alias("d"))
    return deltas.groupBy("d.kind", "d.node").agg(F.sum("d.q").alias("charge"))


ARGS_SQL = "SELECT o_custkey % 64 AS point, {f}(o_orderstatus, o_orderkey) AS arg FROM orders WHERE o_custkey % 64 < 40 GROUP BY 1"


def _args(t, replace):
    entries = t("orders").where("o_custkey % 64 < 40").select((F.col("o_custkey") % 64).alias("point"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("arg"))
    return L.argument_map(entries, "point", "seq", replace)


@query(f"SELECT CAST(p.point AS BIGINT) AS point, arg FROM range(64) AS p(point) LEFT JOIN ({ARGS_SQL.format(f='arg_max')}) a ON a.point = p.point")
def arg_map_join(t, spark):
    return L.with_arguments(spark.range(64).withColumnRenamed("id", "point"), _args(t, True), "point")


@query(ARGS_SQL.format(f="arg_min"))
def arg_map_first_write(t, spark):
    return _args(t, False)


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10)")
def subspace_semi(t, spark):
    sub = t("part").where("p_size < 10").select("p_partkey")
    return t("lineitem").join(sub, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("l_orderkey", "l_quantity")


@query("SELECT count(*) AS bad FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 7 <> 0)")
def pointer_check(t, spark):
    good = t("part").where("p_partkey % 7 <> 0").select("p_partkey")
    return t("lineitem").join(good, F.col("l_partkey") == F.col("p_partkey"), "left_anti").agg(F.count(F.lit(1)).alias("bad"))


RUNS_SQL = "(SELECT min(p) AS start, count(*) AS len FROM (SELECT p, p - row_number() OVER (ORDER BY p) AS g FROM (SELECT o_orderkey AS p FROM orders WHERE o_custkey % 5 <> 0)) GROUP BY g)"


@query(f"SELECT start, len FROM {RUNS_SQL}")
def index_runs(t, spark):
    return runs(t("orders").where("o_custkey % 5 <> 0"), "o_orderkey", 10)


@query(f"SELECT min(start + len) AS free FROM (SELECT *, lead(start) OVER (ORDER BY start) AS nxt FROM {RUNS_SQL}) WHERE nxt - start - len >= 2")
def find_free_run(t, spark):
    """The first gap of two ids or more: where a run ends and neither of the next two ids is taken."""
    ids = t("orders").where("o_custkey % 5 <> 0").select(F.col("o_orderkey").alias("p"))
    taken = ids.select(F.explode(F.array(F.col("p") - 1, F.col("p") - 2)).alias("p")).union(ids.agg(F.max("p").alias("p"))).distinct()
    return ids.join(taken, "p", "left_anti").agg((F.min("p") + 1).alias("free"))


@query("SELECT p_partkey AS ptr, p_size AS size FROM part UNION ALL SELECT m + i, NULL FROM (SELECT max(p_partkey) AS m FROM part), range(1, 11) AS r(i)")
def alloc_rows(t, spark):
    p = t("part").select(F.col("p_partkey").alias("ptr"), F.col("p_size").alias("size"))
    top = p.agg(F.max("ptr").alias("m"))
    return p.union(spark.range(1, 11).crossJoin(F.broadcast(top)).select(F.col("m") + F.col("id"), F.lit(None).cast("int")))


@query("SELECT p_partkey AS ptr FROM part WHERE NOT (p_partkey BETWEEN 20 AND 60)")
def free_rows(t, spark):
    freed = spark.range(20, 61).withColumnRenamed("id", "p_partkey")
    return t("part").join(freed, "p_partkey", "left_anti").select(F.col("p_partkey").alias("ptr"))


@query("SELECT count(*) AS n, count(*) FILTER (v IS NULL) AS unset FROM (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS v FROM customer)")
def field_allocation(t, spark):
    r = t("customer").select("c_custkey", "c_acctbal").withColumn("v", F.lit(None).cast("double"))
    r = L.overlay(r, t("customer").withColumn("v", F.col("c_acctbal")), "c_custkey", "v", F.col("c_acctbal") > 0).drop("c_acctbal")
    return r.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v").isNull()).alias("unset"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def deferred_copy(t, spark):
    c = t("customer").select("c_custkey", "c_acctbal")
    src = t("customer").select("c_custkey", "c_mktsegment", F.lit(0.0).alias("c_acctbal"))
    return L.overlay(c, src, "c_custkey", "c_acctbal", F.col("c_mktsegment") == "BUILDING")


@query("SELECT l_orderkey, l_partkey, p_brand, s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey")
def pointer_dereference(t, spark):
    return (
        t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select("l_orderkey", "l_partkey", "p_brand", "s_name")
    )


@query("""SELECT tag, count(*) AS n, CAST(sum(v) AS BIGINT) AS v FROM (SELECT 'part' AS tag, p_partkey AS ptr, p_size AS v FROM part UNION ALL SELECT 'supplier', s_suppkey, s_nationkey FROM supplier) t
JOIN (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'part' ELSE 'supplier' END AS tag, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey ELSE l_suppkey END AS ptr FROM lineitem) USING (tag, ptr) GROUP BY 1""")
def tagged_dereference(t, spark):
    target = t("part").select(F.lit("part").alias("tag"), F.col("p_partkey").alias("ptr"), F.col("p_size").alias("v")).union(
        t("supplier").select(F.lit("supplier"), "s_suppkey", "s_nationkey"))
    even = F.col("l_linenumber") % 2 == 0
    links = t("lineitem").select(F.when(even, "part").otherwise("supplier").alias("tag"), F.when(even, F.col("l_partkey")).otherwise(F.col("l_suppkey")).alias("ptr"))
    return links.join(target, ["tag", "ptr"]).groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))


@query("SELECT o.color, n_orders, n_customers FROM (SELECT o_custkey % 8 AS color, count(*) AS n_orders FROM orders GROUP BY 1) o JOIN (SELECT c_custkey % 8 AS color, count(*) AS n_customers FROM customer GROUP BY 1) c ON o.color = c.color")
def co_partitioned_join(t, spark):
    o = t("orders").groupBy((F.col("o_custkey") % 8).alias("color")).agg(F.count(F.lit(1)).alias("n_orders"))
    return o.join(t("customer").groupBy((F.col("c_custkey") % 8).alias("color")).agg(F.count(F.lit(1)).alias("n_customers")), "color")


@query("SELECT (o_orderkey * 3 + 1) % 8 AS color, count(*) AS n FROM orders GROUP BY 1")
def projection_function(t, spark):
    return t("orders").groupBy(((F.col("o_orderkey") * 3 + 1) % 8).alias("color")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN n > 100 THEN 'run' ELSE 'skip' END AS outcome, n FROM (SELECT count(*) AS n FROM orders)")
def predicated_launch(t, spark):
    n = t("orders").agg(F.count(F.lit(1)).alias("n"))
    many = n.first()["n"] > 100  # one row: the future that the predicate waits for
    return L.predicated(n.select(F.lit("run").alias("outcome"), "n"), many).union(L.predicated(n.select(F.lit("skip"), "n"), not many))


V3 = "(VALUES (TRUE), (FALSE), (NULL))"


@query(f"SELECT a, b, a AND b AS both_, a OR b AS any_, NOT a AS not_a FROM {V3} x(a), {V3} y(b)")
def predicate_logic(t, spark):
    v = spark.createDataFrame([(True,), (False,), (None,)], "a boolean")
    return v.crossJoin(v.withColumnRenamed("a", "b")).select("a", "b", (F.col("a") & F.col("b")).alias("both_"), (F.col("a") | F.col("b")).alias("any_"), (~F.col("a")).alias("not_a"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'large' ELSE o_orderpriority END AS label FROM orders")
def guarded_expression(t, spark):
    return t("orders").select("o_orderkey", F.when(F.col("o_totalprice") > 100000, "large").otherwise(F.col("o_orderpriority")).alias("label"))


@query("SELECT s_suppkey, s_acctbal FROM supplier EXCEPT ALL SELECT s_suppkey, s_acctbal FROM supplier WHERE s_nationkey IN (1, 2, 3)")
def blacklist_difference(t, spark):
    s = t("supplier")
    return s.join(s.where(F.col("s_nationkey").isin(1, 2, 3)).select("s_suppkey"), "s_suppkey", "left_anti").select("s_suppkey", "s_acctbal")


MASKS = "(SELECT p_partkey AS id, p_partkey * 2654435761 % 65536 AS a, p_size * 40503 % 65536 AS b FROM part)"


@query(f"SELECT id, a | b AS or_, a & b AS and_, xor(a, b) AS xor_, a & ~b AS minus_, (a & b) = 0 AS disjoint, a = 0 AS empty_, CAST(bit_count(a) AS INTEGER) AS bits, CAST(a & -a AS BIGINT) AS lowest FROM {MASKS}")
def field_mask_ops(t, spark):
    a, b = F.col("a"), F.col("b")
    m = t("part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 2654435761 % 65536).alias("a"), (F.col("p_size").cast("long") * 40503 % 65536).alias("b"))
    return m.select("id", a.bitwiseOR(b).alias("or_"), a.bitwiseAND(b).alias("and_"), a.bitwiseXOR(b).alias("xor_"), a.bitwiseAND(F.bitwise_not(b)).alias("minus_"),
                    (a.bitwiseAND(b) == 0).alias("disjoint"), (a == 0).alias("empty_"), F.bit_count(a).alias("bits"), a.bitwiseAND(-a).alias("lowest"))


@query("SELECT o_orderkey AS ptr FROM orders WHERE o_custkey % 2 = 0 INTERSECT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def mask_intersection(t, spark):
    o = t("orders")
    return o.where("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("ptr")).intersect(o.where("o_orderstatus = 'F'").select("o_orderkey"))


@query("SELECT c_custkey, o_orderkey, CAST(rn AS INTEGER) AS rank FROM (SELECT o_custkey AS c_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 8")
def topk_schedule(t, spark):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t("orders").withColumn("rank", F.row_number().over(w)).where("rank <= 8").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "rank")


@query("""WITH c AS (SELECT l_suppkey % 16 AS bin, l_linenumber AS div, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT bin, div, n, CAST(coalesce(sum(n) OVER (ORDER BY bin, div ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM c""")
def sample_sort_offsets(t, spark):
    c = t("lineitem").groupBy((F.col("l_suppkey") % 16).alias("bin"), F.col("l_linenumber").alias("div")).agg(F.count(F.lit(1)).alias("n"))
    return running_sums(c, F.col("bin"), ["bin", "div"], {"off": F.col("n")}, exclusive=True)


@query("SELECT o_custkey % 16 AS bin, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey % 16 ORDER BY o_orderkey) - 1 AS INTEGER) AS slot FROM orders")
def slot_assignment(t, spark):
    """Bins are few and each holds many rows, so slots are counted in chunks of a bin's keys."""
    rows = t("orders").select((F.col("o_custkey") % 16).alias("bin"), "o_orderkey")
    slots = running_sums(rows, F.shiftright("o_orderkey", 20), ["o_orderkey"], {"slot": F.lit(1)}, exclusive=True, by=["bin"])
    return slots.withColumn("slot", F.col("slot").cast("int"))


@query("SELECT p_name || CASE WHEN k = 1 THEN '' ELSE '(' || k || ')' END AS label, p_partkey FROM (SELECT p_name, p_partkey, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part)")
def unique_names(t, spark):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("p_name").orderBy("p_partkey"))
    return t("part").withColumn("k", k).select(F.concat("p_name", F.when(F.col("k") == 1, "").otherwise(F.concat(F.lit("("), F.col("k"), F.lit(")")))).alias("label"), "p_partkey")


@query("SELECT s_nationkey, max_by(s_suppkey, s_acctbal) AS best, min_by(s_suppkey, s_acctbal) AS worst FROM supplier GROUP BY 1")
def best_memory(t, spark):
    return t("supplier").groupBy("s_nationkey").agg(F.max_by("s_suppkey", "s_acctbal").alias("best"), F.min_by("s_suppkey", "s_acctbal").alias("worst"))


@query("""WITH c AS (SELECT DISTINCT o_custkey % 37 * 2 AS color FROM orders) SELECT min(color + 1) AS color FROM c WHERE color + 1 NOT IN (SELECT color FROM c)""")
def generate_color(t, spark):
    """The smallest color above a used one that is free."""
    c = t("orders").select((F.col("o_custkey") % 37 * 2).alias("color")).distinct()
    return c.select((F.col("color") + 1).alias("color")).join(c, "color", "left_anti").agg(F.min("color").alias("color"))


@query("SELECT count(*) AS done, (SELECT count(DISTINCT o_custkey % 8) FROM orders) AS total, count(*) = (SELECT count(DISTINCT o_custkey % 8) FROM orders) AS complete FROM (SELECT o_custkey % 8 FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)")
def completion_fraction(t, spark):
    point = F.col("o_custkey") % 8
    o = t("orders").groupBy(point.alias("p")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    return o.agg(F.count_if(F.col("f") > 0).alias("done"), F.count(F.lit(1)).alias("total")).withColumn("complete", F.col("done") == F.col("total"))
