"""Queries on kernels: stencils, meshes, particles, circuits, linear algebra, trees, lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators.kernels import block_multiply, lu, lu_product, near_sums, tree_levels
from tessera.registry import query


@query("SELECT l_orderkey, l_linenumber, round(2.0 * l_quantity + l_extendedprice, 4) AS z FROM lineitem")
def saxpy(t, spark):
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(F.lit(2.0) * F.col("l_quantity") + F.col("l_extendedprice"), 4).alias("z"))


DIMS = "(SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


def dims(t):
    return t("embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))


@query(f"SELECT vec_id, CAST(i AS INTEGER) AS i, round(v + 0.1 * (coalesce(lag(v) OVER w, 0) - 2 * v + coalesce(lead(v) OVER w, 0)), 6) AS v FROM {DIMS} WINDOW w AS (PARTITION BY vec_id ORDER BY i)")
def stencil_step(t, spark):
    w = Window.partitionBy("vec_id").orderBy("i")
    v = F.col("v")
    step = v + F.lit(0.1) * (F.coalesce(F.lag(v).over(w), F.lit(0.0)) - 2 * v + F.coalesce(F.lead(v).over(w), F.lit(0.0)))
    return dims(t).select("vec_id", "i", F.round(step, 6).alias("v"))


@query(f"SELECT vec_id, CAST(i // 4 AS BIGINT) AS cell, round(avg(v), 6) AS v, count(*) AS n FROM {DIMS} GROUP BY 1, 2")
def amr_restrict(t, spark):
    return dims(t).groupBy("vec_id", F.floor(F.col("i") / 4).alias("cell")).agg(F.round(F.avg("v"), 6).alias("v"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH c AS (SELECT vec_id, CAST(i // 4 AS BIGINT) AS cell, avg(v) AS v FROM {DIMS} GROUP BY 1, 2), s AS (SELECT *, coalesce(lead(v) OVER w - v, v - lag(v) OVER w, 0) AS slope FROM c WINDOW w AS (PARTITION BY vec_id ORDER BY cell))
SELECT vec_id, cell * 4 + k AS i, round(v + slope * ((k - 1.5) / 4.0), 5) AS v FROM s, range(4) AS r(k)""")
def amr_interpolate(t, spark):
    """Fine cells from coarse ones and their slope."""
    c = dims(t).groupBy("vec_id", F.floor(F.col("i") / 4).alias("cell")).agg(F.avg("v").alias("v"))
    w = Window.partitionBy("vec_id").orderBy("cell")
    v = F.col("v")
    s = c.withColumn("slope", F.coalesce(F.lead(v).over(w) - v, v - F.lag(v).over(w), F.lit(0.0)))
    fine = s.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(4)])))
    return fine.select("vec_id", (F.col("cell") * 4 + F.col("k")).alias("i"), F.round(v + F.col("slope") * ((F.col("k") - 1.5) / 4.0), 5).alias("v"))


POINTS = "(SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"


def points(t):
    e = F.col("embedding")
    return t("embeddings").select(F.col("vec_id").alias("id"), *[F.get(e, F.lit(k)).cast("double").alias(n) for k, n in enumerate("xyz")])


@query(f"""SELECT id, CAST(count(*) AS BIGINT) AS n FROM (SELECT a.id AS a, b.id AS b FROM {POINTS} a JOIN {POINTS} b ON a.id < b.id AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 0.0025) p, LATERAL (SELECT unnest([a, b]) AS id) GROUP BY 1""")
def neighbor_density(t, spark):
    return near_sums(points(t), 0.05, [], {"n": F.lit(1)})


@query(f"SELECT CAST(floor(x / 0.05) AS BIGINT) AS cx, CAST(floor(y / 0.05) AS BIGINT) AS cy, count(*) AS n FROM {POINTS} GROUP BY 1, 2")
def cell_rebuild(t, spark):
    return points(t).groupBy(S.cell_index(F.col("x"), 0.0, 0.05).alias("cx"), S.cell_index(F.col("y"), 0.0, 0.05).alias("cy")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT id, round(x*x + y*y + z*z, 6) AS dot, round(sqrt(x*x + y*y + z*z), 6) AS norm FROM {POINTS}")
def vector3(t, spark):
    p = [F.col(c) for c in "xyz"]
    return points(t).select("id", F.round(S.dot3(p, p), 6).alias("dot"), F.round(F.sqrt(S.dot3(p, p)), 6).alias("norm"))


MAT = "(SELECT l_suppkey % 24 AS i, l_partkey % 24 AS k, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2)"


def matrix(t):
    return t("lineitem").groupBy((F.col("l_suppkey") % 24).alias("i"), (F.col("l_partkey") % 24).alias("k")).agg(F.sum(F.col("l_quantity").cast("long")).alias("v"))


@query(f"SELECT a.i, b.k AS j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM {MAT} a JOIN {MAT} b ON a.k = b.i GROUP BY 1, 2")
def matmul_block(t, spark):
    m = matrix(t)
    return block_multiply(m, m)


@query(f"SELECT k AS col, arg_max(i, abs(v) * 100 - i) AS pivot, max(abs(v)) AS size FROM {MAT} GROUP BY 1")
def pivot_argmax(t, spark):
    """Row with the largest absolute value of each column; of equals the lowest."""
    return matrix(t).groupBy(F.col("k").alias("col")).agg(F.max_by("i", F.struct(F.abs("v"), -F.col("i"))).alias("pivot"), F.max(F.abs("v")).alias("size"))


@query("SELECT conv_id, CAST(floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / 2) AS BIGINT) AS piece, turn FROM conversations")
def list_partition(t, spark):
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return t("conversations").select("conv_id", F.floor(pos / 2).alias("piece"), "turn")


@query("SELECT piece, CAST(sum(length(text)) AS BIGINT) AS s, count(*) AS n FROM (SELECT CAST(floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / 2) AS BIGINT) AS piece, text FROM conversations) GROUP BY 1")
def list_sum(t, spark):
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return t("conversations").withColumn("piece", F.floor(pos / 2)).groupBy("piece").agg(F.sum(F.length("text")).alias("s"), F.count(F.lit(1)).alias("n"))


TREE = """WITH RECURSIVE tree(node, depth) AS (SELECT sha1('root' || i), 0 FROM range(20) AS r(i)
UNION ALL SELECT sha1(unhex(node) || unhex(printf('%08X', k))), depth + 1 FROM tree, range(3) AS c(k) WHERE depth < 6 AND (('0x' || right(node, 8))::UINTEGER & 2147483647) / 2147483648.0 < 0.3)"""


@query(f"{TREE} SELECT depth, count(*) AS n, min(node) AS first FROM tree GROUP BY depth")
def tree_count(t, spark):
    roots = spark.range(20).select(F.sha1(F.concat(F.lit("root"), F.col("id")).cast("binary")).alias("node"))
    return tree_levels(roots, 3, 0.3, 6).groupBy("depth").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"))


HIST = "CAST(((((xor(CAST(o_orderkey AS HUGEINT), 12345) * 25214903917 + 11) & 281474976710655) * 25214903917 + 11) & 281474976710655) % 1024 AS BIGINT)"


@query(f"SELECT {HIST} AS bucket, count(*) AS n FROM orders GROUP BY 1")
def histogram_fold(t, spark):
    return t("orders").groupBy((S.lcg48(F.col("o_orderkey").bitwiseXOR(F.lit(12345)), 2) % 1024).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT {HIST} AS bucket, count(*) AS n FROM orders GROUP BY 1")
def histogram_localize(t, spark):
    """Counted by node first, then added up: the same rows as folding at once."""
    b = (S.lcg48(F.col("o_orderkey").bitwiseXOR(F.lit(12345)), 2) % 1024).alias("bucket")
    local = t("orders").groupBy(b, (F.col("o_custkey") % 4).alias("node")).agg(F.count(F.lit(1)).alias("c"))
    return local.groupBy("bucket").agg(F.sum("c").alias("n"))


WIRES = "(SELECT l_suppkey % 50 AS a, l_partkey % 50 AS b, 1.0 + l_linenumber AS r FROM lineitem)"


@query(f"""WITH n AS (SELECT CAST(i AS BIGINT) AS node, CAST(i % 7 AS DOUBLE) AS v FROM range(50) AS x(i)),
c AS (SELECT a, b, (na.v - nb.v) / r AS cur FROM {WIRES} JOIN n na ON na.node = a JOIN n nb ON nb.node = b),
d AS (SELECT node, sum(dq) AS dq FROM (SELECT a AS node, -cur AS dq FROM c UNION ALL SELECT b, cur FROM c) GROUP BY 1)
SELECT n.node, round(v + 0.0010007 * coalesce(dq, 0), 4) AS v FROM n LEFT JOIN d ON d.node = n.node""")
def resistive_circuit(t, spark):
    """One step: currents from both ends of each wire, charge to both, new voltages."""
    n = spark.range(50).select(F.col("id").alias("node"), (F.col("id") % 7).cast("double").alias("v"))
    w = t("lineitem").select((F.col("l_suppkey") % 50).alias("a"), (F.col("l_partkey") % 50).alias("b"), (F.lit(1.0) + F.col("l_linenumber")).alias("r"))
    na, nb = n.toDF("a", "va"), n.toDF("b", "vb")
    cur = w.join(na, "a").join(nb, "b").withColumn("cur", (F.col("va") - F.col("vb")) / F.col("r"))
    both = cur.select(F.explode(F.array(F.struct(F.col("a").alias("node"), (-F.col("cur")).alias("dq")), F.struct(F.col("b").alias("node"), F.col("cur").alias("dq")))).alias("d"))
    d = both.groupBy("d.node").agg(F.sum("d.dq").alias("dq"))
    return n.join(d, "node", "left").select("node", F.round(F.col("v") + F.lit(0.0010007) * F.coalesce("dq", F.lit(0.0)), 4).alias("v"))


GRID = "(SELECT x, y, z, (x * 10 + y) * 10 + z AS id FROM range(10) a(x), range(10) b(y), range(10) c(z))"


def grid(spark):
    return spark.range(1000).select(F.floor(F.col("id") / 100).alias("x"), (F.floor(F.col("id") / 10) % 10).alias("y"), (F.col("id") % 10).alias("z"), "id")


@query(f"SELECT id, (x // 5) * 4 + (y // 5) * 2 + z // 5 AS block FROM {GRID}")
def grid_blocks(t, spark):
    return grid(spark).select("id", (F.floor(F.col("x") / 5) * 4 + F.floor(F.col("y") / 5) * 2 + F.floor(F.col("z") / 5)).alias("block"))


@query(f"SELECT id, (x // 5) AS block FROM {GRID} WHERE x BETWEEN 1 AND 8 AND y BETWEEN 1 AND 8 AND z BETWEEN 1 AND 8")
def grid_owned(t, spark):
    inner = " AND ".join(f"{c} BETWEEN 1 AND 8" for c in "xyz")
    return grid(spark).where(inner).select("id", F.floor(F.col("x") / 5).alias("block"))


@query(f"SELECT axis, dir, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM (SELECT 'x' AS axis, 1 AS dir, id FROM {GRID} WHERE x % 5 = 4 AND x < 9 UNION ALL SELECT 'x', -1, id FROM {GRID} WHERE x % 5 = 0 AND x > 0 UNION ALL SELECT 'y', 1, id FROM {GRID} WHERE y % 5 = 4 AND y < 9 UNION ALL SELECT 'y', -1, id FROM {GRID} WHERE y % 5 = 0 AND y > 0 UNION ALL SELECT 'z', 1, id FROM {GRID} WHERE z % 5 = 4 AND z < 9 UNION ALL SELECT 'z', -1, id FROM {GRID} WHERE z % 5 = 0 AND z > 0) GROUP BY 1, 2")
def ghost_planes(t, spark):
    """The six ghost colorings: faces of the blocks that another block looks at."""
    g = grid(spark)
    sides = [F.when((F.col(a) % 5 == 4) & (F.col(a) < 9), F.struct(F.lit(a).alias("axis"), F.lit(1).alias("dir"))) for a in "xyz"]
    sides += [F.when((F.col(a) % 5 == 0) & (F.col(a) > 0), F.struct(F.lit(a).alias("axis"), F.lit(-1).alias("dir"))) for a in "xyz"]
    return g.select("id", F.explode(F.array(*sides)).alias("s")).where("s IS NOT NULL").groupBy("s.axis", "s.dir").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query(f"""WITH f AS (SELECT id, x, y, z, CAST(id * 37 % 101 AS DOUBLE) AS ey, CAST(id * 53 % 97 AS DOUBLE) AS ez FROM {GRID})
SELECT a.id, round(0.25 * ((b.ez - a.ez) - (c.ey - a.ey)), 6) AS dhx FROM f a JOIN f b ON b.x = a.x AND b.z = a.z AND b.y = a.y + 1 JOIN f c ON c.x = a.x AND c.y = a.y AND c.z = a.z + 1""")
def fdtd_step(t, spark):
    """One curl component: windows along the axes in place of three-way self-joins."""
    f = grid(spark).select("*", (F.col("id") * 37 % 101).cast("double").alias("ey"), (F.col("id") * 53 % 97).cast("double").alias("ez"))
    up = F.lead("ez").over(Window.partitionBy("x", "z").orderBy("y")) - F.col("ez")
    side = F.lead("ey").over(Window.partitionBy("x", "y").orderBy("z")) - F.col("ey")
    return f.withColumn("u", up).withColumn("s", side).where("u IS NOT NULL AND s IS NOT NULL").select("id", F.round(F.lit(0.25) * (F.col("u") - F.col("s")), 6).alias("dhx"))


TRI = "(SELECT p_partkey AS id, p_partkey AS n1, p_partkey + 1 + p_size % 5 AS n2, p_partkey + 7 + p_size % 3 AS n3 FROM part)"


@query(f"""WITH e AS (SELECT id, least(u, v) AS lo, greatest(u, v) AS hi FROM (SELECT id, n1 AS u, n2 AS v FROM {TRI} UNION ALL SELECT id, n2, n3 FROM {TRI} UNION ALL SELECT id, n3, n1 FROM {TRI}))
SELECT a.id AS a, b.id AS b, a.lo, a.hi FROM e a JOIN e b ON a.lo = b.lo AND a.hi = b.hi AND a.id < b.id""")
def mesh_adjacency(t, spark):
    p, s = F.col("p_partkey"), F.col("p_size")
    tri = t("part").select(p.alias("id"), F.array(p, p + 1 + s % 5, p + 7 + s % 3).alias("n"))
    n = [F.col("n")[k] for k in range(3)]
    sides = F.explode(F.array(*[F.struct(F.least(n[i], n[(i + 1) % 3]).alias("lo"), F.greatest(n[i], n[(i + 1) % 3]).alias("hi")) for i in range(3)]))
    e = tri.select("id", sides.alias("s")).select("id", "s.lo", "s.hi")
    return e.alias("a").join(e.alias("b"), (F.col("a.lo") == F.col("b.lo")) & (F.col("a.hi") == F.col("b.hi")) & (F.col("a.id") < F.col("b.id"))).select(
        F.col("a.id").alias("a"), F.col("b.id").alias("b"), "a.lo", "a.hi")


@query("""WITH s AS (SELECT p_partkey AS id, 3.0 + p_size % 4 AS a, 4.0 + p_size % 3 AS b, 5.0 + p_size % 2 AS c FROM part)
SELECT id, round(degrees(acos((b*b + c*c - a*a) / (2*b*c))), 4) AS alpha, degrees(acos((b*b + c*c - a*a) / (2*b*c))) > 90.1 AS obtuse, degrees(acos((b*b + c*c - a*a) / (2*b*c))) < 30 AS bad FROM s""")
def triangle_quality(t, spark):
    """Triangles given by their sides; placed in the plane, then measured by their corners."""
    s = F.col("p_size")
    d = t("part").select(F.col("p_partkey").alias("id"), (F.lit(3.0) + s % 4).alias("a"), (F.lit(4.0) + s % 3).alias("b"), (F.lit(5.0) + s % 2).alias("c"))
    x = (F.col("b") * F.col("b") + F.col("c") * F.col("c") - F.col("a") * F.col("a")) / (2 * F.col("c"))
    y = F.sqrt(F.col("b") * F.col("b") - x * x)
    zero = F.lit(0.0)
    alpha = S.triangle_angles(zero, zero, F.col("c"), zero, x, y)[0]
    return d.select("id", alpha.alias("t")).select("id", F.round("t", 4).alias("alpha"), (F.col("t") > 90.1).alias("obtuse"), (F.col("t") < 30).alias("bad"))


@query("""SELECT i, CAST(j AS INTEGER) AS j, count(l_orderkey) + CASE WHEN i = j THEN 1 ELSE 0 END::DOUBLE AS v FROM (SELECT i, j FROM range(8) a(i), range(8) b(j))
LEFT JOIN lineitem ON l_suppkey % 8 = i AND l_partkey % 8 = j GROUP BY i, j""")
def lu_round_trip(t, spark):
    """Lines by supplier and part, each modulo 8, and 1 on the diagonal: divided into LU and multiplied again."""
    counts = t("lineitem").groupBy((F.col("l_suppkey") % 8).alias("id"), (F.col("l_partkey") % 8).alias("j")).agg(F.count(F.lit(1)).alias("n"))
    cells = [F.coalesce(F.max(F.when(F.col("j") == j, F.col("n"))), F.lit(0)) + (F.col("id") == j).cast("int") for j in range(8)]
    rows = spark.range(8).join(counts, "id", "left").groupBy("id").agg(F.array(*cells).alias("v"))
    return lu_product(lu(rows, 8)).withColumn("v", F.round("v", 6))
