"""Queries on whole kernels: all fields, several steps, loops to an end."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import kernels as K
from tessera.plans.queries_kernels import GRID, HIST, POINTS, grid, points
from tessera.registry import query

# --- Circuit -------------------------------------------------------------------------------------------------------

#: Segments of a wire, length of a step, steps within one; leakage of a node.
SEGMENTS, DT, SUBSTEPS, LEAK = 10, 1e-3, 3, 0.1
WIRE = "id, a, b, r, " + ", ".join([*(f"i{k}" for k in range(SEGMENTS)), *(f"v{k}" for k in range(SEGMENTS + 1))])


def substep() -> str:
    """One step within a wire: currents from the voltages on both sides, inner voltages from the currents."""
    new = [f"(v{k} - v{k + 1}) / r" for k in range(SEGMENTS)]
    inner = [f"v{k} + {DT} * ((v{k - 1} - v{k}) / r - (v{k} - v{k + 1}) / r) AS v{k}" for k in range(1, SEGMENTS)]
    return ", ".join(["id", "a", "b", "r", *(f"{e} AS i{k}" for k, e in enumerate(new)), "v0", *inner, f"v{SEGMENTS}"])


WIRES_SQL = f"""(SELECT l_orderkey * 8 + l_linenumber AS id, l_partkey AS a, l_suppkey AS b, 1.0 + l_linenumber AS r, {", ".join(f"0.0 AS i{k}" for k in range(SEGMENTS))},
{", ".join(f"CAST({k} % 3 AS DOUBLE) AS v{k}" for k in range(1, SEGMENTS))} FROM lineitem)"""


def circuit_sql(steps: int) -> str:
    out = f"WITH n0 AS (SELECT ptr, CAST(ptr % 7 AS DOUBLE) AS v FROM (SELECT l_partkey AS ptr FROM lineitem UNION SELECT l_suppkey FROM lineitem)), w0 AS {WIRES_SQL}"
    for s in range(steps):
        inner = ", ".join(f"v{k}" for k in range(1, SEGMENTS))
        out += f", x{s}_0 AS (SELECT id, a, b, r, {', '.join(f'i{k}' for k in range(SEGMENTS))}, na.v AS v0, {inner}, nb.v AS v{SEGMENTS} FROM w{s} JOIN n{s} na ON na.ptr = a JOIN n{s} nb ON nb.ptr = b)"
        for j in range(SUBSTEPS):
            out += f", x{s}_{j + 1} AS (SELECT {substep()} FROM x{s}_{j})"
        out += f", w{s + 1} AS (SELECT id, a, b, r, {', '.join(f'i{k}' for k in range(SEGMENTS))}, {inner} FROM x{s}_{SUBSTEPS})"
        out += f", q{s} AS (SELECT ptr, sum(q) AS q FROM (SELECT a AS ptr, -{DT} * i0 AS q FROM w{s + 1} UNION ALL SELECT b, {DT} * i{SEGMENTS - 1} FROM w{s + 1}) GROUP BY 1)"
        out += f", n{s + 1} AS (SELECT n{s}.ptr, (v + coalesce(q, 0)) * (1 - {LEAK}) AS v FROM n{s} LEFT JOIN q{s} ON q{s}.ptr = n{s}.ptr)"
    return out + f" SELECT ptr, round(v, 5) AS v FROM n{steps}"


@query(circuit_sql(2))
def circuit_steps(t, spark):
    """Two whole steps: currents of ten segments in each wire, charge at both ends, new voltages with leakage."""
    wires = t("lineitem").selectExpr(
        "l_orderkey * 8 + l_linenumber AS id", "l_partkey AS a", "l_suppkey AS b", "cast(1 + l_linenumber AS double) AS r",
        *[f"cast(0 AS double) AS i{k}" for k in range(SEGMENTS)], *[f"cast({k % 3} AS double) AS v{k}" for k in range(1, SEGMENTS)])
    ptrs = t("lineitem").select(F.explode(F.array("l_partkey", "l_suppkey")).alias("ptr")).distinct()
    nodes = ptrs.withColumn("v", (F.col("ptr") % 7).cast("double"))
    return K.circuit(nodes, wires, substep(), 2, SUBSTEPS, SEGMENTS, DT, LEAK).select("ptr", F.round("v", 5).alias("v"))


@query()
def circuit_to_rest(t, spark):
    """Resistive circuit of the nations: steps until no voltage moves by 0.05; a wire for each supplier."""
    s = t("supplier").select((F.col("s_nationkey")).cast("long").alias("a"), ((F.col("s_nationkey") + 1 + F.col("s_suppkey") % 7) % 25).alias("b"), F.lit(2.0).alias("r"))
    n = t("nation").select(F.col("n_nationkey").cast("long").alias("ptr"), (F.col("n_nationkey") % 7).cast("double").alias("v"))
    return K.settle(n, s, 0.5, 0.05)


# --- Trees ---------------------------------------------------------------------------------------------------------


@query("""WITH RECURSIVE tree(node, depth) AS (SELECT sha1('root' || i), 0 FROM range(20) AS r(i)
UNION ALL SELECT sha1(unhex(node) || unhex(printf('%08X', k))), depth + 1 FROM tree, range(3) AS c(k) WHERE (('0x' || right(node, 8))::UINTEGER & 2147483647) / 2147483648.0 < 0.3)
SELECT count(*) AS nodes, max(depth) AS deepest, min(node) AS first FROM tree""")
def tree_search(t, spark):
    """To exhaustion: a level is made from the one before until it is empty."""
    roots = spark.range(20).select(F.sha1(F.concat(F.lit("root"), F.col("id")).cast("binary")).alias("node"))
    return K.tree_search(roots, 3, 0.3).agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("deepest"), F.min("node").alias("first"))


# --- Particles -----------------------------------------------------------------------------------------------------

#: Radius of the neighbourhood, density and pressure factors, rest density, viscosity, length of a step.
H, RHO, PRESSURE, REST, VISCOSITY, STEP = 0.05, 2.0e6, 3.0, 0.02, 0.4, 0.005
PAIR_SQL = f"""p AS {POINTS}, d AS (SELECT a.id AS a, b.id AS b, a.x - b.x AS dx, a.y - b.y AS dy, a.z - b.z AS dz, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) AS d2
FROM p a JOIN p b ON a.id < b.id AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= {H * H}),
rho AS (SELECT p.id, {RHO} * (coalesce(sum(power({H * H} - d2, 3)), 0) + {H ** 6}) AS rho FROM p LEFT JOIN (SELECT a AS id, d2 FROM d UNION ALL SELECT b, d2 FROM d) e ON e.id = p.id GROUP BY p.id)"""


@query(f"WITH {PAIR_SQL} SELECT id, round(rho, 6) AS rho FROM rho")
def sph_density(t, spark):
    """Each pair of neighbours adds (h^2 - r^2)^3 to both."""
    return K.sph_density(points(t), H, RHO).select("id", F.round("rho", 6).alias("rho"))


@query(f"""WITH {PAIR_SQL}, f AS (SELECT a, b, {PRESSURE} * power({H} - greatest(sqrt(d2), 1e-12), 2) / greatest(sqrt(d2), 1e-12) * (ra.rho + rb.rho - 2 * {REST}) / (ra.rho * rb.rho) AS k, dx, dy, dz FROM d JOIN rho ra ON ra.id = a JOIN rho rb ON rb.id = b),
s AS (SELECT id, sum(x) AS x, sum(y) AS y, sum(z) AS z FROM (SELECT a AS id, k * dx AS x, k * dy AS y, k * dz AS z FROM f UNION ALL SELECT b, -k * dx, -k * dy, -k * dz FROM f) GROUP BY 1)
SELECT p.id, round(p.x + {STEP * STEP} * coalesce(s.x, 0), 5) AS x, round(p.y + {STEP * STEP} * coalesce(s.y, 0), 5) AS y, round(p.z + {STEP * STEP} * (coalesce(s.z, 0) - 9.8), 5) AS z FROM p LEFT JOIN s ON s.id = p.id""")
def sph_step(t, spark):
    """Density, forces (equal and opposite in each pair) and new places of particles at rest, under gravity along z."""
    return K.sph_advance(points(t), H, RHO, PRESSURE, REST, STEP).select("id", *[F.round(c, 5).alias(c) for c in "xyz"])


# --- Cells ---------------------------------------------------------------------------------------------------------

CELLS = "(SELECT (c_custkey // 16) AS x, c_custkey % 16 AS y, c_acctbal AS v FROM customer)"


def cells(t):
    return t("customer").select(F.floor(F.col("c_custkey") / 16).alias("x"), (F.col("c_custkey") % 16).alias("y"), F.col("c_acctbal").alias("v"))


@query(f"""WITH c AS {CELLS}, f AS (SELECT a.x, a.y, b.x AS bx, b.y AS byy, 0.1 * (b.v - a.v) AS flux FROM c a JOIN c b ON (b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1)),
s AS (SELECT x, y, sum(flux) AS d FROM (SELECT x, y, flux FROM f UNION ALL SELECT bx, byy, -flux FROM f) GROUP BY 1, 2)
SELECT c.x, c.y, round(v + coalesce(d, 0), 5) AS v FROM c LEFT JOIN s ON s.x = c.x AND s.y = c.y""")
def heat_step(t, spark):
    """Flux over each face between cells, once for a face; then every cell takes the fluxes of its faces."""
    return K.heat_step(cells(t), 0.1).select("x", "y", F.round("v", 5).alias("v"))


@query(f"SELECT x // 2 AS x, y // 2 AS y, round(avg(v), 6) AS v, count(*) AS n FROM {CELLS} GROUP BY 1, 2")
def restrict_2d(t, spark):
    """A coarse cell is the average of its up to four children."""
    return K.restrict(cells(t), ["x", "y"]).withColumn("v", F.round("v", 6))


@query(f"SELECT x // 2 AS x, y // 2 AS y, z // 2 AS z, round(avg(id % 17), 6) AS v, count(*) AS n FROM {GRID} GROUP BY 1, 2, 3")
def restrict_3d(t, spark):
    return K.restrict(grid(spark).withColumn("v", F.col("id") % 17), ["x", "y", "z"]).withColumn("v", F.round("v", 6))


@query(f"""WITH q AS (SELECT x // 2 AS cx, y // 2 AS cy, avg(v) AS m, max(v) FILTER (x % 2 = 0 AND y % 2 = 0) AS a, max(v) FILTER (x % 2 = 1 AND y % 2 = 0) AS b, max(v) FILTER (x % 2 = 0 AND y % 2 = 1) AS c, max(v) FILTER (x % 2 = 1 AND y % 2 = 1) AS d FROM {CELLS} GROUP BY 1, 2 HAVING count(*) = 4)
SELECT cx, cy, round(m + ((b - a) + (d - c)) / 2 * 0.25 + ((c - a) + (d - b)) / 2 * -0.25, 5) AS v FROM q""")
def bilinear_estimate(t, spark):
    """avg + mx dx + my dy from four children, at (0.25, -0.25) of their spacing from the middle."""
    c = cells(t)
    at = lambda i, j: F.max(F.when((F.col("x") % 2 == i) & (F.col("y") % 2 == j), F.col("v")))
    q = c.groupBy(F.floor(F.col("x") / 2).alias("cx"), F.floor(F.col("y") / 2).alias("cy")).agg(F.count(F.lit(1)).alias("n"), *[at(i, j).alias(f"c{i}{j}") for i in (0, 1) for j in (0, 1)])
    return q.where("n = 4").select("cx", "cy", F.round(S.bilinear(*[F.col(f"c{i}{j}") for i, j in ((0, 0), (1, 0), (0, 1), (1, 1))], 0.25, -0.25), 5).alias("v"))


FIELD_SQL = f"(SELECT id, x, y, z, {', '.join(f'CAST(id * {m} % {p} AS DOUBLE) AS {f}' for f, m, p in (('ex', 31, 89), ('ey', 37, 101), ('ez', 53, 97), ('hx', 41, 83), ('hy', 43, 79), ('hz', 47, 73)))} FROM {GRID})"


def fdtd_sql() -> str:
    def curl(f, up, sign):  # f, then the components whose derivatives along the two other axes it takes
        axis = "xyz".index(f[1])
        a, b = "xyz"[(axis + 1) % 3], "xyz"[(axis + 2) % 3]
        diff = lambda g, along: f"({up(g, along)} - {g})" if sign > 0 else f"({g} - {up(g, along)})"
        other = "e" if f[0] == "h" else "h"
        return f"{f} + 0.25 * ({diff(other + b, a)} - {diff(other + a, b)})"

    def moved(kind):
        return lambda g, along: f"coalesce({kind}({g}) OVER (PARTITION BY {', '.join(c for c in 'xyz' if c != along)} ORDER BY {along}), {g})"

    h = ", ".join(f"{curl(f, moved('lead'), 1)} AS {f}" for f in ("hx", "hy", "hz"))
    e = ", ".join(f"{curl(f, moved('lag'), -1)} AS {f}" for f in ("ex", "ey", "ez"))
    return f"""WITH f AS {FIELD_SQL}, h AS (SELECT id, x, y, z, ex, ey, ez, {h} FROM f), e AS (SELECT id, x, y, z, hx, hy, hz, {e} FROM h)
SELECT id, {', '.join(f'round({c}, 5) AS {c}' for c in ('ex', 'ey', 'ez', 'hx', 'hy', 'hz'))} FROM e"""


@query(fdtd_sql())
def fdtd_fields(t, spark):
    """One step of all six fields: H from forward differences of E, then E from backward differences of the new H; nothing crosses the border."""
    f = grid(spark)
    for c, m, p in (("ex", 31, 89), ("ey", 37, 101), ("ez", 53, 97), ("hx", 41, 83), ("hy", 43, 79), ("hz", 47, 73)):
        f = f.withColumn(c, (F.col("id") * m % p).cast("double"))
    return K.fdtd(f, 0.25, 1).select("id", *[F.round(c, 5).alias(c) for c in ("ex", "ey", "ez", "hx", "hy", "hz")])


# --- Histogram strategies, reduction copies ------------------------------------------------------------------------


def _bucket():
    return (S.lcg48(F.col("o_orderkey").bitwiseXOR(F.lit(12345)), 2) % 1024).alias("bucket")


@query(f"SELECT {HIST} AS bucket, count(*) AS n FROM orders GROUP BY 1")
def histogram_list(t, spark):
    """A list of (bucket, 1) first, applied to a table of zeros at the end."""
    return K.histogram(t("orders").select(_bucket()), 1024, "list").where("n > 0")


@query(f"SELECT {HIST} AS bucket, count(*) AS n FROM orders GROUP BY 1")
def histogram_single(t, spark):
    """One array of all buckets for each part of the rows, added up slot by slot."""
    return K.histogram(t("orders").select(_bucket()), 1024, "single").where("n > 0")


@query(f"SELECT {HIST} AS bucket, count(*) AS n FROM orders GROUP BY 1")
def histogram_direct(t, spark):
    """Every row adds one to its bucket in the table of zeros."""
    return K.histogram(t("orders").select(_bucket()), 1024, "direct").where("n > 0")


@query("""WITH d AS (SELECT l_suppkey AS ptr, CAST(l_linenumber AS BIGINT) AS v FROM lineitem), s AS (SELECT ptr, sum(v) AS v FROM d GROUP BY 1)
SELECT kind, count(*) AS n, CAST(sum(v) AS BIGINT) AS v FROM (
SELECT 'fold to normal' AS kind, s_suppkey AS ptr, s_nationkey + coalesce(s.v, 0) AS v FROM supplier LEFT JOIN s ON s.ptr = s_suppkey
UNION ALL SELECT 'fold to fold', ptr, 2 * v FROM s UNION ALL SELECT 'list to normal', s_suppkey, s_nationkey + coalesce(s.v, 0) FROM supplier LEFT JOIN s ON s.ptr = s_suppkey
UNION ALL SELECT 'list to fold', ptr, 2 * v FROM s UNION ALL SELECT 'list to list', ptr, v FROM d UNION ALL SELECT 'list to list', ptr, v FROM d) GROUP BY 1""")
def reduction_copies(t, spark):
    """The five kinds of copies between instances: folded or a list, into a normal, folded or list instance."""
    normal = t("supplier").select(F.col("s_suppkey").alias("ptr"), F.col("s_nationkey").cast("long").alias("v"))
    log = t("lineitem").select(F.col("l_suppkey").alias("ptr"), F.col("l_linenumber").cast("long").alias("v"))
    fold = log.groupBy("ptr").agg(F.sum("v").alias("v"))
    out = None
    for name, src, sk, dst, dk in (("fold to normal", fold, "fold", normal, "normal"), ("fold to fold", fold, "fold", fold, "fold"), ("list to normal", log, "list", normal, "normal"), ("list to fold", log, "list", fold, "fold"), ("list to list", log, "list", log, "list")):
        one = K.reduction_copy(src, sk, dst, dk).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v")).select(F.lit(name).alias("kind"), "n", "v")
        out = one if out is None else out.union(one)
    return out


# --- Sorting -------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS place FROM orders")
def sample_sort(t, spark):
    """Splitters from a sample, rows to bins, offsets of the bins, places within them."""
    return K.sample_sort(t("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


@query("SELECT event_id, ts FROM events ORDER BY ts, event_id")
def events_by_creation(t, spark):
    return t("events").select("event_id", "ts").orderBy("ts", "event_id")


# --- Scalars -------------------------------------------------------------------------------------------------------


@query("""SELECT event_id, round(exp(-(t - 20) * (t - 20) / 50.0) * cos(0.3 * t), 6) AS re, round(exp(-(t - 20) * (t - 20) / 50.0) * sin(0.3 * t), 6) AS im,
round((exp(-(t - 20) * (t - 20) / 50.0) * (cos(0.3 * t) * 3 + sin(0.3 * t) * 4)) / 25, 6) AS divided FROM (SELECT event_id, CAST(event_id % 40 AS DOUBLE) AS t FROM events)""")
def pulse_source(t, spark):
    """A Gaussian pulse as a complex number, and its real part after division by 3 + 4i."""
    e = t("events").select("event_id", (F.col("event_id") % 40).cast("double").alias("t"))
    re, im = S.pulse(F.col("t"), 20.0, 50.0, 0.3)
    d = S.complex_divide(re, im, F.lit(3.0), F.lit(4.0))
    return e.select("event_id", F.round(re, 6).alias("re"), F.round(im, 6).alias("im"), F.round(d[0], 6).alias("divided"))


@query(f"SELECT id, round(greatest(0, 1 - abs(x)) * greatest(0, 1 - abs(y)) * greatest(0, 1 - abs(z)), 6) AS w FROM {POINTS}")
def interpolation_weight(t, spark):
    return points(t).select("id", F.round(S.product([F.greatest(F.lit(0.0), 1 - F.abs(F.col(c))) for c in "xyz"]), 6).alias("w"))


@query(f"SELECT id, CAST(greatest(0, least(9, CAST(floor(x * 100) AS BIGINT))) AS BIGINT) AS clamped, CAST(((CAST(floor(x * 100) AS BIGINT) % 3) + 3) % 3 AS BIGINT) AS third, (5 - CAST(id % 6 AS INTEGER)) AS back FROM {POINTS}")
def clamp_and_modulo(t, spark):
    """Cells clamped to the grid, a true modulo, the reverse of a direction (0..5, opposite ones add up to 5)."""
    c = F.floor(F.col("x") * 100).cast("long")
    return points(t).select("id", S.clamp(c, 0, 9).alias("clamped"), S.true_modulo(c, 3).alias("third"), S.reverse_direction((F.col("id") % 6).cast("int")).alias("back"))


@query("SELECT o_orderkey, (o_orderkey + 1) AS after, (o_orderkey - 1) AS before, o_orderkey + 3 * 8 AS stride, (o_orderkey * 12 + 5) AS cell FROM orders")
def pointer_arithmetic(t, spark):
    p = F.col("o_orderkey")
    return t("orders").select("o_orderkey", (p + 1).alias("after"), (p - 1).alias("before"), (p + S.stride(3, 8)).alias("stride"), (p * 12 + 5).alias("cell"))


@query("""WITH p AS (SELECT p_partkey AS id, CAST(p_partkey % 11 AS DOUBLE) AS ax, CAST(p_size AS DOUBLE) AS ay, CAST(p_partkey % 11 + 3 + p_size % 4 AS DOUBLE) AS bx, CAST(p_size + 1 AS DOUBLE) AS byy, CAST(p_partkey % 11 + 1 AS DOUBLE) AS cx, CAST(p_size + 4 + p_partkey % 3 AS DOUBLE) AS cy FROM part),
c AS (SELECT *, 2 * (ax * (byy - cy) + bx * (cy - ay) + cx * (ay - byy)) AS d FROM p),
o AS (SELECT *, ((ax*ax + ay*ay) * (byy - cy) + (bx*bx + byy*byy) * (cy - ay) + (cx*cx + cy*cy) * (ay - byy)) / d AS ox, ((ax*ax + ay*ay) * (cx - bx) + (bx*bx + byy*byy) * (ax - cx) + (cx*cx + cy*cy) * (bx - ax)) / d AS oy FROM c)
SELECT id, round(ox, 4) AS ox, round(oy, 4) AS oy, (ax + 2 - ox) * (ax + 2 - ox) + (ay + 2 - oy) * (ay + 2 - oy) < (ax - ox) * (ax - ox) + (ay - oy) * (ay - oy) AS inside FROM o""")
def circumcentres(t, spark):
    """Centre of the circle through three corners, and whether a fourth point lies in it."""
    d = lambda e: e.cast("double")
    k, s = F.col("p_partkey"), F.col("p_size")
    p = t("part").select(k.alias("id"), d(k % 11).alias("ax"), d(s).alias("ay"), d(k % 11 + 3 + s % 4).alias("bx"), d(s + 1).alias("by"), d(k % 11 + 1).alias("cx"), d(s + 4 + k % 3).alias("cy"))
    a, b, c = [(F.col(f"{n}x"), F.col(f"{n}y")) for n in "abc"]
    ox, oy = S.circumcentre(a, b, c)
    return p.select("id", F.round(ox, 4).alias("ox"), F.round(oy, 4).alias("oy"), S.in_circle(a, b, c, (a[0] + 2, a[1] + 2)).alias("inside"))


# --- Grids and meshes ----------------------------------------------------------------------------------------------


@query(f"SELECT x // 5 AS bx, y // 5 AS byy, z // 5 AS bz, dx, dy, dz, count(*) AS n FROM {GRID}, range(-1, 2) a(dx), range(-1, 2) b(dy), range(-1, 2) c(dz) WHERE (x + dx) // 5 = x // 5 + dx AND (y + dy) // 5 = y // 5 + dy AND (z + dz) // 5 = z // 5 + dz AND (dx <> 0 OR dy <> 0 OR dz <> 0) AND x + dx BETWEEN 0 AND 9 AND y + dy BETWEEN 0 AND 9 AND z + dz BETWEEN 0 AND 9 GROUP BY ALL")
def ghost_neighbourhood(t, spark):
    """Cells of each block that one of the 26 blocks around it looks at, by direction."""
    return K.ghost_cells(grid(spark), 5, 10).groupBy("bx", "byy", "bz", "dx", "dy", "dz").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT p_partkey AS id, p_size AS x1, p_partkey % 50 AS y1, p_size + p_partkey % 4 AS x2, p_partkey % 50 + 2 AS y2, p_size + 1 AS x3, p_partkey % 50 + p_size % 5 AS y3 FROM part),
c AS (SELECT id, least(4, x1 // 10) * 5 + least(4, y1 // 10) AS a, least(4, x2 // 10) * 5 + least(4, y2 // 10) AS b, least(4, x3 // 10) * 5 + least(4, y3 // 10) AS c FROM e)
SELECT id, CASE WHEN a = b AND b = c THEN a ELSE -1 END AS cell FROM c""")
def element_cells(t, spark):
    """Elements whose corners all lie in one cell of a 5 x 5 grid have that cell, all others the boundary's (-1)."""
    k, s = F.col("p_partkey"), F.col("p_size")
    e = t("part").select(k.alias("id"), F.array(F.struct(s.cast("long").alias("x"), (k % 50).alias("y")), F.struct((s + k % 4).alias("x"), (k % 50 + 2).alias("y")), F.struct((s + 1).cast("long").alias("x"), (k % 50 + s % 5).alias("y"))).alias("p"))
    return e.select("id", S.common_cell("p", 10, 5).alias("cell"))
