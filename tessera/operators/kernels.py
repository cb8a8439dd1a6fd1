"""Kernels of the applications: neighbour joins, blocked products, trees, LU factors."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import uts_child, uts_has_children
from tessera.operators.shared import written

#: A cell and the 26 around it.
AROUND = [(dx, dy, dz) for dx in (-1, 0, 1) for dy in (-1, 0, 1) for dz in (-1, 0, 1)]


def block_multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v) of the product of two matrices in rows (i, k, v)."""
    l, r = a.alias("l"), b.alias("r")
    return l.join(r, F.col("l.k") == F.col("r.i")).groupBy(F.col("l.i").alias("i"), F.col("r.k").alias("j")).agg(F.sum(F.col("l.v") * F.col("r.v")).alias("v"))


def tree_levels(roots: DataFrame, width: int, q: float, depth: int) -> DataFrame:
    """(node, depth) of the trees below ``roots``: each level is made from the one before, down to ``depth``."""
    level = roots.select("node", F.lit(0).alias("depth"))
    levels = [level]
    for d in range(1, depth + 1):
        children = F.explode(F.array(*[F.lit(k) for k in range(width)]))
        level = level.where(uts_has_children(F.col("node"), q)).withColumn("k", children).select(uts_child(F.col("node"), F.col("k")).alias("node"), F.lit(d).alias("depth"))
        levels.append(level)
    return reduce(DataFrame.union, levels)


class SingularMatrix(ArithmeticError):
    """No row that is left has a number other than zero in the pivot's column."""


def lu(rows: DataFrame, n: int, every: int = 8) -> DataFrame:
    """(id, rank, v): LU with partial pivoting of an n x n matrix given in rows (id, v array of doubles).

    Row ``id`` comes to place ``rank``; v holds the multipliers below the diagonal (which are 1 on it)
    and the upper triangle from it on. Of rows with equally large pivots that with the least id is taken.
    Each of the n steps brings one row, the pivot's, to the driver: n doubles. All others stay where they
    are, so a step is one pass over the rows without a shuffle. Every ``every`` steps they are written.
    """
    state = rows.select("id", F.col("v").cast("array<double>").alias("v"), F.lit(None).cast("int").alias("rank"))
    for k in range(n):
        here = F.col("v")[k]
        best = state.where("rank IS NULL").agg(F.max_by(F.struct("id", "v"), F.struct(F.abs(here), -F.col("id"))).alias("p")).first()["p"]
        if best is None or not best["v"][k]:
            raise SingularMatrix(f"column {k}")
        pivot = F.array(*map(F.lit, best["v"]))
        factor = here / F.lit(best["v"][k])
        step = F.transform("v", lambda x, i: F.when(i < k, x).when(i == k, factor).otherwise(x - factor * F.get(pivot, i)))  # noqa: B023
        lower = F.col("rank").isNull() & (F.col("id") != best["id"])
        state = state.select("id", F.when(lower, step).otherwise(F.col("v")).alias("v"), F.when(F.col("id") == best["id"], k).otherwise(F.col("rank")).alias("rank"))
        if (k + 1) % every == 0:
            state = written(state, "lu")
    return state.select("id", "rank", "v")


def lu_product(factors: DataFrame) -> DataFrame:
    """(i, j, v): the matrix whose rows ``lu`` divided, row numbers as before."""
    cells = factors.select("id", "rank", F.posexplode("v").alias("k", "x"))
    left = cells.where("k < rank").select("id", "k", "x").union(factors.select("id", F.col("rank"), F.lit(1.0)))
    right = cells.where("k >= rank").select(F.col("rank").alias("k"), F.col("k").alias("j"), F.col("x").alias("y"))
    return left.join(right, "k").groupBy(F.col("id").alias("i"), "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def circuit(nodes: DataFrame, wires: DataFrame, substep: str, steps: int, substeps: int, segments: int, dt: float, leak: float) -> DataFrame:
    """(ptr, v) after ``steps`` steps. Wires (id, a, b, r, i0.., v1..) take the voltages of both ends, run ``substeps`` steps within
    (``substep`` is their select list) and give the charge of their outer segments to both ends. Each step's tables are made from the last one's."""
    from tessera.operators.launch import reduce_into

    for s in range(steps):
        ends = wires.join(nodes.toDF("a", "v0"), "a").join(nodes.toDF("b", f"v{segments}"), "b")
        for _ in range(substeps):
            ends = ends.selectExpr(*_split(substep))
        wires = ends.drop("v0", f"v{segments}")
        if s + 1 < steps:
            wires = written(wires, "wires")  # two tables in turn: the next step reads the one and makes another
        charge = wires.select(F.explode(F.array(
            F.struct(F.col("a").alias("p"), (F.col("i0") * F.lit(-dt)).alias("q")), F.struct(F.col("b").alias("p"), (F.col(f"i{segments - 1}") * F.lit(dt)).alias("q")))).alias("c")).select("c.p", "c.q")
        nodes = reduce_into(nodes, "ptr", "v", charge, "p", F.col("q")).withColumn("v", F.col("v") * (1 - leak))
    return nodes


def _split(selected: str) -> list[str]:
    """A select list by the commas outside of parentheses."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(selected):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(selected[start:i].strip())
            start = i + 1
    return [*out, selected[start:].strip()]


def settle(nodes: DataFrame, wires: DataFrame, rate: float, least: float, most: int = 10_000) -> DataFrame:
    """(ptr, v) once no voltage moves by ``least`` or more in a step. Wires (a, b, r) drive a current by the voltage between their ends;
    the capacity of a node is the sum of its wires' conductances, so a rate of up to 1 is stable.

    Raises ArithmeticError if that isn't so after ``most`` steps, as with a rate above 1.
    """
    both = written(wires.select("a", "b", "r").union(wires.select("b", "a", "r")).groupBy("a", "b").agg(F.sum(1 / F.col("r")).alias("g")), "conductances")
    for step in range(most):
        flow = both.join(nodes.toDF("b", "vb"), "b").join(nodes.toDF("a", "va"), "a").groupBy(F.col("a").alias("ptr")).agg((F.sum((F.col("vb") - F.col("va")) * F.col("g")) / F.sum("g")).alias("i"))
        new = nodes.join(flow, "ptr", "left").select("ptr", (F.col("v") + rate * F.coalesce("i", F.lit(0.0))).alias("v"), (rate * F.coalesce("i", F.lit(0.0))).alias("moved"))
        new = written(new, "voltages")
        nodes = new.select("ptr", "v")
        if (new.agg(F.max(F.abs("moved"))).first()[0] or 0.0) < least:
            return nodes
    raise ArithmeticError(f"voltages still move after {most} steps")


def tree_search(roots: DataFrame, width: int, q: float) -> DataFrame:
    """(node, depth) of all nodes below ``roots``: levels are made until one is empty, and each is written."""
    level = written(roots.select("node", F.lit(0).alias("depth")), "level")
    levels = level
    while not level.isEmpty():
        children = F.explode(F.array(*[F.lit(k) for k in range(width)]))
        below = level.where(uts_has_children(F.col("node"), q)).withColumn("k", children).select(uts_child(F.col("node"), F.col("k")).alias("node"), (F.col("depth") + 1).alias("depth"))
        level = written(below, "level")
        levels = levels.union(level)
    return levels


#: Points of a cell that a task holds at once, and pairs that a task tests on average.
CELL_BLOCK, TASK_PAIRS = 1024, 20_000_000


def near_sums(points: DataFrame, radius: float, rest: list[str], sums: dict[str, Column]) -> DataFrame:
    """(id, sums) over the other points at most ``radius`` away, for points that have one.

    The terms are told from o_c and p_c, the columns c (id, x, y, z and ``rest``) of the point itself and of the other one, and d2, their squared
    distance. No pair is written or shuffled: copies of the points meet in their cells and each task sums what it tests. The work grows
    with the pairs, as it must; what is moved with the points. A crowded cell is split into blocks, which each visitor meets in turn.
    """
    cells, cols = ["c0", "c1", "c2"], ["id", *"xyz", *rest]
    at = points.select(*cols, *[F.floor(F.col(c) / radius).cast("long").alias(k) for c, k in zip("xyz", cells, strict=True)]).where(" AND ".join(f"{c} IS NOT NULL" for c in "xyz"))
    at = written(at, "cells")
    sizes = written(at.groupBy(*cells).agg(F.count(F.lit(1)).alias("n")), "cell-sizes")
    step = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(cells, d, strict=True)]) for d in AROUND])
    move = lambda df: df.withColumn("d", F.explode(step)).select(*[c for c in df.columns if c not in cells], *[(F.col(k) + F.col(f"d.{k}")).alias(k) for k in cells])
    pairs = move(sizes.withColumnRenamed("n", "m")).join(sizes, cells).agg(F.sum(F.col("m").cast("double") * F.col("n"))).first()[0] or 0.0
    tasks = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(pairs / TASK_PAIRS))
    blocks = F.ceil(F.col("n") / CELL_BLOCK)
    own = at.join(sizes, cells).select(*[F.col(c).alias(f"p_{c}") for c in cols], *cells, F.pmod(F.xxhash64("id"), blocks).alias("block"))
    ask = move(at).join(sizes, cells).select(*[F.col(c).alias(f"o_{c}") for c in cols], *cells, F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"))
    key = [*cells, "block"]
    d2 = reduce(lambda a, b: a + b, [(F.col(f"o_{c}") - F.col(f"p_{c}")) * (F.col(f"o_{c}") - F.col(f"p_{c}")) for c in "xyz"])
    met = ask.repartition(tasks, *key).join(own.repartition(tasks, *key).hint("merge"), key).where((F.col("o_id") != F.col("p_id")) & (d2 <= radius * radius)).withColumn("d2", d2)
    return met.groupBy(F.col("o_id").alias("id")).agg(*[F.sum(v).alias(k) for k, v in sums.items()])


def sph_density(points: DataFrame, h: float, factor: float) -> DataFrame:
    """(id, rho): factor x (h^6 + the sum of (h^2 - r^2)^3 over the neighbours within h)."""
    part = F.lit(h * h) - F.col("d2")
    sums = near_sums(points, h, [], {"t": part * part * part})
    return points.select("id").join(sums, "id", "left").select("id", (F.lit(factor) * (F.coalesce("t", F.lit(0.0)) + h**6)).alias("rho"))


def sph_advance(points: DataFrame, h: float, factor: float, pressure: float, rest: float, dt: float, gravity: float = 9.8) -> DataFrame:
    """(id, x, y, z) after a step from rest: pressure pushes the two of each pair apart, gravity pulls along z."""
    dense = points.join(sph_density(points, h, factor), "id")
    far = F.greatest(F.sqrt("d2"), F.lit(1e-12))
    k = pressure * (h - far) * (h - far) / far * (F.col("o_rho") + F.col("p_rho") - 2 * rest) / (F.col("o_rho") * F.col("p_rho"))
    force = near_sums(dense, h, ["rho"], {f"f{c}": k * (F.col(f"o_{c}") - F.col(f"p_{c}")) for c in "xyz"})
    moved = lambda c: F.col(c) + dt * dt * (F.coalesce(F.col(f"f{c}"), F.lit(0.0)) - (gravity if c == "z" else 0.0))
    return points.join(force, "id", "left").select("id", *[moved(c).alias(c) for c in "xyz"])


def heat_step(cells: DataFrame, k: float) -> DataFrame:
    """(x, y, v): each face between two cells carries k times their difference, from the warmer to the colder one."""
    faces = cells.withColumn("d", F.explode(F.array(F.struct(F.lit(1).alias("dx"), F.lit(0).alias("dy")), F.struct(F.lit(0).alias("dx"), F.lit(1).alias("dy")))))
    faces = faces.select("x", "y", "v", (F.col("x") + F.col("d.dx")).alias("ox"), (F.col("y") + F.col("d.dy")).alias("oy")).join(cells.toDF("ox", "oy", "ov"), ["ox", "oy"])
    flux = F.lit(k) * (F.col("ov") - F.col("v"))
    both = faces.select(F.explode(F.array(F.struct("x", "y", flux.alias("f")), F.struct(F.col("ox").alias("x"), F.col("oy").alias("y"), (-flux).alias("f")))).alias("e")).select("e.*")
    return cells.join(both.groupBy("x", "y").agg(F.sum("f").alias("f")), ["x", "y"], "left").select("x", "y", (F.col("v") + F.coalesce("f", F.lit(0.0))).alias("v"))


def restrict(cells: DataFrame, axes: list[str]) -> DataFrame:
    """(axes, v, n): coarse cells, each the average of its children, two along each axis."""
    return cells.groupBy(*[F.floor(F.col(a) / 2).alias(a) for a in axes]).agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("n"))


def fdtd(fields: DataFrame, dtdx: float, steps: int) -> DataFrame:
    """(id, x, y, z, ex.. hz) after ``steps`` steps: H by the curl of E ahead, then E by the curl of H behind. Windows run along single lines of the grid."""
    from pyspark.sql import Window

    for _ in range(steps):
        for own, other, shift, sign in (("h", "e", F.lead, 1), ("e", "h", F.lag, -1)):
            def slope(axis: str, along: str, other=other, shift=shift, sign=sign):
                g = F.col(other + axis)
                line = Window.partitionBy(*[c for c in "xyz" if c != along]).orderBy(along)
                return sign * (F.coalesce(shift(g).over(line), g) - g)

            new = {}
            for i, c in enumerate("xyz"):
                a, b = "xyz"[(i + 1) % 3], "xyz"[(i + 2) % 3]
                new[own + c] = F.col(own + c) + F.lit(dtdx) * (slope(b, a) - slope(a, b))
            fields = fields.withColumns(new)
    return fields


def histogram(rows: DataFrame, buckets: int, strategy: str) -> DataFrame:
    """(bucket, n) for all buckets, by one of the ways to reduce: direct, list or single. All give the same rows."""
    zero = rows.sparkSession.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("n"))
    if strategy == "single":
        # An array of counts for each part of the rows, then the sum of each slot.
        part = rows.groupBy(F.spark_partition_id().alias("part"), "bucket").agg(F.count(F.lit(1)).alias("c")).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "c"))).alias("m"))
        added = part.select(F.explode("m").alias("bucket", "c")).groupBy("bucket").agg(F.sum("c").alias("c"))
    elif strategy in ("direct", "list"):
        log = rows.select("bucket", F.lit(1).cast("long").alias("c"))
        if strategy == "list":
            log = written(log, "reduction-list")
        added = log.groupBy("bucket").agg(F.sum("c").alias("c"))
    else:
        raise ValueError(f"no strategy {strategy!r}")
    return zero.join(added, "bucket", "left").select("bucket", (F.col("n") + F.coalesce("c", F.lit(0))).alias("n"))


def reduction_copy(src: DataFrame, src_kind: str, dst: DataFrame, dst_kind: str) -> DataFrame:
    """(ptr, v): sums of one instance put into another. A list keeps every entry, a fold one for each pointer, a normal instance its own rows."""
    if dst_kind == "list":
        if src_kind != "list":
            raise ValueError("only a list is appended to a list")
        return dst.unionByName(src)
    add = src.groupBy("ptr").agg(F.sum("v").alias("v"))
    if dst_kind == "fold":
        return dst.unionByName(add).groupBy("ptr").agg(F.sum("v").alias("v"))
    return dst.join(add.withColumnRenamed("v", "d"), "ptr", "left").select("ptr", (F.col("v") + F.coalesce("d", F.lit(0))).alias("v"))


def sample_sort(rows: DataFrame, key: str, tie: str, bins: int = 64) -> DataFrame:
    """``rows`` with ``place`` from 1 on by key and tie. Splitters are quantiles of the key told by a sketch of bounded size; rows are counted by
    bin, a bin begins after all rows of those before it, and places within it are told by a window over the bin alone."""
    from pyspark.sql import Window

    splitters = rows.stat.approxQuantile(key, [i / bins for i in range(1, bins)], 0.001)
    bin_of = F.lit(0)
    for s in sorted(set(splitters)):
        bin_of = bin_of + (F.col(key) > s).cast("int")
    binned = rows.withColumn("bin", bin_of)
    sizes = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))  # bins rows
    first = sizes.select("bin", F.coalesce(F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("bin").orderBy(key, tie))
    return binned.withColumn("k", within).join(F.broadcast(first), "bin").select(*rows.columns, (F.col("first") + F.col("k")).alias("place"))


def ghost_cells(grid: DataFrame, width: int, size: int) -> DataFrame:
    """(id, bx, byy, bz, dx, dy, dz): cells of a block that stand at its border towards the block in direction (dx, dy, dz)."""
    step = F.array(*[F.lit(v) for v in (-1, 0, 1)])
    around = grid.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step)).withColumn("dz", F.explode(step)).where("dx <> 0 OR dy <> 0 OR dz <> 0")
    for c in "xyz":
        there = F.col(c) + F.col(f"d{c}")
        around = around.where((F.floor(there / width) == F.floor(F.col(c) / width) + F.col(f"d{c}")) & there.between(0, size - 1))
    return around.select("id", *[F.floor(F.col(c) / width).alias(n) for c, n in zip("xyz", ("bx", "byy", "bz"), strict=True)], "dx", "dy", "dz")
