"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within them.

Equal vectors of a label are one point first. Labels with many points are divided into
cells, whose centers are fit on a bounded sample; every point is assigned. A point also
visits each cell c, beside its home h, that a partner may live in: a partner a of b stands
at an angle of at most t = acos(least) from b, so a can only prefer c if b stands at most t
behind the border of c and h, which is b.h - b.c <= sin(t) |c - h|. This holds in every
direction and for vectors of any spectrum. So all partners of a point are found in its home
cell, where its links are counted once. (``z`` allows for that many times the part of
sqrt(2 - 2 least) that falls on one direction of evenly spread differences instead. It visits
fewer cells and loses links that lie along few directions; op5 doesn't use it.)

Cells with many points are divided into blocks, a task each: a block's own points stay in
memory and the cell's points stream by, so memory is bounded at any cell size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ship, table, written
from tessera.operators.graph import linked_components
from tessera.llm.simhash import _root, _union

#: Points that the centers are fit on; cells in all; points for a cell; own points of a block.
MAX_SAMPLE, MAX_CELLS, CELL, BLOCK = 20_000, 4_096, 1_000, 1_024
ROUNDS = 8
#: More than the rounding errors of the products that a point's cells are told by.
ROUNDING = 1e-7


@dataclass
class Cells:
    """Centers by group; a group without centers is one cell."""

    centers: dict[str, np.ndarray] = field(default_factory=dict)

    def names(self) -> list[str]:
        return [f"{g}/{i}" for g, c in self.centers.items() for i in range(len(c))]


def _as_doubles(arr: pa.Array) -> list[np.ndarray | None]:
    """Valid vectors as doubles; None for null, zero and those with null or non-finite components."""
    out: list[np.ndarray | None] = []
    offsets, flat = arr.offsets.to_numpy(), arr.values
    nulls = np.asarray(flat.is_null().to_numpy(zero_copy_only=False)) if flat.null_count else None
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    for i, known in enumerate(arr.is_valid().to_pylist()):
        v = values[offsets[i] : offsets[i + 1]]
        with np.errstate(over="ignore"):
            good = known and len(v) and np.isfinite(v).all() and v.any() and not (nulls is not None and nulls[offsets[i] : offsets[i + 1]].any())
            if good:  # so that no square over- or underflows
                v = v / np.abs(v).max()
        out.append(v + 0.0 if good else None)
    return out


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, group, raw): group is label and dimension, null for what links with nothing."""
    for b in batches:
        vectors = _as_doubles(b.column(2))
        groups = [None if v is None or x is None else f"{x}:{len(v)}" for v, x in zip(vectors, b.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(groups, pa.string()), pa.array([v.tobytes() if g is not None else None for v, g in zip(vectors, groups, strict=True)], pa.binary())],
            names=["id", "grp", "raw"])


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k unit centers of the unit rows of x; begins with rows spread evenly over x."""
    centers = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        home = np.argmax(x @ centers.T, axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, home, x)
        size = np.linalg.norm(sums, axis=1)
        centers[size > 0] = sums[size > 0] / size[size > 0, None]
    return centers


def fit_cells(points: DataFrame, cell: int = CELL, max_cells: int = MAX_CELLS, max_sample: int = MAX_SAMPLE) -> Cells:
    """Centers for the groups of more than two cells' points, on at most ``max_sample`` of their points."""
    spark = points.sparkSession
    large = points.groupBy("grp").count().where(F.col("count") > 2 * cell).orderBy(F.desc("count"), "grp").limit(max_cells // 2).collect()
    if not large:
        return Cells()
    some = points.where(F.col("grp").isin([r["grp"] for r in large]))
    ids = some.select("pid").orderBy(F.xxhash64("pid"), "pid").limit(max_sample).collect()
    chosen = spark.createDataFrame(ids, some.select("pid").schema)
    of: dict[str, list[np.ndarray]] = {}
    for r in some.join(F.broadcast(chosen), "pid").orderBy("pid").select("grp", "raw").collect():  # max_sample vectors at most
        v = np.frombuffer(r["raw"])
        of.setdefault(r["grp"], []).append(v / np.linalg.norm(v))
    total = sum(r["count"] for r in large)
    out = Cells()
    for r in large:
        x = of.get(r["grp"], [])
        k = min(-(-r["count"] // cell), max(2, max_cells * r["count"] // total), len(x) // 4)
        if k > 1:
            out.centers[r["grp"]] = spherical_kmeans(np.stack(x), k)
    return out


def _places(cells: Cells, least: float, z: float | None):
    """(cell, role, pid, n, raw): role 0 in the home cell, 1 in each cell visited."""
    part = np.sqrt(2 - 2 * least)
    whole = np.sqrt(1 - least * least) if least >= 0 else np.inf  # beyond a right angle a partner may live anywhere

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            groups, raws = np.array(b.column("grp").to_pylist(), object), b.column("raw")
            names, of = np.unique(groups, return_inverse=True)
            cell, role, row = [], [], []
            for g, group in enumerate(names):
                mine, centers = np.flatnonzero(of == g), cells.centers.get(group)
                if centers is None:
                    cell += [group] * (2 * len(mine))
                    role += [0] * len(mine) + [1] * len(mine)
                    row += [mine, mine]
                    continue
                called = np.array([f"{group}/{i}" for i in range(len(centers))], object)
                for at in range(0, len(mine), 1024):
                    some = mine[at : at + 1024]
                    x, norm = _matrix(raws.take(pa.array(some)).to_pylist())
                    dots = (x / norm[:, None]) @ centers.T
                    home = np.argmax(dots, axis=1)
                    reach = whole if z is None else min(whole, z * part / np.sqrt(x.shape[1]))
                    seen, back = np.unique(home, return_inverse=True)
                    apart = np.sqrt(np.maximum(0, 2 - 2 * centers[seen] @ centers.T))[back]
                    near = dots.max(axis=1)[:, None] - dots <= np.where(apart > 0, reach * apart, 0) + ROUNDING
                    i, c = np.nonzero(near)
                    cell += [*called[home], *called[c]]
                    role += [0] * len(some) + [1] * len(i)
                    row += [some, some[i]]
            at = pa.array(np.concatenate(row))
            kept = [b.column(c).take(at) for c in ("pid", "n", "raw")]
            out = pa.RecordBatch.from_arrays([pa.array(cell, pa.string()), pa.array(role, pa.int32()), *kept], names=["cell", "role", "pid", "n", "raw"])
            for k in range(0, out.num_rows, 4096):
                yield out.slice(k, 4096)

    return run


def _matrix(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(raw)).reshape(len(raw), -1)
    return x, np.linalg.norm(x, axis=1)


def _compared(least: float):
    """(pid, linked, u, v): how many vectors a point is linked with, and links that connect what is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, pid, x, norm, linked, parent = None, [], None, None, None, None, None

        def result(pids: list, counts: list, u: list, v: list) -> pa.RecordBatch:
            gap_a, gap_b = [None] * len(u), [None] * len(pids)
            return pa.RecordBatch.from_arrays(
                [pa.array([*pids, *gap_a], pa.int64()), pa.array([*counts, *gap_a], pa.int64()), pa.array([*gap_b, *u], pa.int64()), pa.array([*gap_b, *v], pa.int64())],
                names=["pid", "linked", "u", "v"])

        def ended() -> pa.RecordBatch:
            root = _root(parent, np.arange(len(parent)))
            child = np.flatnonzero(root != np.arange(len(parent)))
            at = np.flatnonzero(linked)
            return result(pid[at].tolist(), linked[at].tolist(), pid[child].tolist(), pid[root[child]].tolist())

        for b in batches:
            cells, blocks, roles = (b.column(c).to_pylist() for c in ("cell", "block", "role"))
            pids, ns, raws = b.column("pid").to_numpy(), b.column("n").to_numpy(), b.column("raw").to_pylist()
            at = 0
            while at < b.num_rows:
                now, role, to = (cells[at], blocks[at]), roles[at], at + 1
                while to < b.num_rows and roles[to] == role and to - at < BLOCK and (cells[to], blocks[to]) == now:
                    to += 1
                if now != key:
                    if linked is not None and linked.any():
                        yield ended()
                    key, own, x, linked = now, [], None, None
                if role == 0:
                    own += zip(pids[at:to].tolist(), raws[at:to], strict=True)
                elif own:
                    if x is None:
                        pid = np.array([p for p, _ in own])
                        x, norm = _matrix([r for _, r in own])
                        linked, parent = np.zeros(len(own), np.int64), np.arange(len(own))
                    y, other = _matrix(raws[at:to])
                    hit = (x @ y.T) / np.outer(norm, other) >= least
                    hit &= pid[:, None] != pids[None, at:to]
                    if hit.any():
                        linked += hit @ ns[at:to]
                        first, any_ = np.argmax(hit, axis=0), np.flatnonzero(hit.any(axis=0))
                        i, j = np.nonzero(hit)
                        _union(parent, i, first[j])
                        yield result([], [], pids[at:to][any_].tolist(), pid[first[any_]].tolist())
                at = to
        if linked is not None and linked.any():
            yield ended()

    return run


def near_duplicate_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93,
    z: float | None = None, cell: int = CELL, block: int = BLOCK,
) -> DataFrame:
    """(id_col, n_links, component_id, kept), one row for each row of ``vectors``.

    Rows of one label are linked when their cosine in double precision is ``least`` or more.
    Rows with a null label, and vectors that are null, empty, zero or hold a null or
    non-finite component link with nothing; so do vectors of different length. Equal vectors
    of a label always link. component_id is the smallest id reachable, kept says whether
    it's the row's own. A null id counts as a partner but names no component: it takes the
    smallest id of its own, else null, and is not kept. Repeated rows count one each. Rows of one id whose
    vectors differ are vectors of their own, each with its own links; so their component may name that id for both. An
    empty table gives an empty one; other columns are not read.
    """
    ship(vectors.sparkSession)
    rows = written(
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
        .mapInArrow(_points, "id long, grp string, raw binary").withColumn("sha", F.sha2("raw", 256)),
        "vectors",
    )
    points = (
        rows.where("grp IS NOT NULL").groupBy("grp", "raw").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("n"))
        .withColumn("sha", F.sha2("raw", 256)).withColumn("pid", F.xxhash64("grp", "raw"))
    )
    points = written(points, "points")
    cells = fit_cells(points, cell)
    placed = points.mapInArrow(_places(cells, least, z), "cell string, role int, pid long, n long, raw binary")
    large = written(placed.where("role = 0").groupBy("cell").count().where(F.col("count") > block).select("cell", F.ceil(F.col("count") / block).cast("int").alias("k")), "large-cells")
    k = F.coalesce("k", F.lit(1))
    placed = placed.join(large, "cell", "left").withColumn(
        "block", F.explode(F.when(F.col("role") == 0, F.array(F.pmod(F.hash("pid"), k))).otherwise(F.sequence(F.lit(0), k - 1)))).select("cell", "block", "role", "pid", "n", "raw")
    found = written(
        placed.repartition("cell", "block").sortWithinPartitions("cell", "block", "role").mapInArrow(_compared(least), "pid long, linked long, u long, v long"), "found")
    linked = found.where("pid IS NOT NULL").groupBy("pid").agg(F.sum("linked").alias("linked"))
    roots = written(linked_components(found.where("u IS NOT NULL")), "roots")
    names = roots.join(points.select("pid", "least_id"), F.col("node") == F.col("pid")).groupBy("root").agg(F.min("least_id").alias("name"))
    named = roots.join(names, "root").select(F.col("node").alias("pid"), "name")
    of = (
        points.select("grp", "sha", "pid", "least_id", "n").join(linked, "pid", "left").join(named, "pid", "left")
        .select("grp", "sha", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("name", "least_id").alias("component_id"))
    )
    # What links with nothing is not sent to the join, where it would meet in one task.
    met = rows.where("grp IS NOT NULL").join(of, ["grp", "sha"]).select("id", "n_links", "component_id")
    alone = rows.where("grp IS NULL").select("id", F.lit(0).cast("long"), "id")
    return met.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op5_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach(u, w) AS (SELECT u, w FROM l UNION SELECT r.u, l.w FROM reach r JOIN l ON r.w = l.u),
c AS (SELECT u, min(w) AS w FROM reach GROUP BY u),
n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(c.w, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(c.w, vec_id)) AS kept
FROM embeddings LEFT JOIN c ON c.u = vec_id LEFT JOIN n ON n.u = vec_id
"""
