import numpy as np
import pytest

from tessera.llm import embeddings
from tessera.llm.embeddings import near_duplicate_vectors


def data(n=900, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(0, n - 3, 3):
        if i % 2:
            x[i + 1] = x[i] + rng.normal(size=dim) * 0.2
            x[i + 2] = x[i + 1] + rng.normal(size=dim) * 0.2
    rows = [(i + 1, [float(v) for v in x[i].astype(np.float32)], int(i % 7 == 0)) for i in range(n)]
    rows += [(2000 + i, rows[5][1], rows[5][2]) for i in range(40)] + [(3000 + i, [2 * v for v in rows[8][1]], rows[8][2]) for i in range(3)]
    rows += [(4001, None, 1), (4002, [0.0] * dim, 1), (4003, [float("nan")] * dim, 1), (4004, [None] + [1.0] * (dim - 1), 1), (4005, rows[5][1], None), (4006, rows[5][1][:-1], rows[5][2]), (4007, [], 1),
             (4008, [float("inf")] + [1.0] * (dim - 1), 1), (5000, rows[9][1], rows[9][2]), (5000, rows[9][1], rows[9][2])]
    return rows


def brute(rows, least=0.93):
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    n, parent = [0] * len(good), list(range(len(good)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(good)):
        for b in range(a):
            if good[a][2] == good[b][2] and len(good[a][1]) == len(good[b][1]):
                if good[a][1] @ good[b][1] / (np.linalg.norm(good[a][1]) * np.linalg.norm(good[b][1])) >= least:
                    n[a] += 1
                    n[b] += 1
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    least_of = {}
    for k, g in enumerate(good):
        least_of[find(k)] = min(least_of.get(find(k), g[0]), g[0])
    out = sorted((g[0], n[k], least_of[find(k)]) for k, g in enumerate(good))
    ids = [g[0] for g in good]
    return sorted(out + [(i, 0, i) for i, v, lab in rows if ids.count(i) == 0])


@pytest.mark.parametrize("cell,block", [(10_000, 10_000), (60, 64)])
def test_links_are_those_of_brute_force(spark, cell, block):
    rows = data()
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")
    got = near_duplicate_vectors(df, cell=cell, block=block, z=None).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert near_duplicate_vectors(df.limit(0)).count() == 0


def test_recall_with_the_default_reach(spark):
    rows = data(n=1500, dim=32, seed=5)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in near_duplicate_vectors(df, cell=50).collect()}
    want = {i: n for i, n, _ in brute(rows)}
    assert sum(got.values()) >= 0.99 * sum(want.values()) and all(got[i] <= want[i] for i in want)


def test_no_link_is_lost_in_a_large_label_whose_vectors_spread_along_few_directions(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(3000, 64)) / np.arange(1, 65)
    x /= np.linalg.norm(x, axis=1)[:, None]
    top = np.eye(64)[0]
    for i in range(0, 3000, 2):  # its partner at cosine 0.931 to 0.96, away from it along the first direction
        side = top - (top @ x[i]) * x[i]
        cos = rng.uniform(0.931, 0.96)
        x[i + 1] = cos * x[i] + np.sqrt(1 - cos * cos) * side / np.linalg.norm(side) * rng.choice([-1, 1])
    dots = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    want = (dots >= 0.93).sum(axis=1) - 1
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in near_duplicate_vectors(df).collect()}
    assert [got[i] for i in range(3000)] == want.tolist()


def test_null_ids(spark):
    v = [1.0, 2.0]
    df = spark.createDataFrame([(None, v, 1), (7, v, 1), (None, [2.0, -1.0], 1)], "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, near_duplicate_vectors(df).collect()), key=str)
    assert got == sorted([(None, 1, 7, False), (7, 1, 7, True), (None, 0, None, False)], key=str)


def test_one_id_on_two_vectors(spark):
    a, b, c = [1.0, 0.0], [0.0, 1.0], [0.01, 1.0]
    df = spark.createDataFrame([(7, a, 1), (7, b, 1), (8, c, 1), (9, a, 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, near_duplicate_vectors(df).collect())) == [(7, 1, 7, True), (7, 1, 7, True), (8, 1, 7, False), (9, 1, 7, False)]


@pytest.mark.parametrize("n", [300, 2500, 5000])
def test_links_at_several_sizes(spark, n):
    """With one cell and with several; every link is found, each point in blocks of 256."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 24))
    x[1::2] = x[::2] + rng.normal(size=(n // 2, 24)) * 0.3
    dots = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    want = (dots >= 0.93).sum(axis=1) - 1
    assert n // 4 < (want > 0).sum()
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in near_duplicate_vectors(df, block=256).collect()}
    assert [got[i] for i in range(n)] == want.tolist()


def op5_and_sql(spark, folder):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet')")
    want = sorted(con.execute(embeddings.OP5_SQL).fetchall())
    got = sorted(tuple(r) for r in embeddings.op5_embedding_dedup(spark, folder).select("vec_id", "n_links", "component_id", "kept").collect())
    return got, want


def test_op5_equals_sql(spark, sf):
    got, want = op5_and_sql(spark, sf)
    assert got == want


def test_op5_equals_sql_with_planted_links(spark, sf, tmp_path):
    """The given table may hold no link at all, so near copies of its vectors are added, on both sides of the threshold."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    given = pq.read_table(f"{sf}/embeddings.parquet")
    rows, rng = given.to_pylist(), np.random.default_rng(3)
    first = max(r["vec_id"] for r in rows) + 1
    for i, r in enumerate([r for r in rows if r["embedding"] and r["label"] is not None][:120]):
        v = np.array(r["embedding"], float)
        moved = v + rng.normal(size=len(v)) * np.linalg.norm(v) / np.sqrt(len(v)) * (0.1, 0.3, 0.39, 0.41, 0.6)[i % 5]
        rows.append({"vec_id": first + i, "embedding": moved.tolist(), "label": r["label"] if i % 7 else r["label"] + 1})
    pq.write_table(pa.Table.from_pylist(rows, given.schema), tmp_path / "embeddings.parquet")
    got, want = op5_and_sql(spark, str(tmp_path))
    assert got == want and sum(n > 0 for _, n, _, _ in want) > 60
