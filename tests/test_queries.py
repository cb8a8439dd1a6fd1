"""Every query that has SQL gives the rows that DuckDB gives."""

import decimal

import pytest

from tessera import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(registry.queries())


@pytest.fixture(scope="session")
def duck(sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    return float(v) + 0.0 if isinstance(v, (float, decimal.Decimal)) else v


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted([tuple(plain(r[c]) for c in cols) for r in df.collect()], key=str)
    if name not in registry.oracle_sql():
        assert got, "tested in a file of its own"
        return
    found = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted([tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()], key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=2e-4) if any(isinstance(x, float) for x in a) else a == b


def test_windowed_epochs_imply_the_pairs(spark, sf):
    """Writers stand alone, readers and reducers of an epoch don't depend on each other: the pairs within an epoch are none."""
    from tessera.operators import depend as D
    from tessera.plans.queries_traces import ops

    rows = ops(lambda n: spark.read.parquet(f"{sf}/{n}.parquet"))
    e = D.epochs(rows, "region", "seq", "priv").select("seq", "epoch")
    pairs = D.all_pairs(rows, "region", "seq", "priv")
    joined = pairs.join(e.toDF("prev", "ea"), "prev").join(e.toDF("next", "eb"), "next")
    assert joined.where("ea = eb").isEmpty() and joined.where("ea > eb").isEmpty()


def test_claims_and_reductions(spark):
    from pyspark.sql import functions as F

    from tessera.operators import coloring as C
    from tessera.operators import launch as L

    c = spark.createDataFrame([(0, 1), (1, 1), (1, 2)], "color int, ptr long")
    with pytest.raises(C.ColoringError):
        C.declared(c, True)
    assert C.declared(c, False) is c
    with pytest.raises(ValueError):
        L.register_reduction("sum", 0, F.sum, None)
    with pytest.raises(ValueError):
        L.predicated(c, None)
    assert L.predicated(c, False).count() == 0
