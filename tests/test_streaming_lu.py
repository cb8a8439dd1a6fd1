"""Streams give what the batch gives once the watermark has passed; LU against a plain one."""

import datetime as dt
import random

import numpy as np
import pytest

from tessera.operators import trace
from tessera.operators.kernels import SingularMatrix, lu, lu_product
from tessera.streaming import traces

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id long, action int, ts timestamp, n long"


def items():
    rnd = random.Random(3)
    out = []
    for i in range(40):
        for a in [0] * (i % 3 > 0) + [rnd.choice([1, 2, 3]) for _ in range(4)]:
            out.append((i, a, T0 + dt.timedelta(minutes=i * 5 + rnd.random() * 4), len(out)))
    return out


def collected(spark, path, name, make):
    df = make(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path))
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", path + "-state-" + name).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.table(name)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("items") / "in")
    rows = items()
    for part in (rows[:60], rows[60:120], rows[120:], [(-1, 1, T0 + dt.timedelta(days=2), -1)], [(-1, 1, T0 + dt.timedelta(days=4), -2)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def test_orphans(spark, folder):
    got = collected(spark, folder, "orphans", lambda s: traces.stream_orphans(s, ["id"]))
    want = trace.orphans(spark.createDataFrame(items(), SCHEMA), ["id"])
    assert sorted(r.n for r in got.collect() if r.n >= 0) == sorted(r.n for r in want.collect())


def test_lifetimes_and_counts(spark, folder):
    got = collected(spark, folder, "lives", lambda s: traces.stream_lifetimes(s, ["id"]))
    want = trace.lifetimes(spark.createDataFrame(items(), SCHEMA), ["id"], "ts")
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    counts = collected(spark, folder, "counts", lambda s: traces.stream_counts(s, ["action"], "1 hour"))
    assert counts.where(f"start < timestamp'{T0 + dt.timedelta(days=1)}'").groupBy().sum("n").first()[0] == len(items())


def test_lu(spark):
    a = np.random.default_rng(2).integers(-5, 6, (11, 11)).astype(float) + 3 * np.eye(11)
    rows = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(a)], "id long, v array<double>").repartition(3)
    factors = lu(rows, 11, every=4)
    got = sorted(factors.collect(), key=lambda r: r.rank)
    m = np.array([r.v for r in got])
    low, up = np.tril(m, -1) + np.eye(11), np.triu(m)
    assert np.allclose(low @ up, a[[r.id for r in got]]) and np.abs(low).max() <= 1
    back = np.zeros_like(a)
    for r in lu_product(factors).collect():
        back[r.i, r.j] = r.v
    assert np.allclose(back, a)
    with pytest.raises(SingularMatrix):
        lu(rows.limit(0), 2)
    with pytest.raises(SingularMatrix):
        lu(spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 4.0])], "id long, v array<double>"), 2)
