"""Sums over near points are those of all pairs, in crowded cells too."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import kernels as K


@pytest.mark.parametrize("block, pairs", [(4, 500), (1024, 20_000_000)])
def test_sums_over_near_points(spark, monkeypatch, block, pairs):
    rnd = random.Random(5)
    monkeypatch.setattr(K, "CELL_BLOCK", block)
    monkeypatch.setattr(K, "TASK_PAIRS", pairs)
    crowd = [(i, *(rnd.uniform(0.05, 0.1) for _ in "xyz"), 1.0) for i in range(60)]
    rows = [*crowd, *((i, *(rnd.uniform(-0.3, 0.3) for _ in "xyz"), float(i)) for i in range(60, 260)), (300, 0.07, 0.07, 0.07, 2.0), (301, 0.07, 0.07, 0.07, 3.0), (302, None, 0.0, 0.0, 1.0)]
    table = spark.createDataFrame(rows, "id long, x double, y double, z double, w double")
    got = {r.id: (r.n, r.s) for r in K.near_sums(table, 0.05, ["w"], {"n": F.lit(1), "s": F.col("p_w") * F.col("d2") - F.col("o_w")}).collect()}
    want = {}
    for a in rows[:-1]:
        for b in rows[:-1]:
            d2 = sum((p - q) * (p - q) for p, q in zip(a[1:4], b[1:4], strict=True))
            if a[0] != b[0] and d2 <= 0.05 * 0.05:
                n, s = want.get(a[0], (0, 0.0))
                want[a[0]] = (n + 1, s + b[4] * d2 - a[4])
    assert got == {i: (n, pytest.approx(s)) for i, (n, s) in want.items()} and len(want) < 262


def test_pairs_are_summed_where_they_meet(spark):
    """One join makes pairs, and nothing above it but the sums by point is dealt again."""
    table = spark.range(50).selectExpr("id", "id / 1000D AS x", "0D AS y", "0D AS z")
    plan = K.near_sums(table, 0.05, [], {"n": F.lit(1)})._jdf.queryExecution().sparkPlan().toString()
    above = plan[: plan.index("SortMergeJoin")]
    assert "Join" not in above and "Generate" not in above and "HashAggregate" in above
