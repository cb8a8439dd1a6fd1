import random

import pytest

from tessera.operators import eventgraph as E
from tessera.operators import kernels as K
from tessera.operators import tasks


def test_collapsed_paths_are_those_over_events_only(spark):
    rnd = random.Random(3)
    names = [*(f"op {i}" for i in range(6)), *(f"event {i}.1" for i in range(12))]
    edges = sorted({(a, b) for a, b in ((rnd.choice(names), rnd.choice(names)) for _ in range(45)) if names.index(a) % 12 < names.index(b) % 12})
    want = set()
    for a in names[:6]:
        todo, seen = [a], set()
        while todo:
            at = todo.pop()
            for x, y in edges:
                if x == at and y not in seen:
                    seen.add(y)
                    (want.add((a, y)) if y.startswith("op") else todo.append(y))
    got = {tuple(r) for r in E.collapsed(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == want and want


def test_voltages_at_rest_are_those_of_a_plain_loop(spark):
    wires = [(0, 1, 2.0), (1, 2, 1.0), (2, 0, 4.0), (3, 2, 1.0)]
    v = {0: 5.0, 1: 0.0, 2: 1.0, 3: 2.0, 4: 7.0}
    got = {r.ptr: r.v for r in K.settle(spark.createDataFrame(list(v.items()), "ptr long, v double"), spark.createDataFrame(wires, "a long, b long, r double"), 0.5, 0.05).collect()}
    moved = 1.0
    while moved >= 0.05:
        new = {}
        for n in v:
            near = [(b if a == n else a, 1 / r) for a, b, r in wires if n in (a, b)]
            new[n] = v[n] + (0.5 * sum((v[m] - v[n]) * g for m, g in near) / sum(g for _, g in near) if near else 0.0)
        moved, v = max(abs(new[n] - v[n]) for n in v), new
    assert got == pytest.approx(v)


def test_registration_errors(spark):
    r = tasks.Registry()
    r.task("t", "expression")(lambda: [])
    for wrong in (lambda: r.task("t", "expression")(lambda: []), lambda: r.task("t", "gpu"), lambda: r.projection(0, lambda p: p), lambda: r.variant("unknown"), lambda: r.projected(spark.range(1), "id", 9, spark.range(1))):
        with pytest.raises(tasks.RegistrationError):
            wrong()
    assert r.structure("s", "a int, b struct<c: double>").fieldNames() == ["a", "b"]
    with pytest.raises(ValueError):
        K.histogram(spark.range(1).toDF("bucket"), 4, "unknown")
    with pytest.raises(ValueError):
        K.reduction_copy(spark.range(1), "fold", spark.range(1), "list")


def test_epochs_do_not_hang_on_the_order_of_rows_with_one_seq(spark):
    rows = [(1, 5, 0, 0, 1, 1), (1, 9, 0, 0, 1, 1), (1, 9, 0, 0, 1, 273), (1, 9, 0, 0, 1, 256)]
    for given in (rows, rows[::-1], [rows[2], rows[0], rows[3], rows[1]]):
        df = spark.createDataFrame(given, "ctx long, seq long, tree long, node int, fields long, priv int").coalesce(1)
        got = sorted((r.seq, r.usage, r.epoch, r.opens) for r in E.field_epochs(df, 4).collect())
        assert got == [(5, "read", 1, True), (9, "read", 4, True), (9, "reduce", 4, True), (9, "write", 4, True)]
