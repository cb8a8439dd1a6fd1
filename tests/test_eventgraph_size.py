"""Event graphs in tasks of bounded size, and dependences tested without all paths."""

import random

import pytest

from tessera.operators import eventgraph as E
from tessera.operators import shared
from tessera.sources.text import RECORDS


def test_tasks_grow_in_number_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(shared, "TASK_ROWS", 10)
    hops = [h for i in range(80) for h in ((f"op {i}", f"event {i}.1"), (f"event {i}.1", f"event {i}.2"), (f"event {i}.2", f"op {i + 1}"), (f"event {i}.2", f"op {i + 2}"))]
    got = E.collapsed(spark.createDataFrame(hops, "src string, dst string"))
    assert got.rdd.getNumPartitions() == 16  # 160 rows
    assert sorted(map(tuple, got.collect())) == sorted((f"op {i}", f"op {i + d}") for i in range(80) for d in (1, 2))


def paths_of(edges):
    out = set(edges)
    while (more := out | {(a, d) for a, b in out for c, d in edges if b == c}) != out:
        out = more
    return out


@pytest.mark.parametrize("rows", [10, 1_000_000])
@pytest.mark.parametrize("upward", [True, False])
def test_edge_report_is_that_of_all_paths(spark, monkeypatch, upward, rows):
    rnd = random.Random(7)
    monkeypatch.setattr(shared, "TASK_ROWS", rows)
    pick = lambda n: {(rnd.randrange(30), rnd.randrange(30)) for _ in range(n)}
    edges = {(a, b) for a, b in pick(70) if a < b or not upward}
    wanted = pick(120)
    if upward:
        monkeypatch.setattr(E, "reach", lambda *_: pytest.fail("all paths are as many as the square of a chain"))
    table = lambda rows: spark.createDataFrame(sorted(rows), "src long, dst long")
    got = {tuple(r) for r in E.edge_report(table(wanted), table(edges)).collect()}
    paths = paths_of(edges)
    assert got == {("missing", *p) for p in wanted - paths} | {("extra", *p) for p in edges - wanted} and wanted & (paths - edges)


def test_words_of_a_type_are_literal():
    for r in RECORDS.values():
        assert r.words and r.words.replace(" ", "").isalpha() and r.words in r.pattern
