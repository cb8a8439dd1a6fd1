import random

from tessera.operators import placement as P


def test_steals_against_the_plain_walk(spark):
    rnd = random.Random(4)
    rows = [(q, s, [rnd.randrange(12) for _ in range(rnd.randrange(4))] if rnd.random() < 0.9 else None, rnd.choice([0, 0, 1, 2, None])) for q in range(40) for s in rnd.sample(range(1000), 60)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "queue long, seq long, regions array<int>, thefts int, rank string")
    for quota in (1, 4, 6):
        got = {}
        for r in P.permitted_steals(df, "queue", "seq", "regions", "thefts", quota).collect():
            got.setdefault(r.queue, {})[r.rank] = r.seq
        for q in range(40):
            mine = sorted((s, r or []) for k, s, r, n in rows if k == q and (n or 0) < 2)
            assert [got[q][k] for k in sorted(got[q])] == P.greedy(mine, quota)
    assert P.permitted_steals(df.limit(0), "queue", "seq", "regions", "thefts").count() == 0


def test_greedy_order():
    tasks = [(1, ["a"]), (2, ["b"]), (3, ["a", "c"]), (4, ["c"]), (5, ["b"])]
    assert P.greedy(tasks, 4) == [1, 3, 2, 5] and P.greedy(tasks, 9) == [1, 3, 2, 5, 4] and P.greedy(tasks, 0) == []


def test_targets_and_sources(spark):
    procs = spark.createDataFrame([(1,), (2,)], "proc int")
    barred = spark.createDataFrame([(1, 2)], "thief int, proc int")
    assert {r.thief: r.victim for r in P.steal_targets(procs, barred).collect()} == {1: None, 2: 1}
    aff = spark.createDataFrame([("p", "m1", 5, 9), ("p", "m2", 7, 9), ("p", "m3", 7, 1)], "processor string, memory string, bandwidth int, latency int")
    assert [r.memory for r in P.memory_stack(aff).orderBy("rank").collect()] == ["m2", "m3", "m1"]
    assert [r.memory for r in P.memory_stack(aff, "latency").orderBy("rank").collect()] == ["m3", "m1", "m2"]
    inst = spark.createDataFrame([("r", "m1"), ("r", "m2"), ("s", "m3")], "region string, memory string")
    links = spark.createDataFrame([("m2", "m9", 4)], "source string, destination string, bandwidth int")
    copies = spark.createDataFrame([(1, "r", "m1"), (2, "r", "m9"), (3, "s", "m9"), (4, "none", "m9")], "copy int, region string, destination string")
    assert sorted((r.copy, r.memory, r.rank) for r in P.copy_sources(copies, inst, links).collect()) == [(1, "m1", 1), (2, "m2", 1), (3, "m3", 1)]
