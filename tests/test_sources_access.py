import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.coloring import ColoringError
from tessera.plans import access as A
from tessera.plans.catalog import Catalog
from tessera.sources import binary, text


def test_trace_round_trip(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") / 10).alias("time"), *[(F.col("id") % k).alias(n) for n, k in (("node", 4), ("time_units", 7), ("id", 50), ("gen", 3), ("action", 4))])
    folder = str(tmp_path / "trace")
    manifest = binary.write_records(df.repartition(3), folder, binary.EVENT).collect()
    assert sum(r.n for r in manifest) == 1000
    back = binary.read_records(spark, folder, binary.EVENT, step=77)
    assert sorted(map(tuple, back.select(*df.columns).collect())) == sorted(map(tuple, df.collect()))


def test_particles_are_padded(spark, tmp_path):
    p = spark.range(5).select(*[(F.col("id") + i).cast("float").alias(c) for i, (c, _) in enumerate(binary.PARTICLE)])
    path = binary.save_particles(p, str(tmp_path / "p"), 2.5, 8).first().path
    data = open(path, "rb").read()
    assert np.frombuffer(data[:8], binary.PARTICLE_HEADER)[0].tolist() == (2.5, 8) and len(data) == 8 + 8 * 36
    rows = binary.read_particles(spark, path).collect()
    assert len(rows) == 8 and sum(r.pz == 0 for r in rows) == 3
    assert binary.tile(spark.createDataFrame([(0.0, 0.0, 0.0)], "x double, y double, z double"), 2, 1.5).distinct().count() == 8


def test_meshes_and_machines(spark, tmp_path):
    (tmp_path / "m.node").write_text("3 2 0 1\n 1 0.5 1.5 0 # c\n2 1 2 1\n\n3 -1e-3 4 0\n")
    got = text.read_mesh(spark, str(tmp_path / "m.node"), text.NODES).collect()
    assert [tuple(r) for r in got] == [(1, 0.5, 1.5, 0), (2, 1.0, 2.0, 1), (3, -0.001, 4.0, 0)]
    (tmp_path / "machine").write_text("proc p0 cpu\nmem m0 4k\nmem m1 2G\naffinity p0 m0 10 5\n")
    m = text.read_machine(spark, str(tmp_path / "machine"))
    assert {r.name: r.bytes for r in m["memories"].collect()} == {"m0": 4096, "m1": 2 << 30}
    assert m["affinities"].first().bandwidth == 10.0
    (tmp_path / "out.stdio").write_text("x\nELAPSED TIME = 5.25 s\n")
    assert [tuple(r) for r in text.read_results(spark, str(tmp_path / "out.stdio")).collect()] == [("out.stdio", 5.25)]


def test_logs_come_back(spark, tmp_path):
    tables = {}
    for name, r in text.RECORDS.items():
        tables[name] = spark.createDataFrame([tuple(i * 10 + k if t == "long" else f"n {i}" for k, (_, t) in enumerate(r.fields)) for i in range(3)], ", ".join(f"{n} {t}" for n, t in r.fields))
        text.log_lines(tables[name], name).write.mode("append").text(str(tmp_path / "log"))
    spark.createDataFrame([("noise",)], "value string").write.mode("append").text(str(tmp_path / "log"))
    back = text.read_log(spark, str(tmp_path / "log"))
    assert len(text.RECORDS) == 19 and back["other"].count() == 1
    for name in text.RECORDS:
        assert sorted(map(tuple, back[name].collect())) == sorted(map(tuple, tables[name].collect())), name


LINES = """[0 - 7f3a10] {2}{log}: Task Operation 7 3 1 0
[12 - ab] {info}{log}: Region 1 2 3
Region 4 5 6
[0 - 7f] {2}{log}: Logical Requirement Field 7 0 5
[0 - 7f] {2}{log}: Logical Requirement 7 0 1 2 3 4 16 0 0
[0 - 7f] {2}{log}: Task Operation 7 x 1 0
[0 - 7f] {2}{log}: Task Operation 99999999999999999999 3 1 0
"""
OLD = """[0 - 7f] {2}{log}: Task ID 4 main task
[0 - 7f] {2}{log}: Task 9 child Task ID 4 Parent Context 1
[0 - 7f] {2}{log}: Region ab12
[0 - 7f] {2}{log}: Region ab13 Parent c0
[0 - 7f] {2}{log}: Partition 5 Parent ab12 Disjoint 1
[0 - 7f] {2}{log}: Event Event 80000001 1 ff 2
[0 - 7f] {2}{log}: Event Copy Event a 1 b c d e f a0 b0 2
[0 - 7f] {2}{log}: Index Task Launch 3 9 a 1 b 2 c 3 2 10 20 30
"""


def test_log_formats(spark, tmp_path):
    (tmp_path / "new").write_text(LINES)
    (tmp_path / "old").write_text(OLD)
    t = text.read_log(spark, str(tmp_path / "new"))
    assert sorted(map(tuple, t["task"].collect()), key=str) == [(7, 3, 1, 0), (None, 3, 1, 0)]
    assert sorted(map(tuple, t["region"].collect())) == [(1, 2, 3), (4, 5, 6)]
    assert t["req_field"].count() == t["requirement"].count() == t["other"].count() == 1
    t = text.read_log(spark, str(tmp_path / "old"), text.LEGACY)
    assert len(text.LEGACY) == 16 and t["other"].count() == 0
    assert tuple(t["task_name"].first()) == (4, "main task") and tuple(t["task"].first()) == (9, "child", 4, 1)
    assert tuple(t["region"].first()) == ("ab12",) and tuple(t["subregion"].first()) == ("ab13", "c0")
    assert tuple(t["event_event"].first()) == ("80000001", 1, "ff", 2) and t["copy"].count() == 1
    assert text.index_points(t["index_launch"]).first().point == [10, 20]
    (tmp_path / "machine").write_text("processor P0 type1 1\nmemory M2 32k\n\naffinity P0 M2 100 1\nwhat is this\n")
    m = text.read_machine(spark, str(tmp_path / "machine"))
    assert tuple(m["processors"].first()) == ("P0", "type1", 1) and tuple(m["memories"].first()) == ("M2", 32768)
    assert tuple(m["affinities"].first()) == ("P0", "M2", 100.0, 1.0)


def test_access(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "ptr long, x double, y double")
    r = A.Region("r", df, "ptr", {"y": A.READ_ONLY})
    assert r.fields() == ["x", "y"]
    for bad, error in [
        (A.Requirement("r", A.READ_ONLY, ("q",)), A.UnknownField), (A.Requirement("r", A.READ_ONLY, ("x", "x")), A.DuplicateField),
        (A.Requirement("r", A.READ_ONLY, ("x",), ("y",)), A.InstanceOutsidePrivilege), (A.Requirement("r", A.READ_WRITE, ("y",)), A.PrivilegeExceeded),
        (A.Requirement("r", A.READ_WRITE, ("x",), projected=True, disjoint=False), A.AliasedWrite),
    ]:
        with pytest.raises(error):
            bad.check(r)
    A.Requirement("r", A.REDUCE, ("x",), projected=True, disjoint=False).check(r)
    A.Requirement("r", A.READ_ONLY, ("x", "y"), ("x",)).check(r)

    @A.access(reads={"r": ["y"]}, writes={"r": ["x"]})
    def task(r):
        return {"r": r.withColumn("x", F.col("y") * 2)}

    assert task(r=r)["r"].first().x == 6.0

    @A.access(reads={"r": ["y"]})
    def sneaky(r):
        return {"r": r.withColumn("x", F.lit(1.0))}

    with pytest.raises(A.ReadOnlyResult):
        sneaky(r=r)


def test_catalog(spark):
    c = Catalog(spark)
    space = c.create_index_space(10)
    halves = c.create_partition(space, spark.range(10).select(F.floor(F.col("id") / 5).alias("color"), F.col("id").alias("ptr")), True)
    ghosts = c.create_partition(space, spark.createDataFrame([(0, 5), (1, 4), (1, 5)], "color long, ptr long"), False)
    with pytest.raises(ColoringError):
        c.create_partition(space, spark.createDataFrame([(0, 5), (1, 5)], "color long, ptr long"), True)
    a, b, g, h = c.subspace(halves, 0), c.subspace(halves, 1), c.subspace(ghosts, 0), c.subspace(ghosts, 1)
    assert c.subspace(halves, 0) == a and c.path(a, space) == [0, 0] and c.path(h, space) == [1, 1]
    assert not c.aliased(a, b) and c.aliased(a, g) and c.aliased(g, h) and c.aliased(a, space) and not c.aliased(a, c.create_index_space(3))
    fs = c.create_field_space(x="double", y="int")
    c.free_field(fs, "y")
    assert c.create_region("r", space, fs).columns == ["ptr", "x"] and c.nodes[b].table.count() == 5
    assert c.table().count() == len(c.nodes) and c.dump()[0].startswith("space")
    c.destroy(space)
    assert c.regions == {} and len(c.nodes) == 1
