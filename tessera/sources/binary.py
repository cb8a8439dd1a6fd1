"""Fixed-width binary files: event and lock traces, particle sets.

Files are split at record borders into byte ranges, one task each; ranges are read through
the file system of their path, so a large file is read by many tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Little-endian layouts of 28-byte trace records, particles and their header.
EVENT = [("time", "<f8"), ("node", "<u4"), ("time_units", "<u4"), ("id", "<u4"), ("gen", "<u4"), ("action", "<u4")]
LOCK = [("time", "<f8"), ("node", "<u4"), ("time_units", "<u4"), ("lock_id", "<u4"), ("owner", "<u4"), ("action", "<u4")]
PARTICLE = [(f"{v}{a}", "<f4") for v in ("p", "hv", "v") for a in "xyz"]
PARTICLE_HEADER = [("rest_particles_per_meter", "<f4"), ("n", "<i4")]
SPARK = {"<f8": "double", "<f4": "float", "<u4": "long", "<i4": "int"}


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _decode(layout: list, skip: int, schema: pa.Schema):
    kind = np.dtype(layout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start, n in zip(*(b.column(c).to_pylist() for c in ("path", "start", "n")), strict=True):
                fs, at = opened(path)
                with fs.open_input_file(at) as f:
                    f.seek(skip + start * kind.itemsize)
                    rows = np.frombuffer(f.read(n * kind.itemsize), kind)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(rows), pa.string()), pa.array(np.arange(start, start + len(rows))), *(pa.array(rows[c], schema.field(c).type) for c, _ in layout)], schema=schema)

    return run


def read_records(spark: SparkSession, path: str, layout: list, skip: int = 0, step: int = 1 << 18) -> DataFrame:
    """(path, seq, fields) of the whole records in the files; a cut last record is left out."""
    size = np.dtype(layout).itemsize
    files = spark.read.format("binaryFile").load(path).select("path", F.floor((F.col("length") - skip) / size).alias("total")).where("total > 0")
    parts = files.select("path", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(step).cast("long"))).alias("start"))
    parts = parts.select("path", "start", F.least(F.lit(step).cast("long"), F.col("total") - F.col("start")).alias("n"))
    kinds = {"<f8": pa.float64(), "<f4": pa.float32(), "<u4": pa.int64(), "<i4": pa.int32()}
    schema = pa.schema([("path", pa.string()), ("seq", pa.int64()), *((c, kinds[k]) for c, k in layout)])
    return parts.repartition(max(1, parts.count())).mapInArrow(_decode(layout, skip, schema), ", ".join(["path string", "seq long", *(f"{c} {SPARK[k]}" for c, k in layout)]))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return read_records(spark, path, EVENT)


def read_locks(spark: SparkSession, path: str) -> DataFrame:
    return read_records(spark, path, LOCK)


def read_particles(spark: SparkSession, path: str) -> DataFrame:
    return read_records(spark, path, PARTICLE, np.dtype(PARTICLE_HEADER).itemsize)


def write_records(rows: DataFrame, folder: str, layout: list, header: bytes = b"") -> DataFrame:
    """One file for each partition; the manifest (path, n) names the files of the tasks that succeeded."""
    kind = np.dtype(layout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = opened(folder)
        fs.create_dir(at, recursive=True)
        path, n = f"{folder}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:8]}.bin", 0
        with fs.open_output_stream(opened(path)[1], compression=None) as out:
            out.write(header)
            for b in batches:
                data = np.zeros(b.num_rows, kind)
                for c, _ in layout:
                    data[c] = b.column(c).fill_null(0).to_numpy(zero_copy_only=False)
                out.write(data.tobytes())
                n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "n"])

    return rows.select(*[c for c, _ in layout]).mapInArrow(run, "path string, n long")


def save_particles(particles: DataFrame, folder: str, per_meter: float, total: int) -> DataFrame:
    """Particles in one file, padded with zeros to ``total`` rows, as the format's header counts them."""
    spark = particles.sparkSession
    have = particles.count()
    pad = spark.range(max(0, total - have)).select(*[F.lit(0.0).cast("float").alias(c) for c, _ in PARTICLE])
    header = np.array([(per_meter, max(total, have))], PARTICLE_HEADER).tobytes()
    return write_records(particles.select(*[c for c, _ in PARTICLE]).unionByName(pad).coalesce(1), folder, PARTICLE, header)


def tile(points: DataFrame, scale: int, width: float) -> DataFrame:
    """scale^3 copies of points (x, y, z), each moved by a multiple of ``width``."""
    s = F.sequence(F.lit(0), F.lit(scale - 1))
    return points.withColumn("i", F.explode(s)).withColumn("j", F.explode(s)).withColumn("k", F.explode(s)).select(
        *[(F.col(c) + F.col(n) * F.lit(width)).alias(c) for c, n in zip("xyz", "ijk", strict=True)], *[c for c in points.columns if c not in "xyz"])
