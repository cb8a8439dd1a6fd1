"""Tables in the folder that driver and executors share: they cut the lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset a session on one machine (a local master) gets a temporary folder. On a cluster that would
    be another folder on each machine, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; two calls never give the same one. All of a session's paths are removed when it ends."""
    sc = spark.sparkContext
    root = f"{shared_dir(spark)}/tessera-{sc.applicationId}"
    if getattr(sc, "_tessera_root", None) != root:
        path = sc._jvm.org.apache.hadoop.fs.Path(root)
        files = path.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(path)  # only a path that exists is remembered
        files.deleteOnExit(path)
        sc._tessera_root = root
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a lost executor costs no more than the tasks that it was running."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a task is dealt at most on average where ``dealt`` is used: some 200 MB when they are sorted or hashed.
TASK_ROWS = 1_000_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt out by keys to as many tasks as ``rows`` asks for, so that a task's memory doesn't grow with the input.

    Tables that meet in a join are dealt by the same ``rows``, the sum of both. Where the session's own number of
    tasks will do, ``df`` stays as it is: adaptive execution then sees to skewed keys, which it doesn't in dealt tables.
    """
    n = -(-rows // TASK_ROWS)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


#: A key with more than this part of all rows is hot; so fewer keys than this can be, 100 bytes each.
HOT_SHARES = 10_000


def with_labels(rows: DataFrame, labels: DataFrame, key: str | list[str], copies: str, total: int | None = None) -> DataFrame:
    """``rows`` joined with the one label row of their key (a column or several, never null), however many rows a key holds.

    ``copies`` is the column of ``labels`` that tells how many rows have the key. Keys with more than
    1 / HOT_SHARES of all rows are fewer than HOT_SHARES: their labels are broadcast, and their rows
    stay where they are. The others meet by a shuffle. Both tables are read twice, so they should be
    written ones. Rows without a label go, as in any inner join. ``total``: the number of rows, if known.
    """
    hot = F.col(copies) * HOT_SHARES > (rows.count() if total is None else total)
    few, rest = F.broadcast(labels.where(hot).drop(copies)), labels.where(~hot).drop(copies)
    cold = rows.join(F.broadcast(labels.where(hot).select(key)), key, "left_anti")
    return rows.join(few, key).unionByName(cold.join(rest, key))
