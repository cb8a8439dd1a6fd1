"""What the operators of this package share: packaging, tables, row keys; written tables come from the library."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.shared import HOT_SHARES, scratch, shared_dir, with_labels, written  # noqa: F401


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    to = os.path.join(tempfile.mkdtemp(prefix="tessera-ship-"), "tessera_ship.zip")
    with zipfile.ZipFile(to, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(to)
    sc._tessera_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(id_col: str, text_col: str):
    """What names a row: its id and the SHA-256 of its text. Equal rows have equal keys; never null."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.concat_ws(":", F.sha2(text, 256), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))


def with_row_key(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """``rows`` with the column ``row_key`` under a name that none of its columns has, and that name."""
    name, taken = "__key", {c.lower() for c in rows.columns}
    while name in taken:
        name += "_"
    return rows.withColumn(name, row_key(id_col, text_col)), name


#: Keys that are broadcast at most: 100 bytes each.
MAX_BROADCAST_KEYS = 100_000


def without_rows(rows: DataFrame, drop: DataFrame, key: str = "__key") -> DataFrame:
    """``rows`` without those whose key is in ``drop``, and without the key.

    The keys to drop are written and counted; a broadcast only follows if they are few, else a
    join by shuffle.
    """
    drop = written(drop.distinct(), "drop")
    if drop.count() <= MAX_BROADCAST_KEYS:
        drop = F.broadcast(drop)
    return rows.join(drop, key, "left_anti").drop(key)
