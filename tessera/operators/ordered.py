"""Ordered analytics in two levels, so that no task sees all rows.

A window without a partition sends every row to one task. Here rows are windowed within
chunks of the order key, and only one row of totals for each chunk is windowed over all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sums(df: DataFrame, chunk: Column, order: list, sums: dict[str, Column], exclusive: bool = False, by: list[str] | None = None) -> DataFrame:
    """``df`` with a running sum for each entry of ``sums``, within equal columns ``by`` (never null); chunk must not fall along the order."""
    by = by or []
    local = Window.partitionBy(*by, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    rows = df.withColumn("__chunk", chunk)
    for name, value in sums.items():
        rows = rows.withColumn(f"__v_{name}", value)
    before = Window.partitionBy(*by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*by, "__chunk").agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    offsets = totals.select(*by, "__chunk", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums])
    out = rows.select("*", *[F.coalesce(F.sum(f"__v_{n}").over(local), F.lit(0)).alias(f"__l_{n}") for n in sums]).join(offsets, [*by, "__chunk"])
    for n in sums:
        out = out.withColumn(n, F.col(f"__l_{n}") + F.col(f"__o_{n}"))
    return out.drop("__chunk", *[f"__{k}_{n}" for n in sums for k in "vlo"])


def runs(space: DataFrame, ptr: str = "ptr", bits: int = 20) -> DataFrame:
    """(start, len) of the runs of consecutive ids. Runs are found in chunks of 2^bits ids, then those that touch are merged."""
    w = Window.partitionBy("c").orderBy("p")
    ids = space.select(F.col(ptr).cast("long").alias("p")).where("p IS NOT NULL").distinct().withColumn("c", F.shiftright("p", bits))
    parts = ids.withColumn("g", F.col("p") - F.row_number().over(w)).groupBy("c", "g").agg(F.min("p").alias("a"), F.max("p").alias("b"))
    size = 1 << bits
    edge = (F.col("a") % size == 0) | ((F.col("b") + 1) % size == 0)
    inner = parts.where(~edge).select("a", "b")
    touching = parts.where(edge).select("a", "b")  # two for each chunk at most
    o = Window.orderBy("a")
    joined = touching.withColumn("new", F.when(F.lag("b").over(o) + 1 == F.col("a"), 0).otherwise(1)).withColumn("k", F.sum("new").over(o))
    merged = joined.groupBy("k").agg(F.min("a").alias("a"), F.max("b").alias("b")).select("a", "b")
    return inner.union(merged).select(F.col("a").alias("start"), (F.col("b") - F.col("a") + 1).alias("len"))
