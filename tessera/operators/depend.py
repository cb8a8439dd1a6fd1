"""Dependences between operations that declare which fields of which regions they use how."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Privileges are bit sets, coherence and dependence types are codes.
NO_ACCESS, READ_ONLY, WRITE_ONLY, REDUCE, READ_WRITE = 0x000, 0x001, 0x010, 0x100, 0x111
EXCLUSIVE, ATOMIC, SIMULTANEOUS, RELAXED = 0, 1, 2, 3
NONE, TRUE, ANTI, ATOMIC_DEP, SIMULTANEOUS_DEP = 0, 1, 2, 3, 4


def reads_only(p: Column) -> Column:
    return (p == NO_ACCESS) | (p == READ_ONLY)


def has_write(p: Column) -> Column:
    return p.isin(READ_WRITE, WRITE_ONLY, REDUCE)


def writes(p: Column) -> Column:
    return p.isin(READ_WRITE, WRITE_ONLY)


def subset(child: Column, parent: Column) -> Column:
    return child.bitwiseAND(F.bitwise_not(parent)) == 0


def dependence_type(p1: Column, c1: Column, r1: Column, p2: Column, c2: Column, r2: Column) -> Column:
    """Of a later usage (2) on an earlier one (1)."""

    def refined(default: int) -> Column:
        return F.when(reads_only(p1), ANTI).when(p2 == WRITE_ONLY, ANTI).otherwise(default)

    one_atomic_reads = ((c1 != ATOMIC) & reads_only(p1)) | ((c2 != ATOMIC) & reads_only(p2))
    return (
        F.when(reads_only(p1) & reads_only(p2), NONE)
        .when((p1 == REDUCE) & (p2 == REDUCE), F.when(r1 == r2, NONE).otherwise(TRUE))
        .when((c1 == EXCLUSIVE) | (c2 == EXCLUSIVE), refined(TRUE))
        .when((c1 == ATOMIC) & (c2 == ATOMIC), refined(ATOMIC_DEP))
        .when((c1 == ATOMIC) | (c2 == ATOMIC), F.when(one_atomic_reads, NONE).otherwise(refined(TRUE)))
        .otherwise(refined(SIMULTANEOUS_DEP))
    )


def all_pairs(ops: DataFrame, region: str, seq: str, privilege: str) -> DataFrame:
    """(region, prev, next, dtype) over all pairs in a region: the oracle for ``epoch_edges``, quadratic by nature."""
    a, b = ops.alias("a"), ops.alias("b")
    zero = F.lit(EXCLUSIVE)
    kind = dependence_type(F.col(f"a.{privilege}"), zero, zero, F.col(f"b.{privilege}"), zero, zero)
    return (
        a.join(b, (F.col(f"a.{region}") == F.col(f"b.{region}")) & (F.col(f"a.{seq}") < F.col(f"b.{seq}")))
        .select(F.col(f"a.{region}").alias("region"), F.col(f"a.{seq}").alias("prev"), F.col(f"b.{seq}").alias("next"), kind.alias("dtype"))
        .where(F.col("dtype") != NONE)
    )


def epochs(ops: DataFrame, region: str, seq: str, privilege: str) -> DataFrame:
    """``ops`` with ``epoch`` and ``usage``: users of one class side by side share an epoch, a writer has its own."""
    w = Window.partitionBy(region).orderBy(seq)
    usage = F.when(reads_only(F.col(privilege)), "read").when(F.col(privilege) == REDUCE, "reduce").otherwise("write")
    rows = ops.withColumn("usage", usage).withColumn("__before", F.lag("usage").over(w))
    new = F.when(F.col("__before").isNull() | (F.col("usage") != F.col("__before")) | (F.col("usage") == "write"), 1).otherwise(0)
    return rows.withColumn("epoch", F.sum(new).over(w)).drop("__before")


def epoch_summary(ops: DataFrame, region: str, seq: str, privilege: str) -> DataFrame:
    """(region, epoch, usage, first, last, n, after): each epoch depends on the one before: n_prev x n edges stay implied."""
    e = epochs(ops, region, seq, privilege).groupBy(F.col(region).alias("region"), "epoch", "usage").agg(
        F.min(seq).alias("first"), F.max(seq).alias("last"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("region").orderBy("epoch")
    return e.withColumn("after", F.coalesce(F.lag("n").over(w), F.lit(0)))
