"""Launches over the points of a partition, reductions, argument maps, predicates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reduction:
    """fold combines right-hand sides (a partial aggregate), apply puts the result into a left-hand side."""

    name: str
    identity: float
    fold: object
    apply: object


REDUCTIONS: dict[str, Reduction] = {}


def register_reduction(name: str, identity, fold, apply) -> Reduction:
    if not name or name in REDUCTIONS:
        raise ValueError(f"the reduction {name!r} is reserved or known")
    REDUCTIONS[name] = Reduction(name, identity, fold, apply)
    return REDUCTIONS[name]


register_reduction("sum", 0, F.sum, lambda a, b: a + b)
register_reduction("max", None, F.max, lambda a, b: F.greatest(a, b))
register_reduction("min", None, F.min, lambda a, b: F.least(a, b))


def launch(colored: DataFrame, results: dict[str, Column], color: str = "color") -> DataFrame:
    """A row for each point: what its task returns."""
    return colored.groupBy(color).agg(*[c.alias(n) for n, c in results.items()])


def launch_reduced(colored: DataFrame, value: Column, reduction: str = "sum", initial=0, name: str = "value") -> DataFrame:
    """One row: the points' results reduced into the initial value."""
    r = REDUCTIONS[reduction]
    total = F.coalesce(r.fold(value), F.lit(r.identity if r.identity is not None else initial))
    return colored.agg(r.apply(F.lit(initial), total).alias(name))


def reduce_into(lhs: DataFrame, key: str, target: str, deltas: DataFrame, delta_key: str, value: Column, reduction: str = "sum") -> DataFrame:
    """``lhs`` with the log of (key, value) applied: folded by key first, so that only one row for each meets its target."""
    r = REDUCTIONS[reduction]
    folded = deltas.groupBy(F.col(delta_key).alias("__k")).agg(r.fold(value).alias("__v"))
    done = lhs.join(folded, F.col(key) == F.col("__k"), "left")
    return done.withColumn(target, F.when(F.col("__k").isNull(), F.col(target)).otherwise(r.apply(F.col(target), F.col("__v")))).drop("__k", "__v")


def argument_map(entries: DataFrame, point: str, order: str, replace: bool) -> DataFrame:
    """One argument for each point: the last with replace, else the first."""
    pick = F.max_by if replace else F.min_by
    rest = [c for c in entries.columns if c not in (point, order)]
    return entries.groupBy(point).agg(*[pick(F.col(c), F.col(order)).alias(c) for c in rest])


def with_arguments(points: DataFrame, arguments: DataFrame, point: str) -> DataFrame:
    """Points without an argument keep a null one."""
    return points.join(arguments, point, "left")


def predicated(df: DataFrame, predicate: bool | None) -> DataFrame:
    """The launch if its predicate holds, no row if not; an undecided one is an error."""
    if predicate is None:
        raise ValueError("the predicate isn't decided")
    return df if predicate else df.limit(0)


def overlay(dst: DataFrame, src: DataFrame, key: str, field: str, mask: Column) -> DataFrame:
    """A masked copy of one field: where the mask holds for a source row, its value; else the target's own."""
    new = src.where(mask).select(F.col(key).alias("__k"), F.col(field).alias("__new"))
    out = dst.join(new, F.col(key) == F.col("__k"), "left")
    return out.withColumn(field, F.when(F.col("__k").isNotNull(), F.col("__new")).otherwise(F.col(field))).drop("__k", "__new")
