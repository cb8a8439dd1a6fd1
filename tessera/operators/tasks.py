"""The registration surface: tasks with variants, projection functions, predicates over futures, structure types."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, types as T
from pyspark.sql import functions as F


class RegistrationError(ValueError):
    """An id or name that is reserved, known already or not known."""


@dataclass
class Registry:
    """What an application registers before it launches. Projection 0 is the identity."""

    tasks: dict[str, dict[str, Callable]] = field(default_factory=dict)
    projections: dict[int, Callable[[Column], Column]] = field(default_factory=lambda: {0: lambda point: point})
    structures: dict[str, T.StructType] = field(default_factory=dict)

    def task(self, name: str, kind: str = "expression"):
        """A variant of a task: ``expression`` gives Columns for a group's aggregate, ``frame`` a pandas frame for a group's frame."""
        if kind not in ("expression", "frame"):
            raise RegistrationError(f"no variant is of the kind {kind!r}")

        def add(f: Callable) -> Callable:
            if kind in self.tasks.setdefault(name, {}):
                raise RegistrationError(f"the task {name} has this variant already")
            self.tasks[name][kind] = f
            return f

        return add

    def variant(self, name: str) -> tuple[str, Callable]:
        """The expression where there is one: it stays in generated code; else the frame."""
        known = self.tasks.get(name) or {}
        for kind in ("expression", "frame"):
            if kind in known:
                return kind, known[kind]
        raise RegistrationError(f"no task {name}")

    def launch(self, name: str, colored: DataFrame, color: str, schema: str) -> DataFrame:
        """A row or several for each point of an index launch, by the variant that ``variant`` picks."""
        kind, f = self.variant(name)
        if kind == "expression":
            return colored.groupBy(color).agg(*f())
        return colored.groupBy(color).applyInPandas(f, schema)

    def projection(self, number: int, f: Callable[[Column], Column]) -> None:
        if number in self.projections:
            raise RegistrationError(f"projection {number} is known or reserved")
        self.projections[number] = f

    def projected(self, points: DataFrame, point: str, number: int, partition: DataFrame) -> DataFrame:
        """The rows of a partition (color, ...) that each launch point is given by a projection."""
        if number not in self.projections:
            raise RegistrationError(f"no projection {number}")
        return points.withColumn("color", self.projections[number](F.col(point))).join(partition, "color")

    def structure(self, name: str, ddl: str) -> T.StructType:
        if name in self.structures:
            raise RegistrationError(f"the structure {name} is known")
        self.structures[name] = T._parse_datatype_string(ddl)
        return self.structures[name]


def decided(f: Callable[..., bool], *futures: DataFrame) -> bool:
    """A predicate over futures, each a table of one row and column: their values are brought to the driver and ``f`` decides."""
    return bool(f(*[x.first()[0] for x in futures]))


def set_runs(mask: DataFrame, enabled: list[tuple[int, int]] = (), disabled: list[tuple[int, int]] = ()) -> DataFrame:
    """A mask (ptr) with runs (first, n) of ids put in, then others taken out."""
    spark = mask.sparkSession
    out = mask
    for first, n in enabled:
        out = out.union(spark.range(first, first + n).toDF("ptr"))
    out = out.distinct()
    for first, n in disabled:
        out = out.where(~F.col("ptr").between(first, first + n - 1))
    return out


def merged_events(inputs: DataFrame, merge: str, time: str) -> DataFrame:
    """(merge, time, n): a merged event triggers when the last of its inputs does; never (null) while one hasn't."""
    never = F.count_if(F.col(time).isNull()) > 0
    return inputs.groupBy(merge).agg(F.when(~never, F.max(time)).alias(time), F.count(F.lit(1)).alias("n"))


def without_arguments(arguments: DataFrame, point: str, removed: DataFrame) -> DataFrame:
    """An argument map without some points; the map itself stays as it was, as a clone of it does."""
    return arguments.join(removed.select(point).distinct(), point, "left_anti")
