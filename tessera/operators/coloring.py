"""Partition algebra. A coloring is a table (color, ptr); it may be aliased and need not be complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class ColoringError(ValueError):
    """A coloring isn't what it was declared to be."""


def color_by(region: DataFrame, ptr: str, color: Column) -> DataFrame:
    return region.select(color.alias("color"), F.col(ptr).alias("ptr"))


def color_ranges(region: DataFrame, ptr: str, ranges: list[tuple], width: int = 4096) -> DataFrame:
    """Rows of ``region`` in inclusive ranges (color, low, high), by an equi-join on blocks of ``width`` ids.

    A range is filed under each block that it touches, so no row meets a range of another block.
    """
    spark = region.sparkSession
    table = spark.createDataFrame(ranges, "color long, low long, high long").where("low <= high")
    blocks = table.withColumn("b", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))))
    rows = region.select(F.col(ptr).alias("ptr")).withColumn("b", F.floor(F.col("ptr") / width))
    return rows.join(blocks, "b").where("ptr BETWEEN low AND high").select("color", "ptr").distinct()


def overlaps(coloring: DataFrame) -> DataFrame:
    """(ptr, n_colors) of the pointers with several colors."""
    return coloring.groupBy("ptr").agg(F.countDistinct("color").alias("n_colors")).where("n_colors > 1")


def overlap_pairs(coloring: DataFrame) -> DataFrame:
    """(a, b, n) for colors that share n pointers; pairs are made within one pointer's colors only."""
    some = coloring.distinct()
    many = some.join(overlaps(some).select("ptr"), "ptr", "left_semi")
    return (
        many.alias("l").join(many.alias("r"), (F.col("l.ptr") == F.col("r.ptr")) & (F.col("l.color") < F.col("r.color")))
        .groupBy(F.col("l.color").alias("a"), F.col("r.color").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    )


def is_disjoint(coloring: DataFrame) -> bool:
    return overlaps(coloring).isEmpty()


def declared(coloring: DataFrame, disjoint: bool) -> DataFrame:
    """The coloring; a claim to be disjoint is tested."""
    if disjoint and not is_disjoint(coloring):
        raise ColoringError("the coloring was declared disjoint, but some pointer has several colors")
    return coloring


def uncolored(region: DataFrame, ptr: str, coloring: DataFrame) -> DataFrame:
    return region.join(coloring.select(F.col("ptr").alias("__p")), F.col(ptr) == F.col("__p"), "left_anti")


def subregion(region: DataFrame, ptr: str, coloring: DataFrame, color) -> DataFrame:
    mine = coloring.where(F.col("color") == color).select(F.col("ptr").alias("__p"))
    return region.join(mine, F.col(ptr) == F.col("__p"), "left_semi")


def partition(region: DataFrame, ptr: str, coloring: DataFrame) -> DataFrame:
    """Each row once for each of its colors."""
    return region.join(coloring.select("color", F.col("ptr").alias("__p")), F.col(ptr) == F.col("__p")).drop("__p")


def safe_cast(pointers: DataFrame, ptr: str, coloring: DataFrame, color) -> DataFrame:
    """``pointers`` with ``cast``: the pointer if it lies in the subregion, else null."""
    mine = coloring.where(F.col("color") == color).select(F.col("ptr").alias("cast")).distinct()
    return pointers.join(mine, F.col(ptr) == F.col("cast"), "left")


def region_union(a: DataFrame, b: DataFrame, ptr: str) -> DataFrame:
    return a.unionByName(b).dropDuplicates([ptr])


def ghost_split(links: DataFrame, piece: str, node: str, owner: Column) -> DataFrame:
    """(node, piece, kind): private to one piece, shared by several, or a ghost where a piece touches what another owns."""
    touched = links.select(F.col(piece).alias("piece"), F.col(node).alias("node")).distinct().withColumn("owner", owner)
    far = touched.groupBy("node").agg(F.max(F.when(F.col("piece") != F.col("owner"), 1).otherwise(0)).alias("far"), F.max("owner").alias("owner"))
    kept = far.select("node", F.col("owner").alias("piece"), F.when(F.col("far") == 1, "shared").otherwise("private").alias("kind"))
    ghosts = touched.where("piece <> owner").select("node", "piece", F.lit("ghost").alias("kind"))
    return kept.union(ghosts)


def ntile_slices(region: DataFrame, ptr: str, n: int, bits: int = 20) -> DataFrame:
    """(ptr, slice): n even slices in order of ptr, the first remainder slices larger by one. Ranks are found in two levels."""
    from tessera.operators.ordered import running_sums

    ids = region.select(F.col(ptr).alias("ptr"))
    ranked = running_sums(ids, F.shiftright("ptr", bits), ["ptr"], {"r": F.lit(1)})
    total = ids.agg(F.count(F.lit(1)).alias("total"))
    base, rest = F.floor(F.col("total") / n), F.col("total") % n
    cut = rest * (base + 1)
    at = F.when(F.col("r") <= cut, F.floor((F.col("r") - 1) / (base + 1))).otherwise(rest + F.floor((F.col("r") - cut - 1) / F.greatest(base, F.lit(1))))
    return ranked.crossJoin(F.broadcast(total)).select("ptr", (at + 1).cast("int").alias("slice"))


def balanced_split(values: DataFrame, bucket: Column, pieces: int) -> DataFrame:
    """(bucket, n, piece): the first bucket whose running count reaches a piece's share ends it."""
    hist = values.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))  # a row for each bucket
    w = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    total = hist.agg(F.sum("n").alias("total"))
    piece = F.least(F.lit(pieces - 1), F.floor(F.coalesce(F.sum("n").over(w), F.lit(0)) * pieces / F.col("total")))
    return hist.crossJoin(F.broadcast(total)).select("bucket", "n", piece.cast("int").alias("piece"))
