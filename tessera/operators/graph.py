"""Reachability and components by joins to a fixed point; each round is written, not cached."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.shared import written


def reach(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(src, dst) for every pair with a path, by doubling: the paths found are joined with themselves until none is new.

    Rows with a null are left out. The result holds a row for each pair, so it suits graphs of few paths.
    """
    known = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL")
    paths, before = written(known.distinct(), "paths"), -1
    while (now := paths.count()) != before:
        before = now
        longer = paths.alias("a").join(paths.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")
        paths = written(paths.union(longer).distinct(), "paths")
    return paths


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def linked_components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node of a link between two different nodes; root is the smallest node reachable.

    Large-star and small-star rounds run until the edges no longer change, however many that takes: the larger
    neighbours of a node, then its smaller ones, are linked to the smallest node seen from it. A node with very many
    neighbours is combined before the shuffle of its minimum, and adaptive execution splits its edges in the joins
    (each has one row for the node on the other side). Loops and rows with a null are left out; repeated links count once; no link at all gives an empty table.
    """
    a, b = F.col(u), F.col(v)
    edges = links.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges, before = written(edges.distinct(), "links"), None
    while (now := _state(edges))[0] and now != before:
        before = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Both uses of the large star read one exchange; a round is written once.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.withColumnRenamed("u", "c"), F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.where("u != v").union(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(node, component) for every node of an edge, loops included: the smallest node that is connected."""
    ends = edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL")
    ends = written(ends.distinct(), "edges")
    nodes = ends.select(F.col("src").alias("node")).union(ends.select("dst")).distinct()
    return nodes.join(linked_components(ends, "src", "dst"), "node", "left").select("node", F.coalesce("root", "node").alias("component"))
