"""Connected components by alternating large and small stars; every round is a written table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm.tables import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Ties the neighbours of each node (the larger ones, or the smaller ones and itself) to its least neighbour."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least"))
        tied = both.join(least, "a").filter("b > a").select(F.col("b").alias("x"), F.least("least", "a").alias("y"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("least"))
        tied = down.join(least, "a").select(F.col("b").alias("x"), F.col("least").alias("y"))
        tied = tied.unionByName(least.select(F.col("a").alias("x"), F.col("least").alias("y")))
    return tied.filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge (a, b); root is the least node of its component. No order or type is assumed."""
    edges = written(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    before = _mark(edges)
    while before[0]:
        edges = written(_stars(_stars(edges, True), False), "edges")
        after = _mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
