"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.store import drop_table, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b), a > b: neighbours of a node are tied to the smallest of them.

    Smallest neighbours are pre-aggregated and joined back, so no neighbourhood is gathered.
    """
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # larger neighbours of a node are the upper ends of edges whose lower end it is
        up = edges.select(F.col("b").alias("a"), F.col("a").alias("v")).join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return up.where("a > b").distinct()
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = edges.join(least, "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).where("a > b")
    return tied.union(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) for each node of an edge; ``edges`` has two bigint columns.

    Loops, repeated edges and edges in both directions are fine, and no edges give no rows. Every step is written to
    the shared folder and the one before it removed.
    """
    a, b = edges.columns
    edges = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct()
    edges = written(edges, "edges")
    before = _state(edges)
    while before[0]:
        middle = written(_star(edges, True), "large-star")
        drop_table(edges)
        edges = written(_star(middle, False), "small-star")
        drop_table(middle)
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
