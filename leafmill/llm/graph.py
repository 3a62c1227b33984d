"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (a > b). Each vertex's neighbours are linked to the smallest of them and itself.

    The neighbours' minimum is an aggregate that is combined before the shuffle; it is written, so that
    the join with it may split the edges of one hot vertex.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = written(both.groupBy("a").agg(F.min("b").alias("least")), "star-minima").withColumn("least", F.least("a", "least"))
    linked = both.join(least, "a")
    out = linked.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b")) if large else linked.select("b", "least").unionByName(least.select(F.col("a").alias("b"), "least")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return out.where(F.col("a") != F.col("b")).distinct()


def contracted(edges: DataFrame) -> DataFrame:
    """``vertex, component`` after one large-star and one small-star step: each component is a part of a connected one."""
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct(), "edges")
    stars = _star(written(_star(edges, large=True), "edges"), large=False)
    return stars.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "vertex")


def components(edges: DataFrame, max_steps: int = 60) -> DataFrame:
    """``vertex, component`` for every vertex of ``edges`` (``a``, ``b``: long): the smallest vertex it is connected to.

    Runs until the edges are stars, that is until no centre has an edge to a smaller vertex; the
    number of steps grows with the logarithm of the diameter.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct(), "edges")
    for _ in range(max_steps):
        edges = written(_star(edges, large=True), "edges")
        edges = written(_star(edges, large=False), "edges")
        centres = edges.select(F.col("b").alias("a")).distinct()
        if edges.join(centres, "a", "left_semi").isEmpty():
            break
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct())
