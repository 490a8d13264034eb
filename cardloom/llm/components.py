"""Connected components by rounds of joins; nothing of the graph reaches the driver but a count of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import workspace, written


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) of every node of edges (a, b), both long.

    Rounds of large-star and small-star: each node's neighbours are hung on its smallest neighbour, so path lengths
    halve. No edges give no rows; loops and repeated edges do no harm. A node with very many neighbours costs one
    aggregated row of minimum on the way in, as partial minima are made before the shuffle.
    """
    folder = workspace(edges.sparkSession)

    def hang(e: DataFrame, large: bool) -> DataFrame:
        """Large star: every larger neighbour v of u goes to u's least neighbour or u; small star: the smaller ones."""
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        joined = both.join(least, "a")
        moved = joined.where(F.col("b") > F.col("a") if large else F.lit(True)).select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
        return moved.where(F.col("a") != F.col("b")).distinct()

    e = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where(F.col("a") != F.col("b")).distinct(), f"{folder}/0")
    before = None
    for k in range(1, 100):
        e = written(hang(hang(e, True), False), f"{folder}/{k}")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("node")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
