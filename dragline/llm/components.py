"""Connected components by alternating large-star and small-star steps, each a grouped minimum and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dragline.scale import settle


def _with_least(directed: DataFrame) -> DataFrame:
    """Each (u, v) with the least of u and its neighbours."""
    least = directed.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return directed.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = _with_least(edges)  # u > v in every edge
    moved = down.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(down.select("u", F.col("m").alias("v")))


def roots(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that is not the least of its component.

    ``edges``: two columns of longs, in either direction, repeats allowed.  Every round is checkpointed.  The rounds
    grow with the logarithm of the longest path; the edge count never grows.
    """
    a, b = edges.columns
    now = settle(
        edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    mark = (F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    seen = None
    while (is_now := tuple(now.agg(*mark).first())) != seen and is_now[0]:
        seen = is_now
        now = settle(_small_star(_large_star(now).distinct()).distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
