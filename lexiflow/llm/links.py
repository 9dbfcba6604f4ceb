"""From links to classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.session import checkpoint


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())  # one row


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of all ends of edges (a, b): component is the smallest id that can be reached.

    Alternating star contraction: each round points the larger neighbours of a node, then the smaller ones,
    at the smallest; rounds end when nothing changes. Ids are any type with an order.
    """
    stars = checkpoint(
        edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = None
    while (now := _state(stars)) != before and now[0]:
        before = now
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("x")).where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m")))
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m")
        small = large.join(lower, F.col("u") == F.col("x")).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = checkpoint(small.union(lower.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct())
    ends = stars.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ends.union(stars.select(F.col("v"), F.col("v")).distinct())
