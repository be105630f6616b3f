"""Connected components of a link table by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _stars(both: DataFrame, large: bool) -> DataFrame:
    """both: (u, v) rows of u's neighbourhood. Each node hangs the neighbours above it (large), or itself and those
    below it (small), on the least of them."""
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
    joined = lookup(both, least, ["u"], "n")
    hung = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return hung.filter("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (u long, v long), each link in either direction, once or more -> (node, root): the least node that can be
    reached. Nodes without links have no row. Rounds grow with the logarithm of a component's diameter."""
    now = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = _state(now)
    for _ in range(rounds if state[0] else 0):
        large = materialize(_stars(now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), True), "large-star", rows=2 * state[0])
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        now = materialize(_stars(down, False), "small-star", rows=2 * state[0])
        after = _state(now)
        if after == state:
            break
        state = after
    else:
        if state[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
