"""Connected components of a graph whose edges are a table, by alternating star contractions.

A large star hangs every greater neighbour of a node on the node's smallest neighbour, a small star every smaller one;
both keep what is connected, and their alternation ends in stars around the smallest node of each component. Minima are
combined before the shuffle and the join with them splits where one node has many neighbours, so that no task holds
a node's whole neighbourhood. Each round's edges are a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    out = both.join(least, F.col("a") == F.col("k")).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a != b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
    moved = edges.join(least, F.col("a") == F.col("k")).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node it reaches) for each node of the edges a - b that isn't the smallest itself."""
    e = shared_table(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(e)
    while True:
        e = shared_table(small_star(large_star(e)))
        now = _state(e)
        if now == state:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = now
