"""Percentiles and trimmed means of windows too large for one buffer.

A value's cell is its sign and its magnitude to a 13th of an octave: at most 8,000 cells a window, each with at most 2**23 / 13 distinct float32 values. Rows are
counted and summed by cell first, a grouping with partial sums. The cells in which a wanted rank falls are found from these sums, and only their rows are counted
by value: a window over a cell's distinct values gives the ranks. A sum between two ranks is that of the whole cells between and of parts of the
two that are cut. No task holds a window's rows or sorts them. Results equal those of the plain aggregates but for the order of sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import aggregates

STEPS = 13


def cell(value: Column) -> Column:
    """A number that grows with the value: 0 for zeros, NaN last, null for null."""
    v = value.cast("double")
    size = F.when(F.abs(v) == float("inf"), 4000).otherwise(F.floor((F.log2(F.abs(v)) + 151) * STEPS).cast("int"))
    return F.when(F.isnan(v), 4001).when(v == 0, 0).when(v < 0, -size).when(v > 0, size).cast("int")


def trim(n: Column) -> Column:
    """How many values go at either end: a twentieth, one at least, none if that would leave nothing."""
    cut = F.when(n >= 20, F.floor(n / 20)).otherwise(1).cast("long")
    return F.when(2 * cut >= n, 0).otherwise(cut)


def wide(rows: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """keys and a column per aggregate, as a grouping of rows by keys with the plain aggregates of the column value gives it."""
    keys = list(keys)
    given = rows.select(*keys, F.col("value").cast("double").alias("v"), cell(F.col("value")).alias("cell"))
    sums = given.groupBy(*keys, "cell").agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    upto, all_ = F.sum("n").over(W.partitionBy(*keys).orderBy("cell").rowsBetween(W.unboundedPreceding, 0)), F.sum("n").over(W.partitionBy(*keys))
    sums = sums.select("*", (upto - F.col("n")).alias("before"), all_.alias("total"))
    sums = sums.withColumns({"first": trim(F.col("total")), "past": F.col("total") - trim(F.col("total"))})
    end = F.col("before") + F.col("n")
    shares = sorted({aggregates.PERCENTILES[x] for x in names if x in aggregates.PERCENTILES})
    at = {p: (F.col("total") - 1) * F.lit(p) for p in shares}
    trimmed = any(x in aggregates.TRIMMED for x in names)
    whole = (F.col("before") >= F.col("first")) & (end <= F.col("past"))
    wanted = F.lit(False)
    for p in shares:
        wanted = wanted | ((F.ceil(at[p]) >= F.col("before")) & (F.floor(at[p]) < end))
    if trimmed:
        wanted = wanted | (~whole & (end > F.col("first")) & (F.col("before") < F.col("past")))
    needed = sums.where((F.col("n") > 0) & wanted).select(*keys, "cell", "before", "total", "first", "past", whole.alias("whole"))
    fine = given.join(needed, [*keys, "cell"]).groupBy(*keys, "cell", "v").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("before", "total", "first", "past", "whole")])
    own = F.sum("n").over(W.partitionBy(*keys, "cell").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    fine = fine.withColumn("before", F.col("before") + own - F.col("n"))
    holds = lambda r: F.max(F.when((r >= F.col("before")) & (r < end), F.col("v")))
    parts = [f(at[p]) for p in shares for f in (F.floor, F.ceil)]
    ranks = [holds(r).alias(f"r{i}") for i, r in enumerate(parts)]
    inside = F.greatest(F.least(end, F.col("past")) - F.greatest("before", "first"), F.lit(0))
    ends = fine.groupBy(*keys).agg(*ranks, F.coalesce(F.sum(F.when(~F.col("whole"), F.col("v") * inside)), F.lit(0.0)).alias("cut_sum"))
    n, s = F.sum("n"), F.sum("s")
    middle = F.coalesce(F.sum(F.when(whole, F.col("s"))), F.lit(0.0))
    base = sums.groupBy(*keys).agg(n.alias("n"), s.alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), middle.alias("middle"), F.max("past").alias("past"), F.max("first").alias("first"))
    out = base.join(ends, keys, "left")

    def between(p: float) -> Column:
        i, rank = 2 * shares.index(p), (F.col("n") - 1) * F.lit(p)
        low, high = F.col(f"r{i}"), F.col(f"r{i + 1}")
        return F.when(low == high, low).otherwise(low + (rank - F.floor(rank)) * (high - low))

    plain = {"min": F.col("lo"), "max": F.col("hi"), "sum": F.col("s"), "avg": F.col("s") / F.when(F.col("n") > 0, F.col("n")), "count": F.col("n").cast("double")}
    mean = F.when(F.col("n") > 0, (F.col("middle") + F.coalesce("cut_sum", F.lit(0.0))) / F.when(F.col("past") > F.col("first"), F.col("past") - F.col("first")))
    value = lambda x: plain[x] if x in plain else mean if x in aggregates.TRIMMED else between(aggregates.PERCENTILES[x])
    return out.select(*keys, *[value(x).alias(x) for x in names])
