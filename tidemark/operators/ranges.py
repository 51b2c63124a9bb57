"""Range, stride, latest, stepped and aligned reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import timeutil
from .filters import named, time_range


def read_range(samples: DataFrame, metrics: str | Sequence[str], start_ns: int | None = None, end_ns: int | None = None, stride: int = 1) -> DataFrame:
    """Samples of one or several metrics from one scan, in time and arrival order; every stride-th of each metric, the first kept."""
    out = time_range(named(samples, metrics), start_ns, end_ns)
    return strided(out, stride).orderBy("ts_ns", "seq")


def strided(samples: DataFrame, n: int, block_ns: int = timeutil.DAY_NS) -> DataFrame:
    """Every n-th sample of each metric by time and arrival, the first kept.

    A metric is numbered in blocks of time: blocks are counted, and each numbers its own after those of the blocks before it.
    """
    if n <= 1:
        return samples
    rows = samples.withColumn("time_block", timeutil.floor_to(F.col("ts_ns"), block_ns))
    counts = rows.groupBy("db", "metric", "time_block").agg(F.count("*").alias("c"))
    before = F.sum("c").over(W.partitionBy("db", "metric").orderBy("time_block")) - F.col("c")
    rows = rows.join(counts.select("db", "metric", "time_block", before.alias("before")), ["db", "metric", "time_block"])
    at = F.row_number().over(W.partitionBy("db", "metric", "time_block").orderBy("ts_ns", "seq")) - 1 + F.col("before")
    return rows.withColumn("nth", at).where(F.col("nth") % n == 0).select(*samples.columns)


def latest(samples: DataFrame, keys: Sequence[str] = ("db", "metric")) -> DataFrame:
    """The newest row of each series; of equal times the one that came last. A grouping with partial maxima, no sort."""
    rest = [c for c in samples.columns if c not in keys]
    g = samples.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("ts_ns", "seq")).alias("last"))
    return g.select(*keys, "last.*").select(*samples.columns)


def latest_matching(samples: DataFrame, regex: str) -> DataFrame:
    return latest(samples.where(F.col("metric").rlike(regex)))


def last_per_step(samples: DataFrame, step_ns: int) -> DataFrame:
    """db, metric, step_ts_ns, value: the last sample of each step. Steps are cut as windows are, towards 1970."""
    step = timeutil.whole_div(F.col("ts_ns"), step_ns) * F.lit(step_ns).cast("long")
    return samples.groupBy("db", "metric", step.alias("step_ts_ns")).agg(F.max_by("value", F.struct("ts_ns", "seq")).alias("value"))


def preview(samples: DataFrame, n: int = 20) -> DataFrame:
    """The first and the last n rows by time and arrival, with which (head or tail); each a top-n, a row may be in both."""
    first = samples.orderBy("ts_ns", "seq").limit(n).withColumn("which", F.lit("head"))
    return first.unionByName(samples.orderBy(F.desc("ts_ns"), F.desc("seq")).limit(n).withColumn("which", F.lit("tail")))


def aligned(series: DataFrame, names: Sequence[str], column: str = "metric") -> DataFrame:
    """ts_ns and a column for each name: the union of all times, null where a series has none, the last of equal times."""
    return series.groupBy("ts_ns").pivot(column, list(names)).agg(F.max_by("value", "seq"))
