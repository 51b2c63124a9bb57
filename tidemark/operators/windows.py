"""Tumbling windows aligned to the epoch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import aggregates, timeutil
from . import quantiles
from .filters import time_range

KEYS = ("db", "metric")
#: The width up to which a window's values are held in one buffer.
BUFFERED_NS = timeutil.DAY_NS


def bucket(ts_ns: Column, window_ns: int) -> Column:
    """The start of a metric's window: truncates towards zero."""
    return timeutil.whole_div(ts_ns, window_ns) * F.lit(window_ns).cast("long")


def event_bucket(ts_ns: Column, window_ns: int) -> Column:
    """The start of an event's window: floors, before 1970 too."""
    return timeutil.floor_to(ts_ns, window_ns)


def check_window(window_ns: int) -> int:
    if window_ns <= 0:
        raise ValueError("the window must be positive")
    return window_ns


def window_wide(samples: DataFrame, window_ns: int, names: str | Sequence[str], start_ns: int | None = None, end_ns: int | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, start_ts_ns, end_ts_ns and a column per aggregate, for windows that have samples.

    Percentiles and trimmed means hold a window's values in one buffer up to a day's width; wider windows are counted by cell, with the same results.
    Ends are clipped to the range, whose end is inclusive: a sample at the end that opens a window gives one whose start is its end.
    """
    check_window(window_ns)
    resolved = aggregates.resolve(names)
    rows = time_range(samples, start_ns, end_ns)
    if window_ns > BUFFERED_NS and any(n in aggregates.PERCENTILES or n in aggregates.TRIMMED for n in resolved):
        g = quantiles.wide(rows.withColumn("bucket", bucket(F.col("ts_ns"), window_ns)), [*keys, "bucket"], resolved)
    else:
        g = rows.groupBy(*keys, bucket(F.col("ts_ns"), window_ns).alias("bucket")).agg(*aggregates.columns(resolved, F.col("value")))
    start, end = F.col("bucket"), F.col("bucket") + F.lit(window_ns).cast("long")
    start = start if start_ns is None else F.greatest(start, F.lit(start_ns).cast("long"))
    end = end if end_ns is None else F.least(end, F.lit(end_ns).cast("long"))
    return g.select(*keys, start.alias("start_ts_ns"), end.alias("end_ts_ns"), *resolved)


def window_aggregate(samples: DataFrame, window_ns: int, names: str | Sequence[str], start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """db, metric, aggregate, window_ns, start_ts_ns, end_ts_ns, value: a row per window and aggregate, from one grouping."""
    resolved = aggregates.resolve(names)
    wide = window_wide(samples, window_ns, resolved, start_ns, end_ns)
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("aggregate"), F.col(n).alias("value")) for n in resolved])).alias("p")
    return wide.select(*KEYS, "start_ts_ns", "end_ts_ns", pairs).select(*KEYS, "p.aggregate", F.lit(window_ns).cast("long").alias("window_ns"), "start_ts_ns", "end_ts_ns", "p.value")


def step_query(samples: DataFrame, step_ns: int, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """A step without an aggregate is the mean over windows of the step."""
    return window_aggregate(samples, step_ns, [aggregates.DEFAULT_STEP], start_ns, end_ns)


def band(samples: DataFrame, window_ns: int, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """Mean with minimum and maximum side by side."""
    return window_wide(samples, window_ns, ["avg", "min", "max"], start_ns, end_ns)


def latest_window(samples: DataFrame, window_ns: int, names: str | Sequence[str], start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """The last point of each series and aggregate of a windowed query."""
    rows = window_aggregate(samples, window_ns, names, start_ns, end_ns)
    rest = ["window_ns", "start_ts_ns", "end_ts_ns", "value"]
    return rows.groupBy("db", "metric", "aggregate").agg(F.max_by(F.struct(*rest), "start_ts_ns").alias("l")).select("db", "metric", "aggregate", "l.*")


def event_counts(events: DataFrame, window_ns: int, start_ns: int | None = None, end_ns: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """by, bucket_ts_ns (window start), count; only windows that have events."""
    rows = time_range(events, start_ns, end_ns)
    return rows.groupBy(*by, event_bucket(F.col("ts_ns"), check_window(window_ns)).alias("bucket_ts_ns")).agg(F.count("*").alias("count"))
