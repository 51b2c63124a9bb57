"""Lists of events, and their catalog."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from .filters import time_range

DEFAULT_LIMIT, MOST = 100, 1_000


def select(events: DataFrame, name: str | None = None, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """By exact name or glob, and time."""
    rows = time_range(events, start_ns, end_ns)
    if not name:
        return rows
    name = name.strip()
    return rows.where(names.glob_match(F.col("name"), name)) if names.has_glob(name) else rows.where(F.col("name") == name)


def newest(events: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    return events.orderBy(F.desc("ts_ns"), F.desc("seq")).limit(limit)


def stored(events: DataFrame, limit: int = DEFAULT_LIMIT, keys: Sequence[str] = ("partition_key", "seq")) -> DataFrame:
    """In storage order, oldest partition first; 1,000 at most."""
    return events.orderBy(*keys).limit(min(limit, MOST))


def merged_log(events: DataFrame, patterns: Sequence[str], per_series: int = 10) -> DataFrame:
    """series, and the events of several patterns: of each the first per_series stored, together newest first.

    Each series is a top-n of its own, so no series is sorted whole.
    """
    parts = [stored(select(events, p), per_series, ("ts_ns", "seq")).withColumn("series", F.lit(i)) for i, p in enumerate(patterns)]
    return reduce(DataFrame.unionByName, parts).orderBy(F.desc("ts_ns"), F.desc("seq"), "series").limit(per_series * len(patterns))


def numeric_points(events: DataFrame, limit: int = MOST) -> DataFrame:
    """Events that have a value, as they are stored."""
    return stored(events.where(F.col("value").isNotNull()), limit, ("ts_ns", "seq"))


def overlay(events: DataFrame, limit: int = 200) -> DataFrame:
    """Markers of a chart: name and time of the first events stored."""
    return stored(events, min(limit, MOST), ("ts_ns", "seq")).select("name", "ts_ns", "seq")


def catalog(events: DataFrame) -> DataFrame:
    """name, value_type of the first, last_ts_ns."""
    return events.groupBy("name").agg(F.min_by("value_type", "seq").alias("value_type"), F.max("ts_ns").alias("last_ts_ns"))


def resolved(rows: DataFrame, catalog_: DataFrame, key: str = "id") -> DataFrame:
    """Rows with the name and type of their id; an id that isn't in the catalog is an error when it runs. Catalogs have 65,535 names at most per database, so a join of hashes does."""
    known = catalog_.select("db", F.col("id").alias(key), F.col("name").alias("resolved_name"), F.col("value_type").alias("resolved_type"))
    joined = rows.join(known, ["db", key], "left")
    missing = F.raise_error(F.concat(F.lit("unknown id "), F.col(key).cast("string"))).cast("string")
    return joined.withColumn("resolved_name", F.coalesce("resolved_name", missing))


def batched_counts(events: DataFrame, window_ns: int = 60_000_000_000, key: str = "key") -> DataFrame:
    """name, key, bucket_ts_ns, count, payload of the last: floods counted per window."""
    from .windows import event_bucket

    g = events.groupBy("name", key, event_bucket(F.col("ts_ns"), window_ns).alias("bucket_ts_ns"))
    return g.agg(F.count("*").alias("count"), F.max_by("payload", "seq").alias("payload"))
