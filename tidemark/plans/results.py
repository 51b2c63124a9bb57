"""Shapes of results for clients: vectors, matrices, event lists, reports."""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import timeutil, values


def number_text(c: Column) -> Column:
    return values.float_text(c.cast("float"))


def vector(latest: DataFrame) -> DataFrame:
    """db, metric, value: the pair of unix seconds and the value's text."""
    return latest.select("db", "metric", F.struct(timeutil.unix_seconds(F.col("ts_ns")).alias("t"), number_text(F.col("value")).alias("v")).alias("value"))


def matrix(rows: DataFrame, ts: str = "end_ts_ns", keys: tuple[str, ...] = ("db", "metric", "aggregate")) -> DataFrame:
    """keys, values: points in time order. A response is of one request's range, so a series' points are one row."""
    keys = tuple(k for k in keys if k in rows.columns)
    point = F.struct(timeutil.unix_seconds(F.col(ts)).alias("t"), number_text(F.col("value")).alias("v"))
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(point)).alias("values"))


def event_list(events: DataFrame) -> DataFrame:
    return events.select("name", "ts_ns", timeutil.timestamp_text(F.col("ts_ns")).alias("timestamp"), "value_type", F.col("value"), values.compact_payload(F.col("payload")).alias("payload"))


def sample_rows(samples: DataFrame) -> DataFrame:
    """metric, timestamp_ns, timestamp_utc, value_type, value as text: the rows of a report."""
    return samples.select("metric", F.col("ts_ns").alias("timestamp_ns"), timeutil.timestamp_text(F.col("ts_ns")).alias("timestamp_utc"), "value_type", values.value_text(F.col("int32_value"), F.col("float32_value")).alias("value"))


def bucket_rows(rows: DataFrame) -> DataFrame:
    """Windows in a report's order: metric, aggregate, time; the time is the window's clipped end."""
    out = rows.select("metric", "aggregate", F.col("start_ts_ns").alias("start_ns"), F.col("end_ts_ns").alias("end_ns"), F.col("end_ts_ns").alias("timestamp_ns"), "value")
    return out.orderBy("metric", "aggregate", "timestamp_ns")


def report(rows: DataFrame, fmt: str = "table", limit: int = 1000) -> str:
    """A result as a tab-separated table or JSON lines, of up to limit rows; the last line has the count of all rows, the seconds taken and whether some are not shown."""
    if fmt not in ("table", "json"):
        raise ValueError(f"unknown format {fmt!r}")
    began = time.perf_counter()
    wanted = rows.select(F.to_json(F.struct(*rows.columns)).alias("value")) if fmt == "json" else rows
    found = wanted.limit(limit + 1).collect()
    total, shown = rows.count() if len(found) > limit else len(found), found[:limit]
    more, took = total > len(shown), round(time.perf_counter() - began, 3)
    if fmt == "json":
        return "\n".join([*(r["value"] for r in shown), json.dumps({"rows": total, "shown": len(shown), "truncated": more, "seconds": took})])
    lines = ["\t".join(rows.columns)] + ["\t".join("" if v is None else str(v) for v in r) for r in shown]
    return "\n".join([*lines, f"({total} rows, truncated to {len(shown)} in {took} s)" if more else f"({total} rows in {took} s)"])
