"""What the widgets of a dashboard document ask for, and whether a document is valid."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import aggregates, display, timeutil
from ..operators import events as ev
from ..operators import ranges, windows

WIDGETS = ("number", "numbers", "line_chart", "aggregate_band", "event_log")
DEFAULT_INTERVAL = "30s"
COLOR = re.compile(r"#(?:[0-9a-fA-F]{3}|[0-9a-fA-F]{6})")


def number(samples: DataFrame, target: dict) -> DataFrame:
    """The latest value of a target, or of its windows: raw, transformed, text, severity."""
    rows = samples.where(F.col("metric") == display.series_query(target).split("/", 1)[-1])
    if target.get("aggregate"):
        last = windows.latest_window(rows, timeutil.parse_duration(target["window"]), target["aggregate"]).select("metric", F.col("end_ts_ns").alias("ts_ns"), "value")
    else:
        last = ranges.latest(rows).select("metric", "ts_ns", "value")
    t, limits = target.get("transform", {}), target.get("thresholds", {})
    v = display.transform(F.col("value"), t.get("factor", target.get("scale", 1.0)), t.get("offset", target.get("offset", 0.0)))
    out = last.withColumn("shown", v)
    text = display.widget_text(F.col("shown"), t.get("decimals", target.get("decimals", 1)), t.get("unit", target.get("unit", "")), t.get("format", target.get("format", "")))
    return out.withColumn("text", text).withColumn("severity", display.severity(F.col("shown"), limits.get("warning"), limits.get("critical"), limits.get("direction", "above")))


def line_chart(samples: DataFrame, series: list[dict], start_ns: int, end_ns: int) -> DataFrame:
    """ts_ns and a column per series label: steps of the interval, or windows of the aggregate, on one time axis."""
    from functools import reduce

    parts, labels = [], []
    for i, s in enumerate(series):
        rows = samples.where(F.col("metric") == display.series_query(s).split("/", 1)[-1])
        width = timeutil.parse_duration(s.get("window") or s.get("interval") or DEFAULT_INTERVAL)
        w = windows.window_aggregate(rows, width, s.get("aggregate") or aggregates.DEFAULT_STEP, start_ns, end_ns)
        labels.append(display.series_label(s, i))
        t = s.get("transform", {})
        v = display.transform(F.col("value"), t.get("factor", 1.0), t.get("offset", 0.0))
        parts.append(w.select(F.col("end_ts_ns").alias("ts_ns"), F.lit(labels[-1]).alias("metric"), v.alias("value"), F.col("start_ts_ns").alias("seq")))
    return ranges.aligned(reduce(DataFrame.unionByName, parts), labels)


def aggregate_band(samples: DataFrame, series: dict, start_ns: int, end_ns: int) -> DataFrame:
    rows = samples.where(F.col("metric") == display.series_query(series).split("/", 1)[-1])
    return windows.band(rows, timeutil.parse_duration(series["window"]), start_ns, end_ns)


def event_series(events: DataFrame, name: str, factor: float = 1.0, offset: float = 0.0) -> DataFrame:
    """x (unix seconds) and y of numeric events."""
    rows = ev.numeric_points(ev.select(events, name))
    return rows.select(timeutil.unix_seconds(F.col("ts_ns")).alias("x"), display.transform(F.col("value"), factor, offset).alias("y"), "ts_ns", "seq")


def event_log(events: DataFrame, patterns: list[str], per_series: int = 10) -> DataFrame:
    return ev.merged_log(events, patterns, per_series)


def _duration(text, where: str, errors: list[str]) -> None:
    try:
        if timeutil.parse_duration(text or "") <= 0:
            raise ValueError
    except ValueError:
        errors.append(f"{where}: {text!r} is no positive duration")


def validate(document: dict) -> list[str]:
    """What is wrong with a document; nothing if it is valid."""
    errors: list[str] = []
    if not (document.get("title") or "").strip():
        errors.append("title is missing")
    if not document.get("groups"):
        errors.append("groups are missing")
    seen: set[str] = set()
    for gi, group in enumerate(document.get("groups", [])):
        ids = [(f"group {gi}", group)] + [(f"group {gi} widget {wi}", w) for wi, w in enumerate(group.get("widgets", []))]
        for where, item in ids:
            if not item.get("id") or item["id"] in seen:
                errors.append(f"{where}: id is missing or repeated")
            seen.add(item.get("id"))
        for where, w in ids[1:]:
            kind = w.get("type")
            if kind not in WIDGETS:
                errors.append(f"{where}: unknown type {kind!r}")
                continue
            series = w.get("series", [])
            if not series:
                errors.append(f"{where}: series are missing")
            for s in series:
                if kind == "event_log":
                    if not (s.get("event") or s.get("query")):
                        errors.append(f"{where}: a series has no event")
                    continue
                if not display.series_query(s):
                    errors.append(f"{where}: a series has no query")
                if bool(s.get("aggregate")) != bool(s.get("window")):
                    errors.append(f"{where}: aggregate and window go together")
                if s.get("aggregate"):
                    try:
                        aggregates.resolve(s["aggregate"])
                    except ValueError as e:
                        errors.append(f"{where}: {e}")
                for key in ("window", "interval"):
                    if s.get(key):
                        _duration(s[key], where, errors)
                if s.get("color") and not COLOR.fullmatch(s["color"]):
                    errors.append(f"{where}: {s['color']!r} is no colour")
            if kind == "number" and len(series) > 1:
                errors.append(f"{where}: a number has one series")
            if kind == "aggregate_band":
                errors += band_errors(where, series)
    return errors


def band_errors(where: str, series: list[dict]) -> list[str]:
    """A band is one windowed series, or an avg, a min and a max that share query and window."""
    if len(series) == 1:
        return [] if series[0].get("window") else [f"{where}: a band needs a window"]
    roles = sorted(s.get("role") or s.get("aggregate") or "" for s in series)
    shared = {(display.series_query(s), s.get("window")) for s in series}
    out = [] if roles == ["avg", "max", "min"] else [f"{where}: a band needs avg, min and max"]
    return out if len(shared) == 1 else [*out, f"{where}: a band's series share query and window"]
