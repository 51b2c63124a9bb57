"""CSV files of metrics to line protocol under per-file rules.

A file's rows are metric, sensor or value columns in the given order, and a time in milliseconds; a rule per file says whether it
takes part, under what metric, of which type, with which scale, and whether the sensor is appended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names, values

RULES = "file string, enabled boolean, metric string, value_type string, scale double, append_sensor boolean"


def convert(rows: DataFrame, rules: DataFrame, db: str, newer_than: DataFrame | None = None) -> DataFrame:
    """metric, ts_ns, seq_key (file and line), line for rows with file, line_no, metric, sensor, raw, ts_ms.

    Rules are one row per file, so they are broadcast. newer_than (metric, last_ts_ns) keeps newer rows only, to append.
    """
    names.check_database(db)
    r = rows.join(F.broadcast(rules.withColumnRenamed("metric", "rule_metric")), "file", "left").where(F.coalesce("enabled", F.lit(True)))
    base = F.regexp_replace("file", r"^.*/|\.[^.]*$", "")
    name = F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in (F.col("rule_metric"), F.col("metric"), base)])
    sensor = names.sanitize(F.coalesce("sensor", F.lit("")))
    full = F.concat(names.sanitize(name), F.when(F.coalesce("append_sensor", F.lit(True)) & (sensor != ""), F.concat(F.lit("."), sensor)).otherwise(""))
    scale = F.when(F.coalesce("scale", F.lit(0.0)) == 0, 1.0).otherwise(F.col("scale"))
    mode = F.lower(F.trim(F.coalesce("value_type", F.lit("auto"))))
    raw = F.trim("raw")
    own = F.when(mode == "int", values.INT).when(mode == "float", values.FLOAT).when((scale == 1) & raw.rlike(r"^[+-]?\d+$") & raw.try_cast("int").isNotNull(), values.INT).otherwise(values.FLOAT)
    r = r.withColumns({"metric": full, "number": raw.try_cast("double"), "factor": scale, "own": own})
    kinds = r.groupBy("metric").agg(F.min("own").alias("low"), F.max("own").alias("high")).select("metric", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(values.FLOAT).alias("kind"))
    r = r.join(kinds, "metric")
    if newer_than is not None:
        r = r.join(newer_than, "metric", "left").where(F.col("last_ts_ns").isNull() | (F.col("ts_ms") * 1_000_000 > F.col("last_ts_ns"))).drop("last_ts_ns")
    scaled = F.round(F.col("number") * F.col("factor"))
    text = F.when(F.col("kind") == values.INT, F.concat(scaled.cast("long").cast("string"), F.lit("i"))).otherwise(F.regexp_replace((F.col("number") * F.col("factor")).cast("string"), r"\.0$", ""))
    error = F.when(F.col("number").isNull(), "invalid value").when((F.col("kind") == values.INT) & ~scaled.between(values.INT_MIN, values.INT_MAX), "int32 overflow")
    line = F.concat(F.lit(f"{db}/"), F.col("metric"), F.lit(" "), text, F.lit(" "), (F.col("ts_ms") * 1_000_000).cast("string"))
    return r.select("metric", (F.col("ts_ms") * 1_000_000).cast("long").alias("ts_ns"), "file", "line_no", line.alias("line"), error.alias("error")).orderBy("ts_ns", "metric", "file", "line_no")
