"""Messages of a publish-subscribe broker as samples and events. The broker's client is any source of topic and body."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names, values


def select(messages: DataFrame, topic_filter: str, db: str = "", name: str = "") -> DataFrame:
    """Messages whose topic matches, with db and name from the rule or its wildcards."""
    db_c, name_c = names.topic_names(F.col("topic"), topic_filter, db, name)
    return messages.where(F.col("topic").rlike(names.topic_to_regex(topic_filter))).withColumns({"db": db_c, "name": name_c})


def _now(default_ts: int | None):
    return F.lit(time.time_ns() if default_ts is None else default_ts).cast("long")


def _with_type(df: DataFrame, kind, literal) -> DataFrame:
    df = df.withColumn("value_type", kind)
    return df.withColumns({"int32_value": F.when(F.col("value_type") == values.INT, literal.try_cast("double").cast("int")), "float32_value": F.when(F.col("value_type") == values.FLOAT, literal.try_cast("float"))})


def metrics(messages: DataFrame, json: bool = True, default_ts: int | None = None) -> DataFrame:
    """Samples of messages with db and name: JSON {"value", "ts_ns"} typed by the number, or text ``value [ts]`` typed by spelling."""
    body = F.trim(F.col("body"))
    if json:
        literal, ts = F.get_json_object(body, "$.value"), F.get_json_object(body, "$.ts_ns").try_cast("long")
        kind = values.integral_type(literal)
    else:
        fields = F.split(F.regexp_replace(body, r"\s+", " "), " ")
        literal, ts = F.element_at(fields, 1), F.try_element_at(fields, F.lit(2)).try_cast("long")
        kind = values.spelled_type(literal)
    out = _with_type(messages, kind, literal).withColumn("ts_ns", F.coalesce(ts, _now(default_ts))).withColumnRenamed("name", "metric")
    return out.withColumn("value", values.common_value(F.col("int32_value"), F.col("float32_value"))).withColumn("error", F.when(F.col("value_type").isNull(), "invalid value"))


def events(messages: DataFrame, json: bool = True, default_ts: int | None = None) -> DataFrame:
    """Events: a JSON object's value, ts_ns and payload (any other JSON is payload), or text ``value|payload``."""
    body = F.col("body")
    if json:
        is_object = F.trim(body).startswith("{")
        literal = F.when(is_object, F.get_json_object(body, "$.value"))
        ts = F.when(is_object, F.get_json_object(body, "$.ts_ns").try_cast("long"))
        payload = F.when(is_object, F.get_json_object(body, "$.payload")).otherwise(body)
        kind = F.when(literal.isNull(), values.NONE).otherwise(values.integral_type(literal))
    else:
        has = body.contains("|")
        literal = F.when(has, F.substring_index(body, "|", 1))
        payload = F.when(has, F.substring(body, F.instr(body, "|") + 1, F.length(body))).otherwise(body)
        ts = F.lit(None).cast("long")
        kind = F.when(literal.isNull() | (literal == ""), values.NONE).otherwise(values.spelled_type(literal))
    out = _with_type(messages, kind, literal)
    return out.withColumns({"ts_ns": F.coalesce(ts, _now(default_ts)), "payload": payload.cast("binary")}).withColumn("error", F.when(F.col("value_type").isNull(), "invalid value"))
