"""Events from JSON: one object a row, or arrays of them."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, timeutil, values
from ..schema import MAX_PAYLOAD


def objects(bodies: DataFrame, body: str = "body") -> DataFrame:
    """object: the objects of bodies that are one or an array of them, as JSON text."""
    text = F.trim(F.col(body))
    many = F.from_json(text, "array<string>")
    one = F.array(F.when(text.startswith("["), F.lit(None)).otherwise(text))
    return bodies.select(F.posexplode(F.when(text.startswith("["), many).otherwise(one)).alias("item", "object"))


def raw(object_: Column, key: str) -> Column:
    """The raw text of a top-level number, null or text field; null where it is absent."""
    return F.get_json_object(object_, f"$.{key}")


def typed(object_: Column) -> tuple[Column, Column, Column]:
    """Type, int and float value of the object's own value field: what kind of value it is says the parsed object, whether a number is whole says its
    spelling. An absent or null value has type none; strings, booleans and nested values have no type, an error, as has text that is no object."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(object_), "$.value", "variant"))
    literal = F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), raw(object_, "value")).when(kind.isNotNull() & (kind != "VOID"), "nested")
    type_ = F.when(F.try_parse_json(object_).isNotNull(), values.json_type(literal))
    return type_, F.when(type_ == values.INT, literal.try_cast("int")), F.when(type_ == values.FLOAT, literal.try_cast("float"))


def parse(rows: DataFrame, object_: str = "object", default_ts: int | None = None, max_payload: int = MAX_PAYLOAD) -> DataFrame:
    """db, name, ts_ns, value_type, int32_value, float32_value, payload, error for each object; a time of 0 or none is now."""
    now = F.lit(time.time_ns() if default_ts is None else default_ts).cast("long")
    o = F.col(object_)
    kind, whole, real = typed(o)
    ts = raw(o, "ts")
    parsed = F.coalesce(timeutil.parse_timestamp_column(ts), F.lit(0).cast("long"))
    out = rows.select(
        raw(o, "db").alias("db"), F.trim(raw(o, "name")).alias("name"), F.when(ts.isNull() | (parsed == 0), now).otherwise(parsed).alias("ts_ns"),
        kind.alias("value_type"), whole.alias("int32_value"), real.alias("float32_value"), raw(o, "payload").cast("binary").alias("payload"),
    )
    error = (
        F.when(F.col("db").isNull() | ~names.valid_database(F.col("db")), "invalid database")
        .when(F.col("name").isNull() | ~names.valid_event(F.col("name")), "invalid name")
        .when(F.col("value_type").isNull(), "value must be a number or null")
        .when(F.octet_length("payload") > max_payload, "payload too large")
    )
    return out.withColumn("error", error)
