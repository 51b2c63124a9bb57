"""The given tables seen as samples and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timeutil


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _within(df: DataFrame, ts: str, start_ns: int | None, end_ns: int | None) -> DataFrame:
    """Rows that may be in an inclusive range, by the table's own time: that reaches the scan, which a filter on derived nanoseconds doesn't."""
    at = lambda ns: F.lit(timeutil.format_timestamp(ns)[:26]).cast("timestamp_ntz")
    if start_ns is not None:
        df = df.where(F.col(ts) >= at(start_ns))
    return df if end_ns is None else df.where(F.col(ts) <= at(end_ns))


def _samples(df: DataFrame, db: str, metric, ts, value, seq) -> DataFrame:
    return df.select(F.lit(db).alias("db"), metric.alias("metric"), timeutil.from_timestamp(ts).alias("ts_ns"), value.cast("float").alias("value"), seq.alias("seq"))


def event_samples(spark: SparkSession, sf_dir: str, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    e = _within(table(spark, sf_dir, "events"), "ts", start_ns, end_ns)
    return _samples(e, "S", F.col("event_type"), F.col("ts"), F.col("value"), F.col("event_id"))


def events(spark: SparkSession, sf_dir: str, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    e = _within(table(spark, sf_dir, "events"), "ts", start_ns, end_ns)
    kind = F.when(F.col("value").isNull(), "none").otherwise("float32")
    return e.select(F.lit("E").alias("db"), F.col("event_type").alias("name"), timeutil.from_timestamp(F.col("ts")).alias("ts_ns"), kind.alias("value_type"), F.col("value").cast("float").alias("value"), F.col("props").alias("payload"), F.col("event_id").alias("seq"))


def line_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq is a struct, unique and ordered: arrival within equal days."""
    seq = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return _samples(table(spark, sf_dir, "lineitem"), "L", F.concat_ws(".", "l_returnflag", "l_linestatus"), F.col("l_shipdate"), F.col("l_quantity"), seq)


def order_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(table(spark, sf_dir, "orders"), "O", F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_totalprice"), F.col("o_orderkey"))
