"""Row filters and acceptance rules of ingestion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import shared
from ..functions import timeutil
from ..schema import MAX_EVENTS, MAX_METRICS, MAX_PAYLOAD


def time_range(df: DataFrame, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """Both ends inclusive; an end before the start is an error."""
    if start_ns is not None and end_ns is not None and end_ns < start_ns:
        raise ValueError("the end is before the start")
    if start_ns is not None:
        df = df.where(F.col("ts_ns") >= start_ns)
    return df if end_ns is None else df.where(F.col("ts_ns") <= end_ns)


def named(df: DataFrame, names: str | Sequence[str], column: str = "metric") -> DataFrame:
    """Exact names; unknown ones give nothing."""
    return df.where(F.col(column) == names) if isinstance(names, str) else df.where(F.col(column).isin(list(names)))


def _order(keys: Sequence[str], seq: str):
    return W.partitionBy(*keys).orderBy(seq)


def not_stale(df: DataFrame, keys: Sequence[str] = ("db", "metric"), seq: str = "seq", block: int = 1 << 20) -> DataFrame:
    """Rows not older than all that arrived before them in their series; equal times pass.

    A rejected row is older than the newest, so the running maximum over all rows is that of the accepted ones. A series is cut into blocks of
    seq: maxima of blocks are carried forward over one row per block, and only a block is ordered by a task. A seq that isn't a
    whole number is numbered first, by a sort over ranges of it that is written out once.
    """
    keys = list(keys)
    if df.schema[seq].dataType.typeName() not in ("byte", "short", "integer", "long"):
        numbered = shared.cut(df.repartitionByRange(seq).sortWithinPartitions(seq).withColumn("seq_number", F.monotonically_increasing_id()))
        return not_stale(numbered, keys, "seq_number", block).select(*df.columns)
    rows = df.withColumn("seq_block", timeutil.floor_to(F.col(seq).cast("long"), block))
    before = W.partitionBy(*keys).orderBy("seq_block").rowsBetween(W.unboundedPreceding, -1)
    carried = rows.groupBy(*keys, "seq_block").agg(F.max("ts_ns").alias("m")).select(*keys, "seq_block", F.max("m").over(before).alias("carried"))
    rows = rows.join(carried, [*keys, "seq_block"])
    own = F.max("ts_ns").over(_order([*keys, "seq_block"], seq).rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("newest", F.greatest(own, "carried")).where(F.col("newest").isNull() | (F.col("ts_ns") >= F.col("newest")))
    return rows.select(*df.columns)


def not_before(df: DataFrame, last: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows not older than last of their series; series that have none pass."""
    return df.join(last, list(keys), "left").where(F.col("last").isNull() | (F.col("ts_ns") >= F.col("last"))).drop("last")


def pinned(df: DataFrame, keys: Sequence[str] = ("db", "metric"), seq: str = "seq") -> DataFrame:
    """With pinned_type, that of the first row by arrival (a grouping, no order within a series), and accepted."""
    first = df.groupBy(*keys).agg(F.min_by("value_type", seq).alias("pinned_type"))
    return df.join(first, list(keys)).withColumn("accepted", F.col("value_type") == F.col("pinned_type"))


def payload_fits(payload: Column, cap: int = MAX_PAYLOAD) -> Column:
    return payload.isNull() | (F.octet_length(payload) <= cap)


def over_capacity(df: DataFrame, name: str = "metric") -> DataFrame:
    """Databases with more distinct names than a catalog holds."""
    cap = MAX_METRICS if name == "metric" else MAX_EVENTS
    return df.groupBy("db").agg(F.countDistinct(name).alias("n")).where(F.col("n") > cap)


def catalog_ids(df: DataFrame, name: str = "metric", seq: str = "seq") -> DataFrame:
    """db, name, id, value_type, last_ts_ns: dense ids from 1 by first arrival. The window is over one row per name."""
    g = df.groupBy("db", F.col(name).alias("name")).agg(F.min(seq).alias("first"), F.min_by("value_type", seq).alias("value_type"), F.max("ts_ns").alias("last_ts_ns"))
    return g.select("db", "name", F.row_number().over(W.partitionBy("db").orderBy("first", "name")).alias("id"), "value_type", "last_ts_ns")


def with_partition(df: DataFrame, mode: str = "day") -> DataFrame:
    return df.withColumn("partition_key", timeutil.partition_key(F.col("ts_ns"), mode))


def sealed_rejections(df: DataFrame, max_active: int, mode: str = "day", seq: str = "seq") -> DataFrame:
    """With partition_key and sealed: whether a key was sealed when the row arrived.

    A key that opens while max_active are open seals the smallest of those first. A key opens once, with its first row; the openings, one per key, are gone
    through in order as an array per database.
    """
    rows = with_partition(df, mode)
    opened = rows.groupBy("db", "partition_key").agg(F.min(seq).alias("opened"))
    openings = opened.groupBy("db").agg(F.sort_array(F.collect_list(F.struct("opened", "partition_key"))).alias("openings"))
    kind = opened.schema["opened"].dataType.simpleString()
    start = F.struct(F.array().cast("array<string>").alias("open"), F.array().cast(f"array<struct<partition_key:string,sealed_at:{kind}>>").alias("sealed"))

    def step(state: Column, x: Column) -> Column:
        full, oldest = F.size(state["open"]) >= max_active, F.array_min(state["open"])
        left = F.when(full, F.array_remove(state["open"], oldest)).otherwise(state["open"])
        more = F.when(full, F.array_append(state["sealed"], F.struct(oldest.alias("partition_key"), x["opened"].alias("sealed_at")))).otherwise(state["sealed"])
        return F.struct(F.array_append(left, x["partition_key"]).alias("open"), more.alias("sealed"))

    sealed = openings.select("db", F.explode(F.aggregate("openings", start, step)["sealed"]).alias("s")).select("db", "s.partition_key", "s.sealed_at")
    out = rows.join(sealed, ["db", "partition_key"], "left")
    return out.withColumn("sealed", F.coalesce(F.col(seq) > F.col("sealed_at"), F.lit(False))).drop("sealed_at")
