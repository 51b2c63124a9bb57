"""Rates of counters, threshold events and state changes, against the row before in the series, by time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import timeutil

SECTOR = 512


def with_previous(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], block_ns: int = timeutil.DAY_NS, name: str = "before") -> DataFrame:
    """rows with a struct of the columns of the row before in its series, null for the first.

    A series is cut into blocks of time, which order must begin with: a task orders one block, and the last row of each block is carried to the
    next one over a row per block.
    """
    keys, block = list(keys), f"{name}_block"
    cut = rows.withColumn(block, timeutil.floor_to(F.col(order[0]), block_ns))
    last = cut.groupBy(*keys, block).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("last"))
    carried = last.select(*keys, block, F.lag("last").over(W.partitionBy(*keys).orderBy(block)).alias(f"{name}_carried"))
    own = F.lag(F.struct(*columns)).over(W.partitionBy(*keys, block).orderBy(*order))
    return cut.join(carried, [*keys, block]).withColumn(name, F.coalesce(own, F.col(f"{name}_carried"))).drop(block, f"{name}_carried")


def _of_before(name: str) -> Column:
    return F.col(f"before.{name}")


def clamp(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def disk(counters: DataFrame, keys: Sequence[str] = ("device",), order: Sequence[str] = ("ts_ns",)) -> DataFrame:
    """reads, writes (per second), read_kb, write_kb (KB per second), busy_pct; no row where a counter fell, or first.

    Counters: reads, writes, read_sectors, write_sectors, io_ms.
    """
    names = ("reads", "writes", "read_sectors", "write_sectors", "io_ms")
    rows, lag = with_previous(counters, keys, order, [*names, "ts_ns"]), _of_before
    d = rows.select(*keys, *order, *[(F.col(n) - lag(n)).alias(f"d_{n}") for n in names], ((F.col("ts_ns") - lag("ts_ns")) / 1e9).alias("s"))
    d = d.where(F.col("s") > 0)
    for n in names:
        d = d.where(F.col(f"d_{n}") >= 0)
    per = lambda n: F.col(f"d_{n}") / F.col("s")
    busy = F.least(F.lit(100.0), F.col("d_io_ms") / (F.col("s") * 10))
    kb = lambda n: F.col(f"d_{n}") * SECTOR / 1024 / F.col("s")
    return d.select(*keys, *order, per("reads").alias("reads"), per("writes").alias("writes"), kb("read_sectors").alias("read_kb"), kb("write_sectors").alias("write_kb"), busy.alias("busy_pct"))


def cpu(counters: DataFrame, keys: Sequence[str] = ("host",), order: Sequence[str] = ("ts_ns",)) -> DataFrame:
    """busy_pct of total, idle, iowait; no row first, or where the total did not grow."""
    rows, lag = with_previous(counters, keys, order, ["total", "idle", "iowait"]), _of_before
    d = rows.select(*keys, *order, *[(F.col(n) - lag(n)).alias(n) for n in ("total", "idle", "iowait")]).where(F.col("total") > 0)
    return d.select(*keys, *order, clamp(100.0 * (F.col("total") - F.col("idle") - F.col("iowait")) / F.col("total")).alias("busy_pct"))


def process(counters: DataFrame, n_cpu: int, keys: Sequence[str] = ("pid",), order: Sequence[str] = ("ts_ns",)) -> DataFrame:
    """cpu_pct of proc and sys times; 0 without a baseline."""
    rows, lag = with_previous(counters, keys, order, ["proc", "sys"]), _of_before
    p, s = F.col("proc") - lag("proc"), F.col("sys") - lag("sys")
    return rows.select(*keys, *order, F.coalesce(F.when(s > 0, p / s * n_cpu * 100.0), F.lit(0.0)).alias("cpu_pct"))


def filesystem_used(total: Column, free: Column) -> Column:
    return F.when(total > 0, (total - free) / total * 100.0)


def threshold_split(samples: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Samples at or below the threshold, and those strictly above it, which become events instead."""
    return samples.where(F.col("value") <= threshold), samples.where(F.col("value") > threshold).withColumn("threshold", F.lit(float(threshold)))


def transitions(states: DataFrame, keys: Sequence[str] = ("target",), order: Sequence[str] = ("ts_ns",)) -> DataFrame:
    """keys, order, up, outage_ms: a row where up changes; when it comes back, the milliseconds since it went."""
    changed = with_previous(states, keys, order, ["up"]).where(F.col("up") != F.col("before.up")).select(*keys, *order, "up")
    both = with_previous(changed, keys, order, ["ts_ns"], name="went")
    return both.select(*keys, *order, "up", F.when(F.col("up"), F.call_function("div", F.col("ts_ns") - F.col("went.ts_ns"), F.lit(1_000_000).cast("long"))).alias("outage_ms"))
