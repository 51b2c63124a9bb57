"""Live ingestion and continuous queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import aggregates, timeutil
from ..plans.ingest import accept
from ..sources import line_protocol


def accept_in_order(stream: DataFrame, keys: Sequence[str] = ("db", "metric")) -> DataFrame:
    """Rows of a stream that aren't older than the newest accepted of their series, kept as state; equal times pass.

    Within a micro-batch rows count as arrived by seq. The state is one number per series. A watermark would not do: it is
    one for all series, and lets late rows pass within its delay.
    """
    columns = stream.columns

    def accept(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        before = rows["ts_ns"].cummax().shift(1)
        if newest is not None:
            before = before.fillna(newest).clip(lower=newest)
        kept = rows[before.isna() | (rows["ts_ns"] >= before)]
        if len(kept):
            state.update((max(int(kept["ts_ns"].max()), newest if newest is not None else int(kept["ts_ns"].min())),))
        yield kept[columns]

    return stream.groupBy(*keys).applyInPandasWithState(accept, stream.schema, "newest bigint", "append", GroupStateTimeout.NoTimeout)


def continuous_rollup(stream: DataFrame, interval_ns: int, names: Sequence[str], grace: str = "1 hour") -> DataFrame:
    """Windows of a stream, each emitted once the watermark (newest time of all series less the grace) has passed its end.

    Only aggregates that merge are kept up in state; percentiles need the batch form.
    """
    if exact := [n for n in aggregates.resolve(names) if n not in aggregates.ROLLUP_DEFAULT]:
        raise ValueError(f"{exact[0]} needs the batch form")
    timed = stream.withColumn("ts", timeutil.as_timestamp(F.col("ts_ns"))).withWatermark("ts", grace)
    g = timed.groupBy("db", "metric", F.window("ts", f"{interval_ns // 1000} microseconds")).agg(*aggregates.columns(list(names), F.col("value")))
    return g.select("db", "metric", timeutil.from_timestamp(F.col("window.start")).alias("start_ts_ns"), timeutil.from_timestamp(F.col("window.end")).alias("end_ts_ns"), *names)


def batched_counts(stream: DataFrame, key: str = "key", delay: str = "5 seconds") -> DataFrame:
    """name, key, minute's start, count and last payload of a stream of events."""
    timed = stream.withColumn("ts", timeutil.as_timestamp(F.col("ts_ns"))).withWatermark("ts", delay)
    g = timed.groupBy("name", key, F.window("ts", "1 minute")).agg(F.count("*").alias("count"), F.max_by("payload", "seq").alias("payload"))
    return g.select("name", key, timeutil.from_timestamp(F.col("window.start")).alias("bucket_ts_ns"), "count", "payload")


def ingest(lines: DataFrame, store, default_ts: int | None = None, after: Callable[[DataFrame, int], None] | None = None, stream: str = "lines", max_active: int | None = None) -> Callable[[DataFrame, int], None]:
    """What foreachBatch calls: parse the lines of a batch and store the good ones; bad ones, stale ones and those of a second type are dropped.

    A database keeps the number of the newest batch of each stream (a name for each checkpoint folder) with the rows that it brought, so a batch that is
    done again after a failure is stored once. after(rows, batch) is given the rows that the batch has stored, and may roll up and apply retention.
    """

    def process(batch: DataFrame, number: int) -> None:
        parsed = line_protocol.parse(batch.withColumn("seq", F.monotonically_increasing_id()), default_ts=default_ts)
        accept(store, parsed, strict=False, max_active=max_active, stream=stream, batch=number)
        if after is not None:
            after(stored_by(store, stream, number), number)

    return process


def stored_by(store, stream: str, number: int) -> DataFrame:
    """The rows of a batch, of every database."""
    mine = [store.read(d, [p for p in store.state(d).live("samples") if p.batch == f"{stream}:{number}"], "samples") for d in store.databases(True)]
    return reduce(DataFrame.unionByName, mine, store.read("none", [], "samples"))


def ingested(store) -> DataFrame:
    """All rows that batches have written."""
    return reduce(DataFrame.unionByName, [store.streamed(d) for d in store.databases(True)], store.read("none", [], "samples"))
