"""What every way into a store goes through: imports, request bodies, events, batches of streams."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import shared
from ..functions import timeutil
from ..operators import filters
from ..sources.store import NAME, SCHEMAS, State, Store, columns_of


def openings(open_: Sequence[str], sealed: Sequence[str], opened: Sequence[tuple[int, str]], most: int) -> tuple[list[str], dict[str, int]]:
    """Open keys and, of the keys sealed on the way, the arrival that sealed them. opened: keys by first arrival; one that opens beside most others seals the smallest."""
    now, gone = sorted(open_), {}
    for seq, key in sorted(opened):
        if key in now or key in sealed or key in gone:
            continue
        if len(now) >= most:
            gone[now.pop(0)] = seq
        now = sorted([*now, key])
    return now, gone


def accept(store: Store, parsed: DataFrame, kind: str = "samples", strict: bool = True, max_active: int | None = None, stream: str = "", batch: int = -1) -> dict[str, int]:
    """Store the good rows of parsed (error null) by arrival (seq); the number of rows stored, by database.

    Rejected are a second type of a name, pinned by the catalog or else by the first arrival (an error if strict, before anything is seen), rows older than
    the newest of their name in the catalog or before them here, and, with max_active, rows of partitions that are sealed. Rows that are rejected as stale open no
    partition. Rows are parsed once: they are written aside, judged from there, and written to their partitions in one job for all databases; each
    database then takes over its rows in one version. A batch that a database has from an earlier try is left out there.
    """
    spark, name = store.spark, NAME[kind]
    aside = f"{store.root}/.incoming/{uuid.uuid4().hex}"
    schema = ", ".join(c for c in SCHEMAS[kind].split(", ") if not c.startswith("partition_key "))
    try:
        parsed.select(*[c for c in columns_of(kind) if c != "partition_key"], "error").write.parquet(aside)
        rows = spark.read.schema(f"{schema}, error string").parquet(aside).where("error IS NULL").drop("error")
        firsts = rows.groupBy("db", name).agg(F.min_by("value_type", "seq").alias("first"))
        states = {r["db"]: store.state(r["db"]) for r in firsts.select("db").distinct().collect()}  # databases, few
        states = {d: s for d, s in states.items() if not stream or s.batches.get(stream, -1) < batch}
        if not states:
            return {}
        rows = rows.where(F.col("db").isin(list(states)))
        known = reduce(DataFrame.unionByName, [store.catalog(d, kind, s) for d, s in states.items()])
        known = known.select("db", F.col("name").alias(name), F.col("value_type").alias("known_type"), F.col("last_ts_ns").alias("last"))
        pinned = firsts.join(known, ["db", name], "left").select("db", name, F.coalesce("known_type", "first").alias("pinned_type"), "last")
        fits = F.col("value_type") == F.col("pinned_type")
        if strict:
            wrong = F.raise_error(F.concat(F.lit("type of "), F.col(name), F.lit(" is "), F.col("pinned_type"))).cast("boolean")
            fits = F.coalesce(F.when(fits, True), wrong)
        rows = rows.join(pinned, ["db", name]).where(fits).where(F.col("last").isNull() | (F.col("ts_ns") >= F.col("last"))).drop("pinned_type", "last")
        rows = filters.not_stale(rows, ("db", name))
        key = reduce(lambda c, d: c.when(F.col("db") == d, timeutil.partition_key(F.col("ts_ns"), store.mode_of(d, states[d]))), states, F.when(F.lit(False), ""))
        rows = rows.withColumn("partition_key", key)
        after: dict[str, State] = {}
        if max_active is not None:
            rows, after = within_open(rows, states, max_active)
        base = F.create_map(*[F.lit(x) for d, s in states.items() for x in (d, s.next_seq)])
        made = store.put(rows.withColumn("seq", F.col("seq") + F.element_at(base, F.col("db"))), kind)
        change = lambda d: (lambda s: replace(s, open=after[d].open, sealed=after[d].sealed)) if d in after else None
        return {d: store.admit(d, made, kind, stream=stream, batch=batch, change=change(d), base=s) for d, s in states.items()}
    finally:
        store._delete(aside)


def within_open(rows: DataFrame, states: dict[str, State], most: int) -> tuple[DataFrame, dict[str, State]]:
    """The rows whose partition was not sealed when they arrived, and the states with what is open and sealed after them. One row per database and key is collected."""
    first = rows.groupBy("db", "partition_key").agg(F.min("seq").alias("seq")).collect()
    after, closed = {}, []
    for d, s in states.items():
        open_, gone = openings(s.open, s.sealed, [(r["seq"], r["partition_key"]) for r in first if r["db"] == d], most)
        after[d] = replace(s, open=tuple(open_), sealed=tuple(sorted({*s.sealed, *gone})))
        closed += [(d, k, -1) for k in s.sealed] + [(d, k, at) for k, at in gone.items()]
    if not closed:
        return rows, after
    sealed = shared.local(rows.sparkSession, closed, "db string, partition_key string, sealed_at bigint")  # a row per key
    left = rows.join(sealed, ["db", "partition_key"], "left").where(F.col("sealed_at").isNull() | (F.col("seq") <= F.col("sealed_at")))
    return left.drop("sealed_at"), after
