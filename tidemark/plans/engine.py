"""The engine's calls over a store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..functions import aggregates, names, timeutil
from ..operators import events as ev
from ..operators import filters, lineage, ranges, retention, rollup, windows
from ..sources import json_events, line_protocol
from ..sources.store import Store
from . import ingest


class Engine:
    """Databases of a store, their rollup jobs, and what can be asked of them."""

    def __init__(self, spark: SparkSession, root: str, mode: str = "day", jobs: Sequence[rollup.Job] = (), max_payload: int = 4096, max_active: int | None = None, auto_rollup: bool = False):
        """max_active: how many partitions of a database are open at once (None: rows of any partition are taken); auto_rollup: imports roll up what has become due."""
        self.spark, self.store, self.jobs = spark, Store(spark, root, mode), list(jobs)
        self.max_payload, self.max_active, self.auto_rollup = max_payload, max_active, auto_rollup

    # ingestion

    def import_lines(self, lines: DataFrame, db: str | None = None, default_ts: int | None = None, roll_up: bool = False) -> int:
        """Parse, check, drop stale rows, store; the number of rows stored. A bad line or a second type fails the import before anything is stored."""
        given = lines if "seq" in lines.columns else lines.withColumn("seq", F.monotonically_increasing_id())
        return self._take(line_protocol.strict(line_protocol.parse(given, db=db, default_ts=default_ts)), roll_up=roll_up)

    def import_file(self, path: str, db: str | None = None, default_ts: int | None = None, roll_up: bool = False) -> int:
        """import_lines of text files, which are read in splits; the error of a bad line has its number."""
        return self._take(line_protocol.strict(line_protocol.read(self.spark, path, db, default_ts)), roll_up=roll_up)

    def import_bodies(self, bodies: DataFrame, default_ts: int | None = None) -> int:
        """Lines of request bodies up to each body's first bad line; the number stored."""
        return self._take(line_protocol.until_first_error(line_protocol.from_bodies(bodies, default_ts=default_ts)))

    def import_events(self, bodies: DataFrame, default_ts: int | None = None) -> int:
        """Parse, check, drop events older than those before them or stored of their name; the number stored."""
        parsed = json_events.parse(json_events.objects(bodies), default_ts=default_ts, max_payload=self.max_payload).withColumn("seq", F.monotonically_increasing_id())
        failing = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("string"))
        v = F.coalesce(F.col("int32_value").cast("float"), "float32_value")
        return self._take(parsed.withColumn("error", failing).withColumn("event_id", F.lit(None).cast("int")).withColumn("value", v), "events")

    def _take(self, parsed: DataFrame, kind: str = "samples", roll_up: bool = False) -> int:
        stored = ingest.accept(self.store, parsed, kind, max_active=self.max_active)
        if kind == "samples" and (roll_up or self.auto_rollup):
            for db in sorted(stored):
                self.roll_up(db)
        return sum(stored.values())

    def export(self, db: str, suffix: bool = True) -> DataFrame:
        return line_protocol.export(self.store.scan(db), suffix)

    # queries

    def query_last(self, query: str, db: str | None = None) -> DataFrame:
        """The newest sample of a metric. The catalog has its time, so that one partition is read."""
        d, metric = names.split_target(query, db)
        known = self.store.catalog(d).where(F.col("name") == metric).first()
        at = (known["last_ts_ns"],) * 2 if known else (None, None)
        return ranges.latest(filters.named(self.store.scan(d, "samples", *at) if known else self.store.read(d, []), metric))

    def query_range(self, query: str, start: str | int, end: str | int | None = None, step: str | None = None, aggregate: str | None = None, window: str | None = None, stride: int = 1, db: str | None = None, unit: str = "ns", now: int | None = None) -> DataFrame:
        """Raw samples; windows, if an aggregate and a window are given; means, if only a step is."""
        d, metric = names.split_target(query, db)
        lo = start if isinstance(start, int) else timeutil.parse_timestamp_with_unit(start, unit, now)
        hi = end if end is None or isinstance(end, int) else timeutil.parse_timestamp_with_unit(end, unit, now)
        if bool(aggregate) != bool(window) and not step:
            raise ValueError("aggregate and window go together")
        if aggregate and window:
            wanted, width = aggregates.resolve(aggregate), timeutil.parse_duration(window)
        elif step:
            wanted, width = [aggregates.DEFAULT_STEP], timeutil.parse_duration(step)
        else:
            return ranges.read_range(self.store.scan(d, start_ns=lo, end_ns=hi), metric, lo, hi, stride)
        rows = filters.named(self.store.scan(d, start_ns=lo, end_ns=hi), metric)
        return windows.window_aggregate(rows, width, wanted, lo, hi)

    def query_many(self, db: str, regex: str = ".*", start_ns: int | None = None, end_ns: int | None = None, stride: int = 1) -> DataFrame:
        """Metrics that a regex finds anywhere in the name: a range, or without one the latest of each."""
        if start_ns is None and end_ns is None:
            last = self.store.catalog(db).where(F.col("name").rlike(regex)).select(F.col("name").alias("metric"), F.col("last_ts_ns").alias("ts_ns"))
            return ranges.latest(self.store.scan(db, start_ns=last.agg(F.min("ts_ns")).first()[0]).join(last, ["metric", "ts_ns"], "left_semi"))
        rows = self.store.scan(db, start_ns=start_ns, end_ns=end_ns).where(F.col("metric").rlike(regex))
        return ranges.strided(rows, stride).orderBy("metric", "ts_ns", "seq")

    def query_events(self, db: str, name: str | None = None, start_ns: int | None = None, end_ns: int | None = None, limit: int = ev.DEFAULT_LIMIT, newest_first: bool = False) -> DataFrame:
        rows = ev.select(self.store.scan(db, "events", start_ns, end_ns, self._event_names(db, name)), name, start_ns, end_ns)
        return ev.newest(rows, limit) if newest_first else ev.stored(rows, limit)

    def _event_names(self, db: str, name: str | None) -> list[str] | None:
        """The names that a glob stands for, 1,023 at most: a list of names reaches the scan, and its bloom filters, where a pattern doesn't."""
        if not name or not names.has_glob(name):
            return None if not name else [name.strip()]
        return [r["name"] for r in self.store.catalog(db, "events").where(names.glob_match(F.col("name"), name.strip())).collect()]

    def count_events(self, db: str, window: str, name: str | None = None, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
        rows = ev.select(self.store.scan(db, "events", start_ns, end_ns, self._event_names(db, name)), name, start_ns, end_ns)
        return windows.event_counts(rows, timeutil.parse_duration(window)).orderBy("bucket_ts_ns")

    # discovery

    def databases(self, include_internal: bool = False) -> list[str]:
        return self.store.databases(include_internal)

    def metrics(self, db: str) -> DataFrame:
        """The catalog: no sample is read."""
        if db not in self.store.databases(True):
            raise KeyError(db)
        return self.store.catalog(db).orderBy("name")

    def event_names(self, db: str) -> DataFrame:
        return self.store.catalog(db, "events").select("name", "value_type", "last_ts_ns").orderBy("name")

    def aggregates(self) -> dict:
        return {"aggregates": aggregates.supported(), "default": aggregates.DEFAULT_STEP}

    def lineage(self, db: str, metric: str, max_hops: int = lineage.MAX_HOPS) -> tuple[list[tuple], bool]:
        return lineage.downstream(self.jobs, db, metric, max_hops)

    # rollups

    def roll_up(self, db: str, now_ns: int | None = None) -> dict[str, int]:
        """Write what the jobs of a database, and of those that they feed, have due since their checkpoints; rows written by destination."""
        chosen = rollup.closure(self.jobs, [db])
        return self._roll(chosen, timeutil._now(now_ns))

    def _roll(self, chosen: Sequence[rollup.Job], now: int) -> dict[str, int]:
        """A source's scan begins at the first period that is due and ends with the last, and so does that of the destination, which is looked up for
        periods that a run has written that failed before its checkpoints. A destination's rows are seen before the checkpoints."""
        written: dict[str, int] = {}
        for source in rollup.order(chosen):
            for plan in rollup.plans([j for j in chosen if j.source_db == source]):
                state = self.store.state(source)
                wanted = rollup.due(self.store.catalog(source, "samples", state), plan, now, self.store.checkpoints(source), state.open, self.store.mode_of(source, state))
                found = wanted.collect()  # a row per job and metric of a catalog
                if found:
                    known = shared.local(self.spark, [tuple(r) for r in found], rollup.DUE)
                    n = self._write_due(source, plan, known, min(r["start_ns"] for r in found), max(r["until_ns"] for r in found))
                    if n:
                        written[plan.destination_db] = written.get(plan.destination_db, 0) + n
                    self.store.add_checkpoints(source, [(r["job_id"], r["until_ns"]) for r in found])
        return written

    def _write_due(self, source: str, plan: rollup.Plan, wanted: DataFrame, lo: int, hi: int) -> int:
        d = plan.destination_db
        before = self.store.state(d)
        if not before.version:
            self.store.modes.setdefault(d, rollup.destination_mode(plan.interval_ns))
        rows = rollup.run_due(self.store.scan(source, start_ns=lo, end_ns=hi - 1), plan, wanted)
        if before.version:
            rows = rows.join(self.store.scan(d, start_ns=lo, end_ns=hi - 1).select("metric", "ts_ns"), ["metric", "ts_ns"], "left_anti")
        return self.store.write(d, self._as_stored(rows, before.next_seq))

    @staticmethod
    def _as_stored(rows: DataFrame, base: int) -> DataFrame:
        f = F.col("value").cast("float")
        return rows.select("metric", "ts_ns", F.lit("float32").alias("value_type"), F.lit(None).cast("int").alias("int32_value"), f.alias("float32_value"), f.alias("value"), (F.monotonically_increasing_id() + F.lit(base).cast("long")).alias("seq"))

    def backfill(self, sources: Sequence[str] = (), now_ns: int | None = None) -> list[str]:
        """Make every destination of the sources (none: all) anew, from all that feeds it; the databases made, in order.

        Each destination is emptied once, before anything is written, and the checkpoints of what feeds it begin again.
        """
        chosen = rollup.remade(self.jobs, sources)
        steps = rollup.order(chosen)
        made = [d for d in steps if d in {j.destination_db for j in chosen}]
        for d in made:
            self.store.wipe(d)
        for db in {j.source_db for j in chosen}:
            self.store.drop_checkpoints(db)
        self._roll(chosen, timeutil._now(now_ns))
        return made

    # maintenance

    def compact(self, db: str, key: str) -> dict[str, int]:
        return self.store.rewrite(db, key)

    def retain(self, db: str, days: int, action: str = "delete", now_ns: int | None = None) -> dict[str, list[str]]:
        return retention.sweep(self.store, db, timeutil._now(now_ns), days, action)

    def stats(self, db: str) -> DataFrame:
        return retention.partition_stats(self.store.scan(db), self.store.mode_of(db))

    def inspect(self, db: str, kind: str = "samples") -> DataFrame:
        """A row per file of a database and one of totals (file null): bytes, records, times, and whether it can't be read."""
        parts = self.store.state(db).live(kind)
        paths = [self.store.path(db, p) for p in parts]
        return retention.inspected(self.spark, paths, f"{self.store.root}/.data/{kind}")

    def self_metrics(self, now_ns: int | None = None, interval_ns: int = 30 * timeutil.NS) -> int:
        """Counts of the databases as samples of the internal one, which isn't counted itself; nothing if the last ones are less than the interval ago."""
        now = timeutil._now(now_ns)
        last = self.store.catalog(names.INTERNAL).agg(F.max("last_ts_ns")).first()[0]
        if last is not None and now - last < interval_ns:
            return 0
        found = []
        for d in self.store.databases():
            state = self.store.state(d)
            kinds = {k: len(v) for k, v in self.store._catalog_of(d, state).items()}
            found += [(f"{d}/metrics", kinds.get("samples", 0)), (f"{d}/events", kinds.get("events", 0)), (f"{d}/partitions", len({p.key for p in state.parts if not p.archive})), (f"{d}/version", state.version)]
        rows = retention.self_metrics(self.spark.createDataFrame([(k.replace("/", "."), v) for k, v in found], "key string, value bigint"), prefix="engine", ts_ns=now)
        f = F.col("value").cast("float")
        metric = F.regexp_replace("metric", "/", ".")
        typed = rows.select(F.lit(names.INTERNAL).alias("db"), metric.alias("metric"), "ts_ns", F.lit("float32").alias("value_type"), F.lit(None).cast("int").alias("int32_value"), f.alias("float32_value"), f.alias("value"), F.monotonically_increasing_id().alias("seq"), F.lit(None).cast("string").alias("error"))
        return sum(ingest.accept(self.store, typed).values())
