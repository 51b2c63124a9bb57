"""Rollups: jobs that write windows of a metric as samples of another database, up to a horizon, with checkpoints."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import aggregates, names, timeutil
from .windows import bucket

HOUR_NS = 3_600 * timeutil.NS
DEFAULT_GRACE_NS = HOUR_NS
DUE = "job_id string, metric string, prefix string, aggregates array<string>, start_ns bigint, until_ns bigint"


@dataclass(frozen=True)
class Job:
    id: str
    source_db: str
    destination_db: str
    interval_ns: int
    source_metric: str = ""
    source_pattern: str = ""
    exclude: tuple[str, ...] = ()
    aggregates: tuple[str, ...] = aggregates.ROLLUP_DEFAULT
    prefix: str = ""
    grace_ns: int | None = None

    def prefix_column(self) -> Column:
        return F.lit(self.prefix) if self.prefix else F.col("metric")

    def selects(self, metric: Column) -> Column:
        chosen = metric == self.source_metric if self.source_metric else names.glob_match(metric, self.source_pattern)
        for e in self.exclude:
            chosen = chosen & ~names.glob_match(metric, e)
        return chosen


@dataclass(frozen=True)
class Plan:
    """Jobs of one source with the same destination and interval advance together, from one grouping."""

    destination_db: str
    interval_ns: int
    jobs: tuple[Job, ...] = field(default=())


def from_manifest(db: str, block: dict) -> list[Job]:
    """The jobs of a manifest's rollup block. Defaults of the block are inherited; anything invalid is an error; disabled jobs are left out."""
    if not block.get("enabled", True):
        return []
    seen: set[str] = set()
    out = []
    for j in block.get("jobs", []):
        name = (j.get("id") or "").strip()
        if not name or name in seen:
            raise ValueError(f"missing or repeated job id {name!r}")
        seen.add(name)
        if not j.get("enabled", True):
            continue
        metric, pattern = (j.get(k, "").strip() for k in ("source_metric", "source_pattern"))
        if bool(metric) == bool(pattern):
            raise ValueError(f"job {name} needs a source_metric or a source_pattern, and not both")
        exclude = tuple([*block.get("exclude_patterns", []), *j.get("exclude_patterns", [])])
        for p in [*exclude, *([pattern] if pattern else [])]:
            if names.glob_to_regex(p) is None:
                raise ValueError(f"job {name} has a malformed pattern {p!r}")
        interval = timeutil.parse_duration(j.get("interval") or block.get("default_interval") or "")
        if interval <= 0:
            raise ValueError(f"job {name} has no positive interval")
        grace = j.get("grace") or block.get("default_grace") or block.get("retention_grace")
        destination = j.get("destination_db") or block.get("destination_db") or ""
        chosen = aggregates.resolve(j.get("aggregates") or block.get("default_aggregates") or list(aggregates.ROLLUP_DEFAULT), fold_case=True)
        out.append(Job(name, db, names.check_database(destination), interval, metric, pattern, exclude, tuple(chosen), j.get("destination_metric_prefix", ""), timeutil.parse_duration(grace) if grace else None))
    return out


def grace_of(job: Job, default_ns: int | None = None) -> int:
    """The job's grace, else the database's, else an hour."""
    return job.grace_ns if job.grace_ns is not None else default_ns if default_ns is not None else DEFAULT_GRACE_NS


def plans(jobs: Sequence[Job]) -> list[Plan]:
    """Jobs by destination and interval; those without a positive interval are dropped."""
    groups: dict[tuple[str, int], list[Job]] = {}
    for j in jobs:
        if j.interval_ns > 0:
            groups.setdefault((j.destination_db, j.interval_ns), []).append(j)
    return [Plan(d, i, tuple(sorted(g, key=lambda j: j.id))) for (d, i), g in sorted(groups.items())]


def expanded(catalog: DataFrame, jobs: Sequence[Job]) -> DataFrame:
    """job_id (pattern jobs: job::metric), metric, prefix for every metric that a job takes."""
    parts = []
    for j in jobs:
        job_id = F.lit(j.id) if j.source_metric else F.concat(F.lit(f"{j.id}::"), F.col("metric"))
        parts.append(catalog.where(j.selects(F.col("metric"))).select(job_id.alias("job_id"), "metric", j.prefix_column().alias("prefix")))
    return reduce(DataFrame.unionByName, parts)


def destination_mode(interval_ns: int) -> str:
    """Partitions of a destination that a rollup makes: months, or years for a day or more."""
    return "year" if interval_ns >= timeutil.DAY_NS else "month"


def periods(samples: DataFrame, plan: Plan) -> DataFrame:
    """job_id, metric, prefix, start_ts_ns, end_ts_ns, last_ts_ns (of the metric in the database) and a column per aggregate.

    One grouping serves all jobs of the plan: metrics are grouped once, and a job's rows are taken from the groups.
    """
    wanted = list(dict.fromkeys(a for j in plan.jobs for a in j.aggregates))
    any_job = reduce(lambda a, b: a | b, [j.selects(F.col("metric")) for j in plan.jobs])
    rows = samples.where(any_job)
    g = rows.groupBy("metric", bucket(F.col("ts_ns"), plan.interval_ns).alias("start_ts_ns")).agg(F.max("ts_ns").alias("newest"), *aggregates.columns(wanted, F.col("value")))
    # the newest of a metric over its periods, which are a row each: no second look at the samples
    g = g.withColumn("last_ts_ns", F.max("newest").over(W.partitionBy("metric"))).withColumn("end_ts_ns", F.col("start_ts_ns") + F.lit(plan.interval_ns).cast("long"))
    return g.select("*", F.explode(entries(plan)).alias("e")).select("e.job_id", "metric", "e.prefix", "e.grace_ns", "e.aggregates", "start_ts_ns", "end_ts_ns", "last_ts_ns", *wanted)


def entries(plan: Plan) -> Column:
    """The jobs of a plan that take a metric, as an array of job_id, prefix, grace_ns, aggregates."""
    found = []
    for j in plan.jobs:
        job_id = F.lit(j.id) if j.source_metric else F.concat(F.lit(f"{j.id}::"), F.col("metric"))
        found.append(F.when(j.selects(F.col("metric")), F.struct(job_id.alias("job_id"), j.prefix_column().alias("prefix"), F.lit(grace_of(j)).cast("long").alias("grace_ns"), F.array(*[F.lit(a) for a in j.aggregates]).alias("aggregates"))))
    return F.filter(F.array(*found), lambda e: e.isNotNull())


def closed(rows: DataFrame, now_ns: int) -> DataFrame:
    """Periods that end by the metric's newest sample and by now less the grace: no later sample can change them."""
    return rows.where(F.col("end_ts_ns") <= F.least(F.col("last_ts_ns"), F.lit(now_ns).cast("long") - F.col("grace_ns")))


def pending(rows: DataFrame, checkpoints: DataFrame | None) -> DataFrame:
    """Periods that end after their job's last checkpoint."""
    if checkpoints is None:
        return rows
    done = checkpoints.groupBy("job_id").agg(F.max_by("completed_ts_ns", "seq").alias("done_ts_ns"))
    return rows.join(done, "job_id", "left").where(F.col("done_ts_ns").isNull() | (F.col("end_ts_ns") > F.col("done_ts_ns"))).drop("done_ts_ns")


def as_samples(rows: DataFrame, db: str) -> DataFrame:
    """db, metric (prefix.aggregate), ts_ns (period start), value, job_id: an alias writes its canonical name."""
    wanted = [c for c in rows.columns if c in aggregates.AGGREGATES]
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(aggregates.CANONICAL.get(a, a)).alias("name"), F.col(a).alias("value")) for a in wanted])).alias("p")
    out = rows.select("job_id", "prefix", "aggregates", "start_ts_ns", pairs).where(F.array_contains("aggregates", F.col("p.a")))
    return out.select(F.lit(db).alias("db"), F.concat_ws(".", "prefix", "p.name").alias("metric"), F.col("start_ts_ns").alias("ts_ns"), F.col("p.value").cast("double").alias("value"), "job_id")


def run(samples: DataFrame, plan: Plan, now_ns: int, checkpoints: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The samples that a plan writes now, and the checkpoints (job_id, completed_ts_ns) to be written after them."""
    rows = pending(closed(periods(samples, plan), now_ns), checkpoints)
    done = rows.groupBy("job_id").agg(F.max("end_ts_ns").alias("completed_ts_ns"))
    return as_samples(rows, plan.destination_db), done


def due(catalog: DataFrame, plan: Plan, now_ns: int, checkpoints: DataFrame | None, open_keys: Sequence[str] = (), mode: str = "day") -> DataFrame:
    """job_id, metric, prefix, aggregates, start_ns, until_ns for each job and metric that has a period to write, from the catalog's first and last times.

    Periods start at the job's checkpoint, or with the metric's first sample, and end by its newest and by now less the grace; a metric whose newest sample is
    in an open partition waits. A metric that has stopped isn't due, so that it doesn't hold back the start of what is read.
    """
    metrics = catalog.select(F.col("name").alias("metric"), "first_ts_ns", "last_ts_ns")
    if open_keys:
        metrics = metrics.where(~timeutil.partition_key(F.col("last_ts_ns"), mode).isin(list(open_keys)))
    rows = metrics.select("*", F.explode(entries(plan)).alias("e")).select("e.*", "metric", "first_ts_ns", "last_ts_ns")
    rows = rows.withColumn("until_ns", bucket(F.least("last_ts_ns", F.lit(now_ns).cast("long") - F.col("grace_ns")), plan.interval_ns))
    if checkpoints is None:
        rows = rows.withColumn("done_ts_ns", F.lit(None).cast("long"))
    else:
        rows = rows.join(checkpoints.groupBy("job_id").agg(F.max_by("completed_ts_ns", "seq").alias("done_ts_ns")), "job_id", "left")
    rows = rows.withColumn("start_ns", F.coalesce("done_ts_ns", bucket(F.col("first_ts_ns"), plan.interval_ns)))
    return rows.where("until_ns > start_ns").select("job_id", "metric", "prefix", "aggregates", "start_ns", "until_ns")


def run_due(samples: DataFrame, plan: Plan, wanted: DataFrame) -> DataFrame:
    """The samples that a plan writes for what is due: one grouping of the rows between each metric's start and end."""
    listed = list(dict.fromkeys(a for j in plan.jobs for a in j.aggregates))
    spans = wanted.groupBy("metric").agg(F.min("start_ns").alias("from_ns"), F.max("until_ns").alias("to_ns"))
    rows = samples.join(spans, "metric").where((F.col("ts_ns") >= F.col("from_ns")) & (F.col("ts_ns") < F.col("to_ns")))
    g = rows.groupBy("metric", bucket(F.col("ts_ns"), plan.interval_ns).alias("start_ts_ns")).agg(*aggregates.columns(listed, F.col("value")))
    end = F.col("start_ts_ns") + F.lit(plan.interval_ns).cast("long")
    out = g.join(wanted, "metric").where((end > F.col("start_ns")) & (end <= F.col("until_ns")))
    return as_samples(out.select("job_id", "prefix", "aggregates", "start_ts_ns", *listed), plan.destination_db)


def order(jobs: Sequence[Job]) -> list[str]:
    """Databases in the order in which their rollups run: each before those it feeds. A cycle is an error."""
    feeds: dict[str, set[str]] = {}
    for j in jobs:
        feeds.setdefault(j.source_db, set()).add(j.destination_db)
        feeds.setdefault(j.destination_db, set())
    waiting = {d: sum(d in t for t in feeds.values()) for d in feeds}
    out: list[str] = []
    ready = sorted(d for d, n in waiting.items() if not n)
    while ready:
        d = ready.pop(0)
        out.append(d)
        for t in sorted(feeds[d]):
            waiting[t] -= 1
            if not waiting[t]:
                ready.append(t)
    if len(out) < len(feeds):
        raise ValueError("rollup jobs feed each other in a circle")
    return out


def closure(jobs: Sequence[Job], sources: Sequence[str] = ()) -> list[Job]:
    """The jobs of the sources (none: all) and of everything that they feed."""
    wanted = set(sources) or {j.source_db for j in jobs}
    while more := {j.destination_db for j in jobs if j.source_db in wanted} - wanted:
        wanted |= more
    return [j for j in jobs if j.source_db in wanted]


def remade(jobs: Sequence[Job], sources: Sequence[str] = ()) -> list[Job]:
    """The closure of the sources and, as destinations are made anew whole, of every other source that feeds one of them."""
    chosen = closure(jobs, sources)
    while more := {j.source_db for j in jobs if j.destination_db in {c.destination_db for c in chosen}} - {c.source_db for c in chosen}:
        chosen = closure(jobs, sorted(more | {c.source_db for c in chosen}))
    return chosen


def backfill(samples: dict[str, DataFrame], jobs: Sequence[Job], now_ns: int, sources: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Every destination made anew from its sources, cascades in one pass: a destination is the next rollup's source."""
    chosen = closure(jobs, sources)
    made: dict[str, DataFrame] = {}
    for db in order(chosen):
        source = made[db] if db in made else samples.get(db)
        if source is None:
            continue
        for plan in plans([j for j in chosen if j.source_db == db]):
            rows, _ = run(source, plan, now_ns)
            d = plan.destination_db
            made[d] = made[d].unionByName(rows) if d in made else rows
    return made
