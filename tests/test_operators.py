import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import timeutil
from tidemark.operators import events, filters, lineage, ranges, rates, registry, retention, rollup, windows
from tidemark.operators.rollup import Job

S, M, H, D = timeutil.NS, 60 * timeutil.NS, 3_600 * timeutil.NS, timeutil.DAY_NS
BASE = timeutil.parse_timestamp("2026-05-24 12:00:00")
SAMPLE = "db string, metric string, ts_ns bigint, value float, seq bigint"


def samples(spark, points, metric="m", db="db"):
    return spark.createDataFrame([(db, metric, t, float(v), i) for i, (t, v) in enumerate(points)], SAMPLE)


def test_windowed_series(spark):
    df = samples(spark, [(BASE + 10 * S, 10), (BASE + 4 * M, 20), (BASE + 5 * M + 10 * S, 30), (BASE + 9 * M + 59 * S, 40)])
    got = {(r["end_ts_ns"], r["aggregate"]): r["value"] for r in windows.window_aggregate(df, 5 * M, ["sum", "count"]).collect()}
    assert got == {(BASE + 5 * M, "sum"): 30, (BASE + 5 * M, "count"): 2, (BASE + 10 * M, "sum"): 70, (BASE + 10 * M, "count"): 2}


def test_clipped_edges(spark):
    df = samples(spark, [(BASE + 150 * S, 5), (BASE + 4 * M, 7), (BASE + 330 * S, 11), (BASE + 9 * M, 99)])
    got = [(r["start_ts_ns"] - BASE, r["end_ts_ns"] - BASE, r["value"]) for r in windows.window_aggregate(df, 5 * M, "sum", BASE + 2 * M, BASE + 7 * M).orderBy("start_ts_ns").collect()]
    assert got == [(2 * M, 5 * M, 12), (5 * M, 7 * M, 11)]


def test_a_sample_at_the_end_opens_a_window_of_no_length(spark):
    df = samples(spark, [(BASE, 1), (BASE + 5 * M, 2)])
    rows = windows.window_aggregate(df, 5 * M, "sum", BASE, BASE + 5 * M).orderBy("start_ts_ns").collect()
    assert [(r["start_ts_ns"] - BASE, r["end_ts_ns"] - BASE, r["value"]) for r in rows] == [(0, 5 * M, 1), (5 * M, 5 * M, 2)]


def test_bad_ranges_and_windows(spark):
    df = samples(spark, [(BASE, 1)])
    with pytest.raises(ValueError):
        filters.time_range(df, 2, 1)
    with pytest.raises(ValueError):
        windows.window_aggregate(df, 0, "sum")


def test_ranges(spark):
    df = samples(spark, [(BASE + i // 2, i) for i in range(20)])
    assert [r["value"] for r in ranges.read_range(df, "m", BASE + 1, BASE + 3).collect()] == [2, 3, 4, 5, 6, 7]
    assert [r["value"] for r in ranges.read_range(df, "m", stride=6).collect()] == [0, 6, 12, 18]
    assert sorted(r["value"] for r in ranges.strided(df, 3, block_ns=4).collect()) == [0, 3, 6, 9, 12, 15, 18]
    assert ranges.read_range(df, "other").count() == 0
    assert ranges.latest(df).first()["value"] == 19
    assert [r["value"] for r in ranges.last_per_step(df, 4).orderBy("step_ts_ns").collect()][-1] == 19


def test_alignment(spark):
    rows = [("db", "a", 1, 1.0, 0), ("db", "a", 1, 2.0, 1), ("db", "b", 1, 5.0, 2), ("db", "b", 3, 6.0, 3)]
    got = [tuple(r) for r in ranges.aligned(spark.createDataFrame(rows, SAMPLE), ["a", "b", "c"]).orderBy("ts_ns").collect()]
    assert got == [(1, 2.0, 5.0, None), (3, None, 6.0, None)]


def brute_stale(rows):
    newest, out = {}, []
    for key, ts, seq in rows:
        if key not in newest or ts >= newest[key]:
            newest[key] = ts
            out.append(seq)
    return out


def test_staleness_equals_a_loop(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randrange(30), i) for i in range(200)]
    df = spark.createDataFrame([("db", *r) for r in rows], "db string, metric string, ts_ns bigint, seq bigint")
    for block in (1 << 20, 16):
        assert sorted(r["seq"] for r in filters.not_stale(df, block=block).collect()) == brute_stale(rows)
    assert sorted(r["seq"]["seq"] for r in filters.not_stale(df.withColumn("seq", F.struct("seq"))).collect()) == brute_stale(rows)


def test_pinning_catalog_and_caps(spark):
    rows = [("db", "b", 5, "int32", 0), ("db", "a", 6, "float32", 1), ("db", "b", 7, "float32", 2)]
    df = spark.createDataFrame(rows, "db string, metric string, ts_ns bigint, value_type string, seq bigint")
    assert [r["seq"] for r in filters.pinned(df).where(~F.col("accepted")).collect()] == [2]
    assert [(r["name"], r["id"], r["value_type"], r["last_ts_ns"]) for r in filters.catalog_ids(df).orderBy("id").collect()] == [("b", 1, "int32", 7), ("a", 2, "float32", 6)]
    assert filters.over_capacity(df).count() == 0


def test_sealed_partitions_equal_a_loop(spark):
    rng = random.Random(4)
    rows = [("db", rng.randrange(12) * D + 5, i) for i in range(150)]
    open_, sealed, want = [], set(), set()
    for _, ts, seq in rows:
        key = timeutil.partition_key_of(ts, "day")
        if key in sealed:
            want.add(seq)
        elif key not in open_:
            if len(open_) >= 3:
                open_.remove(least := min(open_))
                sealed.add(least)
            open_.append(key)
    got = filters.sealed_rejections(spark.createDataFrame(rows, "db string, ts_ns bigint, seq bigint"), 3)
    seen = {r["seq"] for r in got.where("sealed").collect()}
    assert seen == want


def test_events(spark):
    rows = [("a.x", 1, 0), ("a.y", 2, 1), ("b/x", 2, 2), ("a.x", 2, 3)]
    df = spark.createDataFrame(rows, "name string, ts_ns bigint, seq bigint")
    assert [r["seq"] for r in events.newest(df, 3).collect()] == [3, 2, 1]
    assert events.select(df, "a.*").count() == 3 and events.select(df, " a.x ").count() == 2 and events.select(df, "*").count() == 3
    assert [r["seq"] for r in events.merged_log(df, ["a.x", "*y"], 1).collect()] == [1, 0]
    catalog = spark.createDataFrame([("db", "n", 1, "none")], "db string, name string, id int, value_type string")
    ids = spark.createDataFrame([("db", 1), ("db", 2)], "db string, id int")
    assert events.resolved(ids.where("id = 1"), catalog).first()["resolved_name"] == "n"
    with pytest.raises(Exception, match="unknown id 2"):
        events.resolved(ids, catalog).collect()


def test_registry(spark):
    r = registry.registry(spark)
    assert r.count() == 54 and len(registry.groups()) == 21 and not registry.groups()["engine.wal"]
    assert registry.groups(toggles={"engine.wal": True})["engine.wal"]
    with pytest.raises(ValueError):
        registry.groups(toggles={"nope": True})
    df = spark.createDataFrame([("engine.db.created", 1, 0, "x"), ("engine.wal.reset", 2, 1, "x"), ("engine.db.deleted", 3, 2, "internal")], "name string, ts_ns bigint, seq bigint, source_db string")
    assert [x["seq"] for x in registry.of_group(df, r, "engine.db").collect()] == [2, 0]
    assert [x["seq"] for x in registry.emitted(df, r, registry.groups()).collect()] == [0]
    with pytest.raises(ValueError):
        registry.of_group(df, r, "nope")


def test_rollup_period(spark):
    start = BASE
    df = samples(spark, [(start + 1, 10), (start + 2, 20), (start + 3, 40), (start + H, 100)])
    job = Job("j", "db", "d", H, source_metric="m", grace_ns=0)
    rows, done = rollup.run(df, rollup.plans([job])[0], BASE + D)
    got = {r["metric"]: (r["ts_ns"], r["value"]) for r in rows.collect()}
    assert got == {"m.min": (start, 10), "m.max": (start, 40), "m.sum": (start, 70), "m.avg": (start, pytest.approx(70 / 3)), "m.count": (start, 3)}
    assert [tuple(r) for r in done.collect()] == [("j", start + H)]


def test_horizon_grace_and_checkpoints(spark):
    df = samples(spark, [(BASE + i * H, i) for i in range(6)])
    job = Job("j", "db", "d", H, source_metric="m", aggregates=("sum",), grace_ns=2 * H)
    plan = rollup.plans([job])[0]
    starts = lambda now, cp=None: sorted((r["ts_ns"] - BASE) // H for r in rollup.run(df, plan, now, cp)[0].collect())
    assert starts(BASE + D) == [0, 1, 2, 3, 4] and starts(BASE + 4 * H) == [0, 1]
    cp = spark.createDataFrame([("db", "j", BASE + H, 1), ("db", "j", BASE + 3 * H, 2)], "db string, job_id string, completed_ts_ns bigint, seq bigint")
    assert starts(BASE + D, cp) == [3, 4]


def test_pattern_jobs_share_a_plan(spark):
    df = samples(spark, [(BASE + i * M, 1) for i in range(200)], "temp.a").unionByName(samples(spark, [(BASE + i * M, 1) for i in range(200)], "temp.b")).unionByName(samples(spark, [(BASE, 1)], "other"))
    jobs = [Job("p", "db", "d", H, source_pattern="temp.*", exclude=("*.b",), aggregates=("count",)), Job("q", "db", "d", H, source_metric="temp.b", aggregates=("trimmed_average",), prefix="tb")]
    assert len(rollup.plans(jobs)) == 1
    rows, done = rollup.run(df, rollup.plans(jobs)[0], BASE + D)
    assert {r["metric"] for r in rows.collect()} == {"temp.a.count", "tb.trimmed_avg"} and {r["job_id"] for r in done.collect()} == {"p::temp.a", "q"}
    assert {(r["job_id"], r["metric"]) for r in rollup.expanded(df.select("metric").distinct(), jobs).collect()} == {("p::temp.a", "temp.a"), ("q", "temp.b")}


def test_full_cycle_cascade(spark):
    """Every 10 s for 30 h, value = idx * 1000 + sec % 1000; hours, then days over their sums, against a loop."""
    rows, hours = [], {}
    for i in range(2):
        for k in range(0, 30 * 360):
            ts, v = BASE // D * D + k * 10 * S, i * 1000 + (k * 10) % 1000
            rows.append(("raw", f"temp.synthetic{i:02d}", ts, float(v), k))
            hours.setdefault((f"temp.synthetic{i:02d}", ts // H * H), []).append(v)
    jobs = [Job("h", "raw", "h1", H, source_pattern="temp.*", grace_ns=0), Job("d", "h1", "d1", D, source_pattern="*.sum", aggregates=("sum", "count"), grace_ns=0)]
    made = rollup.backfill({"raw": spark.createDataFrame(rows, SAMPLE)}, jobs, BASE + 9 * D)
    last = max(t for _, t in hours)
    got = {(r["metric"], r["ts_ns"]): r["value"] for r in made["h1"].collect()}
    want = {(f"{m}.{a}", t): f(v) for (m, t), v in hours.items() if t < last for a, f in (("min", min), ("max", max), ("sum", sum), ("count", len), ("avg", lambda v: sum(v) / len(v)))}
    assert got == pytest.approx(want)
    day = {(r["metric"], r["ts_ns"]): r["value"] for r in made["d1"].collect()}
    first = BASE // D * D
    assert day == pytest.approx({(f"{m}.sum.{a}", first): f([sum(v) for (n, t), v in hours.items() if n == m and t < first + D]) for m in ("temp.synthetic00", "temp.synthetic01") for a, f in (("sum", sum), ("count", len))})


def test_manifest():
    block = {"default_interval": "1h", "destination_db": "d", "exclude_patterns": ["x*"], "default_grace": "5m", "jobs": [{"id": "a", "source_metric": "m", "aggregates": ["MAX", "max"]}, {"id": "b", "source_pattern": "t*", "interval": "1d", "exclude_patterns": ["tt"], "enabled": True}, {"id": "c", "enabled": False}]}
    a, b = rollup.from_manifest("db", block)
    assert a.aggregates == ("max",) and a.interval_ns == H and a.grace_ns == 5 * M and b.exclude == ("x*", "tt") and b.interval_ns == D
    for bad in ({"id": ""}, {"id": "a"}, {"id": "a", "source_metric": "m", "source_pattern": "p"}, {"id": "a", "source_metric": "m", "interval": "0s"}, {"id": "a", "source_pattern": "["}, {"id": "a", "source_metric": "m", "aggregates": ["nope"]}, {"id": "a", "source_metric": "m", "destination_db": "/"}):
        with pytest.raises(ValueError):
            rollup.from_manifest("db", {**block, "jobs": [bad]})
    assert rollup.from_manifest("db", {**block, "enabled": False}) == []
    with pytest.raises(ValueError):
        rollup.order([Job("a", "x", "y", H, source_metric="m"), Job("b", "y", "x", H, source_metric="m")])
    assert rollup.destination_mode(H) == "month" and rollup.destination_mode(D) == "year"


def test_lineage_hops():
    jobs = [Job("a", "raw", "h", H, source_metric="t", aggregates=("sum",)), Job("b", "h", "d", D, source_metric="t.sum", aggregates=("max",)), Job("c", "d", "raw", D, source_metric="t.sum.max", aggregates=("min",))]
    rows, more = lineage.downstream(jobs, "raw", "t", 1)
    assert rows == [(1, "h", "t.sum", "sum", "a")] and more
    rows, more = lineage.downstream(jobs, "raw", "t")
    assert [r[0] for r in rows] == [1, 2, 3] and not more
    with pytest.raises(ValueError):
        lineage.downstream(jobs, "raw", "t", 6)


def test_retention(spark):
    now = timeutil.parse_timestamp("2026-03-15 10:00:00")
    keys = {"2026-03-04": True, "2026-03-05": False, "2026-03": True, "2026-04": False, "2025": True, "2027": False, "forever": False}
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert {r["k"]: r["e"] for r in df.select("k", retention.expired(F.col("k"), now, 10).alias("e")).collect()} == keys
    buckets = {r["k"]: r["b"] for r in df.select("k", retention.archive_bucket(F.col("k")).alias("b")).collect()}
    assert buckets["2026-03-04"] == "2026-03" and buckets["2026-03"] == "2026" and buckets["2025"] == "forever"


def test_differences_and_salvage(spark):
    a = samples(spark, [(1, 1), (1, 1), (2, 2)]).select("metric", "ts_ns", "value")
    assert retention.differences(a, a).count() == 0
    r = retention.differences(a, a.dropDuplicates().union(spark.createDataFrame([("m", 9, 9.0)], a.schema))).first()
    assert (r["only_a"], r["only_b"]) == (1, 1)
    rows = samples(spark, [(5, 1), (D + 5, 2), (7, 3)])
    assert [r["value"] for r in retention.salvaged(rows, "1970-01-01", "day", 5).collect()] == [3]


def test_rates(spark):
    rows = [("sda", 0, 100, 50, 1000, 500, 10), ("sda", 10 * S, 200, 100, 3000, 1500, 5010), ("sda", 20 * S, 150, 200, 4000, 2000, 6000), ("sda", 30 * S, 160, 210, 4000, 2000, 26000)]
    df = spark.createDataFrame(rows, "device string, ts_ns bigint, reads bigint, writes bigint, read_sectors bigint, write_sectors bigint, io_ms bigint")
    got = [tuple(r)[2:] for r in rates.disk(df).orderBy("ts_ns").collect()]
    assert got == [(10.0, 5.0, 100.0, 50.0, 50.0), (1.0, 1.0, 0.0, 0.0, 100.0)]
    cpu = spark.createDataFrame([("h", 0, 100, 50, 0), ("h", 1, 200, 100, 10), ("h", 2, 200, 100, 10)], "host string, ts_ns bigint, total bigint, idle bigint, iowait bigint")
    assert [r["busy_pct"] for r in rates.cpu(cpu).collect()] == [40.0]
    proc = spark.createDataFrame([(1, 0, 5, 100), (1, 1, 15, 200)], "pid int, ts_ns bigint, proc bigint, sys bigint")
    assert [r["cpu_pct"] for r in rates.process(proc, 4).orderBy("ts_ns").collect()] == [0.0, 40.0]
    up = spark.createDataFrame([("t", 0, True), ("t", 1 * S, False), ("t", 2 * S, False), ("t", 5 * S, True)], "target string, ts_ns bigint, up boolean")
    assert [(r["up"], r["outage_ms"]) for r in rates.transitions(up).orderBy("ts_ns").collect()] == [(False, None), (True, 4000)]
    low, high = rates.threshold_split(samples(spark, [(0, 5), (1, 6)]), 5)
    assert low.count() == 1 and high.first()["value"] == 6


def test_counters_and_batches(spark):
    u = spark.createDataFrame([("a", "incr", 2, 0), ("a", "incr", 3, 1), ("b", "set", 9, 0), ("b", "set", 4, 1), ("c", "setMin", 5, 0), ("d", "setMax", -3, 0)], "key string, op string, value bigint, seq bigint")
    assert {r["key"]: r["value"] for r in retention.counters(u).collect()} == {"a": 5, "b": 4, "c": 5, "d": 0}
    e = spark.createDataFrame([("n", "k", 1, "p", 0), ("n", "k", 2, "q", 1), ("n", "k", 61 * S, "r", 2)], "name string, key string, ts_ns bigint, payload string, seq bigint")
    assert [(r["count"], r["payload"]) for r in events.batched_counts(e).orderBy("bucket_ts_ns").collect()] == [(2, "q"), (1, "r")]
