"""The store over several writers, failures and versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import aggregates, timeutil
from tidemark.operators import quantiles, rates, registry
from tidemark.operators.rollup import Job
from tidemark.plans import ingest
from tidemark.plans.engine import Engine
from tidemark.sources import json_events, line_protocol
from tidemark.sources.store import Conflict, Part, Store
from tidemark.streaming import live

H, D = 3_600 * timeutil.NS, timeutil.DAY_NS
T0 = timeutil.parse_timestamp("2026-01-01")


def lines(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "seq bigint, line string")


def test_a_later_import_wins_and_keeps_types(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"))
    e.import_lines(lines(spark, "d/a 1 50", "d/a 1 60", "d/a 1 100", "d/b 1i 5"))
    assert e.import_lines(lines(spark, "d/a 2 100", "d/a 9 99")) == 1
    assert e.query_last("d/a").first()["value"] == 2.0
    before = e.store.state("d").version
    with pytest.raises(Exception, match="type of a is float32"):
        e.import_lines(lines(spark, "d/a 5i 200", "d/c 1 1"))
    assert e.store.state("d").version == before and [(r["name"], r["id"], r["last_ts_ns"]) for r in e.metrics("d").collect()] == [("a", 1, 100), ("b", 2, 5)]
    seqs = [r["seq"] for r in e.store.scan("d").collect()]
    assert len(set(seqs)) == len(seqs) == 5


def test_a_second_writer_fails(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    old = s.commit("d", s.state("d"))
    s.commit("d", old)
    with pytest.raises(Conflict):
        s.commit("d", old)


def test_a_failure_before_the_commit_leaves_nothing(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"))
    e.import_lines(lines(spark, "d/a 1 50"))
    rows = e.store.scan("d")
    made = e.store.put(rows)
    assert e.store.scan("d").count() == 1 and e.store.vacuum(0) == [made] and e.store.scan("d").count() == 1


def test_open_partitions(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"), max_active=2)
    day = lambda m, k: f"d/{m} 1 {T0 + k * D}"
    assert e.import_lines(lines(spark, day("a", 0), day("b", 1), day("c", 0), day("a", 2), day("e", 0), day("f", 1))) == 5  # day 0 is sealed when day 2 opens
    state = e.store.state("d")
    assert state.open == ("2026-01-02", "2026-01-03") and state.sealed == ("2026-01-01",)
    assert e.import_lines(lines(spark, day("g", 0), day("h", 1))) == 1
    with pytest.raises(ValueError, match="active"):
        e.compact("d", "2026-01-03")
    assert e.compact("d", "2026-01-01")["dest_bytes"] > 0
    assert ingest.openings(["1"], [], [(5, "2"), (6, "0"), (7, "3")], 2) == (["2", "3"], {"0": 7, "1": 6})


def test_periods_of_open_partitions_wait(spark, tmp_path):
    job = Job("h", "d", "hours", H, source_pattern="*", aggregates=("count",), grace_ns=0)
    e = Engine(spark, str(tmp_path / "s"), jobs=[job], max_active=1, auto_rollup=True)
    e.import_lines(lines(spark, *[f"d/a 1 {T0 + k * H // 2}" for k in range(10)]))
    assert "hours" not in e.databases()
    e.import_lines(lines(spark, f"d/b 1 {T0 + D}"))  # seals the first day
    assert {r["metric"] for r in e.store.scan("hours").collect()} == {"a.count"} and e.store.mode_of("hours") == "month"


def test_a_rollup_reads_from_its_checkpoints_on(spark, tmp_path):
    job = Job("h", "d", "hours", H, source_pattern="*", aggregates=("count",), grace_ns=0)
    e = Engine(spark, str(tmp_path / "s"), jobs=[job])
    e.import_lines(lines(spark, *[f"d/a 1 {T0 + k * H}" for k in range(30)], f"d/gone 1 {T0}"))
    e.roll_up("d", T0 + 90 * D)
    e.import_lines(lines(spark, *[f"d/a 1 {T0 + k * H}" for k in range(30, 60)]))
    asked = []
    scan = e.store.scan
    e.store.scan = lambda db, *a, **k: asked.append((db, k.get("start_ns"))) or scan(db, *a, **k)
    assert e.roll_up("d", T0 + 90 * D) == {"hours": 30}
    assert asked == [("d", T0 + 29 * H), ("hours", T0 + 29 * H)]


def test_two_sources_of_one_destination(spark, tmp_path):
    jobs = [Job("x", "A", "D", H, source_pattern="*", aggregates=("sum",), grace_ns=0), Job("y", "B", "D", H, source_pattern="*", aggregates=("sum",), grace_ns=0)]
    e = Engine(spark, str(tmp_path / "s"), jobs=jobs)
    e.import_lines(lines(spark, f"A/x 1 {T0}", f"A/x 1 {T0 + H}", f"B/y 1 {T0}", f"B/y 1 {T0 + H}"))
    for sources in ((), ["A"]):
        assert e.backfill(sources, T0 + 9 * D) == ["D"]
        assert sorted(r["metric"] for r in e.store.scan("D").collect()) == ["x.sum", "y.sum"]


def test_many_bodies_and_partitions(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"))
    assert e.import_bodies(spark.range(120).repartition(120).selectExpr("concat('d/m', id, ' 1 ', id) AS body")) == 120


def test_batches_of_two_streams(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    one, two = live.ingest(None, s, stream="one"), live.ingest(None, s, stream="two")
    got = []
    three = live.ingest(None, s, stream="two", after=lambda rows, n: got.append((n, rows.count())))
    one(lines(spark, "d/a 1 10"), 0)
    two(lines(spark, "d/a 1 10", "d/a 1 5", "d/a 1i 20", "e/b 1 1"), 0)
    three(lines(spark, "d/a 1 10", "e/b 1 1"), 0)
    assert s.databases() == ["d", "e"] and s.scan("d").count() == 2 and got == [(0, 2)]


def test_nested_values(spark):
    rows = [('{"db":"d","name":"n","ts":1,"payload":{"a":{"value":"x"}},"value":5}', "int32"), ('{"db":"d","name":"n","value":1e2}', "float32"), ('{"db":"d","name":"n","payload":{"value":5}}', "none"), ('{"db":"d","name":"n","value":"5"}', None), ('{"db":"d","name":"n","value":{"value":1}}', None), ('{"db":"d","name":"n","value":[1]}', None), ('{"db":"d"', None)]
    df = spark.createDataFrame([(b,) for b, _ in rows], "object string")
    assert [r["value_type"] for r in json_events.parse(df).collect()] == [k for _, k in rows]


def test_inspect_tells_damaged_files(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"))
    e.import_lines(lines(spark, f"d/a 1 {T0}", f"d/a 2 {T0 + D}"))
    broken = next((tmp_path / "s" / ".data" / "samples").rglob("partition_key=2026-01-01/*.parquet"))
    broken.write_bytes(b"nothing")
    (broken.parent / f".{broken.name}.crc").unlink(missing_ok=True)
    rows = e.inspect("d").collect()
    assert sorted((r["records"], r["damaged"]) for r in rows if r["file"]) == [(0, True), (1, False)]
    total = next(r for r in rows if r["file"] is None)
    assert total["records"] == 1 and total["damaged"] and total["bytes"] == sum(r["bytes"] for r in rows if r["file"])


def test_own_metrics(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"))
    e.import_lines(lines(spark, f"d/a 1 {T0}"))
    assert e.self_metrics(T0) == 4 and e.self_metrics(T0 + timeutil.NS) == 0 and e.self_metrics(T0 + 31 * timeutil.NS) == 4
    assert e.databases() == ["d"] and {r["name"] for r in e.metrics("internal").collect()} == {"engine.d.metrics", "engine.d.events", "engine.d.partitions", "engine.d.version"}


def test_emitter(spark, tmp_path):
    m = registry.Emitter(most=2)
    assert m.emit("engine.db.created", T0, payload={"db": "x"}) and not m.emit("engine.wal.reset", T0) and not m.emit("engine.db.deleted", T0, source_db="internal")
    m.toggle("engine.wal", True)
    assert m.emit("engine.wal.reset", T0, 7.0) and not m.emit("engine.db.created", T0) and m.dropped == 1
    bodies = m.bodies()
    assert json.loads(bodies[1])["value"] == 7 and m.bodies() == []
    e = Engine(spark, str(tmp_path / "s"))
    assert e.import_events(spark.createDataFrame([(b,) for b in bodies], "body string")) == 2
    assert {r["name"]: r["value_type"] for r in e.event_names("internal").collect()} == {"engine.db.created": "none", "engine.wal.reset": "int32"}
    with pytest.raises(ValueError):
        m.emit("engine.nothing", T0)


def test_lines_of_split_files(spark, tmp_path):
    for name, n in (("b", 3000), ("a", 500)):
        (tmp_path / f"{name}.lp").write_text("".join(f"d/{name} {k} {k}\n" for k in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = line_protocol.read(spark, str(tmp_path)).select("metric", "ts_ns", "line_no", "seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert all(r["line_no"] == r["ts_ns"] + 1 and r["seq"] == r["ts_ns"] + (500 if r["metric"] == "b" else 0) for r in rows) and len(rows) == 3500


def test_wide_windows_equal_plain_ones(spark):
    rng = random.Random(2)
    rows = [(f"k{rng.randrange(4)}", rng.choice([0.0, -0.0, 1e-40, 5.0, -3.25, rng.gauss(0, 1), rng.gauss(20, 0.01), 1e30 * rng.random()])) for _ in range(900)] + [("one", 3.0), ("two", 1.0), ("two", 2.0), ("null", None), ("three", -1.0), ("three", None), ("three", 7.0)]
    df = spark.createDataFrame(rows, "k string, value float")
    names = aggregates.supported()
    plain = {r["k"]: r for r in df.groupBy("k").agg(*aggregates.columns(names, F.col("value"))).collect()}
    wide = {r["k"]: r for r in quantiles.wide(df, ["k"], names).collect()}
    assert plain.keys() == wide.keys()
    for k, r in plain.items():
        for n in names:
            assert (r[n] is None and wide[k][n] is None) or wide[k][n] == pytest.approx(r[n], rel=1e-9, abs=1e-9), (k, n)


def test_rows_before_over_blocks(spark):
    df = spark.createDataFrame([(k, t * D // 3, t) for k in ("a", "b") for t in range(12)], "k string, ts_ns bigint, v int")
    got = rates.with_previous(df, ["k"], ["ts_ns"], ["v"]).collect()
    assert all((r["before"]["v"] if r["before"] else -1) == r["v"] - 1 for r in got) and len(got) == 24


def test_part_round_trips(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    state = s.commit("d", s.state("d"))
    assert type(state).of(state.text()) == state and Part("samples", "c", "k").archive == ""
