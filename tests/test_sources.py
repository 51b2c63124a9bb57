import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import timeutil
from tidemark.plans import dashboard, results
from tidemark.plans.engine import Engine
from tidemark.operators.rollup import Job
from tidemark.sources import csv_rules, json_events, line_protocol, topics
from tidemark.sources.store import Store

H, D = 3_600 * timeutil.NS, timeutil.DAY_NS
T0 = timeutil.parse_timestamp("2026-01-01")


def lines(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "seq bigint, line string")


def test_lines(spark):
    df = line_protocol.parse(lines(spark, "db/room.temp 21.5 12", " db/m 3i 2026-01-01 00:00:01.5 ", "# no", "", "db/m 7", "m 1 1", "db/m x 1", "db/m 1 soon", "db/a/b 1 1", "db/m"), default_ts=99)
    got = [(r["db"], r["metric"], r["ts_ns"], r["value_type"], r["value"], r["error"]) for r in df.orderBy("seq").collect()]
    assert got[:3] == [("db", "room.temp", 12, "float32", 21.5, None), ("db", "m", T0 + 1_500_000_000, "int32", 3.0, None), ("db", "m", 99, "float32", 7.0, None)]
    assert [g[-1] for g in got[3:]] == ["invalid database", "invalid value", "invalid timestamp", "invalid metric", "missing value"]
    assert line_protocol.parse(lines(spark, "m 1 1"), db="other").first()["db"] == "other"


def test_files_stop_at_the_first_bad_line(spark, tmp_path):
    (tmp_path / "a.lp").write_text("db/m 1 1\n# c\ndb/m 2 2\ndb/m bad 3\ndb/m 4 4\n")
    (tmp_path / "b.lp").write_text("db/m 5 5\n")
    parsed = line_protocol.read(spark, str(tmp_path))
    assert parsed.where("error IS NOT NULL").first()["line_no"] == 4
    assert sorted(r["ts_ns"] for r in line_protocol.until_first_error(parsed).collect()) == [1, 2, 5]
    with pytest.raises(Exception, match="line 4: invalid value"):
        line_protocol.strict(parsed).collect()


def test_export_round_trips(spark):
    rows = line_protocol.parse(lines(spark, "db/a 1.25 5", "db/b -7i 6", "db/a 100000000 7"))
    rows = rows.withColumn("partition_key", F.lit("forever"))
    out = [r["line"] for r in line_protocol.export(rows).collect()]
    assert out == ["db/a 1.25 1970-01-01 00:00:00.000000005", "db/b -7i 1970-01-01 00:00:00.000000006", "db/a 100000000 1970-01-01 00:00:00.000000007"]
    again = line_protocol.parse(lines(spark, *out))
    assert [tuple(r) for r in again.orderBy("seq").select("metric", "ts_ns", "value_type", "value").collect()] == [tuple(r) for r in rows.orderBy("seq").select("metric", "ts_ns", "value_type", "value").collect()]
    assert [r["line"] for r in line_protocol.export_parts(rows).collect()][0] == "a 1.25 1970-01-01 00:00:00.000000005"


def test_inferred_types(spark):
    df = spark.createDataFrame([("a", "1i"), ("a", "2"), ("b", "1.5"), ("c", "1i"), ("c", "2.5")], "metric string, v string")
    got = {r["metric"]: (r["value_type"], r["error"]) for r in line_protocol.infer_types(df, F.col("v")).collect()}
    assert got == {"a": ("int32", None), "b": ("float32", None), "c": ("int32", "mixed int and float")}


def test_event_objects(spark):
    body = '[{"db":"d","name":" e ","ts":5,"value":3,"payload":{"a":1}},{"db":"d","name":"e","value":2.0},{"db":"d","name":"e","value":"x"},{"db":"d","name":"e","value":null,"ts":0},{"db":"d","name":"e","value":3000000000}]'
    df = spark.createDataFrame([(body,), ('{"db":"d","name":"one","value":true}',), ('{"db":"/","name":"one"}',)], "body string")
    rows = json_events.parse(json_events.objects(df), default_ts=77).collect()
    assert [(r["name"], r["ts_ns"], r["value_type"], r["error"]) for r in rows] == [("e", 5, "int32", None), ("e", 77, "float32", None), ("e", 77, None, "value must be a number or null"), ("e", 77, "none", None), ("e", 77, None, "value must be a number or null"), ("one", 77, None, "value must be a number or null"), ("one", 77, "none", "invalid database")]
    assert bytes(rows[0]["payload"]) == b'{"a":1}'


def test_messages(spark):
    m = spark.createDataFrame([("s/db/m", '{"value":5.0,"ts_ns":9}'), ("s/db/m", '{"value":5.5}'), ("x", "{}")], "topic string, body string")
    got = [(r["db"], r["metric"], r["ts_ns"], r["value_type"], r["value"]) for r in topics.metrics(topics.select(m, "s/+/#"), default_ts=1).collect()]
    assert got == [("db", "m", 9, "int32", 5.0), ("db", "m", 1, "float32", 5.5)]
    t = spark.createDataFrame([("a", "5.0 9"), ("a", "5"), ("a", "x")], "topic string, body string")
    assert [(r["ts_ns"], r["value_type"], r["error"]) for r in topics.metrics(topics.select(t, "a", "d", "m"), json=False, default_ts=1).collect()] == [(9, "float32", None), (1, "int32", None), (1, None, "invalid value")]
    e = spark.createDataFrame([("a", '{"value":2,"payload":{"k":1}}'), ("a", "[1]"), ("a", '{"ts_ns":3}')], "topic string, body string")
    rows = topics.events(topics.select(e, "a", "d", "n"), default_ts=1).collect()
    assert [(r["ts_ns"], r["value_type"], bytes(r["payload"]) if r["payload"] is not None else None) for r in rows] == [(1, "int32", b'{"k":1}'), (1, "none", b"[1]"), (3, "none", None)]
    e = spark.createDataFrame([("a", "1.5|pay|load"), ("a", "note"), ("a", "|x")], "topic string, body string")
    assert [(r["value_type"], bytes(r["payload"])) for r in topics.events(topics.select(e, "a", "d", "n"), json=False).collect()] == [("float32", b"pay|load"), ("none", b"note"), ("none", b"x")]


def test_csv(spark):
    rows = spark.createDataFrame([("in/t.csv", 1, "", "Room 1", "21.5", 2), ("in/t.csv", 2, "", "Room 1", "22", 1), ("in/c.csv", 1, "cnt", "", "7", 1), ("in/off.csv", 1, "z", "", "1", 1), ("in/f.csv", 1, "f", "", "1.25", 1)], "file string, line_no int, metric string, sensor string, raw string, ts_ms bigint")
    rules = spark.createDataFrame([("in/t.csv", True, "temp", "int", 10.0, True), ("in/off.csv", False, None, None, None, None)], csv_rules.RULES)
    got = [r["line"] for r in csv_rules.convert(rows, rules, "d").collect()]
    assert got == ["d/cnt 7i 1000000", "d/f 1.25 1000000", "d/temp.Room_1 220i 1000000", "d/temp.Room_1 215i 2000000"]
    newer = spark.createDataFrame([("temp.Room_1", 1_000_000)], "metric string, last_ts_ns bigint")
    assert [r["line"] for r in csv_rules.convert(rows, rules, "d", newer).collect()][-1] == "d/temp.Room_1 215i 2000000" and csv_rules.convert(rows, rules, "d", newer).count() == 3


def test_engine(spark, tmp_path):
    jobs = [Job("h", "db", "hours", H, source_pattern="*", aggregates=("sum", "count"), grace_ns=0), Job("d", "hours", "days", D, source_metric="m.sum", aggregates=("max",), grace_ns=0)]
    e = Engine(spark, str(tmp_path / "store"), jobs=jobs)
    text = [f"db/m {k}i {T0 + k * 600 * timeutil.NS}" for k in range(200)] + [f"db/m 1i {T0}"]
    assert e.import_lines(lines(spark, *text)) == 200
    assert e.databases() == ["db"] and e.query_last("db/m").first()["int32_value"] == 199
    assert e.import_lines(lines(spark, f"db/m 5i {T0}", f"db/m 6i {T0 + 9 * D}")) == 1
    got = e.query_range("db/m", "2026-01-01 00:00:00", "2026-01-01 02:00:00", aggregate="sum,max", window="1h").collect()
    assert {(r["aggregate"], (r["start_ts_ns"] - T0) // H): r["value"] for r in got} == {("sum", 0): 15, ("max", 0): 5, ("sum", 1): 51, ("max", 1): 11, ("sum", 2): 12, ("max", 2): 12}
    assert e.query_range("db/m", T0, T0 + H).count() == 7 and e.query_range("db/m", T0, T0 + H, stride=3).count() == 3
    assert e.query_range("db/m", T0, T0 + H, step="30m").count() == 3
    assert e.query_range("db/none", T0).count() == 0 and [r["name"] for r in e.metrics("db").collect()] == ["m"]
    plan = e.store.scan("db", start_ns=T0, end_ns=T0 + H)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(partition_key" in plan and "GreaterThanOrEqual(ts_ns" in plan
    assert e.backfill(["db"], T0 + 30 * D) == ["hours", "days"]
    day = e.query_last("days/m.sum.max").first()
    assert day["ts_ns"] == T0 and e.store.scan("hours").count() == 2 * 34
    with pytest.raises(Exception, match="type of m is int32"):
        e.import_lines(lines(spark, "db/m 1i 1", "db/m 1.5 2"))
    saved = e.compact("db", "2026-01-01")
    assert saved["saved_bytes"] == saved["source_bytes"] - saved["dest_bytes"] and e.query_range("db/m", T0, T0 + D - 1).count() == 144
    assert {r["partition_key"]: r["records"] for r in e.stats("db").collect()} == {"2026-01-01": 144, "2026-01-02": 56, "2026-01-10": 1}
    done = e.retain("db", 5, "archive", now_ns=T0 + 9 * D)
    assert done["expired"] == ["2026-01-01", "2026-01-02"] and e.store.scan("db").count() == 1
    assert [r["line"] for r in e.export("db").collect()] == ["db/m 6i 2026-01-10 00:00:00.000000000"]
    assert e.lineage("db", "m")[0] == [] and e.lineage("hours", "m.sum")[0] == [(1, "days", "m.sum.max", "max", "d")]


def test_incremental_rollups(spark, tmp_path):
    jobs = [Job("h", "db", "hours", H, source_pattern="*", aggregates=("sum",), grace_ns=0), Job("d", "hours", "days", D, source_metric="m.sum", aggregates=("sum",), grace_ns=0)]
    e = Engine(spark, str(tmp_path / "store"), jobs=jobs)
    feed = lambda a, b: e.import_lines(lines(spark, *[f"db/m 1 {T0 + k * 1800 * timeutil.NS}" for k in range(a, b)]))
    feed(0, 20)
    assert e.roll_up("db", T0 + 9 * D) == {"hours": 9} and e.roll_up("db", T0 + 9 * D) == {}
    feed(20, 100)
    assert e.roll_up("db", T0 + 9 * D) == {"hours": 40, "days": 2}
    assert e.store.scan("hours").count() == 49 and {r["value"] for r in e.store.scan("days").collect()} == {48.0}
    log = e.store.checkpoints("db")
    assert log.count() == 1 and log.agg(F.max("completed_ts_ns")).first()[0] == T0 + 49 * H
    e.store.drop_checkpoints("db")  # as if the run had failed before they were written
    assert e.roll_up("db", T0 + 9 * D) == {}
    assert e.backfill(["db"], T0 + 9 * D) == ["hours", "days"] and e.store.scan("hours").count() == 49 and e.roll_up("db", T0 + 9 * D) == {}


def test_bodies_and_offline_parts(spark, tmp_path):
    bodies = spark.createDataFrame([("db/m 1 1\ndb/m bad 2\ndb/m 3 3",), ('{"lines":"db/m 4 4\\ndb/m 5 5"}',), ('{"lines":["db/m 6 6"]}',)], "body string")
    e = Engine(spark, str(tmp_path / "store"))
    assert e.import_bodies(bodies) == 4 and sorted(r["ts_ns"] for r in e.store.scan("db").collect()) == [1, 4, 5, 6]
    rows = line_protocol.typed_parts(lines(spark, "db/a 1i 5", "db/a 2 6", "db/b 1.5 86400000000005"))
    assert [tuple(r) for r in rows.orderBy("ts_ns").select("metric", "value_type", "int32_value", "float32_value", "partition_key").collect()] == [("a", "int32", 1, None, "1970-01-01"), ("a", "int32", 2, None, "1970-01-01"), ("b", "float32", None, 1.5, "1970-01-02")]
    with pytest.raises(Exception, match="a: mixed int and float"):
        line_protocol.typed_parts(lines(spark, "db/a 1i 5", "db/a 2.5 6")).collect()


def test_events_of_an_engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    body = ",".join(f'{{"db":"ev","name":"{"ab"[k % 2]}","ts":{T0 + k * H},"value":{k}}}' for k in range(30))
    assert e.import_events(spark.createDataFrame([(f"[{body}]",)], "body string")) == 30
    assert [r["int32_value"] for r in e.query_events("ev", limit=2, newest_first=True).collect()] == [29, 28]
    assert [r["int32_value"] for r in e.query_events("ev", "b", limit=2).collect()] == [1, 3] and e.query_events("ev", "?").count() == 30
    assert {r["count"] for r in e.count_events("ev", "1d", "a").collect()} == {12, 3}
    assert [r["name"] for r in e.event_names("ev").collect()] == ["a", "b"]
    assert results.event_list(e.query_events("ev", "a").withColumn("value", F.col("int32_value").cast("double"))).count() == 15


def test_staged_rows_are_seen_once(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), "month")
    rows = spark.createDataFrame([("m", T0 + k, "float32", None, float(k), float(k), k) for k in range(4)], "metric string, ts_ns bigint, value_type string, int32_value int, float32_value float, value float, seq bigint")
    s.stage("db", rows)
    s.write("db", rows.where("seq < 2"))
    assert s.scan("db").count() == 6 and s.partitions("db") == ["2026-01"]
    s.seal("db")
    assert s.scan("db").count() == 6 and not s._exists(f"{s.root}/db/staged_samples")
    with pytest.raises(ValueError):
        s.scan("db", start_ns=2, end_ns=1)


def test_reports(spark):
    rows = spark.createDataFrame([("db", "m", "avg", T0, T0 + H, 1.5)], "db string, metric string, aggregate string, start_ts_ns bigint, end_ts_ns bigint, value double")
    m = results.matrix(rows).first()
    assert m["values"][0]["t"] == (T0 + H) / 1e9 and m["values"][0]["v"] == "1.5"
    assert results.report(results.bucket_rows(rows)).splitlines()[1].startswith("m\tavg\t") and '"value":1.5' in results.report(results.bucket_rows(rows), "json")
    with pytest.raises(ValueError):
        results.report(rows, "xml")


def test_dashboards(spark):
    rows = spark.createDataFrame([("db", "m", T0 + k * H, float(k), k) for k in range(5)], "db string, metric string, ts_ns bigint, value float, seq bigint")
    n = dashboard.number(rows, {"query": "db/m", "transform": {"factor": 10, "unit": "%"}, "thresholds": {"warning": 30, "critical": 50}}).first()
    assert n["text"] == "40%" and n["severity"] == "warning"
    chart = dashboard.line_chart(rows, [{"query": "m", "label": "a", "interval": "2h"}, {"query": "m", "label": "b", "aggregate": "max", "window": "1h"}], T0, T0 + 10 * H)
    assert chart.columns == ["ts_ns", "a", "b"] and chart.count() == 6
    good = {"title": "t", "groups": [{"id": "g", "widgets": [{"id": "w", "type": "line_chart", "series": [{"query": "m", "aggregate": "avg", "window": "5m", "color": "#fff"}]}]}]}
    assert dashboard.validate(good) == []
    bad = {"groups": [{"id": "g", "widgets": [{"id": "g", "type": "line_chart", "series": [{"aggregate": "avg", "color": "red"}]}, {"id": "b", "type": "aggregate_band", "series": [{"query": "m", "role": "avg", "window": "x", "aggregate": "avg"}, {"query": "n", "role": "min"}]}, {"id": "q", "type": "pie"}]}]}
    assert len(dashboard.validate(bad)) >= 8


def test_events_older_than_stored_are_rejected(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    bodies = lambda *at: spark.createDataFrame([("[" + ",".join(f'{{"db":"{d}","name":"{n}","ts":{T0 + k},"value":{k}}}' for d, n, k in at) + "]",)], "body string")
    assert e.import_events(bodies(("ev", "a", 5), ("ev", "b", 3))) == 2
    assert e.import_events(bodies(("ev", "a", 4), ("ev", "a", 5), ("ev", "b", 4), ("ev", "c", 1), ("other", "a", 1))) == 4
    assert sorted((r["name"], r["int32_value"]) for r in e.query_events("ev").collect()) == [("a", 5), ("a", 5), ("b", 3), ("b", 4), ("c", 1)]


def test_reports_tell_what_they_leave_out(spark):
    rows = spark.range(5)
    assert results.report(rows, limit=3).splitlines()[-1].startswith("(5 rows, truncated to 3 in ") and results.report(rows).splitlines()[-1].startswith("(5 rows in ")
    lines = [json.loads(x) for x in results.report(rows, "json", 3).splitlines()]
    assert len(lines) == 4 and lines[-1].pop("seconds") >= 0 and lines[-1] == {"rows": 5, "shown": 3, "truncated": True}
