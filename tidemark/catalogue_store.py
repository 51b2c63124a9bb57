"""Registered queries that go through a store: several imports, batches, rollups, maintenance, and what the engine is asked then."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .catalogue import BASIC, CUT, DAY, HI, HOUR, LO, NOW, E, L, O, S, long_sql, registered, rollup_sql
from .functions import display, names, timeutil, values
from .operators import events as ev
from .operators import filters, ranges, registry, retention, rollup
from .plans import dashboard, results
from .plans.engine import Engine
from .sources import line_protocol
from .streaming import live

_MADE: dict[tuple, Engine] = {}


def made(spark: SparkSession, sf_dir: str, what: str, make: Callable[[Engine], None], **how) -> Engine:
    """An engine over a store of its own in the shared folder, filled once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _MADE:
        e = Engine(spark, shared.place(spark, "store"), **how)
        make(e)
        _MADE[key] = e
    return _MADE[key]


def lines(samples: DataFrame, db: str) -> DataFrame:
    """Samples that have a value as lines, with seq."""
    rows = samples.where("value IS NOT NULL").withColumns({"db": F.lit(db), "int32_value": F.lit(None).cast("int"), "float32_value": F.col("value")})
    return rows.select("seq", line_protocol.to_line().alias("line"))


def two_halves(e: Engine, spark: SparkSession, sf_dir: str, **how) -> None:
    """Samples of even ids, then those of odd ones: most of the second import is older than the first's newest, and is rejected."""
    for half in (0, 1):
        e.import_lines(lines(S(spark, sf_dir).where(F.col("seq") % 2 == half), "S"), **how)


def halves(spark: SparkSession, sf_dir: str) -> Engine:
    return made(spark, sf_dir, "halves", lambda e: two_halves(e, spark, sf_dir))


def whole(spark: SparkSession, sf_dir: str) -> Engine:
    """All samples, by time in two imports, and all events in two."""

    def fill(e: Engine) -> None:
        for part in (F.col("ts_ns") < CUT, F.col("ts_ns") >= CUT):
            e.import_lines(lines(S(spark, sf_dir).where(part), "S"))
            e.import_events(bodies(E(spark, sf_dir).where(part)))

    return made(spark, sf_dir, "whole", fill)


def bodies(events: DataFrame) -> DataFrame:
    """Events as JSON objects, with payloads that have a value field before the event's own."""
    value = F.when(F.col("value").isNull(), "null").otherwise(F.when(F.col("value") == F.floor("value"), F.concat(values.float_text(F.col("value")), F.lit(".0"))).otherwise(values.float_text(F.col("value"))))
    kept = events.where("value IS NOT NULL")
    return kept.orderBy("seq").select(F.concat(F.lit('{"db":"E","payload":{"value":{"value":"x"},"p":'), F.col("payload"), F.lit('},"name":"'), F.col("name"), F.lit('","ts":'), F.col("ts_ns").cast("string"), F.lit(',"value":'), value, F.lit("}")).alias("body"))


def stale_sql(view: str, name: str, order: str, extra: str = "") -> str:
    """Rows of a view that aren't older than those before them in an order of arrival."""
    return f", a AS (SELECT *, max(ts_ns) OVER (PARTITION BY {name} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM {view} WHERE value IS NOT NULL{extra}), k AS (SELECT * FROM a WHERE newest IS NULL OR ts_ns >= newest)"


def _rows(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, F.round(F.col("value").cast("double"), 4).alias("value"))


@registered(stale_sql("S", "metric", "seq % 2, seq") + " SELECT metric, ts_ns, round(value, 4) AS value FROM k")
def engine_two_imports(spark, sf_dir):
    return _rows(halves(spark, sf_dir).store.scan("S"), "metric", "ts_ns")


@registered(stale_sql("S", "metric", "seq % 2, seq") + " SELECT metric, ts_ns, round(value, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY ts_ns DESC, seq % 2 DESC, seq DESC) AS nth FROM k) WHERE nth = 1")
def engine_latest(spark, sf_dir):
    """The later import wins among equal times."""
    return _rows(halves(spark, sf_dir).query_many("S"), "metric", "ts_ns")


@registered(stale_sql("S", "metric", "seq % 2, seq") + " SELECT metric AS name, CAST(row_number() OVER (ORDER BY min(seq % 2), min(seq), metric) AS INT) AS id, 'float32' AS value_type, min(ts_ns) AS first_ts_ns, max(ts_ns) AS last_ts_ns FROM k GROUP BY metric")
def engine_catalog(spark, sf_dir):
    return halves(spark, sf_dir).metrics("S").drop("db")


@registered("SELECT DISTINCT metric AS name, 'float32' AS value_type, true AS refused FROM S WHERE value IS NOT NULL")
def engine_type_pinning(spark, sf_dir):
    """A later import of whole numbers is refused for every metric, and leaves the catalog as it was."""
    e = halves(spark, sf_dir)
    refused = []
    for r in e.metrics("S").select("name", "last_ts_ns").collect():
        try:
            e.import_lines(shared.local(spark, [(0, f"S/{r['name']} 5i {r['last_ts_ns']}")], "seq bigint, line string"))
        except Exception as error:  # noqa: BLE001 - the error is the result
            if f"type of {r['name']} is float32" in str(error):
                refused.append((r["name"],))
    return e.metrics("S").join(shared.local(spark, refused, "name string").withColumn("refused", F.lit(True)), "name", "left").select("name", "value_type", F.coalesce("refused", F.lit(False)).alias("refused"))


@registered(stale_sql("E", "name", "seq % 2, seq") + " SELECT name, ts_ns, round(value, 4) AS value FROM k")
def engine_event_stale(spark, sf_dir):
    def fill(e: Engine) -> None:
        for half in (0, 1):
            e.import_events(bodies(E(spark, sf_dir).where(F.col("seq") % 2 == half)))

    e = made(spark, sf_dir, "event halves", fill)
    return e.store.scan("E", "events").select("name", "ts_ns", F.round(F.col("float32_value").cast("double"), 4).alias("value"))


@registered(stale_sql("S", "metric", "seq % 3, seq", " AND NOT (seq % 3 = 1 AND seq % 5 = 0)") + " SELECT metric, ts_ns, round(value, 4) AS value FROM k")
def ingest_two_batches(spark, sf_dir):
    """Three batches of a stream, the second tried twice: stale rows and (of the second, where the id divides by 5) whole numbers are dropped; the store has what was streamed."""

    def fill(e: Engine) -> None:
        process = live.ingest(None, e.store)
        for number in (0, 1, 1, 2):
            rows = S(spark, sf_dir).where((F.col("seq") % 3 == number) & F.col("value").isNotNull()).orderBy("seq")
            whole_ = (F.lit(number) == 1) & (F.col("seq") % 5 == 0)
            typed = rows.withColumns({"int32_value": F.when(whole_, F.col("value").cast("int")), "float32_value": F.when(~whole_, F.col("value"))})
            process(typed.select(line_protocol.to_line().alias("line")), number)

    e = made(spark, sf_dir, "batches", fill)
    assert e.databases() == ["S"]
    return _rows(e.store.scan("S"), "metric", "ts_ns")


HOURS = rollup.Job("h", "S", "D", HOUR, source_pattern="*", aggregates=("sum", "count"), grace_ns=0)
ORDERS = rollup.Job("o", "O", "D", DAY, source_pattern="*", aggregates=("max",), grace_ns=0)


@registered(rollup_sql("(SELECT * FROM S WHERE value IS NOT NULL)", HOUR, ["sum", "count"], "metric", stored=True) + " UNION ALL SELECT * FROM (WITH od AS (SELECT replace(metric, ' ', '_') AS metric, ts_ns, value FROM O QUALIFY ts_ns >= coalesce(max(ts_ns) OVER (PARTITION BY metric ORDER BY ts_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ts_ns)), "
            f"ol AS (SELECT metric, max(ts_ns) AS last FROM od GROUP BY 1) SELECT metric || '.max' AS metric, CAST(b AS BIGINT) AS ts_ns, round(m, 4) AS value FROM (SELECT metric, ts_ns - ts_ns % {DAY} AS b, max(value) AS m FROM od GROUP BY 1, 2) JOIN ol USING (metric) WHERE b + {DAY} <= last)")  # fmt: skip
def backfill_two_sources(spark, sf_dir):
    """Two sources of one destination, made anew twice: both are there, once."""

    def fill(e: Engine) -> None:
        e.import_lines(lines(S(spark, sf_dir), "S"))
        in_time = O(spark, sf_dir).select(F.replace("metric", F.lit(" "), F.lit("_")).alias("metric"), "ts_ns", "value", F.col("ts_ns").alias("seq"))
        e.import_lines(lines(in_time, "O"))
        for _ in range(2):
            e.backfill(["S"], timeutil.parse_timestamp("2030-01-01"))

    e = made(spark, sf_dir, "two sources", fill, jobs=[HOURS, ORDERS], mode="year")
    return _rows(e.store.scan("D"), "metric", "ts_ns")


@registered(rollup_sql("(SELECT * FROM S WHERE value IS NOT NULL)", HOUR, BASIC, "metric", stored=True))
def rollup_engine_incremental(spark, sf_dir):
    """Rolled up after each of two imports: the second run reads from the first one's checkpoints on."""

    def fill(e: Engine) -> None:
        e.import_lines(lines(S(spark, sf_dir).where(F.col("ts_ns") < CUT), "S"))
        e.roll_up("S", NOW)
        e.import_lines(lines(S(spark, sf_dir).where(F.col("ts_ns") >= CUT), "S"))
        e.roll_up("S", NOW)

    job = rollup.Job("h", "S", "H", HOUR, source_pattern="*", aggregates=tuple(BASIC), grace_ns=0)
    return _rows(made(spark, sf_dir, "incremental", fill, jobs=[job]).store.scan("H"), "metric", "ts_ns")


@registered("SELECT metric, ts_ns, CAST(value AS INT) AS int32_value FROM L")
def lp_file_import(spark, sf_dir):
    """Exported by partition and time to text files, and these imported."""

    def fill(e: Engine) -> None:
        rows = L(spark, sf_dir).withColumns({"int32_value": F.col("value").cast("int"), "float32_value": F.lit(None).cast("float"), "partition_key": F.lit("forever")})
        path = shared.place(spark, "lines")
        line_protocol.export_parts(rows, with_db=True).select("line").write.text(path)
        e.import_file(path)

    return made(spark, sf_dir, "files", fill, mode="year").store.scan("L").select("metric", "ts_ns", "int32_value")


@registered("SELECT seq // 10 AS body, seq, ts_ns FROM S WHERE value IS NOT NULL AND seq % 10 < 7")
def lp_bodies(spark, sf_dir):
    """Request bodies of ten lines, plain and JSON, whose eighth line is bad: the lines before it are taken."""
    rows = S(spark, sf_dir).select("seq", "ts_ns", F.when(F.col("value").isNull(), "# none").otherwise(F.when(F.col("seq") % 10 == 7, F.lit("S/m bad 1")).otherwise(F.concat(F.lit("S/m "), F.col("seq").cast("string"), F.lit("i "), F.col("ts_ns").cast("string")))).alias("line"))
    fixed = rows.withColumn("line", F.when(F.col("seq") % 10 == 7, "S/m bad 1").otherwise(F.col("line")))
    g = fixed.groupBy(F.floor(F.col("seq") / 10).alias("b")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n").alias("text"))
    body = F.when(F.col("b") % 2 == 0, F.to_json(F.struct(F.col("text").alias("lines")))).otherwise(F.col("text"))
    good = line_protocol.until_first_error(line_protocol.from_bodies(g.select(body.alias("body"))))
    return good.select(F.floor(F.col("int32_value") / 10).alias("body"), F.col("int32_value").cast("long").alias("seq"), "ts_ns")


@registered("SELECT 'S/' || metric || ' ' || 'x' AS head, ts_ns FROM S WHERE value IS NOT NULL")
def engine_export(spark, sf_dir):
    out = whole(spark, sf_dir).export("S")
    parsed = line_protocol.parse(out)
    return parsed.select(F.concat(F.col("db"), F.lit("/"), F.col("metric"), F.lit(" x")).alias("head"), "ts_ns")


@registered(long_sql("S", HOUR, ["avg", "max"], LO, HI, "metric = 'click' AND value IS NOT NULL"))
def engine_query_range(spark, sf_dir):
    rows = whole(spark, sf_dir).query_range("S/click", LO, HI, aggregate="avg,max", window="1h")
    return rows.select("metric", "aggregate", "start_ts_ns", "end_ts_ns", F.round("value", 4).alias("value"))


@registered("SELECT metric, ts_ns, round(value, 4) AS value FROM S WHERE metric = 'view' AND value IS NOT NULL QUALIFY row_number() OVER (ORDER BY ts_ns DESC, seq DESC) = 1")
def engine_query_last(spark, sf_dir):
    return _rows(whole(spark, sf_dir).query_last("S/view"), "metric", "ts_ns")


@registered(f"SELECT name, ts_ns FROM E WHERE value IS NOT NULL AND regexp_full_match(name, '[^/]*i[^/]*') AND ts_ns BETWEEN {LO} AND {HI} ORDER BY ts_ns DESC, seq DESC LIMIT 80")
def engine_events_glob(spark, sf_dir):
    return whole(spark, sf_dir).query_events("E", "*i*", LO, HI, 80, newest_first=True).select("name", "ts_ns")


@registered(f"SELECT CAST(ts_ns - ts_ns % {DAY} AS BIGINT) AS bucket_ts_ns, count(*) AS count FROM E WHERE value IS NOT NULL AND name = 'purchase' GROUP BY 1")
def engine_count_events(spark, sf_dir):
    return whole(spark, sf_dir).count_events("E", "1d", "purchase")


@registered("SELECT name, max(ts_ns) AS last_ts_ns, 'float32' AS value_type FROM E WHERE value IS NOT NULL GROUP BY 1")
def engine_event_names(spark, sf_dir):
    return whole(spark, sf_dir).event_names("E")


@registered("SELECT * FROM (VALUES ('E'), ('S')) t(db)")
def engine_databases(spark, sf_dir):
    return shared.local(spark, [(d,) for d in whole(spark, sf_dir).databases()], "db string")


@registered("SELECT strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%d') AS partition_key, count(*) AS records FROM S WHERE value IS NOT NULL AND strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%d') >= '2024-01-05' GROUP BY 1")
def engine_maintenance(spark, sf_dir):
    """Two imports, one partition rewritten, some staged and sealed, those before the fifth archived, and one of them read from the archive as a check."""

    def fill(e: Engine) -> None:
        two = S(spark, sf_dir).where("value IS NOT NULL").withColumns({"value_type": F.lit("float32"), "int32_value": F.lit(None).cast("int"), "float32_value": F.col("value")})
        e.store.write("S", two.where("seq % 2 = 0"))
        e.store.stage("S", two.where("seq % 2 = 1"))
        e.store.seal("S")
        for key in e.store.partitions("S")[5:8]:
            e.compact("S", key)
        now = timeutil.parse_timestamp("2024-02-04 10:00:00")
        done = e.retain("S", 30, "archive", now)
        held = e.store.archived("S", "2024-01").count()
        assert held == two.where(F.col("ts_ns") < timeutil.parse_timestamp("2024-01-05")).count() and done["expired"]

    return made(spark, sf_dir, "maintained", fill).stats("S").select("partition_key", "records")


@registered("SELECT count(*) AS records, min(ts_ns) AS min_ts_ns, max(ts_ns) AS max_ts_ns, false AS damaged FROM S WHERE value IS NOT NULL")
def engine_inspect(spark, sf_dir):
    return whole(spark, sf_dir).inspect("S").where("file IS NULL").select("records", "min_ts_ns", "max_ts_ns", "damaged")


@registered("SELECT metric, ts_ns, seq, which FROM (SELECT *, 'head' AS which FROM S ORDER BY ts_ns, seq LIMIT 50) UNION ALL SELECT metric, ts_ns, seq, which FROM (SELECT *, 'tail' AS which FROM S ORDER BY ts_ns DESC, seq DESC LIMIT 50)")
def preview(spark, sf_dir):
    return ranges.preview(S(spark, sf_dir), 50).select("metric", "ts_ns", "seq", "which")


@registered("SELECT metric, ts_ns / 1e9 AS t, CAST(round(value, 3) AS VARCHAR) IS NOT NULL AS shown FROM S WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY metric ORDER BY ts_ns DESC, seq DESC) = 1")
def result_vector(spark, sf_dir):
    rows = results.vector(ranges.latest(S(spark, sf_dir).where("value IS NOT NULL")))
    return rows.select("metric", F.col("value.t").alias("t"), (F.length("value.v") > 0).alias("shown"))


@registered(f"SELECT metric, count(*) AS points, min((ts_ns - ts_ns % {DAY} + {DAY}) / 1e9) AS first, max((ts_ns - ts_ns % {DAY} + {DAY}) / 1e9) AS last FROM (SELECT DISTINCT metric, ts_ns - ts_ns % {DAY} AS ts_ns FROM S WHERE value IS NOT NULL) GROUP BY 1")
def result_matrix(spark, sf_dir):
    from .operators import windows

    rows = results.matrix(windows.window_aggregate(S(spark, sf_dir).where("value IS NOT NULL"), DAY, ["avg"]))
    return rows.select("metric", F.size("values").cast("long").alias("points"), F.element_at("values", 1)["t"].alias("first"), F.element_at("values", -1)["t"].alias("last"))


@registered("SELECT nth, line FROM (SELECT row_number() OVER (ORDER BY metric) AS nth, metric || chr(9) || CAST(count(*) AS VARCHAR) AS line FROM S GROUP BY metric) UNION ALL SELECT 0, 'metric' || chr(9) || 'n' UNION ALL SELECT 1 + count(DISTINCT metric), '(' || count(DISTINCT metric) || ' rows)' FROM S")
def result_report(spark, sf_dir):
    text = results.report(S(spark, sf_dir).groupBy("metric").agg(F.count("*").alias("n")).orderBy("metric"))
    return shared.local(spark, [(i, x.split(" in ")[0] + ")" if x.startswith("(") else x) for i, x in enumerate(text.splitlines())], "nth bigint, line string")


@registered("SELECT name, id, count(*) AS n FROM E JOIN (SELECT name AS cname, CAST(row_number() OVER (ORDER BY min(seq), name) AS INT) AS id FROM E GROUP BY name) ON name = cname GROUP BY 1, 2")
def events_by_id(spark, sf_dir):
    """Events that carry ids only, resolved by the catalog."""
    events = E(spark, sf_dir)
    known = filters.catalog_ids(events, "name")
    coded = events.join(known.select(F.col("name").alias("cname"), "id"), F.col("name") == F.col("cname")).select("db", "id", "ts_ns", "seq")
    return ev.resolved(coded, known).groupBy(F.col("resolved_name").alias("name"), "id").agg(F.count("*").alias("n"))


@registered("SELECT db, n FROM (SELECT 'S' AS db, count(DISTINCT seq) AS n FROM S) WHERE n > 65535")
def over_capacity(spark, sf_dir):
    """Databases whose names are more than a catalog holds; here every id is a name."""
    return filters.over_capacity(S(spark, sf_dir).withColumn("metric", F.col("seq").cast("string")))


@registered("SELECT seq, seq % 4 <> 3 AS valid_db, seq % 4 <> 2 AS valid_metric FROM S")
def valid_names(spark, sf_dir):
    db = F.when(F.col("seq") % 4 == 3, "-bad").otherwise(F.concat(F.lit("d."), F.col("metric")))
    metric = F.when(F.col("seq") % 4 == 2, "a/b").otherwise(F.concat(F.col("metric"), F.lit(" ü")))
    return S(spark, sf_dir).select("seq", names.valid_database(db).alias("valid_db"), names.valid_metric(metric).alias("valid_metric"))


MANIFEST = {"enabled": True, "default_interval": "6h", "default_aggregates": ["SUM", " max "], "default_grace": "0s", "destination_db": "M", "exclude_patterns": ["v*"], "jobs": [{"id": "p", "source_pattern": "*"}, {"id": "q", "source_metric": "view", "interval": "1d", "aggregates": ["count"]}, {"id": "off", "enabled": False}]}


@registered(rollup_sql("(SELECT * FROM S WHERE value IS NOT NULL)", 6 * HOUR, ["sum", "max"], "metric", "NOT regexp_full_match(metric, 'v[^/]*')"))
def rollup_manifest(spark, sf_dir):
    """Jobs as a manifest has them: defaults are inherited, and its exclusions hold for a job of one metric too."""
    jobs = rollup.from_manifest("S", json.loads(json.dumps(MANIFEST)))
    made_ = rollup.backfill({"S": S(spark, sf_dir).where("value IS NOT NULL")}, jobs, NOW)
    return made_["M"].select("metric", "ts_ns", F.round("value", 4).alias("value"))


@registered("SELECT name, ts_ns, seq FROM (SELECT CASE seq % 3 WHEN 0 THEN 'engine.db.created' WHEN 1 THEN 'engine.wal.reset' ELSE 'engine.db.deleted' END AS name, ts_ns, seq, CASE WHEN seq % 5 = 0 THEN 'internal' ELSE 'S' END AS source_db FROM E) WHERE name LIKE 'engine.db.%' AND source_db <> 'internal'")
def events_emitted(spark, sf_dir):
    """Events of groups that are on (the log's group is off unless asked for), without those about the database they go to."""
    name = F.when(F.col("seq") % 3 == 0, "engine.db.created").when(F.col("seq") % 3 == 1, "engine.wal.reset").otherwise("engine.db.deleted")
    rows = E(spark, sf_dir).withColumn("name", name).withColumn("source_db", F.when(F.col("seq") % 5 == 0, "internal").otherwise("S"))
    return registry.emitted(rows, registry.registry(spark), registry.groups()).select("name", "ts_ns", "seq")


@registered("SELECT metric, ts_ns, CASE WHEN 2 * value - 1 >= 150 THEN 'critical' WHEN 2 * value - 1 >= 100 THEN 'warning' ELSE 'normal' END AS severity FROM S WHERE metric = 'click' AND value IS NOT NULL QUALIFY row_number() OVER (ORDER BY ts_ns DESC, seq DESC) = 1")
def widget_number(spark, sf_dir):
    rows = S(spark, sf_dir).where("value IS NOT NULL")
    n = dashboard.number(rows, {"query": "S/click", "transform": {"factor": 2, "offset": -1}, "thresholds": {"warning": 100, "critical": 150}})
    return n.select("metric", "ts_ns", "severity")


@registered(f", c AS (SELECT least(ts_ns - ts_ns % {HOUR} + {HOUR}, {HI}) AS t, avg(value) AS v FROM S WHERE metric = 'click' AND ts_ns BETWEEN {LO} AND {HI} GROUP BY 1), m AS (SELECT least(ts_ns - ts_ns % {2 * HOUR} + {2 * HOUR}, {HI}) AS t, max(value) * 10 AS v FROM S WHERE metric = 'view' AND ts_ns BETWEEN {LO} AND {HI} GROUP BY 1) SELECT CAST(coalesce(c.t, m.t) AS BIGINT) AS ts_ns, round(c.v, 4) AS a, round(m.v, 4) AS b FROM c FULL JOIN m ON c.t = m.t WHERE coalesce(c.v, m.v) IS NOT NULL")
def widget_line_chart(spark, sf_dir):
    series = [{"query": "S/click", "label": "a", "interval": "1h"}, {"query": "S/view", "label": "b", "aggregate": "max", "window": "2h", "transform": {"factor": 10}}]
    chart = dashboard.line_chart(S(spark, sf_dir, LO, HI).where("value IS NOT NULL"), series, LO, HI)
    return chart.select("ts_ns", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


@registered(f"SELECT CAST(x // {HOUR} * {HOUR} AS BIGINT) AS step_ts_ns, arg_max(value, seq) AS value FROM (SELECT (seq - 5000) * 1234567890123 AS x, seq, value FROM S WHERE value IS NOT NULL) GROUP BY 1")
def step_before_1970(spark, sf_dir):
    """Steps truncate towards 1970, as windows do: the step of 0 is twice as wide."""
    x = (F.col("seq") - 5000) * F.lit(1234567890123).cast("long")
    rows = S(spark, sf_dir).where("value IS NOT NULL").withColumn("metric", F.lit("m")).withColumn("ts_ns", x)
    return ranges.last_per_step(rows, HOUR).select("step_ts_ns", F.col("value").cast("double").alias("value"))


@registered(", spans AS (SELECT seq, (seq * 137) % 100000 AS d FROM E) SELECT seq, CASE seq % 3 WHEN 0 THEN d * 1000000000 WHEN 1 THEN d * 60000000000 ELSE d * 3600000000000 + 30 * 60000000000 END AS ns FROM spans")
def durations(spark, sf_dir):
    """Durations in seconds, minutes, and hours with minutes, read in a column."""
    d = ((F.col("seq") * 137) % 100_000).cast("string")
    text = F.when(F.col("seq") % 3 == 0, F.concat(d, F.lit("s"))).when(F.col("seq") % 3 == 1, F.concat(d, F.lit("m"))).otherwise(F.concat(d, F.lit("h30m")))
    return E(spark, sf_dir).select("seq", timeutil.duration_column(text).alias("ns"))


@registered("SELECT DISTINCT metric AS query, 'Series ' || CAST(row_number() OVER (ORDER BY metric) AS VARCHAR) AS label FROM S GROUP BY metric")
def series_labels(spark, sf_dir):
    found = [r["metric"] for r in S(spark, sf_dir).select("metric").distinct().orderBy("metric").collect()]
    return shared.local(spark, [(m, display.series_label({}, i)) for i, m in enumerate(found)], "query string, label string")


@registered(f"SELECT strftime(make_timestamp(ts_ns // 1000), '%Y-%m') AS partition_key, count(*) AS records FROM O WHERE strftime(make_timestamp(ts_ns // 1000), '%Y-%m') || '-01' >= '1997-01-01' GROUP BY 1")
def retained(spark, sf_dir):
    rows = retention.retained(O(spark, sf_dir), timeutil.parse_timestamp("1998-01-01 05:00:00"), 365, "month")
    return rows.groupBy("partition_key").agg(F.count("*").alias("records"))


