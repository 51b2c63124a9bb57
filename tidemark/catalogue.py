"""The registered queries of the engine's operators over the given tables, and the SQL each is compared with.

Views: S and E are events as samples and as events, L is lineitem and O is orders as samples.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import aggregates, display, names, timeutil, values
from .operators import events as ev
from .operators import filters, lineage, ranges, rates, registry, retention, rollup, windows
from .plans import dashboard, results
from .sources import csv_rules, json_events, line_protocol, tables, topics

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

NS = timeutil.NS
HOUR, DAY = 3_600 * NS, timeutil.DAY_NS
#: A range whose ends are no window's.
LO, HI = timeutil.parse_timestamp("2024-01-03 05:17:31"), timeutil.parse_timestamp("2024-01-20 18:42:05")
NOW = timeutil.parse_timestamp("2024-01-31")

VIEWS = """
S AS (SELECT event_type AS metric, epoch_us(ts) * 1000 AS ts_ns, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value, event_id AS seq FROM events),
E AS (SELECT event_type AS name, epoch_us(ts) * 1000 AS ts_ns, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value, props AS payload, event_id AS seq FROM events),
L AS (SELECT l_returnflag || '.' || l_linestatus AS metric, epoch_us(l_shipdate) * 1000 AS ts_ns, CAST(CAST(l_quantity AS FLOAT) AS DOUBLE) AS value,
             l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4 FROM lineitem),
O AS (SELECT o_orderpriority AS metric, epoch_us(o_orderdate) * 1000 AS ts_ns, CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE) AS value, o_orderkey AS seq FROM orders)
"""


def registered(sql: str | None):
    """Register a query under its function's name, with what follows the views in its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"WITH {VIEWS.strip()}{sql if sql.lstrip().startswith(',') else ' ' + sql}"
        return f

    return add


S, E, L, O = tables.event_samples, tables.events, tables.line_samples, tables.order_samples  # noqa: E741
TEXT_TIME = "strftime(make_timestamp({0} // 1000), '%Y-%m-%d %H:%M:%S') || '.' || lpad(CAST({0} % 1000000000 AS VARCHAR), 9, '0')"
TRIM = "CASE WHEN 2 * (CASE WHEN n >= 20 THEN n // 20 ELSE 1 END) >= n THEN 0 WHEN n >= 20 THEN n // 20 ELSE 1 END"
AGG_SQL = {
    "min": "min(value)", "max": "max(value)", "sum": "sum(value)", "avg": "avg(value)", "count": "CAST(count(*) AS DOUBLE)", "median": "quantile_cont(value, 0.5)", "p50": "quantile_cont(value, 0.5)",
    "p95": "quantile_cont(value, 0.95)", "p99": "quantile_cont(value, 0.99)", "trimmed_avg": f"avg(value) FILTER (rn > {TRIM} AND rn <= n - ({TRIM}))",
}
AGG_SQL["trimmed_average"] = AGG_SQL["trimmed_avg"]


def long_sql(view: str, width: int, wanted: list[str], lo: int | None = None, hi: int | None = None, where: str = "true") -> str:
    """Windows of a view as SQL: metric, aggregate, start_ts_ns, end_ts_ns, value rounded to 4 places."""
    where += f" AND ts_ns >= {lo}" * (lo is not None) + f" AND ts_ns <= {hi}" * (hi is not None)
    start = f"greatest(b, {lo})" if lo is not None else "b"
    end = f"least(b + {width}, {hi})" if hi is not None else f"b + {width}"
    listed = ", ".join(f"{AGG_SQL[a]} AS a_{a}" for a in wanted)
    rows = " UNION ALL ".join(f"SELECT metric, '{a}' AS aggregate, CAST({start} AS BIGINT) AS start_ts_ns, CAST({end} AS BIGINT) AS end_ts_ns, round(a_{a}, 4) AS value FROM g" for a in wanted)
    ranked = f"SELECT *, ts_ns - ts_ns % {width} AS b, row_number() OVER (PARTITION BY metric, ts_ns - ts_ns % {width} ORDER BY value) AS rn, count(*) OVER (PARTITION BY metric, ts_ns - ts_ns % {width}) AS n FROM {view} WHERE {where}"
    if not any(a.startswith("trim") for a in wanted):
        ranked = f"SELECT *, ts_ns - ts_ns % {width} AS b FROM {view} WHERE {where}"
    return f", w AS ({ranked}), g AS (SELECT metric, b, {listed} FROM w GROUP BY metric, b{', n' if any(a.startswith('trim') for a in wanted) else ''}) {rows}"


def rounded(rows: DataFrame) -> DataFrame:
    return rows.select("metric", "aggregate", "start_ts_ns", "end_ts_ns", F.round("value", 4).alias("value"))


BASIC = ["min", "max", "sum", "avg", "count"]


@registered(long_sql("S", HOUR, BASIC))
def window_basic(spark, sf_dir):
    return rounded(windows.window_aggregate(S(spark, sf_dir), HOUR, BASIC))


@registered(long_sql("S", HOUR, ["min", "max", "avg", "count"], LO, HI))
def window_clipped(spark, sf_dir):
    return rounded(windows.window_aggregate(S(spark, sf_dir, LO, HI), HOUR, ["min", "max", "avg", "count"], LO, HI))


@registered(long_sql("S", 6 * HOUR, ["median", "p50", "p95", "p99"]))
def window_percentiles(spark, sf_dir):
    return rounded(windows.window_aggregate(S(spark, sf_dir), 6 * HOUR, ["median", "p50", "p95", "p99"]))


@registered(long_sql("S", HOUR, ["trimmed_avg"]))
def window_trimmed(spark, sf_dir):
    return rounded(windows.window_aggregate(S(spark, sf_dir), HOUR, ["trimmed_avg"]))


@registered(long_sql("L", 30 * DAY, ["trimmed_avg", "sum", "count"]))
def window_trimmed_large(spark, sf_dir):
    return rounded(windows.window_aggregate(L(spark, sf_dir), 30 * DAY, ["trimmed_avg", "sum", "count"]))


@registered(long_sql("L", 90 * DAY, ["median", "p95", "p99", "trimmed_avg", "avg", "min", "max", "count"]))
def window_quantiles_large(spark, sf_dir):
    return rounded(windows.window_aggregate(L(spark, sf_dir), 90 * DAY, ["median", "p95", "p99", "trimmed_avg", "avg", "min", "max", "count"]))


@registered(long_sql("S", 7 * DAY, ["p50", "p95", "trimmed_avg"]))
def window_quantiles_week(spark, sf_dir):
    return rounded(windows.window_aggregate(S(spark, sf_dir), 7 * DAY, ["p50", "p95", "trimmed_avg"]))


@registered(long_sql("S", DAY, ["trimmed_average", "avg"]))
def window_alias(spark, sf_dir):
    return rounded(windows.window_aggregate(S(spark, sf_dir), DAY, " trimmed_average, ,avg,trimmed_average"))


@registered(long_sql("S", 7 * DAY, ["avg", "count"]))
def window_week(spark, sf_dir):
    return rounded(windows.window_aggregate(S(spark, sf_dir), timeutil.parse_duration("1w"), ["avg", "count"]))


@registered(long_sql("S", 15 * 60 * NS, ["avg"], LO, HI))
def step_avg(spark, sf_dir):
    return rounded(windows.step_query(S(spark, sf_dir, LO, HI), timeutil.parse_duration("15m"), LO, HI))


@registered(f"SELECT metric, CAST(ts_ns - ts_ns % {HOUR} AS BIGINT) AS step_ts_ns, round(arg_max(value, seq), 4) AS value FROM S GROUP BY 1, 2")
def step_last(spark, sf_dir):
    return ranges.last_per_step(S(spark, sf_dir), HOUR).select("metric", "step_ts_ns", F.round(F.col("value").cast("double"), 4).alias("value"))


@registered(f"SELECT metric, CAST(ts_ns - ts_ns % {6 * HOUR} AS BIGINT) AS start_ts_ns, round(avg(value), 4) AS avg, round(min(value), 4) AS min, round(max(value), 4) AS max FROM S GROUP BY 1, 2")
def band(spark, sf_dir):
    return windows.band(S(spark, sf_dir), 6 * HOUR).select("metric", "start_ts_ns", *[F.round(c, 4).alias(c) for c in ("avg", "min", "max")])


@registered(f"SELECT metric, ts_ns, round(value, 4) AS value, seq FROM S WHERE metric IN ('click', 'nothing') AND ts_ns BETWEEN {LO} AND {HI}")
def range_inclusive(spark, sf_dir):
    return ranges.read_range(S(spark, sf_dir, LO, HI), ["click", "nothing"], LO, HI).select("metric", "ts_ns", F.round(F.col("value").cast("double"), 4).alias("value"), "seq")


@registered(f"SELECT metric, ts_ns, round(value, 4) AS value, seq FROM S WHERE metric IN ('click', 'view', 'error') AND ts_ns BETWEEN {LO} AND {HI}")
def range_many(spark, sf_dir):
    return ranges.read_range(S(spark, sf_dir, LO, HI), ["click", "view", "error"], LO, HI).select("metric", "ts_ns", F.round(F.col("value").cast("double"), 4).alias("value"), "seq")


@registered("SELECT metric, ts_ns, value, k1, k2, k3, k4 FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY ts_ns, k1, k2, k3, k4) - 1 AS nth FROM L) WHERE nth % 7 = 0")
def stride_n(spark, sf_dir):
    rows = ranges.strided(L(spark, sf_dir), 7)
    keys = [F.col(f"seq.{c}").alias(f"k{i}") for i, c in enumerate(("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), 1)]
    return rows.select("metric", "ts_ns", F.col("value").cast("double").alias("value"), *keys)


LATEST = "SELECT metric, ts_ns, round(value, 4) AS value, seq FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY ts_ns DESC, seq DESC) AS nth FROM {0}) WHERE nth = 1"


def _latest(rows: DataFrame) -> DataFrame:
    return rows.select("metric", "ts_ns", F.round(F.col("value").cast("double"), 4).alias("value"), "seq")


@registered(LATEST.format("O") + " AND metric = '1-URGENT'")
def latest(spark, sf_dir):
    return _latest(ranges.latest(filters.named(O(spark, sf_dir), "1-URGENT")))


@registered(LATEST.format("S") + " AND regexp_matches(metric, 'i')")
def latest_all(spark, sf_dir):
    return _latest(ranges.latest_matching(S(spark, sf_dir), "i"))


@registered(long_sql("S", DAY, ["avg", "max"]).replace("SELECT metric, 'avg'", "SELECT * FROM (SELECT metric, 'avg'", 1) + ") QUALIFY row_number() OVER (PARTITION BY metric, aggregate ORDER BY start_ts_ns DESC) = 1")
def latest_windowed(spark, sf_dir):
    return rounded(windows.latest_window(S(spark, sf_dir), DAY, ["avg", "max"]))


@registered("SELECT metric, count(*) AS n FROM S WHERE regexp_matches(metric, '^(cl|pur)|up$') GROUP BY 1")
def regex_filter(spark, sf_dir):
    return S(spark, sf_dir).where(F.col("metric").rlike("^(cl|pur)|up$")).groupBy("metric").agg(F.count("*").alias("n"))


@registered("SELECT name, count(*) AS n FROM E WHERE regexp_full_match(name, '[^/]*i[^/][^/]*[kn]?[^/]*') GROUP BY 1")
def glob_filter(spark, sf_dir):
    return ev.select(E(spark, sf_dir), "*i?*").groupBy("name").agg(F.count("*").alias("n"))


@registered("SELECT metric, count(*) AS n FROM S WHERE regexp_full_match(metric, '[^/]*') AND NOT regexp_full_match(metric, 'e[^/]*') AND NOT regexp_full_match(metric, '[^/]*[a-c]lick') GROUP BY 1")
def glob_exclude(spark, sf_dir):
    return S(spark, sf_dir).where(names.glob_select(F.col("metric"), "*", ["e*", "*[a-c]lick"])).groupBy("metric").agg(F.count("*").alias("n"))


def as_int(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"int32_value": F.col("value").cast("int"), "float32_value": F.lit(None).cast("float"), "partition_key": F.lit("forever")})


def _partitions(mode: str, fmt: str):
    key = f"strftime(make_timestamp(ts_ns // 1000), '{fmt}')" if fmt else "'forever'"

    def query(spark, sf_dir):
        return retention.partition_stats(L(spark, sf_dir), mode)

    query.__name__ = f"partition_counts_{mode}"
    registered(f"SELECT {key} AS partition_key, count(*) AS records, min(ts_ns) AS min_ts_ns, max(ts_ns) AS max_ts_ns FROM L GROUP BY 1")(query)


for _mode, _fmt in (("day", "%Y-%m-%d"), ("month", "%Y-%m"), ("year", "%Y"), ("forever", "")):
    _partitions(_mode, _fmt)


@registered("SELECT metric, ts_ns, seq FROM (SELECT *, max(ts_ns) OVER (PARTITION BY metric ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM O) WHERE newest IS NULL OR ts_ns >= newest")
def stale_reject(spark, sf_dir):
    return filters.not_stale(O(spark, sf_dir)).select("metric", "ts_ns", "seq")


@registered("SELECT name, seq FROM (SELECT *, max(ts_ns) OVER (PARTITION BY name ORDER BY hash_seq, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM (SELECT *, seq % 97 AS hash_seq FROM E)) WHERE newest IS NULL OR ts_ns >= newest")
def stale_events(spark, sf_dir):
    rows = E(spark, sf_dir).withColumn("arrival", F.struct(F.col("seq") % 97, "seq"))
    return filters.not_stale(rows, ("db", "name"), "arrival").select("name", "seq")


@registered(", t AS (SELECT *, CASE WHEN seq % 3 = 0 THEN 'int32' ELSE 'float32' END AS value_type FROM S), f AS (SELECT metric, arg_min(value_type, seq) AS pinned_type FROM t GROUP BY 1) SELECT t.metric, f.pinned_type, count(*) FILTER (t.value_type = f.pinned_type) AS accepted, count(*) FILTER (t.value_type <> f.pinned_type) AS rejected FROM t JOIN f ON t.metric = f.metric GROUP BY 1, 2")
def type_pinning(spark, sf_dir):
    rows = S(spark, sf_dir).withColumn("value_type", F.when(F.col("seq") % 3 == 0, "int32").otherwise("float32"))
    p = filters.pinned(rows)
    return p.groupBy("metric", "pinned_type").agg(F.sum(F.col("accepted").cast("long")).alias("accepted"), F.sum((~F.col("accepted")).cast("long")).alias("rejected"))


@registered(f"SELECT name, CAST(ts_ns - ts_ns % {3 * HOUR} AS BIGINT) AS bucket_ts_ns, count(*) AS count FROM E WHERE ts_ns BETWEEN {LO} AND {HI} GROUP BY 1, 2")
def events_count(spark, sf_dir):
    return windows.event_counts(E(spark, sf_dir, LO, HI), 3 * HOUR, LO, HI, ["name"])


@registered(f"SELECT seq - 5000 AS seq, CAST(x - ((x % {HOUR}) + {HOUR}) % {HOUR} AS BIGINT) AS event_bucket, CAST((x // {HOUR}) * {HOUR} AS BIGINT) AS metric_bucket FROM (SELECT seq, (seq - 5000) * 1234567890123 AS x FROM E)")
def buckets_before_1970(spark, sf_dir):
    x = (F.col("seq") - 5000) * F.lit(1234567890123).cast("long")
    return E(spark, sf_dir).select((F.col("seq") - 5000).alias("seq"), windows.event_bucket(x, HOUR).alias("event_bucket"), windows.bucket(x, HOUR).alias("metric_bucket"))


@registered("SELECT name, ts_ns, seq FROM E ORDER BY ts_ns DESC, seq DESC LIMIT 100")
def events_latest_n(spark, sf_dir):
    return ev.newest(E(spark, sf_dir)).select("name", "ts_ns", "seq")


@registered("SELECT name, ts_ns, seq FROM E ORDER BY strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%d'), seq LIMIT 250")
def events_storage_n(spark, sf_dir):
    return ev.stored(filters.with_partition(E(spark, sf_dir)), 250).select("name", "ts_ns", "seq")


@registered(", a AS (SELECT 0 AS series, name, ts_ns, seq FROM E WHERE name = 'click' ORDER BY ts_ns, seq LIMIT 10), b AS (SELECT 1 AS series, name, ts_ns, seq FROM E WHERE regexp_full_match(name, '[^/]*r[^/]*') ORDER BY ts_ns, seq LIMIT 10) SELECT * FROM a UNION ALL SELECT * FROM b")
def events_log_merge(spark, sf_dir):
    return dashboard.event_log(E(spark, sf_dir), ["click", "*r*"]).select("series", "name", "ts_ns", "seq")


@registered("SELECT name, CASE WHEN arg_min(coalesce(value, -1), seq) < 0 THEN 'none' ELSE 'float32' END AS value_type, max(ts_ns) AS last_ts_ns FROM E GROUP BY 1")
def event_catalog(spark, sf_dir):
    return ev.catalog(E(spark, sf_dir))


@registered("SELECT metric AS name, CAST(row_number() OVER (ORDER BY min(seq), metric) AS INT) AS id, max(ts_ns) AS last_ts_ns FROM S GROUP BY 1")
def metric_catalog(spark, sf_dir):
    rows = S(spark, sf_dir).withColumn("value_type", F.lit("float32"))
    return filters.catalog_ids(rows).select("name", "id", "last_ts_ns")


@registered("SELECT DISTINCT db FROM (SELECT 'L' AS db FROM L UNION ALL SELECT 'O' FROM O UNION ALL SELECT 'S' FROM S)")
def databases(spark, sf_dir):
    rows = S(spark, sf_dir).select("db").union(L(spark, sf_dir).select("db")).union(O(spark, sf_dir).select("db")).union(spark.range(1).select(F.lit(names.INTERNAL)))
    return rows.distinct().where(F.col("db") != names.INTERNAL)


@registered("SELECT name, ts_ns / 1e9 AS x, round(value * 1.8 + 32, 4) AS y, seq FROM E WHERE name = 'purchase' AND value IS NOT NULL ORDER BY ts_ns, seq LIMIT 1000")
def event_numeric_points(spark, sf_dir):
    return dashboard.event_series(E(spark, sf_dir), "purchase", 1.8, 32.0).select(F.lit("purchase").alias("name"), "x", F.round("y", 4).alias("y"), "seq")


@registered(f"SELECT name, ts_ns, seq FROM E WHERE ts_ns BETWEEN {LO} AND {HI} ORDER BY ts_ns, seq LIMIT 200")
def event_overlay(spark, sf_dir):
    return ev.overlay(ev.select(E(spark, sf_dir, LO, HI), None, LO, HI))


@registered("SELECT name, CAST(json_extract_string(payload, '$.k') AS BIGINT) AS k, count(*) AS n FROM E GROUP BY 1, 2")
def payload_json(spark, sf_dir):
    k = F.get_json_object(values.compact_payload(F.col("payload")), "$.k").cast("long")
    return E(spark, sf_dir).groupBy("name", k.alias("k")).agg(F.count("*").alias("n"))


@registered("SELECT name, count(*) FILTER (strlen(payload) <= 9) AS fits, count(*) FILTER (strlen(payload) > 9) AS too_large FROM E GROUP BY 1")
def payload_cap(spark, sf_dir):
    fits = filters.payload_fits(F.col("payload"), 9)
    return E(spark, sf_dir).groupBy("name").agg(F.count_if(fits).alias("fits"), F.count_if(~fits).alias("too_large"))


@registered(f"SELECT 'L/' || metric || ' ' || CAST(CAST(value AS INT) AS VARCHAR) || 'i ' || {TEXT_TIME.format('ts_ns')} AS line FROM L")
def lp_export(spark, sf_dir):
    return line_protocol.export(as_int(L(spark, sf_dir)))


@registered("SELECT metric, ts_ns, CAST(value AS INT) AS int32_value, 'int32' AS value_type, CAST(NULL AS VARCHAR) AS error FROM L")
def lp_parse_roundtrip(spark, sf_dir):
    lines = as_int(L(spark, sf_dir)).select(line_protocol.to_line().alias("line"))
    return line_protocol.parse(lines).select("metric", "ts_ns", "int32_value", "value_type", "error")


@registered("SELECT seq, CASE WHEN seq % 5 = 0 THEN 'float32' WHEN seq % 5 = 1 THEN 'int32' WHEN seq % 5 = 2 THEN NULL WHEN seq % 5 = 3 THEN 'float32' ELSE NULL END AS value_type, CASE seq % 5 WHEN 2 THEN 'invalid value' WHEN 4 THEN 'missing value' END AS error FROM S")
def lp_errors(spark, sf_dir):
    n = F.col("seq").cast("string")
    tail = F.when(F.col("seq") % 5 == 0, F.concat(n, F.lit(".5 "), n)).when(F.col("seq") % 5 == 1, F.concat(n, F.lit("i 2024-01-01 00:00:00.5"))).when(F.col("seq") % 5 == 2, "9999999999i 1").when(F.col("seq") % 5 == 3, "1e3 2024-01-01").otherwise("")
    lines = S(spark, sf_dir).select("seq", F.concat(F.lit("S/"), F.col("metric"), F.lit(" "), tail).alias("line"))
    return line_protocol.parse(lines, default_ts=0).select("seq", "value_type", "error")


def _event_json(events):
    value = F.when(F.col("seq") % 3 == 0, "null").when(F.col("seq") % 3 == 1, F.col("seq").cast("string")).otherwise(F.concat(F.col("seq").cast("string"), F.lit(".5")))
    body = F.concat(F.lit('[{"db":"E","name":"'), F.col("name"), F.lit('","ts":'), F.col("ts_ns").cast("string"), F.lit(',"value":'), value, F.lit(',"payload":'), F.col("payload"), F.lit("}]"))
    rows = json_events.parse(json_events.objects(events.select(body.alias("body"))))
    v = F.coalesce(F.col("int32_value").cast("double"), F.col("float32_value").cast("double"))
    return rows.select("name", "ts_ns", "value_type", v.alias("value"), F.get_json_object(F.col("payload").cast("string"), "$.k").cast("long").alias("k"))


@registered("SELECT name, ts_ns, value_type, v AS value, CAST(json_extract_string(payload, '$.k') AS BIGINT) AS k FROM (SELECT *, CASE WHEN seq % 3 = 0 THEN 'none' WHEN seq % 3 = 1 THEN 'int32' ELSE 'float32' END AS value_type, CASE WHEN seq % 3 = 1 THEN CAST(seq AS DOUBLE) WHEN seq % 3 = 2 THEN seq + 0.5 END AS v FROM E)")
def event_json(spark, sf_dir):
    return _event_json(E(spark, sf_dir))


@registered("SELECT 'plant' AS db, name || '/' || CAST(seq % 4 AS VARCHAR) AS metric, ts_ns, CASE WHEN seq % 2 = 0 THEN 'int32' ELSE 'float32' END AS value_type, CAST(seq + (seq % 2) * 0.25 AS DOUBLE) AS value FROM E WHERE name <> 'view'")
def topic_metrics(spark, sf_dir):
    number = F.when(F.col("seq") % 2 == 0, F.concat(F.col("seq").cast("string"), F.lit(".0"))).otherwise(F.concat(F.col("seq").cast("string"), F.lit(".25")))
    topic = F.concat(F.when(F.col("name") == "view", "other/").otherwise("site/plant/"), F.col("name"), F.lit("/"), (F.col("seq") % 4).cast("string"))
    body = F.concat(F.lit('{"value":'), number, F.lit(',"ts_ns":'), F.col("ts_ns").cast("string"), F.lit("}"))
    messages = topics.select(E(spark, sf_dir).select(topic.alias("topic"), body.alias("body")), "site/+/#")
    return topics.metrics(messages).select("db", "metric", "ts_ns", "value_type", F.col("value").cast("double").alias("value"))


@registered(f"SELECT 'temp.' || name AS metric, ts_ns // 1000000 * 1000000 AS ts_ns, 'D/temp.' || name || ' ' || CAST(CAST(round(seq * 10.0) AS BIGINT) AS VARCHAR) || 'i ' || CAST(ts_ns // 1000000 * 1000000 AS VARCHAR) AS line FROM E WHERE name <> 'error'")
def csv_rules_convert(spark, sf_dir):
    rows = E(spark, sf_dir).select(F.concat(F.lit("in/"), F.col("name"), F.lit(".csv")).alias("file"), F.col("seq").alias("line_no"), F.lit("ignored").alias("metric"), F.concat(F.lit(" "), F.col("name"), F.lit("!")).alias("sensor"), F.col("seq").cast("string").alias("raw"), F.call_function("div", F.col("ts_ns"), F.lit(1_000_000).cast("long")).alias("ts_ms"))
    kinds = ("click", "error", "purchase", "signup", "view")
    rules = spark.createDataFrame([(f"in/{k}.csv", k != "error", "temp", "int", 10.0, True) for k in kinds], csv_rules.RULES)
    return csv_rules.convert(rows, rules, "D").select("metric", "ts_ns", "line")


@registered("SELECT ts_ns, round(arg_max(value, seq) FILTER (metric = '1-URGENT'), 4) AS urgent, round(arg_max(value, seq) FILTER (metric = '5-LOW'), 4) AS low FROM O WHERE metric IN ('1-URGENT', '5-LOW') GROUP BY 1")
def align_series(spark, sf_dir):
    rows = filters.named(O(spark, sf_dir), ["1-URGENT", "5-LOW"])
    a = ranges.aligned(rows, ["1-URGENT", "5-LOW"])
    return a.select("ts_ns", F.round(F.col("`1-URGENT`").cast("double"), 4).alias("urgent"), F.round(F.col("`5-LOW`").cast("double"), 4).alias("low"))


@registered("SELECT seq, round(value * 0.5 - 3, 6) AS shown, CASE WHEN value * 0.5 - 3 >= 40 THEN 'critical' WHEN value * 0.5 - 3 >= 20 THEN 'warning' ELSE 'normal' END AS above, CASE WHEN value * 0.5 - 3 <= 0 THEN 'critical' WHEN value * 0.5 - 3 <= 5 THEN 'warning' ELSE 'normal' END AS below FROM S WHERE value IS NOT NULL")
def transform_severity(spark, sf_dir):
    rows = S(spark, sf_dir).where("value IS NOT NULL").withColumn("shown", display.transform(F.col("value"), 0.5, -3.0))
    return rows.select("seq", F.round("shown", 6).alias("shown"), display.severity(F.col("shown"), 20, 40).alias("above"), display.severity(F.col("shown"), 5, 0, "below").alias("below"))


@registered(", t AS (SELECT seq, seq * 37 AS n FROM S) SELECT seq, CASE WHEN n >= 86400 THEN (n // 86400) || 'd ' || (n % 86400 // 3600) || 'h ' || (n % 3600 // 60) || 'm' WHEN n >= 3600 THEN (n // 3600) || 'h ' || (n % 3600 // 60) || 'm' || CASE WHEN n % 60 > 0 THEN ' ' || (n % 60) || 's' ELSE '' END WHEN n >= 60 THEN (n // 60) || 'm' || CASE WHEN n % 60 > 0 THEN ' ' || (n % 60) || 's' ELSE '' END ELSE n || 's' END AS text FROM t")
def duration_text(spark, sf_dir):
    return S(spark, sf_dir).select("seq", display.duration_text(F.col("seq") * 37).alias("text"))


@registered(f"SELECT metric, {TEXT_TIME.format('ts_ns')} AS timestamp_utc, ts_ns AS timestamp_ns, CAST(CAST(value AS INT) AS VARCHAR) AS value FROM L WHERE metric = 'A.F'")
def sample_report(spark, sf_dir):
    rows = filters.named(L(spark, sf_dir), "A.F").withColumns({"value_type": F.lit("int32"), "int32_value": F.col("value").cast("int"), "float32_value": F.lit(None).cast("float")})
    return results.sample_rows(rows).select("metric", "timestamp_utc", "timestamp_ns", "value")


# Rollups


def rollup_sql(view: str, width: int, wanted: list[str], prefix: str, where: str = "true", closed: str = "", stored: bool = False) -> str:
    """Samples of a rollup as SQL, after CTEs that end in r (metric, b, last and a column per aggregate). stored: as float32, as a store has them."""
    listed = ", ".join(f"CAST(CAST({AGG_SQL[a]} AS FLOAT) AS DOUBLE) AS a_{a}" if stored else f"{AGG_SQL[a]} AS a_{a}" for a in wanted)
    rows = " UNION ALL ".join(f"SELECT {prefix} || '.{aggregates.CANONICAL.get(a, a)}' AS metric, CAST(b AS BIGINT) AS ts_ns, round(a_{a}, 4) AS value FROM r" for a in wanted)
    return f", last AS (SELECT metric, max(ts_ns) AS last FROM {view} WHERE {where} GROUP BY 1), r AS (SELECT * FROM (SELECT metric, ts_ns - ts_ns % {width} AS b, {listed} FROM {view} WHERE {where} GROUP BY 1, 2) JOIN last USING (metric) WHERE b + {width} <= last {closed}) {rows}"


def _rolled(rows: DataFrame) -> DataFrame:
    return rows.select("metric", "ts_ns", F.round("value", 4).alias("value"))


HOURLY = rollup.Job("h", "S", "S1h", HOUR, source_pattern="*", grace_ns=0)


@registered(rollup_sql("S", HOUR, BASIC, "metric"))
def rollup_1h(spark, sf_dir):
    return _rolled(rollup.run(S(spark, sf_dir), rollup.plans([HOURLY])[0], NOW)[0])


CUT = timeutil.parse_timestamp("2024-01-15 06:30:00")


@registered(rollup_sql("S", HOUR, ["max", "count"], "'site.' || metric", "metric = 'click'", f"AND b + {HOUR} <= {CUT - 2 * HOUR}").replace("'site.' || metric", "'site'"))
def rollup_grace(spark, sf_dir):
    job = rollup.Job("g", "S", "D", HOUR, source_metric="click", prefix="site", aggregates=("max", "count"), grace_ns=2 * HOUR)
    return _rolled(rollup.run(S(spark, sf_dir), rollup.plans([job])[0], CUT)[0])


@registered(rollup_sql("S", HOUR, ["sum", "p95", "trimmed_avg"][:2], "metric", "regexp_full_match(metric, '[^/]*i[^/]*') AND NOT regexp_full_match(metric, 's[^/]*')"))
def rollup_pattern(spark, sf_dir):
    job = rollup.Job("p", "S", "D", HOUR, source_pattern="*i*", exclude=("s*",), aggregates=("sum", "p95"), grace_ns=0)
    return _rolled(rollup.run(S(spark, sf_dir), rollup.plans([job])[0], NOW)[0])


@registered(f", l1 AS (SELECT metric, max(ts_ns) AS last FROM S GROUP BY 1), h AS (SELECT * FROM (SELECT metric, ts_ns - ts_ns % {HOUR} AS ts_ns, sum(value) AS value FROM S GROUP BY 1, 2) JOIN l1 USING (metric) WHERE ts_ns + {HOUR} <= last), l2 AS (SELECT metric, max(ts_ns) AS last2 FROM h GROUP BY 1), d AS (SELECT * FROM (SELECT metric, ts_ns - ts_ns % {DAY} AS b, sum(value) AS s, max(value) AS m FROM h GROUP BY 1, 2) JOIN l2 USING (metric) WHERE b + {DAY} <= last2) SELECT metric || '.sum.sum' AS metric, CAST(b AS BIGINT) AS ts_ns, round(s, 3) AS value FROM d UNION ALL SELECT metric || '.sum.max', CAST(b AS BIGINT), round(m, 3) FROM d")
def rollup_cascade_1d(spark, sf_dir):
    daily = rollup.Job("d", "S1h", "S1d", DAY, source_pattern="*.sum", aggregates=("sum", "max"), grace_ns=0)
    made = rollup.backfill({"S": S(spark, sf_dir)}, [HOURLY, daily], NOW)
    return made["S1d"].select("metric", "ts_ns", F.round("value", 3).alias("value"))


@registered(rollup_sql("S", HOUR, BASIC, "metric"))
def rollup_incremental(spark, sf_dir):
    """Two runs, the second from the first one's checkpoints, give what one run gives."""
    plan = rollup.plans([HOURLY])[0]
    early = S(spark, sf_dir).where(F.col("ts_ns") < CUT)
    first, done = rollup.run(early, plan, CUT)
    second, _ = rollup.run(S(spark, sf_dir), plan, NOW, done.withColumn("seq", F.lit(1)))
    return _rolled(first.unionByName(second))


JOBS = [
    rollup.Job("a", "raw", "h1", HOUR, source_metric="temp", aggregates=("sum", "max")), rollup.Job("b", "h1", "d1", DAY, source_metric="temp.sum", aggregates=("sum",)),
    rollup.Job("c", "d1", "y1", 365 * DAY, source_metric="temp.sum.sum", prefix="year.temp", aggregates=("avg",)), rollup.Job("e", "raw", "x", HOUR, source_pattern="t*"),
]


@registered("""SELECT * FROM (WITH RECURSIVE j(sdb, sm, ddb, prefix, agg, id) AS (VALUES ('raw', 'temp', 'h1', 'temp', 'sum', 'a'), ('raw', 'temp', 'h1', 'temp', 'max', 'a'), ('h1', 'temp.sum', 'd1', 'temp.sum', 'sum', 'b'), ('d1', 'temp.sum.sum', 'y1', 'year.temp', 'avg', 'c')),
 t AS (SELECT 1 AS hop, ddb AS db, prefix || '.' || agg AS metric, agg AS aggregate, id AS job_id FROM j WHERE sdb = 'raw' AND sm = 'temp' UNION ALL SELECT hop + 1, ddb, prefix || '.' || agg, agg, id FROM t JOIN j ON sdb = t.db AND sm = t.metric WHERE hop < 5) SELECT * FROM t)""")
def rollup_lineage(spark, sf_dir):
    return lineage.lineage(spark, JOBS, "raw", "temp")


# Retention, equality, statistics


@registered("SELECT partition_key, records, partition_key || '-01' < '1999-03-15' AS expired, substr(partition_key, 1, 4) AS bucket FROM (SELECT strftime(make_timestamp(ts_ns // 1000), '%Y-%m') AS partition_key, count(*) AS records FROM L GROUP BY 1)")
def retention_expired(spark, sf_dir):
    stats = retention.partition_stats(L(spark, sf_dir), "month")
    now = timeutil.parse_timestamp("2000-03-14 11:00:00")
    return stats.select("partition_key", "records", retention.expired(F.col("partition_key"), now, 365).alias("expired"), retention.archive_bucket(F.col("partition_key")).alias("bucket"))


@registered("SELECT DISTINCT strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%d') AS partition_key, strftime(make_timestamp(ts_ns // 1000), '%Y-%m') AS bucket FROM S")
def archive_bucket(spark, sf_dir):
    return retention.partition_stats(S(spark, sf_dir)).select("partition_key", retention.archive_bucket(F.col("partition_key")).alias("bucket"))


@registered("SELECT metric, count(*) FILTER (seq % 50 = 0) AS only_a, CAST(0 AS BIGINT) AS only_b FROM S GROUP BY 1 HAVING only_a > 0")
def equality_check(spark, sf_dir):
    a = S(spark, sf_dir).select("metric", "ts_ns", "value", "seq")
    return retention.differences(a, a.where("seq % 50 != 0"))


@registered(", u AS (SELECT metric AS key, CASE metric WHEN 'click' THEN 'incr' WHEN 'error' THEN 'set' WHEN 'purchase' THEN 'setMin' ELSE 'setMax' END AS op, seq AS value, seq FROM S) SELECT key, op, CAST(CASE op WHEN 'incr' THEN sum(value) WHEN 'set' THEN arg_max(value, seq) WHEN 'setMin' THEN min(value) ELSE greatest(max(value), 0) END AS BIGINT) AS value FROM u GROUP BY 1, 2")
def stat_counters(spark, sf_dir):
    op = F.when(F.col("metric") == "click", "incr").when(F.col("metric") == "error", "set").when(F.col("metric") == "purchase", "setMin").otherwise("setMax")
    return retention.counters(S(spark, sf_dir).select(F.col("metric").alias("key"), op.alias("op"), F.col("seq").alias("value"), "seq"))


@registered("""SELECT strftime(make_timestamp(O.ts_ns // 1000), '%Y-%m') AS partition_key, count(*) FILTER (coalesce(O.seq > n.sealed_at, false)) AS rejected, count(*) AS records FROM O LEFT JOIN (
 WITH RECURSIVE k AS (SELECT *, row_number() OVER (ORDER BY opened) AS nth FROM (SELECT strftime(make_timestamp(ts_ns // 1000), '%Y-%m') AS key, min(seq) AS opened FROM O GROUP BY 1)),
 r(nth, open, key, sealed_at) AS (SELECT nth, [key], CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT) FROM k WHERE nth = 1 UNION ALL
  SELECT k.nth, CASE WHEN len(open) >= 24 THEN list_append(list_filter(open, lambda x: x <> list_min(open)), k.key) ELSE list_append(open, k.key) END, CASE WHEN len(open) >= 24 THEN list_min(open) END, CASE WHEN len(open) >= 24 THEN k.opened END FROM r JOIN k ON k.nth = r.nth + 1)
 SELECT key, sealed_at FROM r WHERE key IS NOT NULL) n ON n.key = strftime(make_timestamp(O.ts_ns // 1000), '%Y-%m') GROUP BY 1""")
def sealed_partitions(spark, sf_dir):
    rows = filters.sealed_rejections(O(spark, sf_dir), 24, "month")
    return rows.groupBy("partition_key").agg(F.count_if("sealed").alias("rejected"), F.count("*").alias("records"))


# Rates, thresholds, transitions


COUNTERS = "SELECT metric AS device, ts_ns, seq, sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY metric ORDER BY seq) + CASE WHEN seq % 211 = 0 THEN -100000 ELSE 0 END AS c FROM S WHERE value IS NOT NULL"


def _counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    rows = S(spark, sf_dir).where("value IS NOT NULL").select(F.col("metric").alias("device"), "ts_ns", "seq", F.floor(F.col("value").cast("double")).cast("long").alias("v"))
    upto = F.sum("v").over(W.partitionBy("device").orderBy("seq"))
    return rows.select("device", "ts_ns", "seq", (upto + F.when(F.col("seq") % 211 == 0, -100000).otherwise(0)).alias("c"))


@registered(f", k AS ({COUNTERS}), d AS (SELECT device, ts_ns, seq, c - lag(c) OVER w AS d, (ts_ns - lag(ts_ns) OVER w) / 1e9 AS s FROM k WINDOW w AS (PARTITION BY device ORDER BY ts_ns, seq)) SELECT device, ts_ns, seq, round(d / s, 6) AS reads, round(d * 512 / 1024 / s, 6) AS read_kb, round(least(100.0, d / (s * 10)), 6) AS busy_pct FROM d WHERE s > 0 AND d >= 0")
def rates_disk(spark, sf_dir):
    rows = _counters(spark, sf_dir).select("device", "ts_ns", "seq", *[F.col("c").alias(n) for n in ("reads", "writes", "read_sectors", "write_sectors", "io_ms")])
    return rates.disk(rows, order=("ts_ns", "seq")).select("device", "ts_ns", "seq", *[F.round(n, 6).alias(n) for n in ("reads", "read_kb", "busy_pct")])


@registered(f", k AS ({COUNTERS}), d AS (SELECT device, ts_ns, seq, 3 * c - lag(3 * c) OVER w AS t, c - lag(c) OVER w AS i, (seq % 7) - lag(seq % 7) OVER w AS o FROM k WINDOW w AS (PARTITION BY device ORDER BY ts_ns, seq)) SELECT device AS host, ts_ns, seq, round(greatest(0.0, least(100.0, 100.0 * (t - i - o) / t)), 6) AS busy_pct FROM d WHERE t > 0")
def rates_cpu(spark, sf_dir):
    rows = _counters(spark, sf_dir).select(F.col("device").alias("host"), "ts_ns", "seq", (3 * F.col("c")).alias("total"), F.col("c").alias("idle"), (F.col("seq") % 7).alias("iowait"))
    return rates.cpu(rows, order=("ts_ns", "seq")).select("host", "ts_ns", "seq", F.round("busy_pct", 6).alias("busy_pct"))


@registered(f", k AS ({COUNTERS}), d AS (SELECT device, ts_ns, seq, (seq % 5) - lag(seq % 5) OVER w AS p, c - lag(c) OVER w AS s FROM k WINDOW w AS (PARTITION BY device ORDER BY ts_ns, seq)) SELECT device AS pid, ts_ns, seq, round(coalesce(CASE WHEN s > 0 THEN p / CAST(s AS DOUBLE) * 4 * 100.0 END, 0.0), 6) AS cpu_pct FROM d")
def rates_process(spark, sf_dir):
    rows = _counters(spark, sf_dir).select(F.col("device").alias("pid"), "ts_ns", "seq", (F.col("seq") % 5).alias("proc"), F.col("c").alias("sys"))
    return rates.process(rows, 4, order=("ts_ns", "seq")).select("pid", "ts_ns", "seq", F.round("cpu_pct", 6).alias("cpu_pct"))


@registered("SELECT metric, count(*) FILTER (value <= 75) AS samples, count(*) FILTER (value > 75) AS events FROM S GROUP BY 1")
def threshold_events(spark, sf_dir):
    low, high = rates.threshold_split(S(spark, sf_dir), 75)
    both = low.select("metric", F.lit(1).alias("s"), F.lit(0).alias("e")).union(high.select("metric", F.lit(0), F.lit(1)))
    return both.groupBy("metric").agg(F.sum("s").alias("samples"), F.sum("e").alias("events"))


@registered(", u AS (SELECT metric AS target, ts_ns, seq, value <= 80 AS up FROM S WHERE value IS NOT NULL), c AS (SELECT *, lag(up) OVER (PARTITION BY target ORDER BY ts_ns, seq) AS was FROM u), t AS (SELECT * FROM c WHERE was IS NOT NULL AND was <> up) SELECT target, ts_ns, seq, up, CASE WHEN up THEN (ts_ns - lag(ts_ns) OVER (PARTITION BY target ORDER BY ts_ns, seq)) // 1000000 END AS outage_ms FROM t")
def transitions(spark, sf_dir):
    rows = S(spark, sf_dir).where("value IS NOT NULL").select(F.col("metric").alias("target"), "ts_ns", "seq", (F.col("value") <= 80).alias("up"))
    return rates.transitions(rows, order=("ts_ns", "seq"))


@registered(f"SELECT name, seq % 3 AS key, CAST(ts_ns - ts_ns % {60 * NS} AS BIGINT) AS bucket_ts_ns, count(*) AS count, arg_max(payload, seq) AS payload FROM E GROUP BY 1, 2, 3")
def batched_counts(spark, sf_dir):
    return ev.batched_counts(E(spark, sf_dir).withColumn("key", F.col("seq") % 3))


# Scalars, sources and the registry


@registered(f"SELECT seq, {TEXT_TIME.format('ts_ns')} AS text, ts_ns / 1e9 AS seconds, ts_ns AS parsed FROM S")
def timestamp_text(spark, sf_dir):
    rows = S(spark, sf_dir).select("seq", timeutil.timestamp_text(F.col("ts_ns")).alias("text"), timeutil.unix_seconds(F.col("ts_ns")).alias("seconds"))
    return rows.withColumn("parsed", timeutil.parse_timestamp_column(F.col("text")))


@registered("SELECT seq, trim(regexp_replace(trim(metric || ' #' || CAST(seq % 5 AS VARCHAR) || '?? x '), '[^a-zA-Z0-9.\\-_/]+', '_', 'g'), '_.-/') AS name FROM S")
def sanitized_names(spark, sf_dir):
    raw = F.concat(F.col("metric"), F.lit(" #"), (F.col("seq") % 5).cast("string"), F.lit("?? x "))
    return S(spark, sf_dir).select("seq", names.sanitize(raw).alias("name"))


@registered("SELECT metric, CASE WHEN max(CAST(seq % 7 = 0 AS INT)) = 1 THEN 'int32' ELSE 'float32' END AS value_type, CASE WHEN max(CAST(seq % 7 = 0 AS INT)) = 1 AND max(CAST(seq % 7 = 1 AS INT)) = 1 THEN 'mixed int and float' END AS error FROM (SELECT CASE WHEN seq % 2 = 0 THEN metric ELSE 'x' END AS metric, CASE WHEN seq % 2 = 0 THEN seq % 7 ELSE 3 END AS seq FROM S) GROUP BY 1")
def inferred_types(spark, sf_dir):
    kind = F.when(F.col("seq") % 2 == 0, F.col("seq") % 7).otherwise(3)
    literal = F.when(kind == 0, "5i").when(kind == 1, "5.5").otherwise("5")
    rows = S(spark, sf_dir).select(F.when(F.col("seq") % 2 == 0, F.col("metric")).otherwise("x").alias("metric"), literal.alias("literal"))
    return line_protocol.infer_types(rows, F.col("literal"))


@registered("SELECT seq, CAST(round((CASE WHEN seq % 2 = 0 THEN seq ELSE -seq END) * 0.5) AS INT) AS scaled, CASE WHEN seq % 3 = 0 THEN NULL ELSE (1000 - seq % 1000) / CAST(1000 AS DOUBLE) * 100.0 END AS used FROM (SELECT seq FROM S)")
def scaled_and_used(spark, sf_dir):
    signed = F.when(F.col("seq") % 2 == 0, F.col("seq")).otherwise(-F.col("seq"))
    total = F.when(F.col("seq") % 3 == 0, 0).otherwise(1000)
    return S(spark, sf_dir).select("seq", values.scale_to_int(signed.cast("double"), 0.5).alias("scaled"), rates.filesystem_used(total, F.col("seq") % 1000).alias("used"))


@registered("SELECT name, CASE WHEN seq % 3 = 0 THEN 'none' WHEN seq % 3 = 1 THEN 'int32' ELSE 'float32' END AS value_type, count(*) AS n, sum(length(payload)) AS payload_bytes FROM E GROUP BY 1, 2")
def topic_events(spark, sf_dir):
    left = F.when(F.col("seq") % 3 == 0, "").when(F.col("seq") % 3 == 1, "7").otherwise("7.5")
    body = F.concat(left, F.lit("|"), F.col("payload"))
    messages = topics.select(E(spark, sf_dir).select(F.concat(F.lit("ev/"), F.col("name")).alias("topic"), body.alias("body")), "ev/+", db="E")
    rows = topics.events(messages, json=False, default_ts=0)
    return rows.groupBy("name", "value_type").agg(F.count("*").alias("n"), F.sum(F.octet_length("payload").cast("long")).alias("payload_bytes"))


@registered("SELECT 'internal' AS db, 'engine/' || metric AS metric, CAST(7 AS BIGINT) AS ts_ns, CAST(CAST(count(*) AS FLOAT) AS DOUBLE) AS value FROM S GROUP BY metric")
def self_metrics(spark, sf_dir):
    counts = S(spark, sf_dir).groupBy(F.col("metric").alias("key")).agg(F.count("*").alias("value"))
    return retention.self_metrics(counts, ts_ns=7).withColumn("value", F.col("value").cast("double"))


@registered("SELECT name, ts_ns, seq FROM (SELECT CASE seq % 3 WHEN 0 THEN 'engine.db.created' WHEN 1 THEN 'engine.wal.reset' ELSE 'engine.db.deleted' END AS name, ts_ns, seq FROM E) WHERE name LIKE 'engine.db.%' ORDER BY ts_ns DESC, seq DESC LIMIT 50")
def events_of_group(spark, sf_dir):
    name = F.when(F.col("seq") % 3 == 0, "engine.db.created").when(F.col("seq") % 3 == 1, "engine.wal.reset").otherwise("engine.db.deleted")
    return registry.of_group(E(spark, sf_dir).withColumn("name", name), registry.registry(spark), "engine.db", 50).select("name", "ts_ns", "seq")


@registered("SELECT metric, count(*) AS n FROM S WHERE strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%d') = '2024-01-09' AND ts_ns > 1704790000000000000 GROUP BY 1")
def salvaged(spark, sf_dir):
    rows = retention.salvaged(S(spark, sf_dir), "2024-01-09", "day", 1704790000000000000)
    return rows.groupBy("metric").agg(F.count("*").alias("n"))


@registered("SELECT seq, CASE WHEN seq % 5 = 0 THEN '--' WHEN seq % 5 = 1 THEN CAST(seq AS VARCHAR) || '%' WHEN seq % 5 = 2 THEN CAST(seq AS VARCHAR) || '.5%' ELSE CAST(seq AS VARCHAR) || '.25%' END AS text FROM S")
def widget_text(spark, sf_dir):
    v = F.when(F.col("seq") % 5 == 0, float("nan")).when(F.col("seq") % 5 == 1, F.col("seq").cast("double")).when(F.col("seq") % 5 == 2, F.col("seq") + 0.5).otherwise(F.col("seq") + 0.25)
    return S(spark, sf_dir).select("seq", display.widget_text(v, 2, "%").alias("text"))
