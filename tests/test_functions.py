import math
import random
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import aggregates, display, names, timeutil, values

H = 3_600 * timeutil.NS


@pytest.mark.parametrize(("text", "ns"), [("90s", 90 * 10**9), ("1.5h", 5400 * 10**9), ("1w2d3h", (9 * 24 + 3) * H), ("-5m", -300 * 10**9), ("0", 0), ("+2ms", 2 * 10**6), ("0.5d", 12 * H), ("1us2ns", 1002), (".5s", 5 * 10**8)])
def test_durations(text, ns):
    assert timeutil.parse_duration(text) == ns


@pytest.mark.parametrize("text", ["", "5", "h", "1x", "1h 2m", "-", "1d2", "99999999999w"])
def test_bad_durations(text):
    with pytest.raises(ValueError):
        timeutil.parse_duration(text)


@given(st.integers(0, 4 * 10**18))
def test_timestamps_round_trip(ns):
    assert timeutil.parse_timestamp(timeutil.format_timestamp(ns)) == ns


@pytest.mark.parametrize(
    ("text", "unit", "ns"),
    [("12", "s", 12 * 10**9), ("1.5", "ms", 1_500_000), ("12", "ns", 12), ("2026-05-14", "s", 1778716800 * 10**9), ("2026-05-14 12:34", "s", 1778762040 * 10**9), ("2026-05-14T12:34:56Z", "s", 1778762096 * 10**9), ("2026-05-14T12:34:56.25+02:00", "ns", 1778754896_250000000), ("-20", "s", 10**18 - 20 * 10**9), ("-5m", "ms", 10**18 - 300 * 10**9)],
)
def test_units(text, unit, ns):
    assert timeutil.parse_timestamp_with_unit(text, unit, now=10**18) == ns


def test_relative_limits_and_cli_times():
    assert timeutil.parse_timestamp("-20", now=10**18) == 10**18 - 20 * 10**9
    assert timeutil.parse_cli_time("5m", now=10**18) == 10**18 - 300 * 10**9
    assert timeutil.parse_cli_time("7", now=10**18) == 7
    for bad in ("-9999d", "", "soon", "2026-13-01"):
        with pytest.raises(ValueError):
            timeutil.parse_timestamp(bad)
    with pytest.raises(ValueError):
        timeutil.normalize_unit("minutes")


def test_time_columns_agree_with_python(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(0, 4 * 10**18),) for _ in range(200)] + [(0,), (1,), (-1,), (-(10**18) - 7,)]
    df = spark.createDataFrame(rows, "ts bigint")
    out = df.select("ts", timeutil.timestamp_text(F.col("ts")).alias("t"), *[timeutil.partition_key(F.col("ts"), m).alias(m) for m in timeutil.PARTITION_MODES])
    for r in out.collect():
        assert r["t"] == timeutil.format_timestamp(r["ts"])
        assert all(r[m] == timeutil.partition_key_of(r["ts"], m) for m in timeutil.PARTITION_MODES)


def test_parsed_text_columns(spark):
    texts = ["12", "2026-05-14", "2026-05-14 12", "2026-05-14 12:34", "2026-05-14 12:34:56.1", "2026-05-14 12:34:56.1234567891", "x", "2026-99-14", "99999999999999999999"]
    got = [r["n"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(timeutil.parse_timestamp_column(F.col("t")).alias("n")).collect()]
    want = [12, *[timeutil.parse_timestamp(t) for t in texts[1:6]], None, None, None]
    assert got == want


@pytest.mark.parametrize(
    ("glob", "name", "yes"),
    [("*", "a.b", True), ("*", "a/b", False), ("a?c", "abc", True), ("a?c", "a/c", False), ("[a-c]x", "bx", True), ("[^a-c]x", "bx", False), ("a.b", "aXb", False), ("a\\*", "a*", True), ("a\\*", "ab", False), ("room[12].*", "room2.temp", True), ("[", "[", False), ("a[", "a", False)],
)
def test_globs(spark, glob, name, yes):
    assert spark.createDataFrame([(name,)], "n string").select(names.glob_match(F.col("n"), glob).alias("m")).first()["m"] is yes


def test_names_and_targets():
    assert names.is_database("prod-1.a") and not names.is_database(".a") and not names.is_database("-a") and not names.is_database("a" * 65) and not names.is_database("")
    assert names.split_target("db/room/temp") == ("db", "room/temp") and names.split_target("m", "db") == ("db", "m")
    for bad in ("m", "/m", "db/"):
        with pytest.raises(ValueError):
            names.split_target(bad)


def test_sanitize(spark):
    texts = ["  Küche temp!! 1 ", "__a--", "a  b/c", "..", "日本 x", "a$$b"]
    got = [r["s"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(names.sanitize(F.col("t")).alias("s")).collect()]
    assert got == ["Küche_temp_1", "a", "a_b/c", "", "日本_x", "a_b"]


@pytest.mark.parametrize(
    ("rule", "topic", "want"),
    [("a/+/b", "a/x/b", ("", "x")), ("+/+", "d/m", ("d", "m")), ("+/#", "d/m/n", ("d", "m/n")), ("#", "d/m", ("", "d/m")), ("s/+/+/#", "s/d/m/n/o", ("d", "m/n/o")), ("a/b", "a/b", ("", ""))],
)
def test_topics(spark, rule, topic, want):
    db, name = names.topic_names(F.col("t"), rule)
    r = spark.createDataFrame([(topic,)], "t string").select(db.alias("d"), name.alias("n"), F.col("t").rlike(names.topic_to_regex(rule)).alias("m")).first()
    assert r["m"] and (r["d"], r["n"]) == want


def test_topic_filters_do_not_overreach(spark):
    for rule, topic in (("a/+", "a/b/c"), ("a/b", "a"), ("+", "a/b"), ("a/+/c", "a/b")):
        assert not spark.createDataFrame([(topic,)], "t string").select(F.col("t").rlike(names.topic_to_regex(rule)).alias("m")).first()["m"]


def test_literals(spark):
    cases = {"12i": ("int32", 12), "-3i": ("int32", -3), "2147483648i": (None, None), "1.5i": (None, None), "12": ("float32", 12.0), "1e3": ("float32", 1000.0), "1e39": (None, None), "x": (None, None), "nan": ("float32", math.nan), "+Inf": ("float32", math.inf), ".5": ("float32", 0.5), "": (None, None)}
    c = F.col("t")
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", values.lp_type(c).alias("k"), F.coalesce(values.lp_int(c).cast("double"), values.lp_float(c).cast("double")).alias("v")).collect()
    for r in rows:
        kind, value = cases[r["t"]]
        assert r["k"] == kind and (r["v"] == value or (value is not None and math.isnan(value) and math.isnan(r["v"])) or (value is None and kind is None))


def test_json_and_message_typing(spark):
    c = F.col("t")
    row = lambda t: spark.createDataFrame([(t,)], "t string").select(values.json_type(c).alias("j"), values.integral_type(c).alias("i"), values.spelled_type(c).alias("s")).first()
    assert tuple(row("5.0")) == ("float32", "int32", "float32") and tuple(row("5")) == ("int32", "int32", "int32")
    assert tuple(row("3000000000")) == (None, "float32", "float32") and row("true")["j"] is None and row("null")["j"] == "none"


def plain(x):
    f = np.float32(x)
    text = np.format_float_positional(f, unique=True, trim="-")
    return "-0" if text == "-0" else text


def test_float_text_is_shortest_without_exponent(spark):
    rng = random.Random(2)
    xs = [float(np.float32(x)) for x in [0.0, 1.0, -2.5, 1e8, 1e-4, 123456789.0, 3.4e38, 1.17e-38, 21.0, 0.1, 1e7, 12345678.0, *[rng.uniform(-1, 1) * 10 ** rng.randrange(-12, 20) for _ in range(300)]]]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", values.float_text(F.col("x").cast("float")).alias("t")).collect()
    for r in got:
        assert "E" not in r["t"] and np.float32(r["t"]) == np.float32(r["x"])
        assert len(r["t"]) <= len(plain(r["x"])) + 1


def test_payloads(spark):
    texts = ['{ "a" : 1 }', "no json", None, ""]
    got = [r["p"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(values.compact_payload(F.col("t").cast("binary")).alias("p")).collect()]
    assert got == ['{"a":1}', '{"raw_base64":"bm8ganNvbg=="}', None, None]


def trim_mean(v):
    v = sorted(v)
    cut = len(v) // 20 if len(v) >= 20 else 1
    cut = 0 if 2 * cut >= len(v) else cut
    v = v[cut : len(v) - cut]
    return sum(v) / len(v)


def aggregate(spark, v, name):
    df = spark.createDataFrame([(float(x),) for x in v], "value double")
    return df.agg(*aggregates.columns([name], F.col("value"))).first()[name]


@pytest.mark.parametrize(("name", "want"), [("min", 10), ("max", 100), ("sum", 220), ("avg", 44), ("count", 5), ("p50", 40), ("median", 40), ("p95", 90), ("p99", 98)])
def test_aggregate_vector(spark, name, want):
    assert aggregate(spark, [10, 20, 40, 50, 100], name) == pytest.approx(want)


@pytest.mark.parametrize(("v", "want"), [([*range(1, 11), 1000], 6), ([1, 2, 1000], 2), ([0] * 5 + [10] * 45, 430 / 46), ([1, 3], 2), ([7], 7)])
def test_trimmed_means(spark, v, want):
    assert aggregate(spark, v, "trimmed_avg") == pytest.approx(want) == pytest.approx(trim_mean(v))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=60))
def test_trimmed_mean_property(spark, v):
    assert aggregate(spark, v, "trimmed_average") == pytest.approx(trim_mean(v), abs=1e-6)


def test_aggregate_lists():
    assert aggregates.resolve(" avg, ,p95,avg ") == ["avg", "p95"] and aggregates.resolve(["MAX"], fold_case=True) == ["max"]
    for bad in ("", "MAX", "avg,nope"):
        with pytest.raises(ValueError):
            aggregates.resolve(bad)
    assert len(aggregates.supported()) == 11 and aggregates.supported() == sorted(aggregates.supported())


def test_display(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    v = lambda x: F.lit(float(x))
    assert one(display.transform(v(10), 1.8, 32)) == 50 and one(display.transform(v("nan"))) is None
    assert [one(display.severity(v(x), 20, 40)) for x in (10, 20, 40)] == ["normal", "warning", "critical"]
    assert [one(display.severity(v(x), 5, 1, "below")) for x in (1, 5, 6)] == ["critical", "warning", "normal"]
    assert one(display.severity(v(5))) == "none" and one(display.severity(v("nan"), 1)) == "none"
    assert [one(display.number_text(v(x), d)) for x, d in ((1.5, 2), (2.0, 3), (10.25, 1), (100, 0), (0.104, 3))] == ["1.5", "2", "10.3", "100", "0.104"]
    assert [one(display.duration_text(v(x))) for x in (-1, 59, 61, 3600, 3661, 90061)] == ["0s", "59s", "1m 1s", "1h 0m", "1h 1m 1s", "1d 1h 1m"]
    assert one(display.widget_text(v(61), template="up {duration}")) == "up 1m 1s" and one(display.widget_text(v(2.5), 1, "%")) == "2.5%"
    assert display.series_label({"query": "db/m", "aggregate": "avg", "window": "5m"}) == "db/m [avg 5m]" and display.series_label({}, 1) == "Series 2"


def test_scaling(spark):
    one = lambda x, s: spark.range(1).select(values.scale_to_int(F.lit(float(x)), s).alias("x")).first()["x"]
    assert one(2.5, 0) == 3 and one(-2.5, 1) == -3 and one(1.26, 10) == 13 and one(3e9, 1) is None
    assert Decimal("0.1") * 10 == 1
