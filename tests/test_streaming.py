import json

from pyspark.sql import functions as F

from tidemark.functions import timeutil
from tidemark.plans.engine import Engine
from tidemark.sources.store import Store
from tidemark.streaming import live

SCHEMA = "db string, metric string, ts_ns bigint, value float, seq bigint"
S, H = timeutil.NS, 3_600 * timeutil.NS


def feed(spark, folder, batches, schema=SCHEMA):
    """A stream that gets one file a batch."""
    folder.mkdir()
    names = [c.split(" ")[0] for c in schema.split(", ")]
    for i, rows in enumerate(batches):
        (folder / f"{i:03d}.json").write_text("\n".join(json.dumps(dict(zip(names, r))) for r in rows))
        import os

        os.utime(folder / f"{i:03d}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def run(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.sql(f"SELECT * FROM {name}")


def test_order_is_kept_across_batches(spark, tmp_path):
    batches = [[("d", "a", 5, 1.0, 0), ("d", "a", 4, 2.0, 1), ("d", "b", 9, 3.0, 2)], [("d", "a", 4, 4.0, 3), ("d", "a", 5, 5.0, 4), ("d", "b", 8, 6.0, 5)], [("d", "a", 9, 7.0, 6), ("d", "a", 6, 8.0, 7)]]
    got = run(live.accept_in_order(feed(spark, tmp_path / "in", batches)), "ordered", tmp_path)
    assert sorted(r["seq"] for r in got.collect()) == [0, 2, 4, 6]


def test_continuous_rollup(spark, tmp_path):
    batches = [[("d", "m", k * 600 * S, float(k), k) for k in range(a, a + 12)] for a in (0, 12, 24)] + [[("d", "m", 99 * H, 0.0, 99)]]
    got = run(live.continuous_rollup(feed(spark, tmp_path / "in", batches), H, ["sum", "count"], "1 hour"), "rolled", tmp_path)
    rows = {r["start_ts_ns"] // H: (r["sum"], r["count"]) for r in got.collect()}
    assert all(rows[h] == (sum(range(6 * h, 6 * h + 6)), 6) for h in range(4))


def test_floods_are_counted(spark, tmp_path):
    schema = "name string, key string, ts_ns bigint, payload string, seq bigint"
    batches = [[("n", "k", k * 10 * S, f"p{k}", k) for k in range(6)], [("n", "k", 1000 * S, "z", 9)], [("n", "k", 2000 * S, "z", 10)]]
    got = run(live.batched_counts(feed(spark, tmp_path / "in", batches, schema)), "floods", tmp_path)
    assert ("n", "k", 0, 6, "p5") in [tuple(r) for r in got.collect()]


def test_batches_are_stored_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    batch = spark.createDataFrame([("db/m 1 10",), ("db/m 2 5",), ("bad",), ("db/m 3i 11",), ("db/m 3 11",)], "line string")
    process = live.ingest(batch, store)
    process(batch, 0)
    process(batch, 0)
    process(spark.createDataFrame([("db/m 4 12",)], "line string"), 1)
    rows = live.ingested(store)
    assert sorted(r["ts_ns"] for r in rows.collect()) == [10, 11, 12] and rows.where(F.col("db") == "db").count() == 3


def test_batches_reject_what_is_older_than_stored(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    lines = lambda *rows: spark.createDataFrame([(r,) for r in rows], "line string")
    Engine(spark, store.root).import_lines(lines("db/k 1 50"))
    sealed = lambda rows, number: store.write("db", rows.where(F.col("db") == "db"))
    process = live.ingest(lines(), store, after=sealed)
    process(lines("db/m 1 10", "db/m 2 20", "db/k 3 40", "db/k 4 50"), 0)
    for _ in range(2):  # done again after it was sealed: stored as at first
        process(lines("db/m 3 15", "db/m 4 20", "db/m 5 30", "db/n 6 1", "db2/m 7 1"), 1)
    got = sorted((r["db"], r["metric"], r["ts_ns"]) for r in live.ingested(store).collect())
    assert got == [("db", "k", 50), ("db", "m", 10), ("db", "m", 20), ("db", "m", 20), ("db", "m", 30), ("db", "n", 1), ("db2", "m", 1)]
