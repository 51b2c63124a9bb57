"""Retention, equality of rewritten data, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timeutil
from .filters import with_partition

ACTIONS = ("keep", "delete", "archive")


def cutoff_day(now_ns: int, days: int) -> str:
    return timeutil.format_timestamp(now_ns // timeutil.DAY_NS * timeutil.DAY_NS - days * timeutil.DAY_NS)[:10]


def expired(key: Column, now_ns: int, days: int) -> Column:
    """Whether a partition starts before today's start less the days; one without end never expires."""
    return (key != "forever") & (F.rpad(F.concat(key, F.lit("-01-01")), 10, "") < F.lit(cutoff_day(now_ns, days)))


def archive_bucket(key: Column) -> Column:
    """Days go to their month, months to their year, years to forever."""
    return F.when(F.length(key) == 10, F.substring(key, 1, 7)).when(F.length(key) == 7, F.substring(key, 1, 4)).otherwise("forever")


def sweep(store, db: str, now_ns: int, days: int, action: str = "delete") -> dict[str, list[str]]:
    """Act on a store's expired partitions; the keys by what was done."""
    if action not in ACTIONS:
        raise ValueError(f"unknown retention action {action!r}")
    limit = cutoff_day(now_ns, days)
    keys = sorted({p.key for p in store.state(db).parts if not p.archive})  # of either kind, staged and streamed rows too
    gone = [k for k in keys if k != "forever" and (k + "-01-01")[:10] < limit]
    for k in gone:
        if action == "delete":
            store.remove(db, k)
        elif action == "archive":
            store.archive(db, k, k[:7] if len(k) == 10 else k[:4] if len(k) == 7 else "forever")
    return {"expired": gone, "kept": [k for k in keys if k not in gone]}


def retained(df: DataFrame, now_ns: int, days: int, mode: str = "day") -> DataFrame:
    return with_partition(df, mode).where(~expired(F.col("partition_key"), now_ns, days))


def differences(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("metric",)) -> DataFrame:
    """keys, only_a, only_b: how many rows each has that the other hasn't, as bags; nothing where they are equal.

    One grouping of both sides; no row is compared with another.
    """
    columns = a.columns
    both = a.select(*columns, F.lit(1).alias("n")).unionByName(b.select(*columns, F.lit(-1).alias("n")))
    g = both.groupBy(*columns).agg(F.sum("n").alias("n")).where("n != 0")
    return g.groupBy(*keys).agg(F.sum(F.greatest("n", F.lit(0))).alias("only_a"), F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("only_b"))


def salvaged(rows: DataFrame, key: str, mode: str, covered_until_ns: int | None = None) -> DataFrame:
    """What is kept of a damaged partition's readable rows: those of its own key, and beyond what is covered already."""
    out = with_partition(rows.drop("partition_key"), mode).where(F.col("partition_key") == key)
    return out if covered_until_ns is None else out.where(F.col("ts_ns") > covered_until_ns)


def partition_stats(df: DataFrame, mode: str = "day", keys: Sequence[str] = ()) -> DataFrame:
    """partition_key (and keys), records, min_ts_ns, max_ts_ns."""
    g = with_partition(df.drop("partition_key"), mode).groupBy("partition_key", *keys)
    return g.agg(F.count("*").alias("records"), F.min("ts_ns").alias("min_ts_ns"), F.max("ts_ns").alias("max_ts_ns"))


def file_stats(df: DataFrame) -> DataFrame:
    """Per file of a scan: records, bytes, time span, bytes a record. df must come straight from files."""
    g = df.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    return g.agg(F.count("*").alias("records"), F.min("ts_ns").alias("min_ts_ns"), F.max("ts_ns").alias("max_ts_ns")).withColumn("bytes_per_record", F.col("bytes") / F.col("records"))


def inspected(spark: SparkSession, paths: Sequence[str], base: str) -> DataFrame:
    """file, bytes, records, min_ts_ns, max_ts_ns, bytes_per_record, damaged: a row per file of the folders, and one of totals whose file is null.

    A file that can't be read, or not to its end, has fewer rows than it should, or none, and is told by its footer: damaged files are passed over.
    """
    if not paths:
        return spark.createDataFrame([], "file string, bytes bigint, records bigint, min_ts_ns bigint, max_ts_ns bigint, bytes_per_record double, damaged boolean")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(list(paths)).select(F.col("path").alias("file"), F.col("length").alias("bytes"))
    rows = spark.read.schema("ts_ns bigint").option("basePath", base).option("ignoreCorruptFiles", "true").parquet(*paths)
    read = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("records"), F.min("ts_ns").alias("min_ts_ns"), F.max("ts_ns").alias("max_ts_ns"))
    per = lambda g: (F.col("bytes") / F.when(F.col("records") > 0, F.col("records"))).alias("bytes_per_record")
    each = files.join(read, "file", "left").select("file", "bytes", F.coalesce("records", F.lit(0)).cast("bigint").alias("records"), "min_ts_ns", "max_ts_ns", F.col("records").isNull().alias("damaged"))
    totals = each.agg(F.lit(None).cast("string").alias("file"), F.sum("bytes").alias("bytes"), F.sum("records").alias("records"), F.min("min_ts_ns").alias("min_ts_ns"), F.max("max_ts_ns").alias("max_ts_ns"), F.max("damaged").alias("damaged"))
    both = each.unionByName(totals)
    return both.select("file", "bytes", "records", "min_ts_ns", "max_ts_ns", per(both), "damaged")


def metric_catalog(samples: DataFrame) -> DataFrame:
    return samples.groupBy("db", "metric").agg(F.count("*").alias("records"), F.max("ts_ns").alias("last_ts_ns"))


def counters(updates: DataFrame) -> DataFrame:
    """key, value of keyed updates (key, op, value, seq): incr adds, set takes the last, setMin and setMax the extreme, the latter from 0."""
    g = updates.groupBy("key", "op").agg(F.sum("value").alias("s"), F.max_by("value", "seq").alias("l"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    value = F.when(F.col("op") == "incr", F.col("s")).when(F.col("op") == "set", F.col("l")).when(F.col("op") == "setMin", F.col("lo")).when(F.col("op") == "setMax", F.greatest(F.col("hi"), F.lit(0)))
    return g.select("key", "op", value.alias("value"))


def self_metrics(values: DataFrame, prefix: str = "engine", db: str = "internal", ts_ns: int = 0) -> DataFrame:
    """Counters as float32 samples named prefix/key of the internal database."""
    return values.select(F.lit(db).alias("db"), F.concat(F.lit(f"{prefix}/"), F.col("key")).alias("metric"), F.lit(ts_ns).cast("long").alias("ts_ns"), F.col("value").cast("float").alias("value"))
