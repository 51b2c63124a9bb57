"""Line protocol: ``DB/metric value [ts]``, parsed and written with columns only."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names, timeutil, values

MAX_LINE = 1 << 20


def parse(lines: DataFrame, line: str = "line", default_ts: int | None = None, db: str | None = None) -> DataFrame:
    """The columns of lines and db, metric, ts_ns, value_type, int32_value, float32_value, value, error (null if the line is good).

    Blank lines and those that begin with # are left out. A missing time is default_ts, or the clock. db replaces the line's.
    """
    now = time.time_ns() if default_ts is None else default_ts
    # one step builds on the columns of the one before, so that nothing is worked out twice
    rows = lines.withColumn("lp_text", F.trim(F.col(line))).where((F.col("lp_text") != "") & ~F.col("lp_text").startswith("#"))
    rows = rows.withColumn("lp_fields", F.split(F.regexp_replace("lp_text", r"\s+", " "), " "))
    fields = F.col("lp_fields")
    rest = F.array_join(F.slice(fields, 3, F.greatest(F.size(fields) - 2, F.lit(0))), " ")
    rows = rows.withColumns({"lp_target": F.element_at(fields, 1), "lp_literal": F.try_element_at(fields, F.lit(2)), "lp_when": rest})
    target, literal = F.col("lp_target"), F.col("lp_literal")
    slash = target.contains("/")
    tail = F.substring(target, F.instr(target, "/") + 1, F.length(target))
    base = F.when(slash, F.substring_index(target, "/", 1)) if db is None else F.lit(db)
    metric = F.when(slash, tail) if db is None else F.when(slash, tail).otherwise(target)
    out = rows.withColumns({"db": base, "metric": metric, "int32_value": values.lp_int(literal), "lp_double": F.when(~values.has_int_suffix(literal), values.lp_double(literal)), "ts_ns": F.when(F.col("lp_when") == "", F.lit(now).cast("long")).otherwise(timeutil.parse_timestamp_column(F.col("lp_when")))})
    out = out.withColumn("float32_value", values.fitted(F.col("lp_literal"), F.col("lp_double")))
    kind = F.when(F.col("int32_value").isNotNull(), values.INT).when(F.col("float32_value").isNotNull(), values.FLOAT)
    out = out.withColumns({"value_type": kind, "value": values.common_value(F.col("int32_value"), F.col("float32_value"))})
    error = (
        F.when(F.octet_length(F.col(line)) > MAX_LINE, "line too long")
        .when(F.size(fields) < 2, "missing value")
        .when(F.col("db").isNull() | ~names.valid_database(F.col("db")), "invalid database")
        .when(F.col("metric").isNull() | ~names.valid_metric(F.col("metric")), "invalid metric")
        .when(F.col("value_type").isNull(), "invalid value")
        .when(F.col("ts_ns").isNull(), "invalid timestamp")
    )
    return out.withColumn("error", error).drop("lp_text", "lp_fields", "lp_target", "lp_literal", "lp_when", "lp_double")


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1), seq (over all files, by path), line of text files.

    Files are read in splits, so a large file is many tasks: a line's place in its split is its id less the split's first, and the lines of the
    splits before it, a row each, are counted.
    """
    block = F.col("_metadata.file_block_start")
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), block.alias("lp_block"), F.monotonically_increasing_id().alias("lp_id"), F.col("value").alias("line"))
    splits = raw.groupBy("file", "lp_block").agg(F.min("lp_id").alias("lp_first"), F.count("*").alias("lp_n"))
    before = lambda w: F.sum("lp_n").over(w) - F.col("lp_n") - F.col("lp_first")
    splits = splits.select("file", "lp_block", before(W.partitionBy("file").orderBy("lp_block")).alias("lp_in_file"), before(W.orderBy("file", "lp_block")).alias("lp_in_all"))
    return raw.join(splits, ["file", "lp_block"]).select("file", (F.col("lp_id") + F.col("lp_in_file") + 1).alias("line_no"), (F.col("lp_id") + F.col("lp_in_all")).alias("seq"), "line")


def read(spark: SparkSession, path: str, db: str | None = None, default_ts: int | None = None) -> DataFrame:
    """Parsed lines of text files with file, line_no and seq."""
    return parse(numbered(spark, path), db=db, default_ts=default_ts)


def from_bodies(bodies: DataFrame, body: str = "body", **how) -> DataFrame:
    """Parsed lines of request bodies: plain text, or JSON with the text (or a list of lines) under lines; with file (the body's number), line_no and seq."""
    b = F.trim(F.col(body))
    inner = F.get_json_object(b, "$.lines")
    listed = F.from_json(inner, "array<string>")
    text = F.when(b.startswith("{"), F.when(inner.startswith("["), F.array_join(listed, "\n")).otherwise(inner)).otherwise(F.col(body))
    given = bodies.select(F.monotonically_increasing_id().alias("file"), text.alias("lp_body"))  # before lines are made of it
    rows = given.select("file", F.posexplode(F.split("lp_body", "\n")).alias("line_no", "line"))
    return parse(rows.withColumn("line_no", F.col("line_no") + 1).withColumn("seq", F.monotonically_increasing_id()), **how)


def until_first_error(parsed: DataFrame) -> DataFrame:
    """The good lines before the first bad one of each file: what an import that stops there has stored."""
    bad = parsed.where(F.col("error").isNotNull()).groupBy("file").agg(F.min("line_no").alias("bad_line"))
    return parsed.join(bad, "file", "left").where(F.col("bad_line").isNull() | (F.col("line_no") < F.col("bad_line"))).drop("bad_line")


def strict(parsed: DataFrame) -> DataFrame:
    """parsed, failing at the first bad line when it runs."""
    where = F.concat(F.lit("line "), F.coalesce(F.col("line_no").cast("string"), F.lit("?")), F.lit(": "), F.col("error")) if "line_no" in parsed.columns else F.col("error")
    return parsed.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(where).cast("string")))


def to_line(suffix: bool = True, with_db: bool = True, text_time: bool = True) -> Column:
    """A sample as a line; the int suffix keeps the type over a round trip, the plain form loses it."""
    target = F.concat(F.col("db"), F.lit("/"), F.col("metric")) if with_db else F.col("metric")
    when = timeutil.timestamp_text(F.col("ts_ns")) if text_time else F.col("ts_ns").cast("string")
    return F.concat_ws(" ", target, values.value_text(F.col("int32_value"), F.col("float32_value"), suffix), when)


def export(samples: DataFrame, suffix: bool = True, with_db: bool = True) -> DataFrame:
    """line, in storage order: partition, then arrival."""
    return samples.orderBy("partition_key", "seq").select(to_line(suffix, with_db).alias("line"))


def export_parts(samples: DataFrame, with_db: bool = False) -> DataFrame:
    """partition_key, line: each partition by time and metric, equal ones as they arrived; ints keep their suffix."""
    return samples.orderBy("partition_key", "ts_ns", "metric", "seq").select("partition_key", to_line(True, with_db).alias("line"))


def typed_parts(lines: DataFrame, line: str = "line", mode: str = "day", default_ts: int | None = None) -> DataFrame:
    """Samples with their partition for an offline import: a metric's type is inferred from all of its literals, and mixed ones fail when run."""
    parsed = parse(lines.withColumn("lp_value", F.try_element_at(F.split(F.regexp_replace(F.trim(line), r"\s+", " "), " "), F.lit(2))), line, default_ts).where("error IS NULL")
    kinds = infer_types(parsed, F.col("lp_value")).select("metric", F.when(F.col("error").isNotNull(), F.raise_error(F.concat("metric", F.lit(": "), "error")).cast("string")).otherwise(F.col("value_type")).alias("kind"))
    rows = parsed.drop("value_type").join(kinds, "metric").withColumnRenamed("kind", "value_type")
    whole = F.when(F.col("value_type") == values.INT, F.coalesce("int32_value", F.col("lp_value").try_cast("int")))
    real = F.when(F.col("value_type") == values.FLOAT, F.col("float32_value"))
    return rows.withColumns({"int32_value": whole, "float32_value": real}).withColumn("partition_key", timeutil.partition_key(F.col("ts_ns"), mode)).drop("lp_value")


def infer_types(parsed: DataFrame, literal: Column) -> DataFrame:
    """metric, value_type, error: any suffixed literal makes the metric int32; beside one that looks like a float that's an error."""
    ints, floats = F.max(values.has_int_suffix(literal).cast("int")), F.max(values.looks_like_float(literal).cast("int"))
    g = parsed.groupBy("metric").agg(ints.alias("ints"), floats.alias("floats"))
    return g.select("metric", F.when(F.col("ints") == 1, values.INT).otherwise(values.FLOAT).alias("value_type"), F.when((F.col("ints") == 1) & (F.col("floats") == 1), "mixed int and float").alias("error"))
