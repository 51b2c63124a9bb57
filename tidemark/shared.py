"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a session of one machine gets a temporary folder as its own; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="tidemark-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def place(spark: SparkSession, name: str = "tidemark") -> str:
    """A path in the shared folder that nobody else has; what is there goes when the driver's JVM ends."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut, it is evaluated once, and the loss of an executor costs nothing of it."""
    path = place(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a local relation, which plans without a job or a Python worker."""
    types = to_arrow_schema(StructType.fromDDL(schema))
    columns = list(zip(*rows)) if rows else [()] * len(types)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, types)], schema=types))
