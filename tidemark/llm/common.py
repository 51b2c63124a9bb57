"""What the corpus operators share: shared tables, table access, column naming."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import shared

#: Rows of a one-row-per-key table that may be broadcast; each row is under 200 bytes, so 20 MB at most.
BROADCAST_ROWS = 100_000

BATCH_BYTES = 4 << 20

#: Words are runs of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of its own only on a single machine that has it unset."""
    return shared.folder(spark)


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limit on the bytes of an Arrow batch to BATCH_BYTES, if it is higher.

    Texts differ in length by orders of magnitude: a worker holds a batch of them, and the JVM up to two. The limit is read when a plan runs,
    which may be after the operator has returned, so it stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)))
    if now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_table(df: DataFrame) -> DataFrame:
    """Cut the lineage of df: write it as a table in the shared folder and read it again.

    Every executor can read the files, so the loss of one costs nothing that was written. The files go when
    the driver's JVM ends, or with forget.
    """
    small_batches(df.sparkSession)
    return shared.cut(df)


def forget(*tables: DataFrame) -> None:
    """Delete the files of shared tables that nothing will read again: those of a loop's last round, say."""
    for t in tables:
        spark = t.sparkSession
        for f in {x.rsplit("/", 1)[0] for x in t.inputFiles()}:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
            if at.getName().startswith("tidemark-"):
                at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the limit, else as it is."""
    return F.broadcast(df) if rows <= limit else df


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name like name that none of the taken ones equals, whatever their case."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids fall in fold 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % n, F.lit(0))


def unit_hash(*cols: Column) -> Column:
    """A number in [0, 1) that the given columns decide."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def bit_map(ids: DataFrame, per_id: int) -> tuple[DataFrame, int]:
    """A bit map of the hashes of ids (a column id), in rows of 32,768 bits to be broadcast, and its number of bits.

    It has per_id bits or more for each id, up to 2**27 (16 MB); beyond that it lets more through.
    """
    bits = 1 << min(27, max(18, (per_id * ids.count()).bit_length()))
    place = F.pmod(F.xxhash64("id"), F.lit(bits))
    rows = ids.select(place.alias("p")).groupBy(F.floor(F.col("p") / 32768).alias("map_row")).agg(F.bitmap_construct_agg(F.col("p") % 32768).alias("map"))
    return F.broadcast(rows), bits


def maybe(rows: DataFrame, marks: tuple[DataFrame, int], name: str, keep: Sequence[str], of: str = "doc_id") -> DataFrame:
    """Columns to keep of rows and, as a boolean of the name, whether the bit of the id in column of is set; a null id has none."""
    id_ = F.col(f"r.{of}")
    place = F.pmod(F.xxhash64(id_), F.lit(marks[1]))
    r = rows.alias("r").join(marks[0].alias("m"), F.floor(place / 32768) == F.col("m.map_row"), "left")
    within = place % 32768
    byte = F.conv(F.hex(F.substring(F.col("m.map"), (F.floor(within / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (within % 8 + 1).cast("int")))
    return r.select(*[F.col(f"r.`{c}`") for c in keep], (id_.isNotNull() & (F.coalesce(bit, F.lit(0)) != 0)).alias(name))


def copy_numbers(rows: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """rows of a shared table with the number of each among those of equal keys, from 0. Its column arrival (of monotonically_increasing_id, written with the rows) says the order.

    Rows are counted by key and the task that wrote them, the counts are added up over a row per task, and each such part numbers its own: one key that has most rows is
    many parts.
    """
    by = rows.withColumn("task", F.shiftright("arrival", 33))
    counts = by.groupBy(*keys, "task").agg(F.count("*").alias("c"))
    before = counts.select(*[F.col(k).alias(f"{k}_of") for k in keys], F.col("task").alias("task_of"), (F.sum("c").over(W.partitionBy(*keys).orderBy("task")) - F.col("c")).alias("before"))
    own = by.withColumn("own", F.row_number().over(W.partitionBy(*keys, "task").orderBy("arrival")) - 1)
    same = F.col("task") == F.col("task_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_of"))
    return own.join(before.where("before > 0"), same, "left").select(*rows.columns, (F.col("own") + F.coalesce("before", F.lit(0))).cast("long").alias(name))
