"""Map a DataFrame's Arrow batches through a function of one text column, keeping other columns by position."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import fresh, small_batches


def map_text(docs: DataFrame, keep: Sequence[str], make: Callable[[], Callable[[pa.Array], list[pa.Array]]], schema: str, text: str = "text") -> DataFrame:
    """The columns to keep, then those that the made function gives for the texts of each batch.

    make runs once per task, on the executor. Kept columns must not be named as those of the schema.
    """
    small_batches(docs.sparkSession)
    own = fresh("text_read", keep)
    kept = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(own))
    given = kept.drop(own).schema
    out = StructType.fromDDL(schema)
    names = [f.name for f in given] + [f.name for f in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *apply(b.column(b.num_columns - 1))], names=names)
            del b
            pa.default_memory_pool().release_unused()

    return kept.mapInArrow(run, StructType([*given.fields, *out.fields]))
