"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.session import new_path, settings

# White space of the word rules: a blank and the characters U+0009 to U+000D.
SPACE = r" \t\n\x0B\f\r"


# What Spark hands to Python at once. It keeps as much again, up to twice, outside its heap for each task, where 64 MB are the
# default; with texts that was a tenth of an executor's memory.
ARROW_BYTES = 8 << 20


def small_batches(spark: SparkSession):
    """For what is run inside the block, batches of at most about ``ARROW_BYTES`` go to Python."""
    return settings(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": ARROW_BYTES})


def staged(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """The frame written to the shared folder and read back, so that its lineage ends there."""
    path = new_path(spark, label)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bytes_of_text(text: pa.Array) -> list[bytes]:
    """UTF-8 bytes per text; a missing text is empty."""
    return [b"" if x is None else x for x in text.cast(pa.large_binary()).to_pylist()]


def crc_of_id(column: str):
    """crc32 of the id written as text, as an unsigned number."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def batches(frames: Iterable[pa.RecordBatch], limit: int, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of at most ``limit`` bytes of text each, or of one row where a row is larger.

    Bounds the memory of a task whatever the batch size of the session is. What Arrow holds back goes with the last one,
    as the worker may idle beside the stages that follow.
    """
    for batch in frames:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < len(sizes):
            yield batch.slice(start)
    pa.default_memory_pool().release_unused()
