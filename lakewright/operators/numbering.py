"""Row numbers over a whole table without a single-task window.

A window without a partition key moves every row to one task. Here Spark range-partitions
and sorts the rows, the sorted rows are written to the shared folder with their position
inside their partition, and the rows of earlier partitions are added. Written rows keep their
numbers however often the result is read or an executor is lost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lakewright.functions.columns import col
from lakewright.session import new_path

_SLOT = "__slot"
_PART = "__part"
_OFFSET = "__offset"
# monotonically_increasing_id: partition number above bit 33, position in it below.
_POSITION_BITS = 33


def hashable_columns(df: DataFrame) -> list[Column]:
    """The columns a hash can be taken of: all without maps."""
    return [col(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()]


def _written_in_order(df: DataFrame, order: Sequence[Column], partitions: int | None) -> DataFrame:
    spark = df.sparkSession
    # A hash of the row comes last in the order: rows of a hot key can then be split over tasks,
    # and equal keys are ordered the same way whenever a task is repeated.
    hashable = hashable_columns(df)
    order = [*order, F.xxhash64(*hashable)] if hashable else list(order)
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    path = new_path(spark, "ordered")
    ranged.sortWithinPartitions(*order).withColumn(_SLOT, F.monotonically_increasing_id()).write.parquet(path)
    slot = F.col(_SLOT)
    return spark.read.parquet(path).select(
        *[col(name) for name in df.columns],
        slot.bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)).alias(_SLOT),
        F.shiftright(slot, _POSITION_BITS).alias(_PART),
    )


def _as_columns(order_by: Sequence[str | Column]) -> list[Column]:
    return [col(o) if isinstance(o, str) else o for o in order_by]


def with_row_number(
    df: DataFrame, order_by: Sequence[str | Column], name: str = "row_number", partitions: int | None = None
) -> DataFrame:
    """Global 1-based row number in the given order.

    Rows that ``order_by`` does not tell apart are ordered by a hash of the row, which also
    lets several tasks share a hot key. Select the needed columns first, since every column of
    ``df`` is shuffled and written once.
    """
    ordered = _written_in_order(df, _as_columns(order_by), partitions)
    # One row per shuffle partition: bounded by the partition setting, not by the data.
    sizes = ordered.groupBy(_PART).agg((F.max(_SLOT) + 1).alias("rows"))
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(_PART, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias(_OFFSET))
    return ordered.join(F.broadcast(offsets), _PART).select(
        *[col(c) for c in df.columns], (F.col(_SLOT) + F.col(_OFFSET) + 1).alias(name)
    )


def with_running_total(
    df: DataFrame,
    order_by: Sequence[str | Column],
    weight: Column,
    name: str = "running_total",
    partitions: int | None = None,
) -> DataFrame:
    """Sum of ``weight`` over all rows up to and including this one, in the given order."""
    ordered = _written_in_order(df.withColumn("__weight", weight), _as_columns(order_by), partitions)
    sums = ordered.groupBy(_PART).agg(F.sum("__weight").alias("total"))
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(_PART, F.coalesce(F.sum("total").over(before), F.lit(0)).alias(_OFFSET))
    inside = Window.partitionBy(_PART).orderBy(_SLOT).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ordered.withColumn("__inside", F.sum("__weight").over(inside))
        .join(F.broadcast(offsets), _PART)
        .select(*[col(c) for c in df.columns], (F.col("__inside") + F.col(_OFFSET)).alias(name))
    )


def with_total(df: DataFrame, name: str = "total_rows") -> DataFrame:
    """The number of all rows on every row, counted once beforehand."""
    return df.withColumn(name, F.lit(df.count()).cast("bigint"))


def ntile_of(row_number: Column, total: Column, n: int) -> Column:
    """The SQL NTILE bucket from a row number: the first ``total % n`` buckets get one more row."""
    small = F.floor(total / F.lit(n)).cast("bigint")
    large_buckets = total % F.lit(n)
    in_large = large_buckets * (small + 1)
    return F.when(row_number <= in_large, F.floor((row_number - 1) / (small + 1)).cast("bigint") + 1).otherwise(
        large_buckets + F.floor((row_number - 1 - in_large) / F.greatest(small, F.lit(1))).cast("bigint") + 1
    )


def with_ntile(
    df: DataFrame, order_by: Sequence[str | Column], n: int, name: str = "bucket", partitions: int | None = None
) -> DataFrame:
    """NTILE over the whole table, from the distributed row number and the row count."""
    if n < 1:
        raise ValueError("n must be at least 1")
    total = df.count()
    numbered = with_row_number(df, order_by, "__rn", partitions)
    bucket = ntile_of(F.col("__rn"), F.lit(total), n)
    return numbered.select(*[col(c) for c in df.columns], bucket.alias(name))


def with_chunk_id(
    df: DataFrame, order_by: Sequence[str | Column], rows: int, name: str = "chunk_id", partitions: int | None = None
) -> DataFrame:
    """Number of the fixed-size chunk a row falls into when the table is cut in key order."""
    numbered = with_row_number(df, order_by, "__rn", partitions)
    chunk = F.floor((F.col("__rn") - 1) / F.lit(rows)).cast("bigint")
    return numbered.select(*[col(c) for c in df.columns], chunk.alias(name))
