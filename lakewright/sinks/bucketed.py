"""Tables laid out for their joins: both sides hashed into the same buckets on the key, and sorted by it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakewright.functions.columns import col
from lakewright.sinks.lake import parquet_options

# A task sorts one bucket when it is written, and holds a page of each side when two are joined.
ROWS_PER_BUCKET = 1_000_000


def buckets_for(*sides: DataFrame, least: int = 8, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """How many buckets tables that are joined should share: a power of two times ``least``, so that the largest has about ``rows_per_bucket`` rows each.

    Tables grow by doublings of their buckets, so those of one lake mostly agree. Parquet files are counted from their footers.
    """
    if least < 1 or rows_per_bucket < 1:
        raise ValueError("at least one bucket and one row in it are needed")
    rows, buckets = max(side.count() for side in sides), least
    while buckets * rows_per_bucket < rows:
        buckets *= 2
    return buckets


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str, mode: str = "errorifexists", options: dict[str, str] | None = None) -> None:
    """Write ``df`` as a catalog table of ``buckets`` buckets on the key, with its files under ``path``.

    Rows are shuffled by the key once, here, so that each bucket is one sorted file; joins and aggregations on the key
    with tables of as many buckets then need no shuffle and no sort, however often they run. Choose so many buckets
    that one fits a task, as ``buckets_for`` does; a key that alone outgrows one belongs in ``join_salted``.
    """
    if buckets < 1:
        raise ValueError("at least one bucket is needed")
    spread = df.repartition(buckets, col(key))
    writer = spread.write.mode(mode).format("parquet").options(**(options or parquet_options()))
    writer.option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def drop_bucketed(spark: SparkSession, table: str) -> None:
    """Take the table out of the catalog; its files stay where they are."""
    spark.sql(f"DROP TABLE IF EXISTS {table}")
