"""Incremental extraction: keyset steps, high-water marks, and the streaming form."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from lakewright.functions import predicates
from lakewright.functions.cleaning import partition_text
from lakewright.functions.columns import col, quoted
from lakewright.operators.clean import apply_schema
from lakewright.operators.filters import keep_values
from lakewright.operators.ordering import top_n
from lakewright.sinks.lake import parquet_options, write_partitioned
from lakewright.sinks.versions import VersionedDataset


def keyset_chunk(df: DataFrame, key: str, last: object | None, rows: int, keep_ties: bool = True) -> DataFrame:
    """The next ``rows`` rows after key ``last`` in key order.

    With ``keep_ties`` the chunk also takes the remaining rows of its last key, so that no row
    of a repeated key is lost when the next chunk starts after that key.
    """
    rest = df if last is None else df.filter(predicates.after_key(key, last))
    if not keep_ties:
        return top_n(rest, [key], rows)
    end = high_water_mark(top_n(rest.select(col(key)), [key], rows), key)
    return rest.filter(predicates.key_range(key, None, end)) if end is not None else rest.limit(0)


def high_water_mark(df: DataFrame, key: str) -> object | None:
    return df.agg(F.max(quoted(key))).first()[0]


def append_new(df: DataFrame, key: str, path: str, **kwargs) -> object | None:
    """Append the rows above the highest key already in the dataset; returns the new mark.

    The mark is read from the committed files themselves, so it never runs ahead of or behind
    them, and a second run without new rows writes nothing.
    """
    spark = df.sparkSession
    try:
        mark = high_water_mark(spark.read.parquet(path), key)
    except AnalysisException as error:
        # Only a dataset that is not there yet has no mark; anything else is a fault.
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        mark = None
    new = df if mark is None else df.filter(predicates.after_key(key, mark))
    top = high_water_mark(new, key)
    if top is None:
        return mark
    # The upper end is fixed too: rows that arrive meanwhile wait for the next run.
    write_partitioned(new.filter(predicates.key_range(key, None, top)), path, mode="append", **kwargs)
    return top


def stream_files(
    spark: SparkSession, folder: str, schema: T.StructType, glob: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    """Parquet files of a folder as a stream; files that arrive later become new batches."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def extract_stream(
    stream: DataFrame,
    category: str,
    valid: DataFrame,
    date_column: str,
    start: str,
    end: str,
    schema: T.StructType | None = None,
    errors_column: str | None = None,
) -> DataFrame:
    """The extraction on a stream: allow-list, half-open dates, coercion to a fixed schema.

    Rows are filtered one by one, so the stream keeps no state.
    """
    kept = keep_values(stream.filter(predicates.half_open(date_column, start, end)), category, valid)
    return apply_schema(kept, schema, errors_column) if schema is not None else kept


def run_stream(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    date: Column | None = None,
    partition_columns: Sequence[str] = (),
    on_started: Callable[[StreamingQuery], None] | None = None,
) -> StreamingQuery:
    """Process all files that are there and stop. The checkpoint remembers what was read, so a
    later run takes only new files; the file sink commits each batch exactly once."""
    by = list(partition_columns)
    if date is not None:
        stream = stream.withColumn("date", partition_text(date))
        by = ["date", *by]
    writer = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    writer = writer.option("path", path).option("checkpointLocation", checkpoint).options(**parquet_options())
    query = (writer.partitionBy(*by) if by else writer).start()
    if on_started:
        on_started(query)
    query.awaitTermination()
    return query


def run_committed_stream(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    date: Column | None = None,
    partition_columns: Sequence[str] = (),
    writer: str | None = None,
    on_started: Callable[[StreamingQuery], None] | None = None,
    **kwargs,
) -> StreamingQuery:
    """Process all files that are there into a versioned dataset, one commit a batch, and stop.

    The commit holds the number of the batch, so a batch that is delivered again after a failure adds nothing, and the
    output has no log of the file sink: compaction, backfill and any batch reader work on it. The writer's name is the id
    that the checkpoint keeps for the query, unless one is given; a new checkpoint is a new writer.
    """

    def commit(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        name = writer or spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        VersionedDataset(spark, path, date, partition_columns).append(batch, name, number, **kwargs)

    query = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if on_started:
        on_started(query)
    query.awaitTermination()
    return query
