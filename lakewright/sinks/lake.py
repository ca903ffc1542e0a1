"""Partitioned Parquet datasets: tuned writes, compaction, manifest, idempotent backfill."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lakewright.functions.cleaning import partition_text
from lakewright.functions.columns import col
from lakewright.session import drop_folder, folders_like, new_path, settings

# Codec, level, and rows per row group of the conservative and the wide setting.
CODEC, LEVEL = "zstd", 6
WIDE_CODEC = "snappy"
ROW_GROUP_ROWS = 671_000
WIDE_ROW_GROUP_ROWS = 1_000_000

TARGET_FILE_BYTES = 256 * 1024 * 1024


def parquet_options(
    codec: str = CODEC,
    level: int | None = LEVEL,
    dictionary_columns: Sequence[str] | None = None,
    row_group_rows: int | None = ROW_GROUP_ROWS,
    columns: Sequence[str] = (),
) -> dict[str, str]:
    """Writer options. Statistics and the page index are always written by Spark's writer.

    ``dictionary_columns`` restricts dictionaries to these of ``columns``; None leaves the
    choice to the writer.
    """
    options = {"compression": codec}
    if codec == "zstd" and level is not None:
        options["parquet.compression.codec.zstd.level"] = str(level)
    if row_group_rows:
        options["parquet.block.row.count.limit"] = str(row_group_rows)
    if dictionary_columns is not None:
        for name in columns:
            options[f"parquet.enable.dictionary#{name}"] = str(name in dictionary_columns).lower()
    return options


def write_partitioned(
    df: DataFrame,
    path: str,
    date: Column | None = None,
    partition_columns: Sequence[str] = (),
    mode: str = "errorifexists",
    sort_by: Sequence[str] = (),
    rows_per_file: int | None = None,
    target_file_bytes: int = TARGET_FILE_BYTES,
    options: Mapping[str, str] | None = None,
    dynamic: bool = False,
    rebalance: bool | None = None,
) -> list[str]:
    """Write ``date=<yyyy-MM-dd_HH>/<column>=<value>`` folders; returns the partition columns.

    ``date`` is the instant that names the date folder. The rebalance hint brings the rows of
    one folder together and adaptive execution splits a folder that outgrows the target size,
    so neither a hot date nor a thousand tiny files result. Small shuffle partitions are merged
    only for a dataset without folders: with folders that saves no file, only parallelism.
    A dataset without folders is written as it is partitioned, with no shuffle, unless
    ``rebalance`` asks for files of the target size. ``dynamic`` replaces only the folders
    present in ``df``, which makes a rerun idempotent.
    """
    by = list(partition_columns)
    if date is not None:
        df = df.withColumn("date", partition_text(date))
        by = ["date", *by]
    rebalance = bool(by) if rebalance is None else rebalance
    spread = df.hint("rebalance", *[col(c) for c in by]) if rebalance else df
    if sort_by:
        spread = spread.sortWithinPartitions(*[col(c) for c in [*by, *sort_by]])
    writer = spread.write.mode(mode).options(**dict(options or parquet_options()))
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if dynamic:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    if by:
        writer = writer.partitionBy(*by)
    spark = df.sparkSession
    sizing = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": target_file_bytes}
    if by:
        # Merging off would also switch off its own initial partition count, if one is set.
        count = spark.conf.get("spark.sql.shuffle.partitions")
        sizing |= {
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.shuffle.partitions": spark.conf.get(
                "spark.sql.adaptive.coalescePartitions.initialPartitionNum", None
            )
            or count,
        }
    with settings(spark, sizing):
        writer.parquet(path)
    return by


def refuse_stream_output(spark: SparkSession, path: str) -> None:
    """Raise for the output of the file sink of a stream: its log, not its folders, says what is read."""
    if folders_like(spark, f"{path}/_spark_metadata"):
        raise ValueError(f"{path} is written by a stream, whose log would hide or miss the replaced files; compact to a new path")


def backfill(df: DataFrame, path: str, date: Column, **kwargs) -> list[str]:
    """Write a set of ranges in one job, replacing exactly the date folders they touch."""
    refuse_stream_output(df.sparkSession, path)
    return write_partitioned(df, path, date=date, mode="overwrite", dynamic=True, **kwargs)


def compact(
    spark: SparkSession,
    source: str,
    target: str,
    partition_columns: Sequence[str] = (),
    sort_by: Sequence[str] = (),
    target_file_bytes: int = TARGET_FILE_BYTES,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Rewrite a dataset of many small files into files of about the target size.

    The result goes to a new path, so readers of the source are not disturbed and a failed run
    loses nothing; the old files are the caller's to drop. ``sort_by`` keeps the row order.
    """
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("compaction needs a target other than its source")
    write_partitioned(
        _read_text_partitions(spark, source),
        target,
        partition_columns=partition_columns,
        sort_by=sort_by,
        target_file_bytes=target_file_bytes,
        options=options,
        rebalance=True,
    )
    return _read_text_partitions(spark, target)


def compact_in_place(
    spark: SparkSession, path: str, partition_columns: Sequence[str], sort_by: Sequence[str] = (), **kwargs
) -> None:
    """Compact the folders of a partitioned dataset that need it, under its own path.

    These are the folders of more files than their bytes fill, with a mean size below the
    target. Their compacted copy is written beside the dataset first and then replaces them, so
    a path is never read and overwritten at once; all other folders stay as they are.
    """
    if not partition_columns:
        raise ValueError("in-place compaction replaces partition folders")
    refuse_stream_output(spark, path)
    data, target = _read_text_partitions(spark, path), kwargs.get("target_file_bytes", TARGET_FILE_BYTES)
    folders = manifest(data, partition_columns)
    loose = folders.filter((F.col("bytes_written") < F.col("files_written") * target) & (F.ceil(F.col("bytes_written") / target) < F.col("files_written")))
    # Kept by value, one row per folder: the dataset changes below.
    listed = new_path(spark, "loose-folders")
    loose.select(*[col(c).alias(f"__{i}") for i, c in enumerate(partition_columns)]).write.parquet(listed)
    loose = spark.read.parquet(listed)
    if loose.isEmpty():
        return
    same = [col(c).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(partition_columns)]
    shape = {"partition_columns": partition_columns, "sort_by": sort_by, **kwargs}
    copy = new_path(spark, "compacted")
    write_partitioned(data.join(loose, same, "left_semi"), copy, **shape)
    write_partitioned(_read_text_partitions(spark, copy), path, mode="overwrite", dynamic=True, **shape)
    drop_folder(spark, copy)
    drop_folder(spark, listed)


def _read_text_partitions(spark: SparkSession, path: str) -> DataFrame:
    """Read with folder values as text, so that rewriting gives the same folder names."""
    with settings(spark, {"spark.sql.sources.partitionColumnTypeInference.enabled": "false"}):
        return spark.read.parquet(path)


def read_dataset(spark: SparkSession, path: str, text_partitions: bool = True) -> DataFrame:
    return _read_text_partitions(spark, path) if text_partitions else spark.read.parquet(path)


def extraction_id(
    spark: SparkSession, table: str, start: str | None, end: str | None, excluded: Iterable[str] = ()
) -> str:
    """First eight hex digits of the md5 of the extraction's settings; equal runs, equal id."""
    return spark.range(1).select(extraction_id_of(F.lit(table), start, end, excluded)).first()[0]


def extraction_id_of(table: Column, start: str | None, end: str | None, excluded: Iterable[str] = ()) -> Column:
    parts = [table, F.lit(str(start)), F.lit(str(end)), F.lit(",".join(sorted(excluded)))]
    return F.substring(F.md5(F.concat_ws("_", *parts)), 1, 8)


def manifest(df: DataFrame, partition_columns: Sequence[str] = ("date",)) -> DataFrame:
    """Rows, files and bytes per partition folder of a written dataset, from its own files."""
    by = [col(c) for c in partition_columns]
    files = df.groupBy(*by, F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    return files.groupBy(*by).agg(
        F.sum("rows").alias("rows_processed"),
        F.count(F.lit(1)).alias("files_written"),
        F.sum("size").alias("bytes_written"),
    )


def run_totals(partitions: DataFrame) -> DataFrame:
    """Rows, files and partitions of a run."""
    return partitions.agg(
        F.coalesce(F.sum("rows_processed"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum("files_written"), F.lit(0)).alias("total_files"),
        F.count(F.lit(1)).alias("total_partitions"),
    )


def write_manifest(partitions: DataFrame, path: str, facts: Mapping[str, object]) -> None:
    """The run's facts and totals as one JSON record, its partitions as JSON lines beside it."""
    spark = partitions.sparkSession
    totals = run_totals(partitions).first().asDict()
    values = {**facts, **totals}
    record = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items() if v is not None])
    partitions.write.mode("overwrite").json(f"{path}/partitions")
    record.write.mode("overwrite").json(f"{path}/run")
