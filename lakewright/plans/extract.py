"""The extraction job: categories, filtered join, cleaning, partitioned write, manifest."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lakewright.functions import predicates
from lakewright.functions.columns import col
from lakewright.operators.clean import CleanPlan, plan_clean
from lakewright.operators.filters import apply_category_policy, held_values, valid_values
from lakewright.operators.joins import join_salted, star_with_prefix
from lakewright.operators.ranges import time_slot
from lakewright.plans.config import ExtractConfig
from lakewright.session import drop_folder, folders_like, new_path
from lakewright.sinks.lake import (
    extraction_id,
    manifest,
    parquet_options,
    read_dataset,
    write_manifest,
    write_partitioned,
)


@dataclass(frozen=True)
class ExtractResult:
    extraction_id: str
    path: str
    data: DataFrame
    partitions: DataFrame


def joined_rows(fact: DataFrame, detail: DataFrame, categories: DataFrame, config: ExtractConfig) -> DataFrame:
    """Fact rows of the wanted days joined to detail rows of the wanted categories.

    All filters sit below the join, on the side they belong to, and reach the scans.
    """
    if bool(config.start) != bool(config.end):
        raise ValueError("give both days of the range or neither")
    if config.date_column and config.start and config.end:
        stop = date.fromisoformat(config.end) + timedelta(days=1)
        fact = fact.filter(predicates.half_open(config.date_column, config.start, stop))
    if config.partition_column and config.partition_value is not None:
        side_is_fact = config.partition_column in fact.columns
        test = predicates.equals(config.partition_column, config.partition_value)
        fact, detail = (fact.filter(test), detail) if side_is_fact else (fact, detail.filter(test))
    valid = valid_values(categories, config.excluded)
    detail = apply_category_policy(detail, config.category, valid, config.excluded, config.category_mode)
    columns = list(config.detail_columns)
    if config.partition_column and config.partition_column not in fact.columns and config.partition_column not in columns:
        columns.append(config.partition_column)
    shape = (fact, detail, config.fact_key, config.detail_key, columns, config.prefix)
    return join_salted(*shape, share=config.hot_share) if config.hot_share else star_with_prefix(*shape)


def run_extract(
    spark: SparkSession,
    fact: DataFrame,
    detail: DataFrame,
    categories: DataFrame,
    config: ExtractConfig,
    lake: str,
) -> ExtractResult:
    """Join, clean, write under ``lake/table`` and write the manifest beside the data.

    Without a fixed schema the joined rows are staged once in the shared folder: deciding the
    types and writing then read columnar files instead of joining twice.

    Date folders keep the first run's anchor, so that later runs name them alike. A run replaces
    the folders of its days and partition value; of a folder it covers in part the other rows
    are kept, and a folder that has become empty goes. Data and manifest are those of this run's folders.
    """
    path = f"{lake}/{config.table}"
    valid, _ = held_values(valid_values(categories, config.excluded))
    rows = joined_rows(fact, detail, valid, config)
    staged = None
    if config.schema is not None:
        cleaned = CleanPlan(config.schema).apply(rows)
    else:
        staged = new_path(spark, "joined")
        rows.write.parquet(staged)
        rows = spark.read.parquet(staged)
        cleaned = plan_clean(rows, config.min_ratio, config.strict_types).apply(rows)
    column = _partition_column(fact, config)
    slot, run_days, of_run = None, None, F.lit(True)
    if config.date_column and config.start and config.end:
        anchor = _anchor(spark, lake, config)
        slot = time_slot(config.date_column, anchor, config.hours)
        run_days = _slots(anchor, config)
        of_run = F.col("date").between(*run_days.names)
    if column and config.partition_value is not None:
        of_run = of_run & (col(column) == str(config.partition_value))
    kept, existing = None, []
    if run_days:
        existing = _folders_of_run(spark, path, run_days.names, column, config)
        if existing:
            kept = new_path(spark, "kept")
            cleaned = _with_kept_rows(spark, cleaned, path, run_days, of_run, config, kept)
    name = extraction_id(spark, config.table, config.start, config.end, config.excluded)
    before = {folder: folders_like(spark, f"{folder}/*.parquet") for folder, _ in existing}
    by = write_partitioned(
        cleaned,
        path,
        date=slot,
        partition_columns=[column] if column else [],
        mode="overwrite" if slot is not None or column or config.replace else "errorifexists",
        dynamic=slot is not None or column is not None,
        sort_by=[config.fact_key],
        target_file_bytes=config.target_file_bytes,
        options=parquet_options(
            config.codec, config.level, config.dictionary_columns, config.row_group_rows, cleaned.columns
        ),
    )
    # A folder that still has its old files has got no row of this run.
    for folder, files in before.items():
        if folders_like(spark, f"{folder}/*.parquet") == files:
            drop_folder(spark, folder)
    for folder in (staged, kept):
        if folder:
            drop_folder(spark, folder)
    if by and not folders_like(spark, f"{path}/{by[0]}=*"):
        return ExtractResult(name, path, *_nothing(spark, cleaned, by))
    written = read_dataset(spark, path).filter(of_run) if by else read_dataset(spark, path)
    folder = F.concat_ws("/", *[F.concat(F.lit(f"{c}="), F.coalesce(col(c), F.lit("__HIVE_DEFAULT_PARTITION__"))) for c in by])
    partitions = manifest(written, by).withColumns({"partition_id": folder, "path": F.concat(F.lit(f"{path}/"), folder)})
    write_manifest(
        partitions,
        manifest_path(lake, config, name),
        {
            "extraction_id": name,
            "partition_column": column,
            "partition_value": None if config.partition_value is None else str(config.partition_value),
            "excluded_categories": ",".join(sorted(config.excluded)),
            "valid_categories_count": valid.count(),
            "date_range": f"{config.start} to {config.end}" if config.start else "all",
            "compression": config.codec,
            "row_group_rows": config.row_group_rows,
            "completed": True,
            **config.facts,
        },
    )
    return ExtractResult(name, path, written, partitions)


def manifest_path(lake: str, config: ExtractConfig, name: str) -> str:
    """Where a run's manifest lies: runs of the same days for several partition values have one each."""
    value = "" if config.partition_value is None else "-" + quote(str(config.partition_value), safe="")
    return f"{lake}/_manifests/{config.table}/{name}{value}"


def extraction_runs(spark: SparkSession, lake: str, table: str) -> DataFrame:
    """The facts and totals of all runs of a table, one row per manifest."""
    return spark.read.json(f"{lake}/_manifests/{table}/*/run")


def extraction_partitions(spark: SparkSession, lake: str, table: str) -> DataFrame:
    """The partitions of all runs of a table, with the manifest each is listed in."""
    manifest_name = F.regexp_extract(F.col("_metadata.file_path"), "/([^/]+)/partitions/[^/]*$", 1)
    return spark.read.json(f"{lake}/_manifests/{table}/*/partitions").withColumn("manifest", manifest_name)


def _nothing(spark: SparkSession, cleaned: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Data and partitions of a run that found no row in a dataset without any; such a run has no manifest."""
    fields = [f for f in cleaned.schema.fields if f.name not in by] + [T.StructField(c, T.StringType()) for c in by]
    counts = [T.StructField(c, T.LongType()) for c in ("rows_processed", "files_written", "bytes_written")]
    texts = [T.StructField(c, T.StringType()) for c in ("partition_id", "path")]
    return spark.createDataFrame([], T.StructType(fields)), spark.createDataFrame([], T.StructType(fields[-len(by) :] + counts + texts))


@dataclass(frozen=True)
class _Slots:
    start: datetime
    stop: datetime
    names: tuple[str, str]
    partial: bool


def _partition_column(fact: DataFrame, config: ExtractConfig) -> str | None:
    """The name of the partition column in the joined rows."""
    name = config.partition_column
    return name if name is None or name in fact.columns else config.prefix + name


def _anchor(spark: SparkSession, lake: str, config: ExtractConfig) -> str:
    """The day at which the date folders of a table begin: that of its first run, kept beside its manifests."""
    path = f"{lake}/_manifests/{config.table}/_layout"
    if folders_like(spark, f"{path}/_SUCCESS"):
        kept = spark.read.json(path, schema="anchor string, hours int").first()
        if kept.hours != config.hours:
            raise ValueError(f"the date folders of {config.table} are {kept.hours} hours wide, not {config.hours}")
        return kept.anchor
    layout = spark.range(1).select(F.lit(config.start).alias("anchor"), F.lit(config.hours).alias("hours"))
    layout.coalesce(1).write.mode("overwrite").json(path)
    return config.start


def _slots(anchor: str, config: ExtractConfig) -> _Slots:
    """The run's days, the names of their first and last date folder, and whether these reach beyond the days."""
    origin, width = datetime.fromisoformat(anchor), timedelta(hours=config.hours)
    start, stop = datetime.fromisoformat(config.start), datetime.fromisoformat(config.end) + timedelta(days=1)
    first = origin + (start - origin) // width * width
    last = origin + (stop - timedelta(microseconds=1) - origin) // width * width
    names = (first.strftime("%Y-%m-%d_%H"), last.strftime("%Y-%m-%d_%H"))
    return _Slots(start, stop, names, first < start or last + width > stop)


def _folders_of_run(
    spark: SparkSession, path: str, names: tuple[str, str], column: str | None, config: ExtractConfig
) -> list[tuple[str, tuple]]:
    """The folders of the run's slots and partition value that are there, with their keys."""
    out = []
    for folder in folders_like(spark, f"{path}/date=*" + (f"/{column}=*" if column else "")):
        keys = tuple(unquote(part.split("=", 1)[1]) for part in folder.split("/")[-2 if column else -1 :])
        keys = tuple(None if k == "__HIVE_DEFAULT_PARTITION__" else k for k in keys)
        own = column is None or config.partition_value is None or keys[-1] == str(config.partition_value)
        if own and names[0] <= keys[0] <= names[1]:
            out.append((folder, keys))
    return out


def _with_kept_rows(
    spark: SparkSession, cleaned: DataFrame, path: str, days: _Slots, of_run: Column, config: ExtractConfig, copy: str
) -> DataFrame:
    """The run's rows and those rows of its outer folders that lie beyond its days, which are written aside first."""
    if not days.partial:
        return cleaned
    instant = col(config.date_column)
    beyond = (instant < predicates.moment_literal(days.start)) | (instant >= predicates.moment_literal(days.stop))
    old = read_dataset(spark, path).filter(of_run & F.col("date").isin(*days.names) & beyond)
    old.drop("date").write.parquet(copy)
    kept = spark.read.parquet(copy)
    types = {f.name: f.dataType for f in cleaned.schema.fields}
    text = [c for c in kept.columns if c in types and isinstance(kept.schema[c].dataType, T.StringType)]
    return cleaned.unionByName(kept.withColumns({c: col(c).cast(types[c]) for c in text}), allowMissingColumns=True)
