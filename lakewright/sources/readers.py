"""Readers and whole-dataset facts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lakewright.functions.columns import col, quoted
from lakewright.session import settings


# Quoting as in RFC 4180, which other tools write and read.
CSV_FORMAT = {
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


FOOTER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.BooleanType)


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | str | None = None,
    options: Mapping[str, object] | None = None,
    multi_line: bool | None = None,
) -> DataFrame:
    """CSV with a header row, quotes doubled inside quoted text, spaces kept.

    Without a schema Spark reads the data once more to infer it; instants are then read without
    a time zone. A file with a line break inside quoted text can only be read whole, by one task. Unless the caller
    says which it is, a pass over the lines looks for such breaks, and files without them are split.
    """
    if multi_line is None:
        multi_line = has_quoted_breaks(spark, path, options)
    reader = spark.read.option("header", True).options(**CSV_FORMAT).option("multiLine", multi_line)
    reader = reader.options(**dict(options or {}))
    if schema is not None:
        return reader.schema(schema).csv(path)
    with settings(spark, {"spark.sql.timestampType": "TIMESTAMP_NTZ"}):
        return reader.option("inferSchema", True).csv(path)


def has_quoted_breaks(spark: SparkSession, path: str | Sequence[str], options: Mapping[str, object] | None = None) -> bool:
    """Whether a line of the files has an odd number of quotes, as where quoted text goes on in the next.

    Lines are read in splits, and the search stops at the first find. With other quoting than ours the answer is yes.
    """
    given = {k.lower(): v for k, v in dict(options or {}).items()}
    if any(given.get(k, CSV_FORMAT[k]) != CSV_FORMAT[k] for k in ("quote", "escape")) or not {"linesep", "encoding", "charset"}.isdisjoint(given):
        return True
    kept = {k: v for k, v in dict(options or {}).items() if k.lower() in ("pathglobfilter", "recursivefilelookup")}
    lines = spark.read.options(**kept).text(path)
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return not lines.filter(quotes % 2 == 1).isEmpty()


def read_values(df: DataFrame, column: str) -> DataFrame:
    """The set of non-null values of one column; the scan reads that column only."""
    return df.select(col(column)).dropna().distinct()


def jdbc_options(
    url: str,
    table: str | None = None,
    query: str | None = None,
    fetch_size: int = 50_000,
    key: str | None = None,
    bounds: tuple[object, object] | None = None,
    splits: int | None = None,
    session_init: str | None = None,
    properties: Mapping[str, str] | None = None,
) -> dict[str, str]:
    """Options for the built-in JDBC source; with key, bounds and splits it reads in parallel."""
    if (table is None) == (query is None):
        raise ValueError("give either a table or a query")
    parallel = (key, bounds, splits)
    if any(x is not None for x in parallel) and any(x is None for x in parallel):
        raise ValueError("a parallel read needs key, bounds and splits together")
    if query is not None and key is not None:
        table, query = f"({query}) q", None
    options = {"url": url, "fetchsize": str(fetch_size), **dict(properties or {})}
    options["dbtable" if table is not None else "query"] = table if table is not None else query
    if key is not None:
        options |= {
            "partitionColumn": key,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(splits),
        }
    if session_init:
        options["sessionInitStatement"] = session_init
    return options


def jdbc_predicate_call(url: str, table: str, predicates: Sequence[str], properties: Mapping[str, str] | None = None, **kwargs) -> dict[str, object]:
    """Arguments of ``spark.read.jdbc`` for one partition per predicate, such as those of ``range_predicates``.

    The predicates must leave no row out and share none; the first range of ``range_predicates`` includes its low end.
    """
    if not predicates:
        raise ValueError("give at least one predicate")
    if any(not p.strip() for p in predicates):
        raise ValueError("an empty predicate would read the whole table")
    options = jdbc_options(url, table=table, properties=properties, **kwargs)
    if "partitionColumn" in options:
        raise ValueError("give either predicates or a key with bounds")
    return {"url": url, "table": table, "predicates": list(predicates), "properties": {k: v for k, v in options.items() if k not in ("url", "dbtable")}}


def read_jdbc(spark: SparkSession, predicates: Sequence[str] | None = None, **kwargs) -> DataFrame:
    """Scan of a database table through Spark's JDBC source; see ``jdbc_options`` and ``jdbc_predicate_call``."""
    if predicates is not None:
        return spark.read.jdbc(**jdbc_predicate_call(predicates=predicates, **kwargs))
    return spark.read.format("jdbc").options(**jdbc_options(**kwargs)).load()


def footer_facts(spark: SparkSession, path: str | Sequence[str], *names: str) -> DataFrame:
    """Row count and bounds of columns of Parquet files from their footers alone: ``total_rows, min_<name>, max_<name>``.

    The aggregates are pushed into the scan, for columns whose footers hold exact bounds: integers, dates and booleans;
    others are an error, as they would be read (the bounds of texts may be cut short, those of doubles leave NaN out). A session
    of its own keeps the settings for this to itself.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    files = own.read.parquet(*([path] if isinstance(path, str) else path))
    for name in names:
        if not isinstance(files.schema[name].dataType, FOOTER_TYPES):
            raise ValueError(f"footers hold no exact bounds of {name}")
    bounds = [f(quoted(n)).alias(f"{x}_{n}") for n in names for x, f in (("min", F.min), ("max", F.max))]
    return files.agg(F.count(F.lit(1)).alias("total_rows"), *bounds)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_rows"))


def overview(df: DataFrame, full_rows: int | None = None) -> DataFrame:
    """Rows, columns, names, and bytes of a dataset read from files.

    ``full_rows`` is the size of the dataset ``df`` was sampled from: the share of the sample
    and the bytes scaled to the full size follow from it. Bytes come from the file metadata,
    so the scan reads no data column. ``df`` must be an unprojected file scan.
    """
    files = df.groupBy(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")
    ).agg(F.count(F.lit(1)).alias("rows"))
    totals = files.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("sample_rows"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("file_bytes"),
        F.count(F.lit(1)).alias("files"),
    )
    rows = F.col("sample_rows")
    full = F.lit(full_rows).cast("bigint") if full_rows is not None else rows
    return totals.select(
        full.alias("total_rows"),
        "sample_rows",
        F.round(F.try_divide(rows * 100.0, full.cast("double")), 2).alias("sample_pct"),
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.lit(", ".join(df.columns)).alias("column_names"),
        "files",
        "file_bytes",
        F.round(F.try_divide(F.col("file_bytes") * full.cast("double"), rows.cast("double")), 0)
        .cast("bigint")
        .alias("estimated_full_bytes"),
    )


def column_bounds(df: DataFrame, *names: str) -> DataFrame:
    """Minimum and maximum of each named column, in one row."""
    parts = []
    for name in names:
        parts += [F.min(quoted(name)).alias(f"min_{name}"), F.max(quoted(name)).alias(f"max_{name}")]
    return df.agg(*parts)
