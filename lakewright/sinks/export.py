"""CSV export and the stored profile report."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from lakewright.sources.readers import CSV_FORMAT

# Without these Spark writes milliseconds only.
_MICROSECONDS = {
    "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
}


def write_csv(
    df: DataFrame,
    path: str,
    single_file_rows: int | None = None,
    mode: str = "errorifexists",
    options: Mapping[str, object] | None = None,
) -> None:
    """CSV with a header in every file, no index; null and empty text both come out empty.

    ``single_file_rows`` asks for one file, written by one task, of at most so many rows.
    """
    if single_file_rows is not None:
        if df.limit(single_file_rows + 1).count() > single_file_rows:
            raise ValueError(f"more than {single_file_rows} rows for a single CSV file")
        # A shuffle to one task, so that the work before it stays parallel.
        df = df.repartition(1)
    writer = df.write.mode(mode).option("header", True).option("emptyValue", "").options(**CSV_FORMAT, **_MICROSECONDS)
    writer.options(**dict(options or {})).csv(path)


def write_report(tables: Mapping[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """Each table of a profile as Parquet in a folder of its name."""
    for name, table in tables.items():
        table.write.mode(mode).parquet(f"{path}/{name}")
