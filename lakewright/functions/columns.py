"""Choosing columns by type class, position or name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

FLOATS = (T.FloatType, T.DoubleType)
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TEXT = (T.StringType, T.CharType, T.VarcharType)
MOMENTS = (T.DateType, T.TimestampType, T.TimestampNTZType)

# Name parts that mark a column as a date candidate, compared in lower case.
DATE_NAME_PARTS = ("date", "time")
# Preview width, charted numeric columns, charted categorical columns.
PREVIEW_COLUMNS = 10
MAX_NUMERIC_CHARTS = 20
MAX_CATEGORY_CHARTS = 10


def quoted(name: str) -> str:
    """Backtick form, for names with dots, spaces or leading digits."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def numeric_columns(df: DataFrame, limit: int | None = None) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)][:limit]


def categorical_columns(df: DataFrame, limit: int | None = None) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, TEXT)][:limit]


def moment_columns(df: DataFrame, limit: int | None = None) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, MOMENTS)][:limit]


def first_columns(df: DataFrame, k: int = PREVIEW_COLUMNS) -> DataFrame:
    """Projection on the first ``k`` columns."""
    return df.select(*[col(name) for name in df.columns[:k]])


def date_candidates(df: DataFrame, epoch_unit: str | None = None) -> list[str]:
    """Columns that may hold dates: dated by type, or text whose name says so.

    A numeric column is a candidate only when ``epoch_unit`` tells how to read it.
    """
    names = []
    for field in df.schema.fields:
        named = any(part in field.name.lower() for part in DATE_NAME_PARTS)
        readable = isinstance(field.dataType, TEXT) or (
            epoch_unit is not None and isinstance(field.dataType, INTEGERS)
        )
        if isinstance(field.dataType, MOMENTS) or (named and readable):
            names.append(field.name)
    return names


def field_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def missing(name: str, data_type: T.DataType) -> Column:
    """True for null, and for NaN in floating columns."""
    c = col(name)
    return c.isNull() | F.isnan(c) if isinstance(data_type, FLOATS) else c.isNull()


def present(name: str, data_type: T.DataType) -> Column:
    """The column with NaN turned into null."""
    c = col(name)
    return F.when(~F.isnan(c), c) if isinstance(data_type, FLOATS) else c


def as_double(name: str, data_type: T.DataType) -> Column:
    return present(name, data_type).cast("double")


def one_row(df: DataFrame, parts: Sequence[Column]) -> DataFrame:
    """The aggregates in one row, with the row count as ``n``."""
    return df.agg(F.count(F.lit(1)).alias("n"), *parts)


def long_form(wide: DataFrame, key: str, rows: Sequence[tuple[str, Sequence[tuple[str, Column]]]]) -> DataFrame:
    """One output row per (label, fields) for every input row; meant for one-row aggregates."""
    if not rows:
        return wide.select(F.lit(None).cast("string").alias(key)).limit(0)
    structs = [
        F.struct(F.lit(label).alias(key), *[value.alias(name) for name, value in fields])
        for label, fields in rows
    ]
    return wide.select(F.inline(F.array(*structs)))
