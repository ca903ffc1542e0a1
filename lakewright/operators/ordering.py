"""Sorting, top-n and previews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lakewright.functions.columns import PREVIEW_COLUMNS, col, first_columns
from lakewright.operators.numbering import hashable_columns, with_row_number

# Spark merges a top n in one task; beyond this size the distributed row number is used.
ONE_TASK_ROWS = 200_000
# Fixed value: usual number of preview rows.
PREVIEW_ROWS = 10


def sort_by(df: DataFrame, *keys: str | Column) -> DataFrame:
    return df.orderBy(*[col(k) if isinstance(k, str) else k for k in keys])


def top_n(df: DataFrame, keys: Sequence[str | Column], n: int) -> DataFrame:
    """The first ``n`` rows, sorted by the keys and, where these are equal, by a hash of the row."""
    order = [col(k) if isinstance(k, str) else k for k in keys]
    hashable = hashable_columns(df)
    if n <= ONE_TASK_ROWS:
        return df.orderBy(*order, *([F.xxhash64(*hashable)] if hashable else [])).limit(n)
    return with_row_number(df, order, "__rn").filter(f"__rn <= {int(n)}").orderBy("__rn").drop("__rn")


def preview(
    df: DataFrame, rows: int = PREVIEW_ROWS, keys: Sequence[str | Column] = (), all_columns: bool = False
) -> DataFrame:
    """A few rows and, unless asked for all, the first columns; repeatable when keys are given."""
    shown = top_n(df, keys, rows) if keys else df.limit(rows)
    return shown if all_columns else first_columns(shown, PREVIEW_COLUMNS)
