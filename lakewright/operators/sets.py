"""Set operations and de-duplication."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lakewright.functions.columns import col


def set_difference(values: DataFrame, removed: DataFrame) -> DataFrame:
    """Distinct non-null values that are not in ``removed``."""
    return values.dropna().subtract(removed)


def distinct_values(df: DataFrame, column: str, ordered: bool = True) -> DataFrame:
    values = df.select(col(column)).dropna().distinct()
    return values.orderBy(col(column)) if ordered else values


def keep_first(df: DataFrame, keys: Sequence[str], position: Sequence[str | Column]) -> DataFrame:
    """The first row of every key in position order.

    Spark turns the rank filter into a limit per key before the shuffle, so a key with any
    number of copies sends one row per task.
    """
    order = [col(p) if isinstance(p, str) else p for p in position]
    rank = F.row_number().over(Window.partitionBy(*[col(k) for k in keys]).orderBy(*order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def concat_chunks(*chunks: DataFrame) -> DataFrame:
    """Chunks appended by column name; a column a chunk lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), chunks)
