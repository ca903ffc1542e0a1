"""Fact and detail joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lakewright.functions.columns import col, quoted
from lakewright.operators.numbering import hashable_columns
from lakewright.session import new_path


def star_with_prefix(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    right_columns: Sequence[str],
    prefix: str = "tb2_",
    how: str = "inner",
) -> DataFrame:
    """Equi join returning every left column and the chosen right columns under a prefix.

    The join strategy is Spark's choice: broadcast, shuffled hash or sort-merge by size.
    """
    l, r = left.alias("l"), right.select(*[col(c) for c in dict.fromkeys([right_key, *right_columns])]).alias("r")
    condition = F.col(f"l.{quoted(left_key)}") == F.col(f"r.{quoted(right_key)}")
    return l.join(r, condition, how).select(
        *[F.col(f"l.{quoted(c)}") for c in left.columns],
        *[F.col(f"r.{quoted(c)}").alias(prefix + c) for c in right_columns],
    )


def hot_keys(df: DataFrame, key: str, share: float = 0.01) -> list:
    """Keys that hold at least ``share`` of the rows; at most ``1 / share`` of them exist.

    One pass over the table: the total is the sum of the counts, which are staged.
    """
    if not 0 < share < 1:
        raise ValueError("share lies between 0 and 1")
    path = new_path(df.sparkSession, "key-counts")
    df.groupBy(col(key).alias("k")).agg(F.count(F.lit(1)).alias("n")).write.parquet(path)
    counts = df.sparkSession.read.parquet(path)
    total = counts.agg(F.sum("n")).first()[0] or 0
    return [row.k for row in counts.filter(F.col("k").isNotNull() & (F.col("n") >= F.lit(share * total))).collect()]


def join_salted(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    right_columns: Sequence[str],
    prefix: str = "tb2_",
    how: str = "inner",
    share: float = 0.01,
    salts: int = 32,
) -> DataFrame:
    """``star_with_prefix`` with the hot keys of the left side spread over ``salts`` tasks.

    Left rows of a hot key get a salt from a hash of the row; the few right rows of these keys
    are repeated once per salt. All other rows keep salt 0, so the result is the same. For
    ``inner`` and ``left`` joins, where the left row decides.
    """
    if how not in ("inner", "left"):
        raise ValueError("salting supports inner and left joins")
    hot = hot_keys(left, left_key, share)
    if not hot:
        return star_with_prefix(left, right, left_key, right_key, right_columns, prefix, how)
    row_hash = F.xxhash64(*hashable_columns(left))
    l = left.withColumn(
        "__salt",
        F.when(col(left_key).isin(hot), F.pmod(row_hash, F.lit(salts)).cast("int")).otherwise(F.lit(0)),
    ).alias("l")
    copies = F.when(col(right_key).isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    needed = dict.fromkeys([right_key, *right_columns])
    r = right.select(*[col(c) for c in needed], F.explode(copies).alias("__salt")).alias("r")
    condition = (F.col(f"l.{quoted(left_key)}") == F.col(f"r.{quoted(right_key)}")) & (
        F.col("l.__salt") == F.col("r.__salt")
    )
    return l.join(r, condition, how).select(
        *[F.col(f"l.{quoted(c)}") for c in left.columns],
        *[F.col(f"r.{quoted(c)}").alias(prefix + c) for c in right_columns],
    )


def count_distinct_over_optional(
    base: DataFrame,
    linked: DataFrame,
    optional: DataFrame,
    base_link: Column,
    optional_link: Column,
    group_by: Sequence[str],
    counted: str,
    name: str = "distinct_count",
) -> DataFrame:
    """``base JOIN linked LEFT JOIN optional``, then a distinct count per group.

    Groups without an optional row count 0. Spark aggregates on (group, value) first, so a
    hot group is spread over its values before they are counted.
    """
    joined = base.join(linked, base_link).join(optional, optional_link, "left")
    return joined.groupBy(*[col(g) for g in group_by]).agg(F.count_distinct(col(counted)).alias(name))
