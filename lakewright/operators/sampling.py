"""Random, head, systematic and stratified samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from lakewright.functions.columns import col
from lakewright.operators.numbering import hashable_columns, with_row_number, with_running_total
from lakewright.operators.ordering import top_n
from lakewright.operators.quantiles import order_statistic

# Fixed value: rows in a sample unless told otherwise.
SAMPLE_ROWS = 1_000_000
# Tables of at most this many rows (files, strata) may be broadcast, after a count.
BROADCAST_ROWS = 100_000


def random_sample(df: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 42, total: int | None = None) -> DataFrame:
    """About ``rows`` rows; all of them when the table is smaller."""
    total = df.count() if total is None else total
    return df if total <= rows else df.sample(False, rows / total, seed)


def exact_sample(df: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 42) -> DataFrame:
    """Exactly ``rows`` random rows, the same ones on every run; all rows of a smaller table.

    Every row has a number from a hash of itself and the seed. The bound below which so many lie is found by counting,
    so no row is moved or sorted for it. Only rows at the bound itself, equal rows, need an order.
    """
    if rows < 1:
        return df.limit(0)
    columns = hashable_columns(df)
    # 52 bits of the hash are exact in a double.
    drawn = F.shiftright(F.xxhash64(*columns, F.lit(seed)), 12)
    bound = order_statistic(df.select(drawn.alias("drawn")), "drawn", rows - 1)
    if bound is None:
        return df
    limit = F.lit(int(bound)).cast("bigint")
    below = df.filter(drawn < limit)
    missing = rows - below.count()
    equal = with_row_number(df.filter(drawn == limit), [F.xxhash64(*columns, F.lit(seed + 1))], "__place")
    return below.unionByName(equal.filter(F.col("__place") <= missing).drop("__place"))


def keyed_sample(df: DataFrame, key: str, per_mille: int) -> DataFrame:
    """A repeatable share of the rows, chosen by mixing an integer key.

    The key is reduced before the multiplication so that no id overflows.
    """
    mixed = F.pmod(F.pmod(col(key), F.lit(1_000_003)) * F.lit(2_654_435_761), F.lit(1000))
    return df.filter(mixed < per_mille)


def head_sample(df: DataFrame, rows: int, order_by: Sequence[str | Column]) -> DataFrame:
    return top_n(df, order_by, rows)


def with_file_position(df: DataFrame, name: str = "position") -> DataFrame:
    """1-based position of a row in a Parquet dataset, files in path order.

    The scan delivers the row index inside each file; the rows of earlier files are added. The
    table itself is not shuffled while its file list is small enough to broadcast.
    """
    path, index = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    files = df.groupBy(path.alias("__path")).agg((F.max(index) + 1).alias("rows"))
    upto = with_running_total(files, ["__path"], F.col("rows"), "upto")
    offsets = upto.select("__path", (F.col("upto") - F.col("rows")).alias("__offset"))
    if offsets.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    placed = df.select("*", path.alias("__path"), index.alias("__index")).join(offsets, "__path")
    return placed.select(*[col(c) for c in df.columns], (F.col("__offset") + F.col("__index") + 1).alias(name))


def systematic_sample(
    df: DataFrame, rows: int, order_by: Sequence[str | Column] = (), total: int | None = None
) -> DataFrame:
    """Every ``total // rows``-th row, at most ``rows`` of them.

    Positions follow ``order_by``, or the order in the Parquet files when none is given.
    """
    total = df.count() if total is None else total
    step = max(1, total // rows)
    placed = with_row_number(df, order_by, "__pos") if order_by else with_file_position(df, "__pos")
    kept = (F.col("__pos") % step == 0) & (F.col("__pos") <= step * rows)
    return placed.filter(kept).drop("__pos")


def stratified_random(
    df: DataFrame, stratum: str, fractions: Mapping, seed: int = 42, default: float | None = None
) -> DataFrame:
    """About the given share of each stratum, in one scan.

    A stratum without a share, null among them, has the ``default``; without one it is an error.
    """
    listed = F.coalesce(col(stratum).isin(list(fractions)), F.lit(False))
    if default is None and not df.filter(~listed).isEmpty():
        raise ValueError("some strata have no share; list them or give a default")
    share = F.lit(default or 0.0)
    for value, fraction in fractions.items():
        share = F.when(col(stratum) == F.lit(value), F.lit(fraction)).otherwise(share)
    return df.filter(F.rand(seed) < share)


def stratified_sample(
    df: DataFrame, stratum: str, fraction: float, order_by: Sequence[str | Column]
) -> DataFrame:
    """Exactly the first ``ceil(fraction * rows)`` rows of each stratum in key order.

    Ranks inside a stratum come from the row number over (stratum, key), so a stratum that
    holds most of the table is still spread over all tasks.
    """
    numbered = with_row_number(df, [col(stratum), *order_by], "__rn")
    strata = numbered.groupBy(col(stratum).alias("__s")).agg(
        F.min("__rn").alias("__first"), F.ceil(F.count(F.lit(1)) * F.lit(Decimal(str(fraction)))).cast("bigint").alias("__take")
    )
    if strata.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        strata = F.broadcast(strata)
    joined = numbered.join(strata, col(stratum).eqNullSafe(F.col("__s")))
    return joined.filter(F.col("__rn") < F.col("__first") + F.col("__take")).select(*[col(c) for c in df.columns])
