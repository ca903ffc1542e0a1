"""Row filters on whole frames: category policy, semi-join allow-lists, combined filters."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date

from pyspark.sql import DataFrame, functions as F

from lakewright.functions import predicates
from lakewright.functions.columns import col, field_type, missing

# A set of at most this many values and bytes may be broadcast; a larger one is left to a shuffled join.
BROADCAST_VALUES = 100_000
BROADCAST_BYTES = 16 * 1024 * 1024
# Bits of a Bloom filter for each value, and the most it may have: 2^28 bits are 2^22 words of 16 bytes with their place.
BLOOM_BITS, MOST_BLOOM_BITS = 16, 1 << 28


def valid_values(values: DataFrame, excluded: Iterable = ()) -> DataFrame:
    """Distinct non-null values of a one-column frame minus the excluded ones."""
    name = values.columns[0]
    excluded = [v for v in excluded if v is not None]
    kept = values.dropna()
    return (kept.filter(~col(name).isin(excluded)) if excluded else kept).distinct()


def held_values(values: DataFrame) -> tuple[DataFrame, bool]:
    """A one-column set, and whether it is small enough to broadcast.

    A small set is read once here and kept by value, so that the scan behind it is not
    repeated by every use; a larger one stays the plan it was. Bytes are summed before any value
    is sent to the driver.
    """
    few = values.limit(BROADCAST_VALUES + 1)
    size = F.octet_length(col(values.columns[0]).cast("string")).cast("bigint")
    count, size = few.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    if count > BROADCAST_VALUES or size > BROADCAST_BYTES:
        return values, False
    found = few.collect()
    return values.sparkSession.createDataFrame(found, values.schema), True


def keep_values(df: DataFrame, column: str, values: DataFrame, negate: bool = False) -> DataFrame:
    """Semi join (or anti join) with a one-column set of values of any size.

    The set is broadcast only once it is known to be small. Beyond that the join is left to
    Spark, and adaptive execution splits a partition that one hot value fills.
    """
    named, small = held_values(values.select(col(values.columns[0]).alias("__value")).dropna())
    right = F.broadcast(named) if small else named
    left = df.filter(col(column).isNotNull()) if negate else df
    return left.join(right, col(column) == F.col("__value"), "left_anti" if negate else "left_semi")


def bloom_words(values: DataFrame, bits: int) -> DataFrame:
    """A Bloom filter of a one-column set as its words that are not zero: ``__word`` (their place) and ``__set`` (64 bits).

    Bits are set inside the tasks, so a shuffle holds at most one row per word and task.
    """
    place = F.pmod(F.xxhash64(col(values.columns[0])), F.lit(bits))
    places = values.select(place.alias("place"))
    word, bit = F.floor(F.col("place") / 64).cast("bigint"), (F.col("place") % 64).cast("int")
    return places.groupBy(word.alias("__word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("__set"))


def bloom_prefilter(df: DataFrame, column: str, words: DataFrame, bits: int) -> DataFrame:
    """The rows whose value may be in the set: all that are, and about the filled share of the others. ``__set`` is not zero."""
    place = F.pmod(F.xxhash64(col(column)), F.lit(bits))
    word, bit = F.floor(place / 64).cast("bigint"), (place % 64).cast("int")
    found = df.join(F.broadcast(words), word == F.col("__word"), "inner")
    return found.filter(F.call_function("shiftright", F.col("__set"), bit).bitwiseAND(F.lit(1)) == 1).drop("__word")


def keep_values_bloom(df: DataFrame, column: str, values: DataFrame, bits: int | None = None, broadcast_small: bool = True) -> DataFrame:
    """``keep_values`` for a set too large to broadcast, when it holds a small share of the rows.

    A Bloom filter of the set, of bounded size, is broadcast and thins the rows at their scan; the exact semi join then
    shuffles only what is left. A set beyond what the filter is made for lets more rows through, never fewer.
    A set that turns out small is broadcast itself, unless ``broadcast_small`` is off.
    """
    named = values.select(col(values.columns[0]).alias("__value")).dropna()
    named, small = held_values(named) if broadcast_small else (named, False)
    if small:
        return keep_values(df, column, named)
    kind = field_type(df, column)
    # Equal values must have equal hashes: both sides are of the column's type, of which others can be no member.
    cast = named.select(F.expr(f"try_cast(__value AS {kind.simpleString()})").alias("__value")).dropna().distinct()
    if bits is None:
        count = cast.agg(F.approx_count_distinct("__value")).first()[0]
        bits = min(MOST_BLOOM_BITS, max(64, 1 << (BLOOM_BITS * count).bit_length()))
    # The words are few and needed once per task; adaptive execution reads them back from one stage.
    thinned = bloom_prefilter(df, column, bloom_words(cast, bits), bits)
    # The key depends on the filter's words: otherwise the semi join would be moved below the filter, to all rows.
    key = F.when(F.col("__set") != 0, col(column))
    return thinned.join(cast, key == F.col("__value"), "left_semi").drop("__set")


def apply_category_policy(
    df: DataFrame, column: str, valid: DataFrame, excluded: Sequence = (), mode: str = "allow"
) -> DataFrame:
    """Filter on a category column.

    ``allow``: category among the valid values. ``deny``: category not among the excluded
    values. ``open``: no filter. They differ for categories that are not among the valid
    values, so the caller chooses; the number of values never does.
    """
    if mode == "allow":
        return keep_values(df, column, valid)
    if mode == "deny":
        return df.filter(predicates.denied(column, excluded))
    if mode != "open":
        raise ValueError(f"unknown mode {mode!r}")
    return df


def select_members(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Multi-select membership: nothing selected means no filter."""
    return df.filter(predicates.allowed(column, values)) if values else df


def default_members(df: DataFrame, column: str, k: int = 5) -> list:
    """The first ``k`` distinct values in order, as the initial selection of a filter."""
    firsts = df.select(col(column).alias("v")).dropna().distinct().orderBy("v").limit(k)
    return [row[0] for row in firsts.collect()]


def only_missing(df: DataFrame, column: str) -> DataFrame:
    return df.filter(missing(column, field_type(df, column)))


def only_present(df: DataFrame, *columns: str) -> DataFrame:
    for name in columns:
        df = df.filter(~missing(name, field_type(df, name)))
    return df


def filter_table(
    df: DataFrame,
    category: str | None = None,
    values: Sequence = (),
    date_column: str | None = None,
    start: str | date | None = None,
    end: str | date | None = None,
) -> DataFrame:
    """Category and inclusive day-range filter chained on one frame.

    Choosing a date column drops rows without a date, even with both ends open.
    """
    if category is not None:
        df = select_members(df, category, values)
    if date_column is not None:
        df = df.filter(col(date_column).isNotNull())
        df = df.filter(predicates.day_range(date_column, start, end))
    return df
