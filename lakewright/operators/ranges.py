"""Splitting a table into key ranges of equal row count and time ranges of equal width."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import date, datetime, timedelta
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from lakewright.functions.columns import col, quoted
from lakewright.functions.predicates import key_literal
from lakewright.operators.numbering import ntile_of, with_running_total

# Hours per time range in the conservative and in the wide setting.
NARROW_HOURS = 12
WIDE_HOURS = 48
# Fixed value: keys kept per range when boundaries are chosen from thinned keys.
THINNING = 10


def key_ranges(df: DataFrame, key: str, n: int, partitions: int | None = None) -> DataFrame:
    """About ``n`` contiguous key ranges holding nearly the same number of rows.

    The keys in order are thinned to every ``total / (10 n)``-th one, the thinned keys are cut
    into ``n`` buckets, and the largest key of each bucket but the last is a boundary. Ranges
    are ``(low, high]``; the first one includes its low end. Columns: range_id, low, high. An
    empty table gives one open range. A key more frequent than a range fills several
    boundaries, which collapse into one, so fewer ranges come back.

    Rows are counted per key first: a hot key is one counted row, and its row numbers follow
    from the running total.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    keys = df.select(col(key).alias("k")).dropna()
    low, high, total = keys.agg(F.min("k"), F.max("k"), F.count(F.lit(1))).first()
    kind = keys.schema["k"].dataType
    spark = df.sparkSession
    if total == 0 or n == 1:
        schema = T.StructType(
            [T.StructField("range_id", T.LongType()), T.StructField("low", kind), T.StructField("high", kind)]
        )
        return spark.createDataFrame([(1, low, high)], schema)
    step = max(1, total // (n * THINNING))
    thinned = F.lit(total // step).cast("bigint")
    counted = with_running_total(
        keys.groupBy("k").agg(F.count(F.lit(1)).alias("n")), ["k"], F.col("n"), "upto", partitions
    )
    # Thinned positions first..last lie inside this key; it is a boundary when a bucket ends there.
    first = F.floor((F.col("upto") - F.col("n")) / step).cast("bigint") + 1
    last = F.floor(F.col("upto") / step).cast("bigint")
    ends_bucket = ntile_of(last + 1, thinned, n) > ntile_of(first, thinned, n)
    inner = counted.filter((last >= first) & (last < thinned) & ends_bucket & (F.col("k") < key_literal(high)))
    # At most n boundaries from here on, so the ordering below is bounded by n.
    ends = inner.select(F.col("k").alias("high")).unionByName(
        spark.range(1).select(key_literal(high).cast(kind).alias("high"))
    )
    w = Window.orderBy("high")
    return ends.select(
        F.row_number().over(w).cast("bigint").alias("range_id"),
        F.coalesce(F.lag("high").over(w), key_literal(low).cast(kind)).alias("low"),
        "high",
    )


def range_predicates(ranges: DataFrame, key: str) -> list[str]:
    """The ranges as SQL predicates, one per range, for a parallel scan by key."""
    rows = ranges.orderBy("range_id").collect()
    name = quoted(key)

    def text(value: object) -> str:
        if isinstance(value, (int, float, Decimal)):
            return str(value)
        quoted_text = "'" + str(value).replace("'", "''") + "'"
        if isinstance(value, datetime):
            return f"TIMESTAMP {quoted_text}"
        return f"DATE {quoted_text}" if isinstance(value, date) else quoted_text

    out = []
    for i, row in enumerate(rows):
        parts = []
        if row["low"] is not None:
            parts.append(f"{name} {'>=' if i == 0 else '>'} {text(row['low'])}")
        if row["high"] is not None:
            parts.append(f"{name} <= {text(row['high'])}")
        out.append(" AND ".join(parts) or "1=1")
    return out


def bounds_below(key: Column, bounds: Column, count: int) -> Column:
    """How many of ``count`` sorted bounds lie below the key, found by halving: the work grows with the digits of ``count``."""
    start = F.struct(F.lit(0).alias("low"), F.lit(count).alias("high"))

    def halve(at: Column, _: Column) -> Column:
        middle = F.shiftright(at["low"] + at["high"], 1)
        done = at["low"] >= at["high"]
        above = ~done & (F.get(bounds, middle) < key)
        return F.struct(
            F.when(above, middle + 1).otherwise(at["low"]).alias("low"),
            F.when(done | above, at["high"]).otherwise(middle).alias("high"),
        )

    steps = F.sequence(F.lit(1), F.lit(max(1, count.bit_length())))
    return F.aggregate(steps, start, halve, lambda at: at["low"]).cast("bigint")


def assign_key_range(df: DataFrame, key: str, ranges: DataFrame, name: str = "range_id") -> DataFrame:
    """The number of the range a key falls into, from the boundaries as one literal array, so no join is made.

    The array holds one element per range. A row finds its range by halving.
    """
    ends = ranges.orderBy("range_id").select(F.col("high").cast("string").alias("text")).collect()[:-1]
    if not ends:
        return df.withColumn(name, F.when(col(key).isNotNull(), F.lit(1).cast("bigint")))
    # One constant for all boundaries, whatever their type: text keeps every digit of it.
    kind = ranges.schema["high"].dataType.simpleString()
    bounds = F.from_json(F.lit(json.dumps([r["text"] for r in ends])), "array<string>").cast(f"array<{kind}>")
    return df.withColumn(name, F.when(col(key).isNotNull(), bounds_below(col(key), bounds, len(ends)) + 1))


def time_ranges(
    spark: SparkSession, start: str | None, end: str | None, hours: int = NARROW_HOURS
) -> DataFrame:
    """Steps of ``hours`` from the start day, clipped at the end of the end day.

    Ranges are half open and anchored at the start, not at the epoch. Columns: range_id,
    range_start, range_end. Without dates one open range comes back.
    """
    if not start or not end:
        schema = "range_id bigint, range_start timestamp_ntz, range_end timestamp_ntz"
        return spark.createDataFrame([(1, None, None)], schema)
    first, stop = _day(start), _day(end) + timedelta(days=1)
    width = timedelta(hours=hours)
    count = max(0, -((first - stop) // width))
    lo, step = F.lit(first.isoformat(sep=" ")).cast("timestamp_ntz"), F.make_dt_interval(hours=F.lit(hours))
    upper = F.lit(stop.isoformat(sep=" ")).cast("timestamp_ntz")
    ids = spark.range(count).select((F.col("id") + 1).alias("range_id"), (lo + step * F.col("id")).alias("range_start"))
    return ids.select("range_id", "range_start", F.least(F.col("range_start") + step, upper).alias("range_end"))


def time_slot(column: str, start: str | date, hours: int) -> Column:
    """Start of the range an instant falls into: arithmetic, so no join with the range list."""
    micros = hours * 3_600_000_000
    origin = F.lit(_day(start).isoformat(sep=" ")).cast("timestamp_ntz")
    elapsed = F.timestamp_diff("MICROSECOND", origin, col(column).cast("timestamp_ntz"))
    steps = F.floor(elapsed / F.lit(micros)).cast("bigint")
    return origin + F.make_dt_interval(hours=F.lit(hours)) * steps


def _day(value: str | date) -> datetime:
    if isinstance(value, str):
        return datetime.strptime(value, "%Y-%m-%d")
    return datetime(value.year, value.month, value.day)


def equal_ranges(df: DataFrame, order_by: Sequence[str], n: int, partitions: int | None = None) -> DataFrame:
    """Exactly equal buckets of a table in key order: bucket, rows, first and last key.

    Rows are counted per key first, so a hot key is one row, which adds to every bucket it reaches into.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    keys = df.groupBy(*[col(c) for c in order_by]).agg(F.count(F.lit(1)).alias("__n"))
    total = df.count()
    counted = with_running_total(keys, list(order_by), F.col("__n"), "__upto", partitions)
    first, rows, first_row = order_by[0], F.lit(total).cast("bigint"), F.col("__upto") - F.col("__n") + 1
    buckets = F.sequence(ntile_of(first_row, rows, n), ntile_of(F.col("__upto"), rows, n))
    reached = counted.select("*", F.explode(buckets).alias("bucket"))
    small, large = total // n, total % n
    end = F.col("bucket") * small + F.least(F.col("bucket"), F.lit(large))
    begin = (F.col("bucket") - 1) * small + F.least(F.col("bucket") - 1, F.lit(large)) + 1
    inside = F.least(F.col("__upto"), end) - F.greatest(first_row, begin) + 1
    return reached.groupBy("bucket").agg(
        F.sum(inside).alias("rows"), F.min(quoted(first)).alias("low"), F.max(quoted(first)).alias("high")
    )
