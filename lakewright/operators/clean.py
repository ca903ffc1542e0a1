"""Cleaning a table: text to numbers, missing tokens, narrow types, a fixed schema.

What a column becomes depends on its data, so one aggregate over the whole table decides for
all columns and one projection applies it. The decision does not depend on row order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lakewright.functions.cleaning import (
    INTEGER_PATTERN,
    NUMBER_PATTERN,
    SCHEMA_NULL_TOKENS,
    finite,
    key_to_integer,
    parse_integer,
    parse_moment,
    parse_number,
    without_tokens,
)
from lakewright.functions.columns import FLOATS, INTEGERS, TEXT, col, date_candidates, field_type, one_row

_INFINITE_PATTERN = r"(?i)^\s*[+-]?inf(inity)?\s*$"
# With what a text that any of the patterns takes can begin: white space, a sign, a point, a digit, or an i.
_FIRST = tuple(map(ord, "\t\n\x0b\f\r +-.0123456789iI"))
_SHORT = (-(2**15), 2**15 - 1)
_INT = (-(2**31), 2**31 - 1)


@dataclass(frozen=True)
class CleanPlan:
    """Target type per column, in table order."""

    schema: T.StructType

    def apply(self, df: DataFrame) -> DataFrame:
        return apply_schema(df, self.schema)


def narrowest_integer(low: int | None, high: int | None) -> T.DataType:
    """Smallest of 16, 32 and 64 bits whose limits the values stay strictly inside."""
    if low is None or high is None:
        return T.IntegerType()
    if low > _SHORT[0] and high < _SHORT[1]:
        return T.ShortType()
    if low > _INT[0] and high < _INT[1]:
        return T.IntegerType()
    return T.LongType()


def plan_clean(df: DataFrame, min_ratio: float = 1.0, strict_types: bool = False) -> CleanPlan:
    """Decide the cleaned type of every column with one pass over the data.

    A text column becomes a number when at least ``min_ratio`` of its values that are not
    missing tokens parse as one: an integer when all are whole and none is missing, else a
    double. Integers get the narrowest type, floats become doubles. ``strict_types`` turns
    every type outside text, numbers and timestamps into text.
    """
    parts: list[Column] = []
    for i, f in enumerate(df.schema.fields):
        c = col(f.name)
        if isinstance(f.dataType, INTEGERS):
            parts += [F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
        elif isinstance(f.dataType, TEXT):
            t = without_tokens(c, SCHEMA_NULL_TOKENS)
            # Most texts are told by their first character; the patterns look at the others only.
            likely = F.when(F.ascii(t).isin(*_FIRST), t)
            whole = parse_integer(likely)
            parts += [
                F.count(t).alias(f"present{i}"),
                F.count_if(likely.rlike(NUMBER_PATTERN)).alias(f"number{i}"),
                F.count_if(likely.rlike(_INFINITE_PATTERN)).alias(f"infinite{i}"),
                F.count(whole).alias(f"whole{i}"),
                F.min(whole).alias(f"lo{i}"),
                F.max(whole).alias(f"hi{i}"),
            ]
    row = one_row(df, parts).first()

    def target(i: int, t: T.DataType) -> T.DataType:
        if isinstance(t, INTEGERS):
            return narrowest_integer(row[f"lo{i}"], row[f"hi{i}"])
        if isinstance(t, FLOATS):
            return T.DoubleType()
        if isinstance(t, TEXT):
            number, parsed = row[f"number{i}"], row[f"number{i}"] + row[f"infinite{i}"]
            if not number or parsed < min_ratio * row[f"present{i}"]:
                return T.StringType()
            if row[f"whole{i}"] == row["n"]:
                return narrowest_integer(row[f"lo{i}"], row[f"hi{i}"])
            return T.DoubleType()
        if isinstance(t, T.TimestampNTZType) or not strict_types:
            return t
        if isinstance(t, T.DecimalType):
            return T.DoubleType()
        return T.TimestampNTZType() if isinstance(t, T.DateType) else T.StringType()

    return CleanPlan(
        T.StructType([T.StructField(f.name, target(i, f.dataType)) for i, f in enumerate(df.schema.fields)])
    )


def clean(df: DataFrame, min_ratio: float = 1.0, strict_types: bool = False) -> DataFrame:
    """The whole cleaning: decide in one pass, then one projection. Repeating it changes nothing."""
    return plan_clean(df, min_ratio, strict_types).apply(df)


def _coerced(c: Column, have: T.DataType, want: T.DataType) -> Column:
    text = isinstance(have, TEXT)
    if isinstance(want, INTEGERS):
        if text:
            c = F.coalesce(parse_integer(c), parse_number(c).try_cast("bigint"))
        elif isinstance(have, FLOATS):
            c = finite(c)
        return c.try_cast(want)
    if isinstance(want, FLOATS):
        return (parse_number(c) if text else finite(c.try_cast("double"))).cast(want)
    if isinstance(want, TEXT):
        if isinstance(have, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        return without_tokens(c.cast("string"), SCHEMA_NULL_TOKENS)
    if isinstance(want, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return (parse_moment(c) if text else c).try_cast(want)
    return c if have == want else c.try_cast(want)


def apply_schema(df: DataFrame, schema: T.StructType, errors_column: str | None = None) -> DataFrame:
    """Coerce columns to a given schema; values that do not fit become null.

    Columns the schema names and the table lacks are skipped, further columns are kept.
    ``errors_column`` adds the names of the columns whose value was lost in the row. Works on
    streams too, since nothing depends on the data.
    """
    wanted = {f.name: f.dataType for f in schema.fields}
    outputs, lost = [], []
    for f in df.schema.fields:
        c = col(f.name)
        if f.name not in wanted:
            outputs.append(c)
            continue
        new = _coerced(c, f.dataType, wanted[f.name])
        outputs.append(new.alias(f.name))
        given = c.isNotNull() & ~F.isnan(c) if isinstance(f.dataType, FLOATS) else c.isNotNull()
        if isinstance(f.dataType, TEXT):
            given = given & ~c.isin(*SCHEMA_NULL_TOKENS)
        lost.append(F.when(given & new.isNull(), F.lit(f.name)))
    if errors_column:
        outputs.append(F.array_compact(F.array(*lost)).alias(errors_column))
    return df.select(*outputs)


def null_infinities(df: DataFrame) -> DataFrame:
    return df.select(
        *[finite(col(f.name)).alias(f.name) if isinstance(f.dataType, FLOATS) else col(f.name) for f in df.schema.fields]
    )


def null_tokens(df: DataFrame, columns: Sequence[str] | None = None, empty_too: bool = False) -> DataFrame:
    tokens = SCHEMA_NULL_TOKENS if empty_too else SCHEMA_NULL_TOKENS[:-1]
    chosen = set(columns) if columns is not None else {f.name for f in df.schema.fields if isinstance(f.dataType, TEXT)}
    return df.select(
        *[without_tokens(col(c), tokens).alias(c) if c in chosen else col(c) for c in df.columns]
    )


def text_to_number(df: DataFrame, columns: Sequence[str] | None = None, min_ratio: float = 1.0) -> DataFrame:
    """Text columns whose values are numbers become numbers; the others stay."""
    chosen = list(columns) if columns is not None else [f.name for f in df.schema.fields if isinstance(f.dataType, TEXT)]
    planned = plan_clean(df.select(*[col(c) for c in chosen]), min_ratio).schema
    numbers = [f for f in planned.fields if not isinstance(f.dataType, TEXT)]
    return apply_schema(df, T.StructType(numbers))


def narrow_integers(df: DataFrame) -> DataFrame:
    chosen = [f.name for f in df.schema.fields if isinstance(f.dataType, INTEGERS)]
    return apply_schema(df, plan_clean(df.select(*[col(c) for c in chosen])).schema) if chosen else df


def floats_to_double(df: DataFrame) -> DataFrame:
    fields = [T.StructField(f.name, T.DoubleType()) for f in df.schema.fields if isinstance(f.dataType, FLOATS)]
    return apply_schema(df, T.StructType(fields))


def keys_to_integer(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key columns as the narrowest integer; keys that are not numbers become null."""
    as_long = df.select(
        *[
            key_to_integer(col(c), isinstance(field_type(df, c), TEXT)).alias(c) if c in keys else col(c)
            for c in df.columns
        ]
    )
    return apply_schema(as_long, plan_clean(as_long.select(*[col(k) for k in keys])).schema)


def parse_dates(
    df: DataFrame, columns: Sequence[str] | None = None, epoch_unit: str | None = None, formats: Sequence[str] = ()
) -> tuple[DataFrame, list[str]]:
    """Date candidates parsed whole column or not at all, and the names of the usable ones.

    One pass counts the values that fail to parse; a text column with any stays as it is and
    is not offered. ``epoch_unit`` ('s', 'ms' or 'us') reads integer candidates as epochs.
    ``formats`` are further patterns of text, tried after the ISO form in the order given: a column takes the
    first that fits all its values. Patterns with a zone give the instant's time in the session's zone.
    """
    scale = {"s": 1_000_000, "ms": 1_000, "us": 1, None: 1}[epoch_unit]
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    parsed: dict[str, list[Column]] = {}
    usable: list[str] = []
    for name in columns if columns is not None else date_candidates(df, epoch_unit):
        kind = field_type(df, name)
        if isinstance(kind, TEXT):
            text = F.when(col(name) != "", col(name))
            parsed[name] = [parse_moment(text), *[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats]]
        elif isinstance(kind, INTEGERS):
            parsed[name] = [origin + F.make_dt_interval(secs=F.lit(1)) * (col(name) * F.lit(scale) / F.lit(1e6))]
        usable.append(name)
    chosen: dict[str, Column] = {}
    if parsed:
        failures = [
            F.count_if(col(n).isNotNull() & (col(n).cast("string") != "") & way.isNull()).alias(f"f{i}_{j}")
            for i, (n, ways) in enumerate(parsed.items())
            for j, way in enumerate(ways)
        ]
        row = one_row(df, failures).first()
        for i, (n, ways) in enumerate(parsed.items()):
            fits = [way for j, way in enumerate(ways) if not row[f"f{i}_{j}"]]
            if fits:
                chosen[n] = fits[0]
        usable = [n for n in usable if n in chosen or n not in parsed]
    return df.select(*[chosen[c].alias(c) if c in chosen else col(c) for c in df.columns]), usable
