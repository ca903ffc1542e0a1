"""Column expressions that clean single values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Texts that stand for a missing value, case-sensitive and untrimmed.
NULL_TOKENS = ("nan", "None", "<NA>")
# Fixed value: the empty text counts as missing only where a schema is applied.
SCHEMA_NULL_TOKENS = (*NULL_TOKENS, "")

# What counts as a number, an integer and a date in text. The guards make the cast agree
# with other engines: Spark alone would read "1d" or a bare year.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INTEGER_PATTERN = r"^\s*[+-]?\d+\s*$"
DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$"


def finite(c: Column) -> Column:
    """Infinities and NaN become null."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def without_tokens(c: Column, tokens: tuple[str, ...] = NULL_TOKENS) -> Column:
    return F.when(~c.isin(*tokens), c)


def parse_number(c: Column) -> Column:
    """Text to double; anything that is not a plain finite number becomes null."""
    return finite(F.when(c.rlike(NUMBER_PATTERN), F.trim(c).try_cast("double")))


def parse_integer(c: Column) -> Column:
    return F.when(c.rlike(INTEGER_PATTERN), F.trim(c).try_cast("bigint"))


def parse_moment(c: Column) -> Column:
    """ISO text to a timestamp without time zone; bad text becomes null."""
    return F.when(c.rlike(DATE_PATTERN), c.try_cast("timestamp_ntz"))


def key_to_integer(c: Column, is_text: bool) -> Column:
    """A key column as bigint; what does not fit becomes null."""
    return parse_integer(c) if is_text else c.try_cast("bigint")


def partition_text(c: Column) -> Column:
    """An instant as ``yyyy-MM-dd_HH``, a fixed format.

    Put together from its fields: a format function would first move an instant without time
    zone into the session's zone, where some hours do not exist.
    """
    return F.concat(c.cast("date").cast("string"), F.lit("_"), F.lpad(F.hour(c).cast("string"), 2, "0"))


def day_start(text: str) -> Column:
    """A ``yyyy-MM-dd`` literal as the first instant of the day."""
    return F.lit(text).cast("date").cast("timestamp_ntz")
