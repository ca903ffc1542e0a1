"""Boolean column expressions; all of them reach the scan as pushed filters."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, datetime, timedelta

from pyspark.sql import Column, functions as F

from lakewright.functions.columns import col


def _moment(value: str | date | datetime) -> datetime:
    if isinstance(value, datetime):
        return value
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day)
    return datetime.fromisoformat(value)


def moment_literal(value: str | date | datetime) -> Column:
    return F.lit(_moment(value).isoformat(sep=" ")).cast("timestamp_ntz")


def key_literal(value: object) -> Column:
    """A literal to compare keys with; an instant stays without time zone."""
    return moment_literal(value) if isinstance(value, datetime) else F.lit(value)


def allowed(name: str, values: Iterable) -> Column:
    """Membership; an empty list lets nothing through."""
    return col(name).isin(list(values))


def denied(name: str, values: Iterable) -> Column:
    """Non-membership by SQL logic: a null is not let through, unless nothing is denied."""
    values = list(values)
    return ~col(name).isin(values) if values else F.lit(True)


def half_open(name: str, start: str | date | datetime, end: str | date | datetime) -> Column:
    return (col(name) >= moment_literal(start)) & (col(name) < moment_literal(end))


def whole_days(name: str, first: str | date, last: str | date) -> Column:
    """Both days included whole; nulls out."""
    lo, hi = _moment(first), _moment(last)
    if lo.date() > hi.date():
        raise ValueError(f"start {first} is after end {last}")
    return half_open(name, lo.date(), hi.date() + timedelta(days=1))


def day_range(name: str, first: str | date | None, last: str | date | None) -> Column:
    """Both days included whole; None leaves a side open, whatever dates it holds."""
    if first is not None and last is not None:
        return whole_days(name, first, last)
    if first is not None:
        return col(name) >= moment_literal(_moment(first).date())
    if last is not None:
        return col(name) < moment_literal(_moment(last).date() + timedelta(days=1))
    return F.lit(True)


def equals(name: str, value: object) -> Column:
    return col(name) == key_literal(value)


def after_key(name: str, last: object) -> Column:
    return col(name) > key_literal(last)


def key_range(name: str, low: object, high: object, include_low: bool = False) -> Column:
    """``(low, high]``, or ``[low, high]`` for the first range; None leaves a side open."""
    c, test = col(name), F.lit(True)
    if low is not None:
        test = test & ((c >= key_literal(low)) if include_low else (c > key_literal(low)))
    if high is not None:
        test = test & (c <= key_literal(high))
    return test
