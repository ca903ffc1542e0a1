"""Exact quantiles with linear interpolation, at any size.

Spark's exact ``percentile`` keeps a value-to-count map of the whole column in one task, which
only a small table allows. Here the wanted order statistics are enclosed instead: a sample
proposes bounds around each of them, and one scan counts what lies below the bounds and gathers
the few values between them. A rank outside its bounds, or bounds with too much between them,
shrinks the interval by exact counts and the next round goes on there. So a poor sample costs a
round, never a wrong result; no column is shuffled and no task holds one.

Every column has its own small aggregate, joined by a union: the scan reads one column for it,
and the columns are worked on side by side.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lakewright.functions.columns import as_double, field_type

# Sampled values per interval and round.
SAMPLE_VALUES = 50_000
# Values of one interval that may be gathered to pick a rank.
GATHERED_VALUES = 200_000


@dataclass
class _Target:
    """Where the value of 0-based ``rank`` is: strictly between two bounds, or known."""

    column: str
    rank: int
    count: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    value: float | None = None

    @property
    def interval(self) -> tuple:
        return self.column, self.low, self.high

    def inside(self) -> Column:
        c = F.col(self.column)
        test = c.isNotNull()
        if self.low is not None:
            test = test & (c > F.lit(self.low))
        if self.high is not None:
            test = test & (c < F.lit(self.high))
        return test


@dataclass
class _Cluster:
    """Neighbouring ranks of one interval. They share proposed bounds, ends included."""

    targets: list[_Target]
    low: float = -math.inf
    high: float = math.inf
    expected: float = 0.0

    @property
    def first(self) -> _Target:
        return self.targets[0]


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    gathered_values: int = GATHERED_VALUES,
    sample_values: int = SAMPLE_VALUES,
) -> dict[str, list[float | None]]:
    """Quantiles per column over its non-null, non-NaN values; None for an empty column.

    The result has one number per column and probability, so it is safe on the driver, where
    the next pass takes it as literals.
    """
    columns, probabilities = list(columns), list(probabilities)
    if not columns:
        return {}
    values = df.select(*[as_double(c, field_type(df, c)).alias(f"c{i}") for i, c in enumerate(columns)])
    names = values.columns
    counts = values.agg(*[F.count(n).alias(n) for n in names]).first().asDict()
    ranks = {n: sorted({r for p in probabilities for r in _neighbours(p, counts[n])}) for n in names}
    targets = [_Target(n, r, counts[n]) for n in names for r in ranks[n]]
    while open_ := [t for t in targets if t.value is None]:
        _narrow(values, _clusters(open_), gathered_values, sample_values)
    found = {(t.column, t.rank): t.value for t in targets}

    def at(name: str, p: float) -> float | None:
        if not counts[name]:
            return None
        lo, hi = _neighbours(p, counts[name])
        part = p * (counts[name] - 1) - lo
        a, b = found[name, lo], found[name, hi]
        return a if a == b else a * (1 - part) + b * part

    return {c: [at(n, p) for p in probabilities] for c, n in zip(columns, names)}


def _neighbours(p: float, count: int) -> tuple[int, ...]:
    if not count:
        return ()
    position = p * (count - 1)
    return math.floor(position), math.ceil(position)


def _clusters(targets: list[_Target]) -> list[_Cluster]:
    clusters: list[_Cluster] = []
    for t in sorted(targets, key=lambda t: (t.column, t.rank)):
        last = clusters[-1].targets[-1] if clusters else None
        if last is not None and last.interval == t.interval and t.rank - last.rank <= 1:
            clusters[-1].targets.append(t)
        else:
            clusters.append(_Cluster([t]))
    return clusters


def _narrow(values: DataFrame, clusters: list[_Cluster], gathered_values: int, sample_values: int) -> None:
    _propose(values, [c for c in clusters if c.first.count > gathered_values], sample_values)
    _gather(values, [c for c in clusters if c.expected <= gathered_values])
    _count_sides(values, [c for c in clusters if any(t.value is None for t in c.targets)])


def _per_column(clusters: Iterable[_Cluster]) -> dict[str, list[_Cluster]]:
    found: dict[str, list[_Cluster]] = {}
    for c in clusters:
        found.setdefault(c.first.column, []).append(c)
    return found


def _collect(numbers: dict[str, DataFrame]) -> dict[str, list[float | None]]:
    """The one-row frames of all columns, each a few numbers, in one job."""
    labelled = [
        frame.select(F.lit(name).alias("name"), F.array(*[F.col(c).cast("double") for c in frame.columns]).alias("numbers"))
        for name, frame in numbers.items()
    ]
    return {r["name"]: r["numbers"] for r in reduce(DataFrame.unionByName, labelled).collect()}


def _sorted_lists(wanted: list[Column]) -> list[Column]:
    return [F.sort_array(F.collect_list(c)) for c in wanted]


def _propose(values: DataFrame, clusters: list[_Cluster], sample_values: int) -> None:
    """Two sampled values per cluster that should enclose its ranks, and how much is between."""
    if not clusters:
        return
    frames = {}
    for name, mine in _per_column(clusters).items():
        first = {c.first.interval: c.first for c in mine}
        place = {interval: f"s{k}" for k, interval in enumerate(first)}
        drawn = values.select(name, F.rand(17).alias("r")).select(
            *[
                F.when((F.col("r") < sample_values / t.count) & t.inside(), F.col(name)).alias(place[t.interval])
                for t in first.values()
            ]
        )
        some = drawn.filter(F.coalesce(*[F.col(s) for s in drawn.columns]).isNotNull())
        samples = some.agg(*[s.alias(n) for s, n in zip(_sorted_lists([F.col(s) for s in drawn.columns]), drawn.columns)])
        picks = []
        for c in mine:
            t, sample = c.first, F.col(place[c.first.interval])
            ends = []
            for rank, sign in ((t.rank, -1), (c.targets[-1].rank, 1)):
                share = (rank - t.below + 0.5) / t.count
                spread = 4 * math.sqrt(max(share * (1 - share), 1 / sample_values) / sample_values)
                spot = F.floor(F.lit(min(1.0, max(0.0, share + sign * spread))) * F.size(sample)).cast("int")
                ends.append(F.get(sample, F.least(spot, F.size(sample) - 1)))
            between = F.try_divide(_count_between(sample, *ends) * F.lit(float(t.count)), F.size(sample).cast("double"))
            picks += [*ends, between]
        frames[name] = samples.select(*[p.alias(f"p{k}") for k, p in enumerate(picks)])
    rows = _collect(frames)
    empty = []
    for name, mine in _per_column(clusters).items():
        for k, c in enumerate(mine):
            c.low, c.high, c.expected = rows[name][3 * k : 3 * k + 3]
            if c.low is None:
                empty.append(c)
    if empty:
        # An empty sample proposes nothing; the smallest value of the interval does instead.
        least = values.agg(*[F.min(F.when(c.first.inside(), F.col(c.first.column))) for c in empty]).first()
        for c, value in zip(empty, least):
            c.low = c.high = value
            c.expected = math.inf


def _count_between(values: Column, low: Column, high: Column) -> Column:
    return F.size(F.filter(values, lambda x: (x >= low) & (x <= high)))


def _gather(values: DataFrame, clusters: list[_Cluster]) -> None:
    """Collect the few values between the bounds and pick the ranks that lie there."""
    if not clusters:
        return
    frames = {}
    for name, mine in _per_column(clusters).items():
        v = F.col(name)
        between = [c.first.inside() & (v >= c.low) & (v <= c.high) for c in mine]
        lists = values.select(
            *[F.when(b, v).alias(f"v{k}") for k, b in enumerate(between)],
            *[(c.first.inside() & (v < c.low)).alias(f"b{k}") for k, c in enumerate(mine)],
        ).agg(
            *[s.alias(f"s{k}") for k, s in enumerate(_sorted_lists([F.col(f"v{k}") for k in range(len(mine))]))],
            *[F.count_if(f"b{k}").alias(f"n{k}") for k in range(len(mine))],
        )
        picks = [
            F.get(F.col(f"s{k}"), (F.lit(t.rank - t.below) - F.col(f"n{k}")).cast("int"))
            for k, c in enumerate(mine)
            for t in c.targets
        ]
        frames[name] = lists.select(*[p.alias(f"p{k}") for k, p in enumerate(picks)])
    rows = _collect(frames)
    for name, mine in _per_column(clusters).items():
        for t, value in zip([t for c in mine for t in c.targets], rows[name]):
            t.value = value


def _count_sides(values: DataFrame, clusters: list[_Cluster]) -> None:
    """Replace the interval of every target by the part of it that holds its rank."""
    if not clusters:
        return
    frames = {}
    for name, mine in _per_column(clusters).items():
        v, counters = F.col(name), []
        for k, c in enumerate(mine):
            counters += [
                F.count_if(c.first.inside() & (v < c.low)).alias(f"a{k}"),
                F.count_if(v == c.low).alias(f"ea{k}"),
                F.count_if((v > c.low) & (v < c.high)).alias(f"m{k}"),
                F.count_if(v == c.high).alias(f"eb{k}"),
            ]
        frames[name] = values.agg(*counters)
    rows = _collect(frames)
    for name, mine in _per_column(clusters).items():
        for k, c in enumerate(mine):
            left, at_low, middle, at_high = (int(x) for x in rows[name][4 * k : 4 * k + 4])
            if c.low == c.high:
                middle = at_high = 0
            upto_low, upto_high = left + at_low, left + at_low + middle
            for t in c.targets:
                offset = t.rank - t.below
                if offset < left:
                    t.high, t.count = c.low, left
                elif offset < upto_low:
                    t.value = c.low
                elif offset < upto_high:
                    t.low, t.high, t.below, t.count = c.low, c.high, t.below + upto_low, middle
                elif offset < upto_high + at_high:
                    t.value = c.high
                else:
                    t.low, t.below, t.count = c.high, t.below + upto_high + at_high, t.count - upto_high - at_high


def order_statistic(df: DataFrame, column: str, rank: int, gathered_values: int = GATHERED_VALUES, sample_values: int = SAMPLE_VALUES) -> float | None:
    """The value of a 0-based rank among the non-null values in order; None where there are not so many."""
    values = df.select(as_double(column, field_type(df, column)).alias("c0"))
    count = values.agg(F.count("c0")).first()[0]
    if not 0 <= rank < count:
        return None
    target = _Target("c0", rank, count)
    while target.value is None:
        _narrow(values, _clusters([target]), gathered_values, sample_values)
    return target.value


def quantile_table(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], **limits) -> DataFrame:
    """The quantiles as rows: column, probability, value."""
    found = exact_quantiles(df, columns, probabilities, **limits)
    rows = [(c, float(p), v) for c, vs in found.items() for p, v in zip(probabilities, vs)]
    schema = T.StructType(
        [
            T.StructField("column", T.StringType()),
            T.StructField("probability", T.DoubleType()),
            T.StructField("value", T.DoubleType()),
        ]
    )
    return df.sparkSession.createDataFrame(rows, schema)
