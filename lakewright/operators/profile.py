"""Profiling: counts, statistics, correlation, histograms, value counts, outliers.

Statistics of all columns come from one wide aggregate; the one-row result is then turned into
one row per column. Quantiles are exact unless ``approximate`` is asked for.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lakewright.functions.columns import (
    as_double,
    categorical_columns,
    col,
    field_type,
    is_numeric,
    long_form,
    missing,
    numeric_columns,
    one_row,
    present,
)
from lakewright.operators.gram import blocked_correlation
from lakewright.operators.quantiles import exact_quantiles

# Reach of the quartile fences, z-score bound, top values.
FENCE_FACTOR = 1.5
Z_BOUND = 3
TOP_VALUES = 10
# Pairs of more columns than this are too many expressions for one aggregate.
WIDE_COLUMNS = 24

_CORRELATION = "column_a string, column_b string, correlation double"


def _percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part * F.lit(100.0), whole.cast("double"))


Quantiles = dict[str, list[float | None]]


def quantiles_of(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], approximate: bool
) -> Quantiles:
    """Exact quantiles, or one sketch per column in a single pass."""
    if not approximate:
        return exact_quantiles(df, columns, probabilities)
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    values = [
        F.percentile_approx(as_double(c, field_type(df, c)), wanted, 10_000).alias(f"q{i}") for i, c in enumerate(columns)
    ]
    row = df.agg(*values).first() if columns else ()
    return {c: list(q) if q is not None else [None] * len(probabilities) for c, q in zip(columns, row)}


def _double(value: float | None) -> Column:
    return F.lit(value).cast("double")


def count_matching(df: DataFrame, condition: Column) -> DataFrame:
    """Matching and total rows in one pass."""
    return df.agg(F.count_if(condition).alias("matching_rows"), F.count(F.lit(1)).alias("total_rows"))


def null_counts(df: DataFrame) -> DataFrame:
    """Missing count and percentage of every column; NaN counts as missing."""
    wide = one_row(
        df,
        [F.count_if(missing(f.name, f.dataType)).alias(f"m{i}") for i, f in enumerate(df.schema.fields)],
    )
    return long_form(
        wide,
        "column",
        [
            (name, [("missing_count", F.col(f"m{i}")), ("missing_pct", _percent(F.col(f"m{i}"), F.col("n")))])
            for i, name in enumerate(df.columns)
        ],
    )


def missing_table(df: DataFrame) -> DataFrame:
    """Only columns with missing values, fewest first."""
    return null_counts(df).filter("missing_count > 0").orderBy("missing_pct", "column")


def distinct_counts(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column, and their share of all rows.

    Exact counts aggregate every column for itself, so a scan reads each column once and no
    row is repeated; the distinct values are what is shuffled. The approximate form keeps one
    fixed-size sketch per column and task, in one pass. ``df`` should be a scan or a written
    table, not a costly plan.
    """
    fields = df.schema.fields
    if approximate:
        wide = one_row(df, [F.approx_count_distinct(present(f.name, f.dataType)).alias(f"d{i}") for i, f in enumerate(fields)])
        counted = long_form(wide, "column", [(f.name, [("d", F.col(f"d{i}")), ("n", F.col("n"))]) for i, f in enumerate(fields)])
    else:
        # Rows are counted per value before the shuffle, so a hot value is one row per task.
        parts = [
            df.groupBy(present(f.name, f.dataType).alias("v"))
            .agg(F.count(F.lit(1)).alias("k"))
            .agg(F.count("v").alias("d"), F.coalesce(F.sum("k"), F.lit(0)).alias("n"))
            .select(F.lit(f.name).alias("column"), "d", "n")
            for f in fields
        ]
        counted = reduce(DataFrame.unionByName, parts)
    return counted.select("column", F.col("d").alias("distinct_count"), _percent(F.col("d"), F.col("n")).alias("distinct_pct"))


def exact_extremes(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Least and greatest value of every numeric column as text: integers and decimals beyond 2^53 keep all their digits.

    NaN is missing. ``numeric_stats`` and ``describe`` give all numbers as doubles.
    """
    names = list(columns) if columns is not None else numeric_columns(df)
    values = {n: present(n, field_type(df, n)) for n in names}
    parts = [fn(values[n]).cast("string").alias(f"{x}{i}") for i, n in enumerate(names) for x, fn in (("lo", F.min), ("hi", F.max))]
    return long_form(one_row(df, parts), "column", [(n, [("min_value", F.col(f"lo{i}")), ("max_value", F.col(f"hi{i}"))]) for i, n in enumerate(names)])


def numeric_stats(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Mean, sample deviation, minimum, maximum and median of every numeric column, as doubles."""
    names = numeric_columns(df)
    medians = quantiles_of(df, names, [0.5], approximate)
    values = {n: as_double(n, field_type(df, n)) for n in names}
    wide = one_row(
        df,
        [
            fn(values[n]).alias(f"{label}{i}")
            for i, n in enumerate(names)
            for label, fn in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))
        ],
    )
    return long_form(
        wide,
        "column",
        [
            (
                n,
                [(label, F.col(f"{label}{i}")) for label in ("mean", "std", "min", "max")]
                + [("median", _double(medians[n][0]))],
            )
            for i, n in enumerate(names)
        ],
    )


def column_profile(df: DataFrame, approximate: bool = False, medians: Quantiles | None = None) -> DataFrame:
    """One row per column: type, missing, distinct, and statistics for numeric columns.

    Counts and moments of all columns are one aggregate; distinct counts and medians have
    their own passes. With ``approximate`` these two are sketches, which is the form for
    tables too large to shuffle their distinct values. ``medians`` saves the pass when they
    are known.
    """
    fields = df.schema.fields
    if medians is None:
        medians = quantiles_of(df, numeric_columns(df), [0.5], approximate)
    parts: list[Column] = []
    for i, f in enumerate(fields):
        parts.append(F.count_if(missing(f.name, f.dataType)).alias(f"m{i}"))
        if is_numeric(f.dataType):
            v = as_double(f.name, f.dataType)
            parts += [
                F.avg(v).alias(f"mean{i}"),
                F.stddev_samp(v).alias(f"std{i}"),
                F.min(v).alias(f"min{i}"),
                F.max(v).alias(f"max{i}"),
            ]
    rows = []
    for i, f in enumerate(fields):
        numeric = is_numeric(f.dataType)
        rows.append(
            (
                f.name,
                [
                    ("dtype", F.lit(f.dataType.simpleString())),
                    ("null_count", F.col(f"m{i}")),
                    ("null_percentage", _percent(F.col(f"m{i}"), F.col("n"))),
                    *[
                        (label, F.col(f"{label}{i}") if numeric else _double(None))
                        for label in ("mean", "std", "min", "max")
                    ],
                    ("median", _double(medians[f.name][0] if numeric else None)),
                ],
            )
        )
    statistics = long_form(one_row(df, parts), "column", rows)
    # One row per column of the table on either side.
    return statistics.join(F.broadcast(distinct_counts(df, approximate)), "column").select(
        "column",
        "dtype",
        "null_count",
        "null_percentage",
        F.col("distinct_count").alias("unique_values"),
        F.col("distinct_pct").alias("unique_percentage"),
        "mean",
        "std",
        "min",
        "max",
        "median",
    )


def describe(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Count, mean, deviation, minimum, quartiles and maximum of every numeric column."""
    names = numeric_columns(df)
    quartiles = quantiles_of(df, names, [0.25, 0.5, 0.75], approximate)
    parts: list[Column] = []
    for i, n in enumerate(names):
        v = as_double(n, field_type(df, n))
        parts += [
            F.count(v).alias(f"count{i}"),
            F.avg(v).alias(f"mean{i}"),
            F.stddev_samp(v).alias(f"std{i}"),
            F.min(v).alias(f"min{i}"),
            F.max(v).alias(f"max{i}"),
        ]
    rows = [
        (
            n,
            [(label, F.col(f"{label}{i}")) for label in ("count", "mean", "std", "min")]
            + [(label, _double(q)) for label, q in zip(("p25", "p50", "p75"), quartiles[n])]
            + [("max", F.col(f"max{i}"))],
        )
        for i, n in enumerate(names)
    ]
    return long_form(one_row(df, parts), "column", rows)


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair of numeric columns over the rows where both are present.

    The means come first; the second pass sums products of the deviations from them, which
    keeps plain sums accurate. Only pairs with a gap in either column need sums of their own;
    the others share one sum of squares per column. A constant column correlates to null. A wide table
    takes ``blocked_correlation``, which sums the same products as matrices.
    Rows: column_a, column_b, correlation, both triangles and the diagonal.
    """
    names = list(columns) if columns is not None else numeric_columns(df)
    if not names:
        return df.sparkSession.createDataFrame([], _CORRELATION)
    if len(names) > WIDE_COLUMNS:
        return blocked_correlation(df, names)
    values = df.select(*[as_double(n, field_type(df, n)).alias(f"c{i}") for i, n in enumerate(names)])
    facts = one_row(
        values, [f(f"c{i}").alias(f"{t}{i}") for i in range(len(names)) for t, f in (("m", F.avg), ("k", F.count))]
    ).first()
    gaps = [facts[f"k{i}"] < facts["n"] for i in range(len(names))]
    centred = values.select(
        *[(F.col(f"c{i}") - F.lit(facts[f"m{i}"]).cast("double")).alias(f"d{i}") for i in range(len(names))]
    )
    parts: dict[str, Column] = {}
    for i in range(len(names)):
        parts[f"s{i}"], parts[f"q{i}"] = F.sum(f"d{i}"), F.sum(F.col(f"d{i}") * F.col(f"d{i}"))
        parts[f"n{i}"] = F.count(f"d{i}")
        for j in range(i + 1, len(names)):
            a, b = F.col(f"d{i}"), F.col(f"d{j}")
            parts[f"p{i}_{j}"] = F.sum(a * b)
            if gaps[i] or gaps[j]:
                a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
                for label, sum_ in (("n", F.count(a)), ("a", F.sum(a)), ("b", F.sum(b)), ("aa", F.sum(a * a)), ("bb", F.sum(b * b))):
                    parts[f"{label}{i}_{j}"] = sum_
    # A few numbers per pair of columns, whatever the number of rows.
    sums = centred.agg(*[c.alias(name) for name, c in parts.items()]).first()

    def correlation(i: int, j: int) -> float | None:
        own = i != j and (gaps[i] or gaps[j])
        picked = [f"{x}{i}_{j}" for x in ("n", "a", "b", "aa", "bb")] if own else [f"n{i}", f"s{i}", f"s{j}", f"q{i}", f"q{j}"]
        n, sa, sb, saa, sbb = (sums[x] for x in picked)
        if not n:
            return None
        va, vb = saa - sa * sa / n, sbb - sb * sb / n
        # What rounding leaves of a constant column is no variance.
        if va <= saa * 1e-14 or vb <= sbb * 1e-14:
            return None
        sab = sums[f"p{i}_{j}"] if i != j else saa
        return (sab - sa * sb / n) / math.sqrt(va) / math.sqrt(vb)

    rows = [(a, b, correlation(min(i, j), max(i, j))) for i, a in enumerate(names) for j, b in enumerate(names)]
    return df.sparkSession.createDataFrame(rows, _CORRELATION)


def value_counts(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    k: int = TOP_VALUES,
    max_columns: int | None = None,
) -> DataFrame:
    """The ``k`` most frequent non-null values of each categorical column; ties by value.

    Values are counted per column first. The rank filter then becomes a limit per column ahead
    of the second shuffle, so a task sends ``k`` rows per column however many values there are.
    """
    names = list(columns) if columns is not None else categorical_columns(df, max_columns)
    if not names:
        return df.sparkSession.createDataFrame([], "column string, value string, count bigint, rank int")
    cells = F.array(*[F.struct(F.lit(n).alias("column"), col(n).cast("string").alias("value")) for n in names])
    counted = (
        df.select(F.inline(cells)).filter("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    )
    w = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    return counted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def histogram(
    df: DataFrame, columns: Sequence[str] | None = None, bins: int = 20, max_columns: int | None = None
) -> DataFrame:
    """Rows per equal-width bin of each numeric column, empty bins left out.

    The maximum falls into the last bin and a constant column into bin 1. Every column is
    aggregated for itself, so the shuffle holds one row per bin and task. Infinite values are
    counted in a row of their own without a bin.
    """
    names = list(columns) if columns is not None else numeric_columns(df, max_columns)
    values = df.select(*[finite_double(df, n).alias(f"c{i}") for i, n in enumerate(names)])
    bounds = []
    for i, n in enumerate(names):
        v = finite_double(df, n)
        infinite = F.abs(as_double(n, field_type(df, n))) == F.lit(float("inf"))
        bounds += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.count_if(infinite).alias(f"inf{i}")]
    b = one_row(df, bounds).first()
    parts = []
    for i, n in enumerate(names):
        lo, hi = b[f"lo{i}"], b[f"hi{i}"]
        if lo is None:
            continue
        width, steps = (hi - lo) / bins, "(v - {lo!r}D) / {width!r}D"
        if math.isinf(width):
            # The span of the values overflows; divide before subtracting.
            width, steps = hi / bins - lo / bins, "v / {width!r}D - {lo!r}D / {width!r}D"
        # Bin by arithmetic on the bounds; the maximum is pulled back into the last bin.
        steps = steps.format(lo=lo, width=width)
        place = f"least(cast(floor({steps}) as bigint) + 1, {bins})" if width else "1"
        parts.append(
            values.selectExpr(f"c{i} as v")
            .filter("v is not null")
            .groupBy(F.expr(f"cast({place} as bigint)").alias("bin"))
            .agg(F.count(F.lit(1)).alias("count"))
            .select(
                F.lit(n).alias("column"),
                "bin",
                F.expr(f"{lo!r}D + {width!r}D * (bin - 1)").alias("bin_start"),
                F.expr(f"{lo!r}D + {width!r}D * bin").alias("bin_end"),
                "count",
            )
        )
    infinite = [(n, None, None, None, b[f"inf{i}"]) for i, n in enumerate(names) if b[f"inf{i}"]]
    if infinite:
        parts.append(df.sparkSession.createDataFrame(infinite, "column string, bin bigint, bin_start double, bin_end double, count bigint"))
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, bin bigint, bin_start double, bin_end double, count bigint")
    return reduce(DataFrame.unionByName, parts)


def finite_double(df: DataFrame, name: str) -> Column:
    v = as_double(name, field_type(df, name))
    return F.when(F.abs(v) != F.lit(float("inf")), v)


def outliers_iqr(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    factor: float = FENCE_FACTOR,
    approximate: bool = False,
    quartiles: Quantiles | None = None,
) -> DataFrame:
    """Rows strictly outside the quartile fences, per numeric column, and their share of the
    non-null rows. Quartiles first, then one counting pass with the fences as literals."""
    names = list(columns) if columns is not None else numeric_columns(df)
    if quartiles is None:
        quartiles = quantiles_of(df, names, [0.25, 0.75], approximate)
    parts: list[Column] = []
    for i, n in enumerate(names):
        v = as_double(n, field_type(df, n))
        q1, q3 = quartiles[n]
        outside = F.lit(False) if q1 is None else (v < q1 - factor * (q3 - q1)) | (v > q3 + factor * (q3 - q1))
        parts += [F.count(v).alias(f"n{i}"), F.count_if(outside).alias(f"o{i}")]
    return _outlier_rows(one_row(df, parts), names)


def outliers_zscore(df: DataFrame, columns: Sequence[str] | None = None, bound: float = Z_BOUND) -> DataFrame:
    """Rows more than ``bound`` sample deviations from the mean; none in a constant column."""
    names = list(columns) if columns is not None else numeric_columns(df)
    values = {n: as_double(n, field_type(df, n)) for n in names}
    moments = one_row(
        df, [f(values[n]).alias(f"{t}{i}") for i, n in enumerate(names) for t, f in (("m", F.avg), ("s", F.stddev_samp))]
    ).first()
    parts: list[Column] = []
    for i, n in enumerate(names):
        mean, std = moments[f"m{i}"], moments[f"s{i}"]
        far = F.abs(values[n] - F.lit(mean)) > F.lit(bound * std) if std else F.lit(False)
        parts += [F.count(values[n]).alias(f"n{i}"), F.count_if(far).alias(f"o{i}")]
    return _outlier_rows(one_row(df, parts), names)


def _outlier_rows(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    return long_form(
        wide,
        "column",
        [
            (n, [("outlier_count", F.col(f"o{i}")), ("outlier_pct", _percent(F.col(f"o{i}"), F.col(f"n{i}")))])
            for i, n in enumerate(names)
        ],
    )


def rank_outliers(outliers: DataFrame, k: int | None = None) -> DataFrame:
    """The columns by their share of outliers, largest first, ties by name; only ``k`` of them if asked for."""
    ranked = outliers.orderBy(F.desc_nulls_last("outlier_pct"), "column")
    return ranked if k is None else ranked.limit(k)
