import math
import random

import pytest
from pyspark.sql import functions as F

from lakewright.functions.columns import categorical_columns, date_candidates, first_columns, moment_columns, numeric_columns
from lakewright.operators import profile
from lakewright.operators.quantiles import exact_quantiles, quantile_table
from tests.conftest import plan_of, values


def by(df, key="column"):
    return {r[key]: r.asDict() for r in df.collect()}


@pytest.fixture(scope="module")
def mixed(spark):
    nan = float("nan")
    rows = [(1.0, 1, "a", True), (2.0, None, "b", None), (2.5, 3, None, True), (10.0, 3, "a", False), (nan, None, "a", True)]
    return spark.createDataFrame(rows, "`x.y` double, n int, s string, b boolean")


def test_column_classes(spark):
    df = spark.createDataFrame([], "created_at string, update_time timestamp, runtime int, candidate string, x double, d date")
    assert date_candidates(df) == ["update_time", "candidate", "d"]
    assert date_candidates(df, epoch_unit="s") == ["update_time", "runtime", "candidate", "d"]
    assert numeric_columns(df) == ["runtime", "x"] and numeric_columns(df, 1) == ["runtime"]
    assert categorical_columns(df) == ["created_at", "candidate"] and moment_columns(df) == ["update_time", "d"]
    assert first_columns(df, 2).columns == ["created_at", "update_time"]


def test_missing_counts_nan(mixed):
    assert [(r.column, r.missing_count, r.missing_pct) for r in profile.missing_table(mixed).collect()] == [
        ("b", 1, 20.0), ("s", 1, 20.0), ("x.y", 1, 20.0), ("n", 2, 40.0),
    ]


def test_distinct_counts_leave_out_missing_values(mixed):
    exact = by(profile.distinct_counts(mixed))
    assert {c: r["distinct_count"] for c, r in exact.items()} == {"x.y": 4, "n": 2, "s": 2, "b": 2}
    assert exact["x.y"]["distinct_pct"] == 80.0
    assert by(profile.distinct_counts(mixed, approximate=True))["x.y"]["distinct_count"] == 4


def test_describe_known_quartiles(mixed):
    row = by(profile.describe(mixed))["x.y"]
    assert (row["count"], row["min"], row["max"]) == (4, 1.0, 10.0)
    assert (row["p25"], row["p50"], row["p75"]) == (1.75, 2.25, 4.375)
    assert row["std"] == pytest.approx(4.130677910464576)


def test_profile_of_hard_columns(spark):
    df = spark.range(3).select(
        F.lit(None).cast("double").alias("void"), F.lit(7).alias("same"), F.lit("t").alias("text"), "id"
    )
    got = by(profile.column_profile(df))
    assert got["void"]["null_count"] == 3 and got["void"]["mean"] is None and got["void"]["median"] is None
    assert got["same"]["std"] == 0.0 and got["same"]["unique_values"] == 1
    assert got["text"]["dtype"] == "string" and got["text"]["mean"] is None
    assert (got["id"]["mean"], got["id"]["median"], got["id"]["unique_percentage"]) == (1.0, 1.0, 100.0)
    one = by(profile.column_profile(spark.range(1)))
    assert one["id"]["std"] is None
    empty = by(profile.column_profile(spark.range(0)))
    assert empty["id"]["null_percentage"] is None and empty["id"]["unique_values"] == 0
    texts = spark.createDataFrame([("a",)], "s string")
    assert by(profile.column_profile(texts))["s"]["unique_values"] == 1
    assert profile.describe(texts).collect() == profile.outliers_iqr(texts).collect() == []


def brute(data, p):
    data = sorted(data)
    k = p * (len(data) - 1)
    lo, hi = math.floor(k), math.ceil(k)
    return data[lo] + (data[hi] - data[lo]) * (k - lo)


random.seed(5)
SHAPES = {
    "near unique": [random.random() for _ in range(3000)],
    "heavy tail": [10.0 ** random.uniform(-200, 200) for _ in range(2000)],
    "hot value": [5.0] * 1500 + [random.uniform(4, 6) for _ in range(1500)],
    "hot at the rank": [0.0] * 1499 + [1.0] * 2 + [2.0] * 1499,
    "constant": [3.0] * 2500,
    "few values": [float(random.randrange(4)) for _ in range(2500)],
    "signed": [random.gauss(0, 1e6) for _ in range(2500)],
}


def test_narrowed_quantiles_are_exact(spark):
    longest = max(map(len, SHAPES.values()))
    rows = [tuple(d[i] if i < len(d) else None for d in SHAPES.values()) for i in range(longest)]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in SHAPES)).repartition(4)
    wanted = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]
    tight = exact_quantiles(df, list(SHAPES), wanted, gathered_values=40, sample_values=300)
    plain = exact_quantiles(df, list(SHAPES), wanted)
    for name, data in SHAPES.items():
        assert tight[name] == pytest.approx([brute(data, p) for p in wanted], rel=1e-12), name
        assert plain[name] == pytest.approx(tight[name], rel=1e-12), name


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    got = exact_quantiles(df, ["a", "b"], [0.5, 1.0])
    assert got == {"a": [None, None], "b": [1.0, 1.0]}
    assert exact_quantiles(df, [], [0.5]) == {}
    assert quantile_table(df, ["b"], [0.5]).collect()[0].asDict() == {"column": "b", "probability": 0.5, "value": 1.0}


def test_correlation_is_pairwise_and_null_for_constants(spark):
    rows = [(1.0, 2.0, 5, None), (2.0, 4.0, 5, 1.0), (3.0, None, 5, 0.0), (4.0, 9.0, 5, -1.0)]
    df = spark.createDataFrame(rows, "a double, b double, c int, d double")
    got = {(r.column_a, r.column_b): r.correlation for r in profile.correlation_matrix(df).collect()}
    assert len(got) == 16
    assert got["a", "a"] == pytest.approx(1.0) and got["a", "d"] == pytest.approx(-1.0)
    assert got["a", "b"] == got["b", "a"] == pytest.approx(df.where("b is not null").stat.corr("a", "b"))
    assert got["a", "c"] is None and got["c", "c"] is None
    assert got["b", "d"] == pytest.approx(-1.0)


def test_correlation_stays_accurate_far_from_zero(spark):
    df = spark.range(1000).select((F.col("id") + 1e9).alias("a"), (F.col("id") % 17 + 1e9).alias("b"), F.lit(0.1).alias("c"))
    got = {(r.column_a, r.column_b): r.correlation for r in profile.correlation_matrix(df).collect()}
    small = spark.range(1000).selectExpr("cast(id as double) a", "cast(id % 17 as double) b")
    assert got["a", "b"] == pytest.approx(small.stat.corr("a", "b"), abs=1e-9)
    assert got["c", "c"] is None


def test_value_counts_rank_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x"), ("a", None), ("c", "y"), ("b", "y")], "p string, q string")
    top = profile.value_counts(df, k=2)
    assert sorted(map(tuple, top.collect())) == [("p", "a", 2, 1), ("p", "b", 2, 2), ("q", "x", 2, 1), ("q", "y", 2, 2)]
    assert plan_of(top).count("WindowGroupLimit") >= 2
    assert profile.value_counts(df.select(F.lit(1).alias("n"))).collect() == []


def test_histogram_edges(spark):
    df = spark.range(11).select(F.col("id").cast("double").alias("x"), F.lit(4).alias("same"), F.lit(None).cast("int").alias("void"))
    rows = profile.histogram(df, bins=5).collect()
    x = {r.bin: r["count"] for r in rows if r.column == "x"}
    assert x == {1: 2, 2: 2, 3: 2, 4: 2, 5: 3}
    assert [(r.bin, r["count"], r.bin_start) for r in rows if r.column == "same"] == [(1, 11, 4.0)]
    assert not [r for r in rows if r.column == "void"]
    assert max(r.bin_end for r in rows if r.column == "x") == 10.0


def test_histogram_of_extreme_and_negative_values(spark):
    df = spark.createDataFrame([(-1.7e308, -3.0), (1.7e308, 1e-7), (0.0, 5e20), (float("inf"), None)], "x double, y double")
    got = sorted((r.column, r.bin or 0, r["count"]) for r in profile.histogram(df, bins=2).collect())
    # The infinite value has a row without a bin.
    assert got == [("x", 0, 1), ("x", 1, 1), ("x", 2, 2), ("y", 1, 2), ("y", 2, 1)]


def test_outliers(spark):
    df = spark.createDataFrame([(float(v), 1.0, None) for v in [*range(20), 500]], "x double, same double, void double")
    iqr = by(profile.outliers_iqr(df))
    assert iqr["x"]["outlier_count"] == 1 and iqr["x"]["outlier_pct"] == pytest.approx(100 / 21)
    assert iqr["same"]["outlier_count"] == 0 and iqr["void"] == {"column": "void", "outlier_count": 0, "outlier_pct": None}
    z = by(profile.outliers_zscore(df))
    assert z["x"]["outlier_count"] == 1 and z["same"]["outlier_count"] == 0 and z["void"]["outlier_pct"] is None
    assert values(profile.rank_outliers(profile.outliers_iqr(df)), "column") == ["x", "same", "void"]


def test_count_matching(mixed):
    assert tuple(profile.count_matching(mixed, F.col("n") == 3).first()) == (2, 5)


def test_no_column_is_left_out_by_default(spark):
    wide = spark.range(20).selectExpr(*[f"id + {i} AS n{i}" for i in range(21)], *[f"CAST(id % 2 AS string) AS s{i}" for i in range(11)])
    assert profile.histogram(wide, bins=2).select("column").distinct().count() == 21
    assert profile.value_counts(wide).select("column").distinct().count() == 11
