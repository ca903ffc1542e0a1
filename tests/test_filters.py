from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lakewright.functions import predicates as p
from lakewright.operators import filters
from tests.conftest import plan_of, values


def cats(spark, rows):
    return spark.createDataFrame([(i, c) for i, c in enumerate(rows)], "id int, `999_categories` string")


C = "999_categories"
ROWS = ["a", "b", "b", None, "it's", "new", "c"]


def kept(df):
    return sorted(values(df, "id"))


def test_allow_and_deny_treat_null_as_sql_does(spark):
    df = cats(spark, ROWS)
    assert kept(df.filter(p.allowed(C, ["a", "it's"]))) == [0, 4]
    assert kept(df.filter(p.denied(C, ["b"]))) == [0, 4, 5, 6]
    assert kept(df.filter(p.allowed(C, []))) == []
    assert kept(df.filter(p.denied(C, []))) == list(range(7))


def test_allow_and_its_complement_cover_the_non_null_rows(spark):
    df = cats(spark, ROWS)
    valid = spark.createDataFrame([("a",), ("b",), (None,), ("b",)], "v string")
    inside, outside = filters.keep_values(df, C, valid), filters.keep_values(df, C, valid, negate=True)
    assert kept(inside) == [0, 1, 2]
    assert kept(outside) == [4, 5, 6]


@pytest.mark.parametrize("n_valid", [0, 9, 30])
def test_the_size_of_the_set_never_changes_the_policy(spark, n_valid):
    names = [f"v{i:02d}" for i in range(n_valid)]
    df = cats(spark, [*names, "x", "unlisted", None])
    valid = spark.createDataFrame([(n,) for n in names], "v string")
    assert kept(filters.apply_category_policy(df, C, valid, ["x"], "allow")) == list(range(n_valid))
    assert kept(filters.apply_category_policy(df, C, valid, ["x"], "deny")) == [*range(n_valid), n_valid + 1]
    assert kept(filters.apply_category_policy(df, C, valid, ["x"], "open")) == list(range(n_valid + 3))
    with pytest.raises(ValueError):
        filters.apply_category_policy(df, C, valid, ["x"], "auto")


def test_policy_modes(spark):
    df, valid = cats(spark, ROWS), spark.createDataFrame([("a",)], "v string")
    assert kept(filters.apply_category_policy(df, C, valid, ["b"], "deny")) == [0, 4, 5, 6]
    with pytest.raises(ValueError):
        filters.apply_category_policy(df, C, valid, [], "other")


def test_large_value_sets_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(filters, "BROADCAST_VALUES", 2)
    df, valid = cats(spark, ROWS), spark.createDataFrame([("a",), ("b",), ("c",)], "v string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        large = filters.keep_values(df, C, valid)
        assert kept(large) == [0, 1, 2, 6]
        assert "BroadcastHashJoin" not in plan_of(large)
        monkeypatch.setattr(filters, "BROADCAST_VALUES", 3)
        assert "BroadcastHashJoin" in plan_of(filters.keep_values(df, C, valid))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


INSTANTS = [
    "2024-01-01 00:00:00",
    "2024-01-07 00:00:00",
    "2024-01-07 12:00:00",
    "2024-01-07 23:59:59.999999",
    "2024-01-08 00:00:00",
    None,
]


@pytest.fixture
def instants(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(INSTANTS)], "id int, t string")
    return df.withColumn("t", F.col("t").cast("timestamp_ntz"))


def test_date_ranges_at_their_borders(instants):
    assert kept(instants.filter(p.half_open("t", "2024-01-01", "2024-01-07"))) == [0]
    assert kept(instants.filter(p.whole_days("t", "2024-01-01", "2024-01-07"))) == [0, 1, 2, 3]
    assert kept(instants.filter(p.whole_days("t", "2024-01-08", "2024-01-08"))) == [4]
    with pytest.raises(ValueError):
        p.whole_days("t", "2024-01-02", "2024-01-01")


def test_key_predicates(spark):
    df = spark.range(10).withColumnRenamed("id", "x.y")
    assert values(df.filter(p.after_key("x.y", 7)), "`x.y`") == [8, 9]
    assert values(df.filter(p.key_range("x.y", 2, 4)), "`x.y`") == [3, 4]
    assert values(df.filter(p.key_range("x.y", 2, 4, include_low=True)), "`x.y`") == [2, 3, 4]
    assert df.filter(p.key_range("x.y", None, None)).count() == 10


def test_members_and_defaults(spark):
    df = cats(spark, ROWS)
    assert filters.default_members(df, C, 2) == ["a", "b"]
    assert filters.select_members(df, C, []).count() == 7
    assert kept(filters.select_members(df, C, ["b"])) == [1, 2]


def test_missing_counts_nan_as_null(spark):
    df = spark.createDataFrame([(0, float("nan")), (1, None), (2, 0.0), (3, float("inf"))], "id int, x double")
    assert kept(filters.only_missing(df, "x")) == [0, 1]
    assert kept(filters.only_present(df, "x")) == [2, 3]


def test_filter_table_drops_null_dates_only_when_a_date_column_is_chosen(instants):
    assert filters.filter_table(instants).count() == 6
    assert kept(filters.filter_table(instants, date_column="t")) == [0, 1, 2, 3, 4]
    assert kept(filters.filter_table(instants, date_column="t", start="2024-01-08")) == [4]


def test_filters_reach_the_scan(lineitem, orders):
    plan = plan_of(lineitem.filter(p.half_open("l_shipdate", datetime(1996, 1, 1), "1997-01-01")).select("l_tax"))
    assert "GreaterThanOrEqual(l_shipdate,1996-01-01T00:00)" in plan
    assert "LessThan(l_shipdate,1997-01-01T00:00)" in plan
    assert "ReadSchema: struct<l_tax:double,l_shipdate:timestamp_ntz>" in plan
    assert "GreaterThan(o_orderkey,5)" in plan_of(orders.filter(p.after_key("o_orderkey", 5)))
    assert "In(o_orderpriority, [1-URGENT,2-HIGH])" in plan_of(
        orders.filter(p.allowed("o_orderpriority", ["1-URGENT", "2-HIGH"]))
    )


def test_open_day_ranges_keep_extreme_dates(spark):
    rows = spark.sql("SELECT id, CAST(d AS timestamp_ntz) d FROM VALUES (1, '0001-01-01'), (2, '2024-01-02 23:59:59'), (3, '9999-12-31') t(id, d)")
    kept = lambda **days: sorted(r.id for r in filters.filter_table(rows, date_column="d", **days).collect())
    assert kept(start="2024-01-02") == [2, 3] and kept(end="2024-01-02") == [1, 2] and kept() == [1, 2, 3]


def test_sets_of_many_bytes_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(filters, "BROADCAST_BYTES", 10)
    long, short = (spark.createDataFrame([(v,)], "v string") for v in ("x" * 11, "x"))
    assert filters.held_values(long)[1] is False and filters.held_values(short)[1] is True


@pytest.mark.parametrize("kind", ["bigint", "string", "double"])
def test_bloom_filter_thins_and_the_join_is_exact(spark, kind):
    df = spark.range(20_000).select(F.col("id"), F.when(F.col("id") % 50 != 0, F.col("id").cast(kind)).alias("k"), F.lit(1).alias("__set"))
    wanted = spark.range(0, 20_000, 97).select(F.col("id").cast("string").alias("v")).union(spark.createDataFrame([("none",), (None,), ("3",), ("3",)], "v string"))
    got = sorted(values(filters.keep_values_bloom(df.drop("__set"), "k", wanted, broadcast_small=False), "id"))
    assert got == sorted({3} | {i for i in range(0, 20_000, 97) if i % 50})
    names = wanted.select(F.expr(f"try_cast(v AS {kind})").alias("v")).dropna().distinct()
    left = filters.bloom_prefilter(df.drop("__set"), "k", filters.bloom_words(names, 4096), 4096)
    assert set(got) <= set(values(left, "id")) and left.count() < 0.12 * 20_000
    assert filters.keep_values_bloom(df.drop("__set"), "k", wanted.limit(0), broadcast_small=False).count() == 0
    assert sorted(values(filters.keep_values_bloom(df.drop("__set"), "k", names), "id")) == got


def test_bloom_filter_comes_before_the_shuffle(spark, monkeypatch):
    df, wanted = spark.range(1000).withColumnRenamed("id", "k"), spark.range(0, 1000, 10)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = plan_of(filters.keep_values_bloom(df, "k", wanted, bits=1 << 12, broadcast_small=False))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    tree = plan.split("\n\n")[0]
    assert "LeftSemi" in tree and tree.index("LeftSemi") < tree.index("BroadcastHashJoin Inner")
    assert tree.rindex("Exchange", 0, tree.index("BroadcastHashJoin Inner")) > tree.index("LeftSemi")
