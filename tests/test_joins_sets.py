import pytest
from pyspark.sql import functions as F

from lakewright.operators import joins, ordering, sets
from tests.conftest import plan_of, values


def test_star_with_prefix_keeps_odd_names(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, `a b` string")
    right = spark.createDataFrame([(1, "c", 0.5), (1, "d", 1.5), (4, "e", 2.5)], "id int, `999_categories` string, `x.y` double")
    out = joins.star_with_prefix(left, right, "id", "id", ["id", "999_categories", "x.y"])
    assert out.columns == ["id", "a b", "tb2_id", "tb2_999_categories", "tb2_x.y"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, "x", 1, "c", 0.5), (1, "x", 1, "d", 1.5)]
    assert joins.star_with_prefix(left, right, "id", "id", ["x.y"], "r_", "left").count() == 4


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salting_does_not_change_the_result(spark, how):
    left = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 400).alias("k"), "id"
    )
    right = spark.range(0, 300).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    right = right.unionByName(right.filter("k = 7"))
    plain = joins.star_with_prefix(left, right, "k", "k", ["v"], how=how)
    salted = joins.join_salted(left, right, "k", "k", ["v"], how=how, share=0.1, salts=5)
    assert joins.hot_keys(left, "k", 0.1) == [7]
    key = lambda rows: sorted(map(tuple, rows), key=str)
    assert key(plain.collect()) == key(salted.collect())


def test_salted_rows_spread_over_tasks(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        left = spark.range(4000).select(F.lit(7).alias("k"), "id")
        right = spark.range(10).select(F.col("id").alias("k"), F.col("id").alias("v"))
        out = joins.join_salted(left, right, "k", "k", ["v"], share=0.5, salts=64)
        assert out.select(F.spark_partition_id()).distinct().count() == 4
        assert out.count() == 4000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_count_distinct_over_left_join(spark):
    a = spark.createDataFrame([(1, "g"), (2, "h")], "a int, g string")
    b = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "a2 int, b int")
    c = spark.createDataFrame([(10, 5), (11, 5), (11, 6)], "b2 int, v int")
    out = joins.count_distinct_over_optional(a, b, c, a.a == b.a2, b.b == c.b2, ["g"], "v", "n")
    assert sorted(map(tuple, out.collect())) == [("g", 2), ("h", 0)]


def test_set_difference_and_distinct(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), ("a",), ("c",)], "v string")
    gone = spark.createDataFrame([("b",)], "v string")
    assert sorted(values(sets.set_difference(df, gone), "v")) == ["a", "c"]
    assert values(sets.distinct_values(df, "v"), "v") == ["a", "b", "c"]


def test_keep_first_limits_each_key_before_the_shuffle(spark):
    rows = [(3, "a"), (1, "b"), (2, "a"), (5, None), (4, None)]
    df = spark.createDataFrame(rows, "pos int, v string")
    first = sets.keep_first(df, ["v"], ["pos"])
    assert sorted(map(tuple, first.collect()), key=str) == [(1, "b"), (2, "a"), (4, None)]
    plan = plan_of(first)
    assert plan.count("WindowGroupLimit") >= 2


def test_concat_chunks_fills_absent_columns(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    b = spark.createDataFrame([(2,)], "k int")
    assert sorted(map(tuple, sets.concat_chunks(a, b).collect())) == [(1, "x"), (2, None)]


def test_top_n_small_and_large_agree(spark, orders, monkeypatch):
    small = ordering.top_n(orders, ["o_orderkey"], 500)
    assert "TakeOrderedAndProject" in plan_of(small)
    monkeypatch.setattr(ordering, "ONE_TASK_ROWS", 10)
    large = ordering.top_n(orders, ["o_orderkey"], 500)
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))


def test_preview_bounds_rows_and_columns(lineitem):
    assert len(ordering.preview(lineitem, 3, ["l_orderkey"]).collect()) == 3
    assert ordering.preview(lineitem, 500, ["l_orderkey"]).count() == 500
    assert len(ordering.preview(lineitem, keys=["l_orderkey"]).columns) == 10
    assert len(ordering.preview(lineitem, keys=["l_orderkey"], all_columns=True).columns) == 11


def test_join_filters_are_pushed_to_their_sides(spark, lineitem, orders):
    from lakewright.plans.config import ExtractConfig
    from lakewright.plans.extract import joined_rows

    config = ExtractConfig(
        "t", "l_orderkey", "o_orderkey", ("o_totalprice",), "o_orderpriority", excluded=("5-LOW",),
        date_column="l_shipdate", start="1996-01-01", end="1996-12-31",
    )
    plan = plan_of(joined_rows(lineitem, orders, orders.select("o_orderpriority"), config))
    assert "GreaterThanOrEqual(l_shipdate,1996-01-01T00:00)" in plan
    assert "LessThan(l_shipdate,1997-01-01T00:00)" in plan
    assert "struct<o_orderkey:bigint,o_totalprice:double,o_orderpriority:string>" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
