import pytest
from pyspark.sql import functions as F

from lakewright.functions import predicates as p
from lakewright.operators import numbering, ranges, sampling
from tests.conftest import plan_of, values


def test_row_numbers_equal_the_sorted_order(events):
    out = numbering.with_row_number(events.select("event_id", "value"), ["value", "event_id"]).collect()
    assert [r.row_number for r in sorted(out, key=lambda r: (r.value, r.event_id))] == list(range(1, len(out) + 1))


def test_row_number_has_no_single_task_window_over_the_table(events):
    plan = plan_of(numbering.with_row_number(events.select("event_id"), ["event_id"]))
    # The only unpartitioned window runs over one row per shuffle partition.
    assert plan.count("Window") <= 3
    assert "SinglePartition" in plan  # the offsets
    scan_of_rows = plan.split("(1) ")[1]
    assert "Window" not in scan_of_rows.splitlines()[0]


@pytest.mark.parametrize("n", [1, 2, 7, 100, 1500])
def test_ntile_formula(spark, n):
    df = spark.range(1000)
    sizes = values(numbering.with_ntile(df, ["id"], n).groupBy("bucket").count().orderBy("bucket"), "count")
    full, extra = divmod(1000, n)
    assert sizes == [full + 1] * extra + ([full] * (n - extra) if full else [])


@pytest.mark.parametrize("order", [["k", "id"], ["k"]])
def test_skewed_key_is_spread(spark, order):
    df = spark.range(2000).select(F.lit(1).alias("k"), "id", F.create_map(F.lit("a"), F.col("id")).alias("m"))
    written = numbering._written_in_order(df, [F.col(o) for o in order], 4)
    assert written.select("__part").distinct().count() == 4
    first, second = (numbering.with_row_number(df, order).select("id", "row_number").collect() for _ in range(2))
    assert sorted(first) == sorted(second) and sorted(r.row_number for r in first) == list(range(1, 2001))


def test_numbering_an_empty_table(spark):
    assert numbering.with_row_number(spark.range(0), ["id"]).collect() == []


def test_running_total(spark):
    df = spark.range(1, 101)
    out = numbering.with_running_total(df, ["id"], F.col("id"))
    assert sorted(map(tuple, out.collect())) == [(i, i * (i + 1) // 2) for i in range(1, 101)]


def covered(df, key, cut):
    rows = cut.orderBy("range_id").collect()
    counts = [
        df.filter(p.key_range(key, r["low"], r["high"], include_low=i == 0)).count() for i, r in enumerate(rows)
    ]
    return rows, counts


@pytest.mark.parametrize("n", [1, 2, 5, 12])
def test_key_ranges_partition_the_keys(orders, n):
    rows, counts = covered(orders, "o_orderkey", ranges.key_ranges(orders, "o_orderkey", n))
    assert len(rows) == n and sum(counts) == orders.count()
    assert max(counts) <= 1.5 * orders.count() / n
    assert all(a["high"] == b["low"] for a, b in zip(rows, rows[1:]))


@pytest.mark.parametrize(
    "keys", [[], [5], [3] * 40, [1] * 30 + list(range(2, 20)), [None, 1, 2, None, 3]], ids=["empty", "one", "equal", "hot", "null"]
)
def test_key_ranges_on_hard_keys(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    cut = ranges.key_ranges(df, "k", 6)
    rows, counts = covered(df, "k", cut)
    assert sum(counts) == sum(k is not None for k in keys)
    assert len({r["high"] for r in rows}) == len(rows) >= 1
    placed = ranges.assign_key_range(df, "k", cut).filter("k is not null").groupBy("range_id").count()
    assert dict(map(tuple, placed.collect())) == {i: c for i, c in enumerate(counts, 1) if c}


def test_key_ranges_on_instants_and_text(events):
    for key in ("ts", "props"):
        rows, counts = covered(events, key, ranges.key_ranges(events, key, 4))
        assert sum(counts) == events.count() and 1 < len(rows) <= 4
        texts = ranges.range_predicates(ranges.key_ranges(events, key, 4), key)
        assert sum(events.filter(t).count() for t in texts) == events.count()


def test_equal_ranges(events):
    rows = ranges.equal_ranges(events, ["event_id"], 3).orderBy("bucket").collect()
    assert [r["rows"] for r in rows] == [334, 333, 333]


def test_time_ranges_cover_the_end_day(spark):
    rows = ranges.time_ranges(spark, "2024-01-01", "2024-01-07", 12).orderBy("range_id").collect()
    assert len(rows) == 14
    assert str(rows[0].range_start) == "2024-01-01 00:00:00" and str(rows[-1].range_end) == "2024-01-08 00:00:00"
    wide = ranges.time_ranges(spark, "2024-01-01", "2024-01-07", 48).orderBy("range_id").collect()
    assert len(wide) == 4 and str(wide[-1].range_start) == "2024-01-07 00:00:00"
    assert str(wide[-1].range_end) == "2024-01-08 00:00:00"
    assert all(a.range_end == b.range_start for a, b in zip(wide, wide[1:]))
    assert [tuple(r) for r in ranges.time_ranges(spark, None, None).collect()] == [(1, None, None)]


def test_time_slot_is_anchored_at_the_start(spark):
    df = spark.sql("select timestamp_ntz'2024-01-04 23:59:59.999999' t union all select timestamp_ntz'2024-01-05 00:00:00'")
    slots = df.orderBy("t").select(ranges.time_slot("t", "2024-01-01", 48).alias("s")).collect()
    assert [str(r.s) for r in slots] == ["2024-01-03 00:00:00", "2024-01-05 00:00:00"]


def test_chunk_ids_are_disjoint_and_complete(orders):
    out = numbering.with_chunk_id(orders.select("o_orderkey"), ["o_orderkey"], 400).groupBy("chunk_id")
    sizes = values(out.count().orderBy("chunk_id"), "count")
    assert sizes == [400, 400, 400, 300]


def test_systematic_positions(spark):
    df = spark.range(1, 101)
    assert sorted(values(sampling.systematic_sample(df, 10, ["id"]), "id")) == list(range(10, 101, 10))
    assert sorted(values(sampling.systematic_sample(df, 30, ["id"]), "id")) == list(range(3, 91, 3))
    assert sampling.systematic_sample(df, 1000, ["id"]).count() == 100


def test_file_positions_over_several_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 50, 1, 3).write.parquet(path)
    out = sampling.with_file_position(spark.read.parquet(path)).collect()
    assert sorted(r.position for r in out) == list(range(1, 51))
    assert [r.id for r in sorted(out, key=lambda r: r.position)] == list(range(50))


def test_random_sample(spark):
    df = spark.range(10_000)
    assert abs(sampling.random_sample(df, 1000).count() - 1000) < 200
    assert sampling.random_sample(df, 20_000).count() == 10_000
    assert 2000 < sampling.keyed_sample(df, "id", 250).count() < 3000


def test_stratified_sample_takes_a_share_of_each_stratum(spark):
    df = spark.range(100).select("id", F.when(F.col("id") < 70, "big").when(F.col("id") < 99, "small").alias("s"))
    out = sampling.stratified_sample(df, "s", 0.1, ["id"])
    assert sorted(map(tuple, out.collect())) == sorted(
        [(i, "big") for i in range(7)] + [(70, "small"), (71, "small"), (72, "small"), (99, None)]
    )
    assert set(values(sampling.stratified_random(df, "s", {"big": 1.0}, default=0.0), "s")) == {"big"}
