"""Merged profiles, heavy hitters, blocked correlation, exact samples, bound search, footers and bucketed joins."""

import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakewright.operators import clean, heavy, profile, ranges, sampling, sketches
from lakewright.operators.gram import blocked_correlation
from lakewright.plans.explore import Tables, explore_table, profile_table
from lakewright.sinks.bucketed import buckets_for, drop_bucketed, write_bucketed
from lakewright.sinks.versions import VersionedDataset
from lakewright.sources import readers
from workload import jobs
from tests.conftest import SMALL, plan_of, values


# --- merged profiles


def folders(spark, events, tmp_path):
    data = VersionedDataset(spark, str(tmp_path / "data"), F.date_trunc("day", "ts"), ["event_type"])
    return data, VersionedDataset(spark, str(tmp_path / "store"))


def test_a_merged_profile_is_that_of_all_rows(spark, events, tmp_path):
    holed = events.withColumn("value", F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    holed = holed.withColumn("none", F.lit(None).cast("double"))
    data, store = folders(spark, holed, tmp_path)
    for i in range(2):
        data.append(holed.filter(F.col("event_id") % 2 == i))
    got = {r["column"]: r for r in sketches.profile_versions(data, store).collect()}
    want = {r["column"]: r for r in profile.column_profile(holed).collect()}
    assert got.keys() == want.keys() | {"date"}
    for name, w in want.items():
        g = got[name]
        assert (g.dtype, g["rows"], g.null_count) == (w.dtype, 1000, w.null_count)
        assert g.unique_estimate == pytest.approx(w.unique_values, rel=0.05, abs=1)
        for x in ("mean", "std", "min", "max"):
            assert g[x] == pytest.approx(w[x]) if w[x] is not None else g[x] is None, (name, x)
    whole = sorted(values(holed.filter("not isnan(value)"), "value"))
    assert whole[int(0.48 * len(whole))] <= got["value"].p50 <= whole[int(0.52 * len(whole))]


def test_only_new_folders_are_read(spark, events, tmp_path, monkeypatch):
    data, store = folders(spark, events, tmp_path)
    read, rows_of = [], VersionedDataset.rows_of

    def watched(self, version, wanted):
        if self is data:
            read.append({(f.run, f.key) for f in wanted})
        return rows_of(self, version, wanted)

    data.append(events.filter("event_id < 500"))
    sketches.profile_versions(data, store).collect()
    first = data.latest()
    data.append(events.filter("event_id >= 500"))
    monkeypatch.setattr(VersionedDataset, "rows_of", watched)
    last = sketches.profile_versions(data, store).collect()
    assert read == [{(f.run, f.key) for f in data.latest().folders if f not in first.folders}]
    sketches.profile_versions(data, store).collect()
    assert len(read) == 1 and {r["rows"] for r in last} == {1000}
    # An older version is profiled from what is stored; replaced folders no longer count in the newest.
    assert {r["rows"] for r in sketches.profile_versions(data, store, 1).collect()} == {500}
    monkeypatch.undo()
    data.replace_range(events.limit(0), "ts", "2024-01-01", "2024-01-16")
    left = events.filter("ts >= '2024-01-16'").count()
    assert {r["rows"] for r in sketches.profile_versions(data, store).collect()} == {left}
    data.compact()
    assert {r["rows"] for r in sketches.profile_versions(data, store).collect()} == {left}


def test_nothing_to_profile(spark, tmp_path, events):
    data, store = folders(spark, events, tmp_path)
    with pytest.raises(ValueError):
        sketches.profile_versions(data, store)


# --- heavy hitters

RANDOM = random.Random(4)
COLUMNS = {
    "few": ["a", "b", "b", None, "c", "c", "c"] * 50,
    "distinct": [f"{RANDOM.random():.12f}" for _ in range(3000)],
    "pairs": [f"v{i // 2}" for i in range(2000)],
    "mixed": ["hot"] * 40 + [f"w{i // 3}" for i in range(90)] + [f"s{i}" for i in range(1500)],
    "repeated first": [f"a{i % 400:03d}" for i in range(800)] + ["z1", "z2", "z3"],
    "short": ["x", "y"],
    "nothing": [None, None],
}


@pytest.mark.parametrize("name", COLUMNS)
@pytest.mark.parametrize("counters", [8, 1 << 16])
def test_top_values(spark, name, counters):
    data = COLUMNS[name]
    df = spark.createDataFrame([(v,) for v in data], "v string").repartition(3)
    for k in (1, 10):
        want = sorted(Counter(v for v in data if v is not None).items(), key=lambda x: (-x[1], x[0]))[:k]
        got = [(r.value, r["count"], r["rank"]) for r in heavy.top_values(df, "v", k, counters).collect()]
        assert got == [(v, n, i) for i, (v, n) in enumerate(want, 1)], (name, k)


def test_singles_among_repeated_least_values(spark, monkeypatch):
    """The least values occur twice, so several limits are needed until singles come up."""
    monkeypatch.setattr(heavy, "LEAST_AT_ONCE", 1)
    data = [f"a{i % 60:03d}" for i in range(120)] + [f"b{i}" for i in range(50)]
    df = spark.createDataFrame([(v,) for v in data], "v string")
    got = [r.value for r in heavy.top_values(df, "v", 100, 4).collect()]
    assert got == sorted({v for v in data if v[0] == "a"}) + sorted(v for v in data if v[0] == "b")[:40]


def test_hashes_are_shuffled_not_values(spark):
    df = spark.createDataFrame([(v,) for v in COLUMNS["distinct"]], "value string")
    shuffled = df.groupBy(F.xxhash64("value").alias("hash")).agg(F.count(F.lit(1)).alias("n"))
    exchange = plan_of(shuffled).split("Exchange")[-1]
    assert "value#" not in exchange.split("Arguments")[0]


# --- correlation


def test_blocked_correlation_equals_the_other_form(spark):
    rnd = random.Random(2)
    rows = [tuple(None if rnd.random() < 0.2 else rnd.gauss(0, 1) * 10**j + i for j in range(6)) + (3.0, None, float("nan")) for i in range(400)]
    df = spark.createDataFrame(rows, ", ".join(f"c{j} double" for j in range(9))).repartition(3)
    want = {(r.column_a, r.column_b): r.correlation for r in profile.correlation_matrix(df).collect()}
    for block in (2, 5, 256):
        got = {(r.column_a, r.column_b): r.correlation for r in blocked_correlation(df, df.columns, block).collect()}
        assert got.keys() == want.keys()
        for pair, w in want.items():
            assert (got[pair] is None) == (w is None) and (w is None or math.isclose(got[pair], w, rel_tol=1e-9, abs_tol=1e-12)), pair
    assert {r.correlation for r in blocked_correlation(df.limit(0), ["c0", "c1"]).collect()} == {None}


def test_wide_tables_take_the_blocked_form(spark):
    df = spark.range(50).select(*[(F.col("id") * (i + 1) % 17).cast("double").alias(f"x{i}") for i in range(profile.WIDE_COLUMNS + 1)])
    got = {(r.column_a, r.column_b): r.correlation for r in profile.correlation_matrix(df).collect()}
    some = {(r.column_a, r.column_b): r.correlation for r in profile.correlation_matrix(df, ["x1", "x7"]).collect()}
    assert all(got[p] == pytest.approx(v) for p, v in some.items()) and len(got) == 25 * 25


def test_extremes_keep_all_digits(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(big, 1.5, None), (big + 2, float("nan"), None), (-(2**63), 2.5, None)], "a bigint, b double, c int")
    got = {r["column"]: (r.min_value, r.max_value) for r in profile.exact_extremes(df).collect()}
    assert got == {"a": (str(-(2**63)), str(big + 2)), "b": ("1.5", "2.5"), "c": (None, None)}


# --- samples, ranges


@pytest.mark.parametrize("rows", [0, 1, 7, 500, 999, 1000, 5000])
def test_exact_sample_has_its_size(spark, events, rows):
    drawn = sampling.exact_sample(events, rows)
    assert drawn.count() == min(rows, 1000) and drawn.columns == events.columns
    assert values(drawn.select("event_id").distinct().agg(F.count("*").alias("n")), "n") == [min(rows, 1000)]


def test_exact_sample_of_equal_rows_and_other_seeds(spark, events):
    same = spark.range(300).select(F.lit("x").alias("v"), F.lit(None).cast("int").alias("n"))
    assert sampling.exact_sample(same, 123).count() == 123
    one, two = (set(values(sampling.exact_sample(events, 100, s), "event_id")) for s in (1, 2))
    assert one != two and one == set(values(sampling.exact_sample(events.repartition(7), 100, 1), "event_id"))


@pytest.mark.parametrize("kind", ["bigint", "double", "string", "timestamp_ntz", "date", "decimal(20,3)"])
def test_ranges_of_any_type_are_found_by_halving(spark, kind):
    cast = {"timestamp_ntz": "timestamp_micros(id * 1234567)", "date": "date_add(date'2020-01-01', cast(id as int))"}.get(kind, "id")
    df = spark.range(200).select(F.expr(cast).cast(kind).alias("k"))
    for n in (1, 2, 7, 64):
        cut = ranges.key_ranges(df, "k", n)
        placed = ranges.assign_key_range(df, "k", cut)
        rows = {r.range_id: r for r in cut.collect()}
        for r in placed.collect():
            mine = rows[r.range_id]
            assert (r.k > mine.low or r.range_id == 1) and r.k <= mine.high


def test_many_ranges_cost_no_more_time_than_their_digits(spark):
    df = spark.range(200_000).withColumnRenamed("id", "k")
    took = {}
    for n in (100, 100_000):
        cut = spark.range(n).select((F.col("id") + 1).alias("range_id"), (F.col("id") * 2).alias("low"), (F.col("id") * 2 + 2).alias("high"))
        placed = ranges.assign_key_range(df, "k", cut)
        placed.limit(1).collect()
        start = time.perf_counter()
        top = placed.agg(F.max("range_id"), F.sum("range_id")).first()
        took[n] = time.perf_counter() - start
        assert top[0] == n
    assert took[100_000] < 8 * took[100] + 2


# --- sources and layouts


def test_footers_answer_without_reading_rows(spark, lineitem):
    facts = readers.footer_facts(spark, f"{SMALL}/lineitem.parquet", "l_orderkey", "l_linenumber")
    want = lineitem.agg(F.count("*"), F.min("l_orderkey"), F.max("l_orderkey"), F.min("l_linenumber"), F.max("l_linenumber")).first()
    assert tuple(facts.first()) == tuple(want)
    plan = plan_of(facts)
    assert "PushedAggregation: [" in plan and "COUNT(*)" in plan and "MIN(l_orderkey)" in plan
    with pytest.raises(ValueError):
        readers.footer_facts(spark, f"{SMALL}/lineitem.parquet", "l_tax")
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_bucketed_sides_join_without_a_shuffle(spark, lineitem, orders, tmp_path):
    write_bucketed(lineitem, "bucketed_lines", "l_orderkey", 4, str(tmp_path / "l"))
    write_bucketed(orders, "bucketed_orders", "o_orderkey", 4, str(tmp_path / "o"))
    joined = spark.table("bucketed_lines").hint("merge").join(spark.table("bucketed_orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    plan = plan_of(joined)
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "(1) Sort" not in plan
    grouped = joined.groupBy("l_orderkey").agg(F.sum("l_quantity"))
    assert "Exchange" not in plan_of(grouped)
    assert joined.count() == lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).count()
    for name in ("bucketed_lines", "bucketed_orders"):
        drop_bucketed(spark, name)
    with pytest.raises(ValueError):
        write_bucketed(orders, "none", "o_orderkey", 0, str(tmp_path / "n"))


def test_buckets_grow_with_the_tables(spark, lineitem, orders, monkeypatch):
    lines = lineitem.count()
    assert buckets_for(orders, lineitem) == 8 and buckets_for(orders, lineitem, least=3, rows_per_bucket=lines // 5) == 6
    monkeypatch.setattr(jobs, "buckets_for", lambda *sides: buckets_for(*sides, rows_per_bucket=lines // 50))
    joined = jobs.bucketed_join(spark, SMALL)
    assert "64 out of 64" in plan_of(joined) and joined.count() == lines
    with pytest.raises(ValueError):
        buckets_for(orders, rows_per_bucket=0)


def test_large_csv_files_are_split_unless_text_has_breaks(spark, tmp_path):
    df = spark.range(60_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v"))
    plain, broken = str(tmp_path / "p"), str(tmp_path / "b")
    df.coalesce(1).write.option("header", True).csv(plain)
    df.withColumn("v", F.when(F.col("id") == 59_999, 'a\n"b"').otherwise(F.col("v"))).coalesce(1).write.options(header=True, **readers.CSV_FORMAT).csv(broken)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 20)
    try:
        assert not readers.has_quoted_breaks(spark, plain) and readers.has_quoted_breaks(spark, broken)
        whole, split = (readers.read_csv(spark, p, "id bigint, v string") for p in (broken, plain))
        assert split.rdd.getNumPartitions() > 3 and whole.rdd.getNumPartitions() == 1
        assert split.count() == whole.count() == 60_000
        assert values(whole.filter("id = 59999"), "v") == ['a\n"b"']
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_jdbc_predicates(spark):
    cut = ranges.key_ranges(spark.range(100), "id", 4)
    call = readers.jdbc_predicate_call("jdbc:x", "t", ranges.range_predicates(cut, "id"), properties={"user": "u"}, fetch_size=7)
    assert call["predicates"][0].startswith("`id` >= 0") and len(call["predicates"]) == 4
    assert call["properties"] == {"fetchsize": "7", "user": "u"} and (call["url"], call["table"]) == ("jdbc:x", "t")
    for bad in ({"predicates": []}, {"predicates": [" "]}, {"predicates": ["a"], "key": "id", "bounds": (1, 2), "splits": 2}):
        with pytest.raises(ValueError):
            readers.jdbc_predicate_call("jdbc:x", "t", **bad)


def test_dates_in_the_first_pattern_that_fits_all(spark):
    rows = [("01/02/2024", "2024-01-02T00:00:00Z", "01/02/2024", "", None), ("13/02/2024", "2024-01-03T10:00:00Z", "2024-01-02", "01/02/2024", None)]
    df = spark.createDataFrame(rows, "a_date string, b_time string, c_date string, d_date string, e_date string")
    parsed, usable = clean.parse_dates(df, formats=("MM/dd/yyyy", "dd/MM/yyyy", "yyyy-MM-dd'T'HH:mm:ssX"))
    assert usable == ["a_date", "b_time", "d_date", "e_date"]
    assert [str(v) for v in values(parsed, "a_date")] == ["2024-02-01 00:00:00", "2024-02-13 00:00:00"]
    assert [str(v) for v in values(parsed, "b_time")] == ["2024-01-02 00:00:00", "2024-01-03 10:00:00"]
    assert values(parsed, "c_date") == ["01/02/2024", "2024-01-02"]
    assert [str(v) for v in values(parsed, "d_date")] == ["None", "2024-01-02 00:00:00"]
    assert clean.parse_dates(df)[1] == ["e_date"]


# --- tables on demand


def test_tables_are_made_when_asked_for(spark, events, monkeypatch):
    made = []
    tables = Tables({"a": lambda: made.append("a") or events, "b": lambda: made.append("b") or events})
    assert set(tables) == {"a", "b"} and len(tables) == 2 and made == []
    assert tables["a"] is tables["a"] is events and made == ["a"]

    def never(*_, **__):
        raise AssertionError("no quantiles are wanted")

    monkeypatch.setattr(profile, "quantiles_of", never)
    assert explore_table(events, order_by=["event_id"])["preview"].count() == 10
    assert profile_table(events)["rows"].first().total_rows == 1000
