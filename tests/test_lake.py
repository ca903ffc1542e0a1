import glob
import json
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql.utils import AnalysisException
from pyspark.sql import functions as F

from lakewright import ExtractConfig, explore_table, profile_table, run_extract
from lakewright.operators.clean import plan_clean
from lakewright.plans.extract import extraction_partitions, extraction_runs
from lakewright.session import new_path, scratch, shared_folder
from lakewright.sinks import export, lake
from lakewright.sources import readers
from lakewright.streaming import incremental
from tests.conftest import values


def files(path):
    return sorted(glob.glob(f"{path}/**/*.parquet", recursive=True))


def test_shared_folder_is_the_sessions_setting(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert new_path(spark, "x") != new_path(spark, "x")


def test_scratch_folders_go_after_their_block(spark):
    kept = new_path(spark, "kept")
    with scratch(spark):
        inside = new_path(spark, "inside")
        spark.range(3).write.parquet(inside)
        with scratch(spark):
            deeper = new_path(spark, "deeper")
            spark.read.parquet(inside).write.parquet(deeper)
            spark.read.parquet(deeper).write.parquet(kept)
        assert os.path.isdir(inside) and not os.path.isdir(deeper)
    assert not os.path.isdir(inside) and spark.read.parquet(kept).count() == 3
    with pytest.raises(RuntimeError), scratch(spark):
        failed = new_path(spark, "failed")
        spark.range(3).write.parquet(failed)
        raise RuntimeError
    assert not os.path.isdir(failed)
    assert os.path.isdir(kept) and new_path(spark, "after") != kept


def test_partitioned_write_reads_back_identical(spark, events, tmp_path):
    path = str(tmp_path / "t")
    by = lake.write_partitioned(events, path, date=F.date_trunc("day", "ts"), partition_columns=["event_type"])
    assert by == ["date", "event_type"]
    back = lake.read_dataset(spark, path)
    assert back.schema["date"].dataType.simpleString() == "string"
    assert sorted(map(str, back.select(*events.columns).collect())) == sorted(map(str, events.collect()))
    assert os.path.isdir(f"{path}/date=2024-01-01_00/event_type=click")
    assert len(files(path)) == back.select("date", "event_type").distinct().count()


def test_writer_options_are_in_the_files(spark, lineitem, tmp_path):
    path = str(tmp_path / "t")
    options = lake.parquet_options(dictionary_columns=["l_returnflag"], row_group_rows=1000, columns=lineitem.columns)
    lake.write_partitioned(lineitem, path, options=options, rows_per_file=2500, sort_by=["l_orderkey"])
    meta = [pq.ParquetFile(f).metadata for f in files(path)]
    assert sum(m.num_rows for m in meta) == lineitem.count() and max(m.num_rows for m in meta) <= 2500
    group = meta[0].row_group(0)
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert group.num_rows <= 1000 and columns["l_tax"].compression == "ZSTD" and columns["l_tax"].is_stats_set
    assert columns["l_returnflag"].has_dictionary_page and not columns["l_tax"].has_dictionary_page
    assert columns["l_tax"].has_offset_index and columns["l_tax"].has_column_index


def test_a_hot_folder_is_split(spark, tmp_path):
    df = spark.range(0, 400_000, 1, 8).select(F.sha2(F.col("id").cast("string"), 256).alias("v"), F.lit("hot").alias("k"))
    path = str(tmp_path / "t")
    lake.write_partitioned(df, path, partition_columns=["k"], target_file_bytes=4 << 20)
    assert len(files(path)) > 1 and spark.read.parquet(path).count() == 400_000


def test_compaction_keeps_rows_and_merges_files(spark, events, tmp_path):
    src, dst = str(tmp_path / "a"), str(tmp_path / "b")
    events.withColumn("date", F.lit("2024-01-01_00")).repartition(6).write.partitionBy("date", "event_type").parquet(src)
    out = lake.compact(spark, src, dst, ["date", "event_type"], ["event_id"])
    assert len(files(src)) > len(files(dst)) == 5
    assert sorted(values(out, "event_id")) == sorted(values(events, "event_id"))
    lake.compact_in_place(spark, src, ["date", "event_type"])
    assert len(files(src)) == 5 and lake.read_dataset(spark, src).count() == events.count()
    with pytest.raises(ValueError):
        lake.compact(spark, src, src + "/", ["date"])


def test_backfill_replaces_only_its_folders(spark, events, tmp_path):
    path, day = str(tmp_path / "t"), F.date_trunc("day", "ts")
    lake.backfill(events, path, day)
    before = set(files(path))
    one = events.filter("ts >= '2024-01-05' and ts < '2024-01-06'")
    for _ in range(2):
        lake.backfill(one, path, day)
        assert lake.read_dataset(spark, path).count() == events.count()
    assert len(before - set(files(path))) == 1


def test_manifest_matches_the_files(spark, events, tmp_path):
    path = str(tmp_path / "t")
    by = lake.write_partitioned(events, path, partition_columns=["event_type"])
    parts = lake.manifest(lake.read_dataset(spark, path), by)
    assert sum(values(parts, "bytes_written")) == sum(map(os.path.getsize, files(path)))
    total = lake.run_totals(parts).first()
    assert (total.total_rows, total.total_files, total.total_partitions) == (events.count(), 5, 5)
    lake.write_manifest(parts, str(tmp_path / "m"), {"extraction_id": "abc", "none": None})
    record = json.loads(next(open(f) for f in glob.glob(f"{tmp_path}/m/run/*.json") if os.path.getsize(f)).readline())
    assert record == {"extraction_id": "abc", "total_rows": 1000, "total_files": 5, "total_partitions": 5}


def test_extraction_id_ignores_the_order_of_exclusions(spark):
    import hashlib

    want = hashlib.md5(b"t_2024-01-01_2024-01-07_cat1,cat2").hexdigest()[:8]
    assert lake.extraction_id(spark, "t", "2024-01-01", "2024-01-07", ["cat2", "cat1"]) == want
    unset = hashlib.md5(b"t_None_None_").hexdigest()[:8]
    assert lake.extraction_id(spark, "t", None, None) == unset


def test_csv_round_trip_and_single_file(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", ""), (2, None, 'q"t')], "id int, `a b` string, c string")
    path = str(tmp_path / "c")
    export.write_csv(df, path, single_file_rows=100)
    (name,) = glob.glob(f"{path}/*.csv")
    lines = open(name).read().splitlines()
    assert lines[0] == "id,a b,c" and sorted(lines[1:])[0] == '1,"a,b",'
    assert readers.read_csv(spark, path).schema["id"].dataType.simpleString() == "int"
    with pytest.raises(ValueError):
        export.write_csv(df, str(tmp_path / "d"), single_file_rows=1)


def test_jdbc_options():
    got = readers.jdbc_options("jdbc:x", query="select 1", key="id", bounds=(1, 9), splits=4, session_init="set a")
    assert got == {
        "url": "jdbc:x", "fetchsize": "50000", "dbtable": "(select 1) q", "partitionColumn": "id",
        "lowerBound": "1", "upperBound": "9", "numPartitions": "4", "sessionInitStatement": "set a",
    }
    assert readers.jdbc_options("jdbc:x", table="t", fetch_size=10)["dbtable"] == "t"
    for bad in ({"table": "t", "query": "q"}, {}, {"table": "t", "key": "id"}):
        with pytest.raises(ValueError):
            readers.jdbc_options("jdbc:x", **bad)


def test_overview_scales_bytes_to_the_full_size(spark, events):
    size = os.path.getsize("/root/testdata/sf0.001/events.parquet")
    row = readers.overview(events, full_rows=4000).first()
    assert (row.sample_rows, row.total_rows, row.sample_pct, row.files) == (1000, 4000, 25.0, 1)
    assert (row.file_bytes, row.estimated_full_bytes, row.column_count) == (size, 4 * size, 6)


def test_keyset_chunks_lose_no_tied_row(spark):
    df = spark.range(90).select((F.col("id") / 3).cast("int").alias("k"), "id")
    last, seen = None, []
    while True:
        chunk = incremental.keyset_chunk(df, "k", last, 10)
        rows = values(chunk, "id")
        if not rows:
            break
        seen += rows
        last = incremental.high_water_mark(chunk, "k")
    assert sorted(seen) == list(range(90))
    assert len(values(incremental.keyset_chunk(df, "k", None, 10, keep_ties=False), "id")) == 10


def test_append_new_is_idempotent(spark, tmp_path):
    path, df = str(tmp_path / "t"), spark.range(100)
    assert incremental.append_new(df.filter("id < 60"), "id", path) == 59
    assert incremental.append_new(df, "id", path) == 99
    count = len(files(path))
    assert incremental.append_new(df, "id", path) == 99
    assert len(files(path)) == count and sorted(values(spark.read.parquet(path), "id")) == list(range(100))


def test_stream_takes_each_file_once(spark, events, tmp_path):
    source, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    thirds = [events.filter(F.col("event_id") % 3 == i).coalesce(1) for i in range(3)]
    valid = spark.createDataFrame([("click",), ("view",)], "v string")
    frozen = plan_clean(events).schema

    def run():
        arrived = incremental.stream_files(spark, source, events.schema, files_per_batch=1)
        wanted = incremental.extract_stream(arrived, "event_type", valid, "ts", "2024-01-02", "2024-01-20", frozen, "errors")
        incremental.run_stream(wanted, target, progress, date=F.date_trunc("day", "ts"))
        return sorted(values(lake.read_dataset(spark, target), "event_id"))

    want = events.filter("event_type in ('click', 'view') and ts >= '2024-01-02' and ts < '2024-01-20'")
    expect = lambda keep: sorted(values(want.filter(keep), "event_id"))
    thirds[0].write.parquet(source)
    thirds[1].write.mode("append").parquet(source)
    assert run() == run() == expect("event_id % 3 < 2")
    thirds[2].write.mode("append").parquet(source)
    assert run() == expect("true")
    assert lake.read_dataset(spark, target).schema["event_id"].dataType.simpleString() == "smallint"


@pytest.mark.parametrize("fixed", [False, True])
def test_extract_job(spark, lineitem, orders, tmp_path, fixed):
    config = ExtractConfig(
        "joined", "l_orderkey", "o_orderkey", ("o_orderpriority",), "o_orderpriority", excluded=("5-LOW", "1-URGENT"),
        date_column="l_shipdate", start="1996-01-01", end="1996-01-31", hours=48, partition_column="l_returnflag",
        hot_share=0.5 if fixed else None,
    )
    if fixed:
        plain = lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey).select(
            *lineitem.columns, F.col("o_orderpriority").alias("tb2_o_orderpriority")
        )
        config = ExtractConfig(**{**config.__dict__, "schema": plan_clean(plain).schema})
    done = run_extract(spark, lineitem, orders, orders.select("o_orderpriority"), config, str(tmp_path))
    want = lineitem.filter("l_shipdate >= '1996-01-01' and l_shipdate < '1996-02-01'").join(
        orders.filter("o_orderpriority in ('2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED')"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    assert done.data.count() == want.count() > 0
    assert done.data.schema["l_orderkey"].dataType.simpleString() == "smallint"
    assert set(done.data.columns) == {*lineitem.columns, "tb2_o_orderpriority", "date"}
    assert sum(values(done.partitions, "rows_processed")) == want.count()
    assert glob.glob(f"{tmp_path}/_manifests/joined/{done.extraction_id}/run/*.json")
    again = run_extract(spark, lineitem, orders, orders.select("o_orderpriority"), config, str(tmp_path))
    assert again.data.count() == want.count() and again.extraction_id == done.extraction_id


def small_lake(spark, tmp_path, **kwargs):
    day = F.timestamp_add("DAY", (F.col("id") % 10).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz"))
    fact = spark.range(200).select("id", day.alias("d"), F.when(F.col("id") % 2 == 0, "EU").otherwise("US").alias("zone"))
    detail = fact.select("id", F.lit("c").alias("cat"), F.col("zone").alias("area"))
    config = ExtractConfig("t", "id", "id", ("cat",), "cat", **{"date_column": "d", "hours": 48, **kwargs})
    return run_extract(spark, fact, detail, detail.select("cat"), config, str(tmp_path))


def everything(spark, result):
    return sorted(values(lake.read_dataset(spark, result.path), "id"))


def test_overlapping_and_repeated_runs_keep_each_row_once(spark, tmp_path):
    ids = lambda low, high: [i for i in range(200) if low <= i % 10 + 1 <= high]
    small_lake(spark, tmp_path, start="2024-01-01", end="2024-01-07")
    second = small_lake(spark, tmp_path, start="2024-01-08", end="2024-01-10")
    assert everything(spark, second) == list(range(200))
    again = small_lake(spark, tmp_path, start="2024-01-02", end="2024-01-05")
    assert everything(spark, again) == list(range(200))
    assert sorted(values(again.partitions, "date")) == ["2024-01-01_00", "2024-01-03_00", "2024-01-05_00"]
    assert sorted(values(again.data, "id")) == ids(1, 6) == sorted(values(again.data, "id"))
    assert sum(values(again.partitions, "rows_processed")) == len(ids(1, 6))
    with pytest.raises(ValueError):
        small_lake(spark, tmp_path, start="2024-01-02", end="2024-01-05", hours=24)


def test_runs_of_partition_values_stay_apart(spark, tmp_path):
    days = {"start": "2024-01-01", "end": "2024-01-10"}
    small_lake(spark, tmp_path, partition_column="area", partition_value="EU", **days)
    us = small_lake(spark, tmp_path, partition_column="area", partition_value="US", **days)
    assert everything(spark, us) == list(range(200))
    assert set(values(us.data, "tb2_area")) == {"US"} and us.data.count() == 100


def test_runs_of_partition_values_keep_their_manifests(spark, tmp_path):
    days = {"start": "2024-01-01", "end": "2024-01-10", "partition_column": "area"}
    for value in ("EU", "US", "EU"):
        small_lake(spark, tmp_path, partition_value=value, **days)
    facts = extraction_runs(spark, str(tmp_path), "t").collect()
    assert sorted((r.partition_value, r.total_rows) for r in facts) == [("EU", 100), ("US", 100)]
    assert len({r.extraction_id for r in facts}) == 1
    listed = extraction_partitions(spark, str(tmp_path), "t").groupBy("manifest").agg(F.sum("rows_processed").alias("n"))
    assert sorted(values(listed, "n")) == [100, 100]


def test_a_fixed_schema_computes_the_rows_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    day = F.timestamp_add("DAY", (F.col("id") % 10).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz"))
    fact = spark.range(200).select("id", day.alias("d"))
    counted = fact.mapInArrow(count, fact.schema)
    detail = spark.range(200).select("id", F.lit("c").alias("cat"))
    schema = fact.withColumn("tb2_cat", F.lit("c")).schema
    config = ExtractConfig("t", "id", "id", ("cat",), "cat", date_column="d", start="2024-01-01", end="2024-01-10", hours=48, schema=schema)
    for run in (1, 2):
        result = run_extract(spark, counted, detail, detail.select("cat"), config, str(tmp_path))
        assert seen.value == 200 * run
    assert everything(spark, result) == list(range(200))


def test_emptied_folders_go_and_plain_datasets_are_not_replaced(spark, tmp_path):
    days = {"start": "2024-01-01", "end": "2024-01-10"}
    small_lake(spark, tmp_path, **days)
    none = small_lake(spark, tmp_path, excluded=("c",), **days)
    assert not glob.glob(f"{none.path}/date=*")
    with pytest.raises(AnalysisException):
        small_lake(spark, tmp_path, date_column=None)


def test_stream_output_is_not_rewritten(spark, tmp_path):
    os.makedirs(tmp_path / "s" / "_spark_metadata")
    with pytest.raises(ValueError):
        lake.compact_in_place(spark, str(tmp_path / "s"), ["date"])


def test_compaction_leaves_full_folders_alone(spark, tmp_path):
    path = str(tmp_path / "c")
    for part, count in (("a", 1), ("b", 3)):
        spark.range(90).withColumn("p", F.lit(part)).repartition(count).write.mode("append").partitionBy("p").parquet(path)
    before = glob.glob(f"{path}/p=a/*.parquet")
    lake.compact_in_place(spark, path, ["p"])
    assert glob.glob(f"{path}/p=a/*.parquet") == before and len(glob.glob(f"{path}/p=b/*.parquet")) == 1
    assert spark.read.parquet(path).count() == 180


def test_profile_job(spark, events, tmp_path):
    tables = profile_table(events, report_path=str(tmp_path / "r"))
    assert set(os.listdir(tmp_path / "r")) == set(tables)
    assert tables["missing"].count() == 0 and tables["columns"].count() == 6
    sampled = profile_table(events, sample_rows=500)
    over = sampled["overview"].first()
    assert over.total_rows == 1000 and 350 < over.sample_rows < 650


def test_explore_job(spark, events, tmp_path):
    out = explore_table(
        events, "event_type", ["click"], "ts", "2024-01-02", "2024-01-03", rows=7, order_by=["event_id"], export_path=str(tmp_path / "e")
    )
    assert out["preview"].count() == 7 and set(values(out["filtered"], "event_type")) == {"click"}
    assert out["rows"].first().total_rows == out["filtered"].count() == readers.read_csv(spark, str(tmp_path / "e/filtered")).count()
    assert readers.read_csv(spark, str(tmp_path / "e/original")).count() == 1000
    with pytest.raises(ValueError):
        explore_table(events, date_column="value")
