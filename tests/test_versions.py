"""The commit log of datasets: killed runs, repeated batches, marks, ranges, packing."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from lakewright.sinks import versions
from lakewright.sinks.versions import ConflictError, VersionedDataset
from lakewright.streaming import incremental
from tests.conftest import values


def day():
    return F.date_trunc("day", "ts")


def ids(dataset, number=None):
    return sorted(values(dataset.read(number), "event_id"))


def kill_before_the_record(dataset, monkeypatch, run):
    def die(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(VersionedDataset, "_create", die)
        with pytest.raises(RuntimeError, match="killed"):
            run()


def test_append_and_read_back(spark, events, tmp_path):
    data = VersionedDataset(spark, str(tmp_path / "t"), day(), ["event_type"])
    with pytest.raises(ValueError):
        data.read()
    assert data.latest() is None and data.log().count() == 0
    for i in range(2):
        data.append(events.filter(F.col("event_id") % 2 == i), facts={"part": i})
    back = data.read()
    assert sorted(map(str, back.drop("date").select(*events.columns).collect())) == sorted(map(str, events.collect()))
    assert set(back.columns) == {*events.columns, "date"}
    assert ids(data, 1) == [i for i in range(1000) if i % 2 == 0] == sorted(values(events.filter("event_id % 2 = 0"), "event_id"))
    assert values(data.log(), "number") == [1, 2] and [r.facts["part"] for r in data.log().collect()] == ["0", "1"]
    assert sum(values(data.manifest(), "rows_processed")) == 500 == sum(values(data.manifest(1), "rows_processed"))
    plan = back.filter("date = '2024-01-05_00'")
    assert 0 < plan.count() == events.filter("to_date(ts) = '2024-01-05'").count()
    with pytest.raises(ValueError):
        data.append(events.drop("value"))


def test_a_killed_run_leaves_the_old_version(spark, events, tmp_path, monkeypatch):
    data = VersionedDataset(spark, str(tmp_path / "t"), day())
    data.append(events.filter("event_id < 300"), "w", 0)
    kill_before_the_record(data, monkeypatch, lambda: data.append(events.filter("event_id >= 300"), "w", 1))
    assert ids(data) == list(range(300)) and len(glob.glob(f"{tmp_path}/t/run=*")) == 2
    for _ in range(2):
        data.append(events.filter("event_id >= 300"), "w", 1)
        assert ids(data) == list(range(1000)) and data.latest().number == 2
    kill_before_the_record(data, monkeypatch, lambda: data.replace_range(events.limit(0), "ts", "2024-01-01", "2030-01-01"))
    kill_before_the_record(data, monkeypatch, lambda: data.compact())
    assert ids(data) == list(range(1000))
    assert len(data.drop_unreferenced()) == 0
    runs, live = set(os.listdir(tmp_path / "t")) - {versions.LOG}, {f"run={f.run}" for f in data.latest().folders}
    dropped = data.drop_unreferenced(older_than_hours=0)
    assert {d.rsplit("/", 1)[1] for d in dropped} == runs - live and len(dropped) >= 2
    assert ids(data) == list(range(1000))


def test_two_writers_of_one_number(spark, events, tmp_path, monkeypatch):
    """The second to come sees the first one's version and goes on from it."""
    data = VersionedDataset(spark, str(tmp_path / "t"))
    data.append(events.filter("event_id < 10"))
    other = VersionedDataset(spark, str(tmp_path / "t"))
    create, met = VersionedDataset._create, []

    def late(self, version):
        if not met:
            met.append(version.number)
            monkeypatch.setattr(VersionedDataset, "_create", create)
            other.append(events.filter("event_id >= 10 and event_id < 20"))
            return create(self, version)
        return create(self, version)

    monkeypatch.setattr(VersionedDataset, "_create", late)
    data.append(events.filter("event_id >= 20 and event_id < 30"))
    assert met == [2] and ids(data) == list(range(30)) and data.latest().number == 3


def test_a_replaced_base_is_a_conflict(spark, events, tmp_path, monkeypatch):
    data = VersionedDataset(spark, str(tmp_path / "t"), day())
    data.append(events)
    create = VersionedDataset._create

    def late(self, version):
        monkeypatch.setattr(VersionedDataset, "_create", create)
        VersionedDataset(spark, str(tmp_path / "t"), day()).replace_range(events.limit(0), "ts", "2024-01-02", "2024-01-03")
        return create(self, version)

    monkeypatch.setattr(VersionedDataset, "_create", late)
    with pytest.raises(ConflictError):
        data.replace_range(events.limit(0), "ts", "2024-01-02", "2024-01-04")


def test_marks_are_read_from_the_log(spark, tmp_path, monkeypatch):
    data = VersionedDataset(spark, str(tmp_path / "t"))
    df = spark.range(100).withColumnRenamed("id", "event_id")
    version, nulls = data.append_new(df.filter("event_id < 60"), "event_id")
    assert version.marks["append_new"] == {"text": "59", "type": "bigint"} and nulls == 0
    kill_before_the_record(data, monkeypatch, lambda: data.append_new(df, "event_id"))
    assert ids(data) == list(range(60))
    for _ in range(2):
        version, _ = data.append_new(df, "event_id")
        assert version.number == 2 and ids(data) == list(range(100))
    # The files are not looked at: without them the mark is still there.
    for run in glob.glob(f"{tmp_path}/t/run=*"):
        os.rename(run, run.replace("run=", "_was="))
    assert data.append_new(df, "event_id")[0].number == 2


def test_null_keys_are_told(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "event_id int, v string")
    data = VersionedDataset(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError, match="1 rows have no event_id"):
        data.append_new(df, "event_id")
    assert data.latest() is None
    version, nulls = data.append_new(df, "event_id", null_keys="count")
    assert nulls == 1 and ids(data) == [1, 3] and version.marks["append_new"]["type"] == "int"


def test_marks_of_instants(spark, events, tmp_path):
    data = VersionedDataset(spark, str(tmp_path / "t"))
    data.append_new(events.filter("ts < '2024-01-10'"), "ts")
    data.append_new(events, "ts")
    assert ids(data) == list(range(1000))


def test_a_range_inside_a_folder(spark, events, tmp_path):
    """Folders that the range covers in part keep their other rows; those it empties go."""
    data = VersionedDataset(spark, str(tmp_path / "t"), day(), ["event_type"])
    data.append(events.filter("event_id % 2 = 0"))
    data.append(events.filter("event_id % 2 = 1"))
    start, stop = "2024-01-05T06:00:00", "2024-01-07T18:00:00"
    inside = f"ts >= timestamp_ntz'{start}' and ts < timestamp_ntz'{stop}'"
    new = events.filter(inside).withColumn("value", F.lit(-1.0))
    before = {(f.run, f.key) for f in data.latest().folders}
    for _ in range(2):
        data.replace_range(new, "ts", start, stop)
        assert ids(data) == list(range(1000))
        assert sorted(values(data.read().filter("value = -1.0"), "event_id")) == sorted(values(new, "event_id"))
    untouched = {(f.run, f.key) for f in data.latest().folders} & before
    assert len(untouched) > 0.8 * len(before)
    data.replace_range(events.limit(0), "ts", "2024-01-05", "2024-01-08")
    assert ids(data) == sorted(values(events.filter("ts < '2024-01-05' or ts >= '2024-01-08'"), "event_id"))
    assert not any("date=2024-01-06" in f.key for f in data.latest().folders)
    with pytest.raises(Exception, match="outside the replaced range"):
        data.replace_range(events, "ts", "2024-01-05", "2024-01-08")


def test_packing_leaves_large_files_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    data = VersionedDataset(spark, path, partition_columns=["k"])
    noise = F.sha2(F.col("event_id").cast("string"), 256).alias("v")
    rows = spark.range(120_000).withColumnRenamed("id", "event_id").select("event_id", noise, F.lit("a b/c+d").alias("k"))
    data.append(rows.filter("event_id < 100000").coalesce(1), rebalance=False)
    (large,) = data.latest().folders
    data.append(rows.filter("event_id >= 100000").repartition(100), rebalance=False)
    sizes = {f: os.path.getsize(f) for f in glob.glob(f"{path}/run=*/k=*/*.parquet")}
    target = 1 << 20
    assert sum(s > target for s in sizes.values()) >= 1 and sum(s < target / 10 for s in sizes.values()) == 100
    version = data.compact(target, small_share=0.5)
    assert ids(data) == list(range(120_000))
    assert large in version.folders
    packed = [f for f in version.folders if f.run == version.run]
    small = sum(s for s in sizes.values() if s < target / 10)
    assert len(packed) == 1 and packed[0].rows == 20_000 and packed[0].files == -(-small // target)
    assert data.compact(target, small_share=0.5).number == version.number
    # Small files beside a large one of the same run: the large one stays by name.
    both = VersionedDataset(spark, str(tmp_path / "u"))
    mixed = rows.drop("k").withColumn("p", F.when(F.col("event_id") < 100_000, 0).otherwise(F.col("event_id") % 7 + 1).cast("int"))
    both.append(mixed.repartitionById(8, F.col("p")).drop("p"))
    done = both.compact(target, small_share=0.5)
    assert ids(both) == list(range(120_000))
    assert any(f.only and len(f.only) == 1 for f in done.folders)


def test_paths_are_taken_apart_once_a_file(spark, events, tmp_path):
    data = VersionedDataset(spark, str(tmp_path / "t"), day(), ["event_type"])
    data.append(events)
    files = versions._files(data.rows_of(data.latest(), data.latest().folders))
    below = files._jdf.queryExecution().optimizedPlan().toString().partition("Aggregate")[2].partition("\n")[2]
    assert "_metadata" in below and "regexp" not in below
    listed = {(r.run, r.key): r.rows for r in files.groupBy("run", "key").agg(F.sum("rows").alias("rows")).collect()}
    assert listed == {(f.run, f.key): f.rows for f in data.latest().folders} and sum(listed.values()) == 1000


def test_stream_batches_are_committed_once(spark, events, tmp_path, monkeypatch):
    source, path, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for i in range(3):
        events.filter(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(source)

    def run(checkpoint=progress):
        arrived = incremental.stream_files(spark, source, events.schema, files_per_batch=1)
        incremental.run_committed_stream(arrived, path, checkpoint, day(), writer="events")

    create = VersionedDataset._create

    def die_once(self, version):
        if version.number == 2:
            monkeypatch.setattr(VersionedDataset, "_create", create)
            raise RuntimeError("killed")
        return create(self, version)

    monkeypatch.setattr(VersionedDataset, "_create", die_once)
    with pytest.raises(Exception, match="killed"):
        run()
    data = VersionedDataset(spark, path, day())
    assert len(ids(data)) < 1000
    run()
    assert ids(data) == list(range(1000)) and data.latest().number == 3 and data.latest().batches == {"events": 2}
    run()
    # The same batches once more, from a checkpoint that has forgotten them.
    run(str(tmp_path / "forgotten"))
    assert ids(data) == list(range(1000)) and data.latest().number == 3
    assert not glob.glob(f"{path}/_spark_metadata")
    data.compact()
    assert len({f.key for f in data.latest().folders}) == len(data.latest().folders)
    assert ids(data) == list(range(1000))


def test_records_are_small_and_complete(spark, events, tmp_path):
    data = VersionedDataset(spark, str(tmp_path / "t"), day())
    version = data.append(events)
    assert versions.Version.from_json(version.to_json()) == version == data.latest()
    names = [n for n in os.listdir(tmp_path / "t" / versions.LOG) if not n.endswith(".crc")]
    assert names == ["00000000000000000001.json"]
    with pytest.raises(ValueError):
        data.version(7)
