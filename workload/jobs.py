"""Writes, compaction, incremental runs, and the whole extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakewright.functions import predicates as p
from lakewright.functions.cleaning import partition_text
from lakewright.operators.clean import plan_clean
from lakewright.operators.ranges import time_slot
from lakewright.plans.config import ExtractConfig
from lakewright.plans.extract import extraction_partitions, extraction_runs, run_extract
from lakewright.session import new_path
from lakewright.sinks import lake
from lakewright.sinks.bucketed import buckets_for, write_bucketed
from lakewright.sinks.versions import VersionedDataset
from lakewright.streaming import incremental
from workload.filtering import CONFIG, priorities
from workload.registry import query, table

PER_FOLDER = """SELECT strftime(ts, '%Y-%m-%d_%H') AS date, event_type, count(*) AS rows, round(sum(value), 2)::DOUBLE AS total
  FROM events GROUP BY 1, 2"""


def per_folder(df):
    return df.groupBy("date", "event_type").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 2).alias("total")
    )


@query("write_partitioned", "K1 C12", PER_FOLDER.replace("_%H", "_00"))
def _(spark, sf):
    path = new_path(spark, "events")
    lake.write_partitioned(table(spark, sf, "events"), path, date=F.date_trunc("day", "ts"), partition_columns=["event_type"])
    return per_folder(lake.read_dataset(spark, path))


@query("write_tuned", "K2 K3", "SELECT * FROM lineitem")
def write_tuned(spark, sf):
    lines, path = table(spark, sf, "lineitem"), new_path(spark, "tuned")
    options = lake.parquet_options(
        dictionary_columns=["l_returnflag", "l_linestatus"], row_group_rows=20_000, columns=lines.columns
    )
    lake.write_partitioned(lines, path, options=options, rows_per_file=500_000, sort_by=["l_orderkey"])
    return spark.read.parquet(path)


@query(
    "compact",
    "K4 H4",
    """SELECT strftime(ts, '%Y-%m-%d_00') AS date, event_type, count(*) AS rows, round(sum(value), 2)::DOUBLE AS total,
       1::BIGINT AS files FROM events GROUP BY 1, 2""",
)
def _(spark, sf):
    path = new_path(spark, "chunks")
    days = table(spark, sf, "events").withColumn("date", partition_text(F.date_trunc("day", "ts")))
    days.repartition(4).write.partitionBy("date", "event_type").parquet(path)
    whole = lake.compact(spark, path, new_path(spark, "compacted"), ["date", "event_type"], ["event_id"])
    files = F.count_distinct("_metadata.file_path").alias("files")
    return whole.groupBy("date", "event_type").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 2).alias("total"), files
    )


@query(
    "manifest",
    "K6 K1",
    """SELECT strftime(time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2024-01-01'), '%Y-%m-%d_%H') AS date,
       count(*) AS rows_processed, 1::BIGINT AS files_written FROM events GROUP BY 1""",
)
def _(spark, sf):
    path = new_path(spark, "slots")
    lake.write_partitioned(table(spark, sf, "events"), path, date=time_slot("ts", "2024-01-01", 12))
    return lake.manifest(lake.read_dataset(spark, path)).drop("bytes_written")


@query(
    "run_totals",
    "A17 K6",
    """SELECT count(*) AS total_rows, count(DISTINCT o_orderpriority) AS total_files,
       count(DISTINCT o_orderpriority) AS total_partitions FROM orders""",
)
def _(spark, sf):
    path = new_path(spark, "orders")
    by = lake.write_partitioned(table(spark, sf, "orders"), path, partition_columns=["o_orderpriority"])
    return lake.run_totals(lake.manifest(lake.read_dataset(spark, path), by))


@query("incremental_batch", "I2 I1", "SELECT * FROM events")
def _(spark, sf):
    events, path = table(spark, sf, "events"), new_path(spark, "appended")
    half = incremental.high_water_mark(events, "event_id") // 2
    incremental.append_new(events.filter(p.key_range("event_id", None, half)), "event_id", path)
    for _ in range(2):
        incremental.append_new(events, "event_id", path)
    return spark.read.parquet(path)


@query(
    "incremental_stream",
    "I3 I5 K1",
    """SELECT event_id::SMALLINT AS event_id, ts, user_id::SMALLINT AS user_id, event_type, value, props,
       strftime(ts, '%Y-%m-%d_00') AS date
       FROM events WHERE event_type IN ('click', 'view', 'purchase', 'signup')
       AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-25'""",
)
def incremental_stream(spark, sf):
    events = table(spark, sf, "events")
    valid = events.select("event_type").filter(p.denied("event_type", ["error"])).distinct()
    target, checkpoint = new_path(spark, "stream"), new_path(spark, "progress")
    frozen = plan_clean(events).schema
    # Run twice: the second run finds the file already read and adds nothing.
    for _ in range(2):
        arrived = incremental.stream_files(spark, sf, events.schema, glob="events.parquet")
        wanted = incremental.extract_stream(arrived, "event_type", valid, "ts", "2024-01-03", "2024-01-25", frozen)
        incremental.run_stream(wanted, target, checkpoint, date=F.date_trunc("day", "ts"))
    return lake.read_dataset(spark, target)


@query("range_backfill", "I4 W4", PER_FOLDER.replace("_%H", "_00"))
def range_backfill(spark, sf):
    events, path = table(spark, sf, "events"), new_path(spark, "backfill")
    day = F.date_trunc("day", "ts")
    # A first run whose last days are wrong, then the ranges from the 20th once more.
    wrong = events.withColumn("value", F.when(F.col("ts") >= "2024-01-20", 0.0).otherwise(F.col("value")))
    lake.backfill(wrong, path, day)
    for _ in range(2):
        lake.backfill(events.filter(p.half_open("ts", "2024-01-20", "2030-01-01")), path, day)
    return per_folder(lake.read_dataset(spark, path))


EXTRACTED = """SELECT l.* EXCLUDE (l_orderkey, l_partkey, l_suppkey, l_linenumber),
       l_orderkey::SMALLINT AS l_orderkey, l_partkey::SMALLINT AS l_partkey, l_suppkey::SMALLINT AS l_suppkey,
       l_linenumber::SMALLINT AS l_linenumber, o.o_orderkey::SMALLINT AS tb2_o_orderkey,
       o.o_orderpriority AS tb2_o_orderpriority, o.o_totalprice AS tb2_o_totalprice,
       strftime(time_bucket(INTERVAL 48 HOUR, l_shipdate, TIMESTAMP '1996-01-01'), '%Y-%m-%d_%H') AS date
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
WHERE o.o_orderpriority <> '5-LOW' AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'"""


@query("extract_run", "L1 U1 J1 J4 H1 R1 C18 K1 K2 K6 F5", EXTRACTED)
def extract_run(spark, sf):
    config = ExtractConfig(**{**CONFIG.__dict__, "hours": 48})
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return run_extract(spark, lines, orders, priorities(spark, sf), config, new_path(spark, "lake")).data


@query(
    "extract_manifest",
    "L1 K6 A17",
    f"SELECT date, count(*) AS rows_processed FROM ({EXTRACTED}) GROUP BY date",
)
def _(spark, sf):
    frozen = ExtractConfig(**{**CONFIG.__dict__, "hours": 48, "schema": None, "hot_share": 0.001})
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    result = run_extract(spark, lines, orders, priorities(spark, sf), frozen, new_path(spark, "lake"))
    return result.partitions.select("date", "rows_processed")


def _ids(sql):
    return f"SELECT l_orderkey::BIGINT AS l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(*) AS rows FROM ({sql}) GROUP BY 1, 2"


def counted_ids(df):
    keys = [F.col(c).cast("bigint").alias(c) for c in ("l_orderkey", "l_linenumber")]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))


def runs(spark, sf, *changes):
    """The whole dataset after some runs, and the result of the last of them."""
    target = new_path(spark, "lake")
    for change in changes:
        config = ExtractConfig(**{**CONFIG.__dict__, "hours": 48, **change})
        last = run_extract(spark, table(spark, sf, "lineitem"), table(spark, sf, "orders"), priorities(spark, sf), config, target)
    return lake.read_dataset(spark, last.path), last


YEARS = """SELECT l.l_orderkey, l.l_linenumber FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
WHERE o.o_orderpriority <> '5-LOW' AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'"""


@query("extract_overlapping_runs", "L1 I4 F5", _ids(YEARS))
def _(spark, sf):
    """Runs over days that overlap and cover folders in part leave each row once."""
    parts = [("1996-01-01", "1996-12-30"), ("1996-12-31", "1997-12-31"), ("1996-06-02", "1997-02-05")]
    return counted_ids(runs(spark, sf, *[{"start": a, "end": b} for a, b in parts])[0])


@query("extract_detail_partition", "L1 W6 K1", _ids(YEARS + " AND o.o_orderstatus IN ('F', 'O')"))
def _(spark, sf):
    """Two runs for two values of a partition column of the detail side."""
    return counted_ids(runs(spark, sf, *[{"partition_column": "o_orderstatus", "partition_value": v} for v in "FO"])[0])


@query("extract_second_manifest", "L1 K6", f"SELECT count(*) AS rows_processed FROM ({YEARS})".replace("'1996-01-01'", "'1997-01-01'"))
def _(spark, sf):
    """The manifest of a second run counts the rows of its own folders: the first of them begins on 1 January 1997 and keeps
    the rows of that day, which the first run wrote."""
    last = runs(spark, sf, {"end": "1997-01-01"}, {"start": "1997-01-02"})[1]
    return last.partitions.agg(F.sum("rows_processed").alias("rows_processed"))


@query(
    "extract_two_values_manifests",
    "L1 K6 K7 W6",
    f"""SELECT o_orderstatus AS partition_value, strftime(time_bucket(INTERVAL 48 HOUR, l_shipdate, TIMESTAMP '1996-01-01'), '%Y-%m-%d_%H') AS date,
       count(*) AS rows_processed, sum(count(*)) OVER (PARTITION BY o_orderstatus)::BIGINT AS total_rows
       FROM ({YEARS.replace('l.l_linenumber FROM', 'l.l_linenumber, o_orderstatus, l_shipdate FROM')}) WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2""",
)
def _(spark, sf):
    """Runs of two partition values over the same days each keep a manifest."""
    folder = runs(spark, sf, *[{"partition_column": "o_orderstatus", "partition_value": v} for v in "FO"])[1].path.rsplit("/", 1)
    facts = extraction_runs(spark, *folder).select("extraction_id", "partition_value", "total_rows")
    listed = extraction_partitions(spark, *folder).select("manifest", "date", "rows_processed")
    own = F.col("manifest") == F.concat_ws("-", "extraction_id", "partition_value")
    return listed.join(facts, own).select("partition_value", "date", "rows_processed", "total_rows")


@query(
    "append_null_keys",
    "I2",
    """SELECT count(*) AS rows, min(key) AS low, max(key) AS high, 2::BIGINT AS versions,
       (SELECT count(*) FROM events WHERE event_type = 'error') AS without_key
       FROM (SELECT nullif(event_id, CASE WHEN event_type = 'error' THEN event_id END) AS key FROM events) WHERE key IS NOT NULL""",
)
def _(spark, sf):
    """Three runs into a versioned dataset, the mark kept in its log; rows without a key are counted, not lost silently."""
    events = table(spark, sf, "events").withColumn("key", F.when(F.col("event_type") != "error", F.col("event_id")))
    data = VersionedDataset(spark, new_path(spark, "logged"))
    half = incremental.high_water_mark(events, "key") // 2
    data.append_new(events.filter(F.col("key") <= half), "key")
    for _ in range(2):
        version, without = data.append_new(events, "key", null_keys="count")
    return data.read().agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("key").alias("low"),
        F.max("key").alias("high"),
        F.lit(version.number).cast("bigint").alias("versions"),
        F.lit(without).cast("bigint").alias("without_key"),
    )


STREAMED = """SELECT strftime(ts, '%Y-%m-%d_00') AS date, event_type, count(*) AS rows, round(sum({value}), 2)::DOUBLE AS total{more}
  FROM events WHERE event_type IN ('click', 'view', 'purchase', 'signup') GROUP BY 1, 2"""


def committed_stream(spark, sf):
    """Five files of the events as a stream of a batch each into a versioned dataset, run twice."""
    events = table(spark, sf, "events")
    source, target, progress = (new_path(spark, name) for name in ("arriving", "committed", "progress"))
    events.repartition(5, "event_id").write.parquet(source)
    day = F.date_trunc("day", "ts")
    for _ in range(2):
        arrived = incremental.stream_files(spark, source, events.schema, files_per_batch=1)
        incremental.run_committed_stream(arrived.filter(F.col("event_type") != "error"), target, progress, day, ["event_type"])
    return VersionedDataset(spark, target, day, ["event_type"])


@query("stream_then_compact", "I3 I5 K4", STREAMED.format(value="value", more=", 1::BIGINT AS files"))
def stream_then_compact(spark, sf):
    """Committed batches leave small files, which are then packed: one in each folder."""
    data = committed_stream(spark, sf)
    data.compact()
    rows = data.read().withColumn("file", F.col("_metadata.file_path"))
    return rows.groupBy("date", "event_type").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 2).alias("total"), F.count_distinct("file").alias("files")
    )


@query(
    "stream_then_backfill",
    "I3 I4 I5",
    STREAMED.format(value="CASE WHEN ts >= TIMESTAMP '2024-01-20 06:00:00' AND ts < TIMESTAMP '2024-01-22 18:00:00' THEN value + 1 ELSE value END", more=""),
)
def _(spark, sf):
    """A range that begins and ends inside a day is corrected twice in the output of a stream."""
    data = committed_stream(spark, sf)
    start, stop = "2024-01-20T06:00:00", "2024-01-22T18:00:00"
    range_ = p.half_open("ts", "2024-01-20 06:00:00", "2024-01-22 18:00:00")
    new = table(spark, sf, "events").filter(range_ & (F.col("event_type") != "error")).withColumn("value", F.col("value") + 1)
    for _ in range(2):
        data.replace_range(new, "ts", start, stop)
    return per_folder(data.read())


@query("backfill_part_of_folder", "I4 F5 W4", PER_FOLDER.replace("_%H", "_00"))
def _(spark, sf):
    """Days that a first run got wrong are replaced from six to six, so that the outer folders are covered in part."""
    events, day = table(spark, sf, "events"), F.date_trunc("day", "ts")
    data = VersionedDataset(spark, new_path(spark, "ranges"), day)
    wrong = (F.col("ts") >= "2024-01-20T06:00:00") & (F.col("ts") < "2024-01-23T06:00:00")
    data.append(events.withColumn("value", F.when(wrong, 0.0).otherwise(F.col("value"))))
    for low, high in (("2024-01-20T06:00:00", "2024-01-21T12:00:00"), ("2024-01-21T12:00:00", "2024-01-23T06:00:00")):
        data.replace_range(events.filter((F.col("ts") >= low) & (F.col("ts") < high)), "ts", low, high)
    return per_folder(data.read())


@query(
    "join_bucketed",
    "J1 K1",
    """SELECT o_orderpriority, l_returnflag, count(*) AS rows, round(sum(l_quantity), 2)::DOUBLE AS quantity
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
)
def join_bucketed(spark, sf):
    """Both sides are written once in buckets of the key; the join reads them without a shuffle."""
    joined = bucketed_join(spark, sf)
    return joined.groupBy("o_orderpriority", "l_returnflag").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("l_quantity"), 2).alias("quantity")
    )


def bucketed_join(spark, sf):
    sides, buckets = [], buckets_for(table(spark, sf, "lineitem"), table(spark, sf, "orders"))
    for name, key in (("lineitem", "l_orderkey"), ("orders", "o_orderkey")):
        path = new_path(spark, f"bucketed-{name}")
        label = path.rsplit("/", 1)[1].replace("-", "_")
        write_bucketed(table(spark, sf, name), label, key, buckets, path)
        sides.append(spark.table(label))
    return sides[0].hint("merge").join(sides[1], F.col("l_orderkey") == F.col("o_orderkey"))
