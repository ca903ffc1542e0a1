"""Row numbers, ranges and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakewright.operators import numbering, ranges, sampling
from lakewright.streaming.incremental import keyset_chunk
from workload.registry import query, table


@query("row_number_global", "F1 F4", "SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) AS row_number, count(*) OVER () AS total_rows FROM events")
def _(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts")
    return numbering.with_total(numbering.with_row_number(events, ["ts", "event_id"]))


@query("ntile_global", "F2 C14", "SELECT event_id, ntile(7) OVER (ORDER BY value, event_id) AS bucket FROM events")
def _(spark, sf):
    events = table(spark, sf, "events").select("event_id", "value")
    return numbering.with_ntile(events, ["value", "event_id"], 7).select("event_id", "bucket")


@query(
    "running_total",
    "F4",
    "SELECT o_orderkey, sum(o_custkey) OVER (ORDER BY o_orderkey)::BIGINT AS running_total FROM orders",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return numbering.with_running_total(orders, ["o_orderkey"], F.col("o_custkey")).select("o_orderkey", "running_total")


def _range_sql(tab, key, n):
    return f"""
    WITH numbered AS (SELECT {key} AS k, row_number() OVER (ORDER BY {key}) AS rn, count(*) OVER () AS total FROM {tab}),
    thin AS (SELECT k, ntile({n}) OVER (ORDER BY rn) AS b FROM numbered
             WHERE rn % greatest(1, total // {n * 10}) = 0),
    ends AS (SELECT b, max(k) AS high FROM thin GROUP BY b),
    lim AS (SELECT min({key}) AS lo, max({key}) AS hi FROM {tab}),
    cuts AS (SELECT DISTINCT high FROM ends, lim WHERE b < {n} AND high < hi UNION SELECT hi FROM lim)
    SELECT row_number() OVER (ORDER BY high) AS range_id,
           coalesce(lag(high) OVER (ORDER BY high), (SELECT lo FROM lim)) AS low, high FROM cuts"""


@query("key_ranges", "F3 A18 A13 C14", _range_sql("orders", "o_orderkey", 8))
def _(spark, sf):
    return ranges.key_ranges(table(spark, sf, "orders"), "o_orderkey", 8)


@query("key_ranges_repeated", "F3 A18", _range_sql("lineitem", "l_shipdate", 16))
def _(spark, sf):
    return ranges.key_ranges(table(spark, sf, "lineitem"), "l_shipdate", 16)


@query(
    "key_range_counts",
    "F3 W8 I4",
    f"""SELECT r.range_id, count(*) AS rows, min(l.l_orderkey) AS low, max(l.l_orderkey) AS high
        FROM lineitem l JOIN ({_range_sql("lineitem", "l_orderkey", 12)}) r
        ON l.l_orderkey <= r.high AND (l.l_orderkey > r.low OR (r.range_id = 1 AND l.l_orderkey >= r.low))
        GROUP BY r.range_id""",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey")
    placed = ranges.assign_key_range(lines, "l_orderkey", ranges.key_ranges(lines, "l_orderkey", 12))
    return placed.groupBy("range_id").agg(
        F.count(F.lit(1)).alias("rows"), F.min("l_orderkey").alias("low"), F.max("l_orderkey").alias("high")
    )


@query(
    "equal_ranges",
    "F2 F3",
    """SELECT bucket, count(*) AS rows, min(event_id) AS low, max(event_id) AS high
       FROM (SELECT event_id, ntile(9) OVER (ORDER BY event_id) AS bucket FROM events) GROUP BY bucket""",
)
def _(spark, sf):
    return ranges.equal_ranges(table(spark, sf, "events"), ["event_id"], 9)


def _time_sql(hours):
    return f"""
    WITH lim AS (SELECT date_trunc('day', min(ts))::TIMESTAMP AS a, date_trunc('day', max(ts))::TIMESTAMP + INTERVAL 1 DAY AS z FROM events),
    r AS (SELECT row_number() OVER (ORDER BY s) AS range_id, s AS range_start, least(s + INTERVAL {hours} HOUR, z) AS range_end
          FROM (SELECT unnest(generate_series(a, z - INTERVAL 1 MICROSECOND, INTERVAL {hours} HOUR)) AS s, z FROM lim))
    SELECT range_id, range_start, range_end, count(event_id) AS rows
    FROM r LEFT JOIN events ON ts >= range_start AND ts < range_end GROUP BY ALL"""


def _per_range(spark, sf, hours):
    events = table(spark, sf, "events").select("event_id", "ts")
    first, last = (str(d) for d in events.agg(F.to_date(F.min("ts")), F.to_date(F.max("ts"))).first())
    slots = events.groupBy(ranges.time_slot("ts", first, hours).alias("range_start")).agg(F.count(F.lit(1)).alias("rows"))
    listed = ranges.time_ranges(spark, first, last, hours)
    return listed.join(slots, "range_start", "left").select(
        "range_id", "range_start", "range_end", F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows")
    )


@query("time_ranges_narrow", "F5", _time_sql(12))
def _(spark, sf):
    return _per_range(spark, sf, 12)


@query("time_ranges_wide", "F5", _time_sql(48))
def _(spark, sf):
    return _per_range(spark, sf, 48)


@query("chunk_ids", "I1", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 500 AS chunk_id FROM orders")
def _(spark, sf):
    return numbering.with_chunk_id(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 500)


@query("keyset_chunk", "I1 W7 O2", "SELECT * FROM orders WHERE o_orderkey > 400 ORDER BY o_orderkey LIMIT 250")
def _(spark, sf):
    return keyset_chunk(table(spark, sf, "orders"), "o_orderkey", 400, 250, keep_ties=False)


@query(
    "keyset_chunk_ties",
    "I1 I2",
    """SELECT * FROM lineitem WHERE l_orderkey > 100 AND l_orderkey <=
       (SELECT max(l_orderkey) FROM (SELECT l_orderkey FROM lineitem WHERE l_orderkey > 100 ORDER BY l_orderkey LIMIT 333))""",
)
def _(spark, sf):
    return keyset_chunk(table(spark, sf, "lineitem"), "l_orderkey", 100, 333)


@query("sample_random", "P1", "SELECT true AS subset, true AS size_within FROM (SELECT count(*) FROM events)")
def _(spark, sf):
    """Whether every sampled row is a row of the table, and the size within five deviations."""
    events = table(spark, sf, "events")
    total = events.count()
    share = min(1.0, 5000 / total)
    sample = sampling.random_sample(events, 5000, total=total).join(events.select("*", F.lit(1).alias("found")), events.columns, "left")
    bound = 5 * (total * share * (1 - share)) ** 0.5
    return sample.agg(
        (F.count("found") == F.count(F.lit(1))).alias("subset"),
        (F.abs(F.count(F.lit(1)) - F.lit(total * share)) <= bound).alias("size_within"),
    )


@query(
    "sample_keyed",
    "P1",
    "SELECT * FROM events WHERE ((event_id % 1000003) * 2654435761) % 1000 < 250",
)
def _(spark, sf):
    return sampling.keyed_sample(table(spark, sf, "events"), "event_id", 250)


SYSTEMATIC = """SELECT * EXCLUDE (rn, total) FROM
  (SELECT *, row_number() OVER (ORDER BY {order}) AS rn, count(*) OVER () AS total FROM events)
  WHERE rn % greatest(1, total // 700) = 0 AND rn <= greatest(1, total // 700) * 700"""


@query("sample_systematic", "P3 F4", SYSTEMATIC.format(order="value, event_id"))
def _(spark, sf):
    return sampling.systematic_sample(table(spark, sf, "events"), 700, ["value", "event_id"])


@query("sample_systematic_file_order", "P3", SYSTEMATIC.format(order="event_id"))
def _(spark, sf):
    return sampling.systematic_sample(table(spark, sf, "events"), 700)


@query(
    "sample_stratified",
    "P4",
    """SELECT * EXCLUDE (rn, total) FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn,
       count(*) OVER (PARTITION BY event_type) AS total FROM events) WHERE rn <= ceil(0.05 * total)""",
)
def _(spark, sf):
    return sampling.stratified_sample(table(spark, sf, "events"), "event_type", 0.05, ["event_id"])


@query(
    "equal_ranges_hot",
    "F2 F3",
    """SELECT bucket, count(*) AS rows, min(k) AS low, max(k) AS high
       FROM (SELECT k, ntile(7) OVER (ORDER BY k) AS bucket FROM
             (SELECT CASE WHEN event_id % 10 = 0 THEN event_id ELSE 500 END AS k FROM events)) GROUP BY bucket""",
)
def _(spark, sf):
    hot = F.when(F.col("event_id") % 10 == 0, F.col("event_id")).otherwise(F.lit(500))
    return ranges.equal_ranges(table(spark, sf, "events").select(hot.alias("k")), ["k"], 7)


@query(
    "sample_stratified_random",
    "P4",
    "SELECT o_orderpriority, true AS size_within FROM orders GROUP BY o_orderpriority",
)
def _(spark, sf):
    """Whether the sample of each stratum has its share, within five deviations."""
    orders, shares = table(spark, sf, "orders"), {"1-URGENT": 0.5, "2-HIGH": 0.1}
    share = F.when(F.col("o_orderpriority") == "1-URGENT", 0.5).when(F.col("o_orderpriority") == "2-HIGH", 0.1).otherwise(0.3)
    sample = sampling.stratified_random(orders, "o_orderpriority", shares, default=0.3)
    sizes = sample.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("k"))
    strata = orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).join(sizes, "o_orderpriority", "left")
    off = F.abs(F.coalesce("k", F.lit(0)) - F.col("n") * share)
    return strata.select("o_orderpriority", (off <= 5 * F.sqrt(F.col("n") * share * (1 - share))).alias("size_within"))


@query(
    "key_range_search",
    "F3 W8",
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE (event_id + 6) // 7 + 1 END AS range_id FROM events",
)
def _(spark, sf):
    """A range for every seven ids, found among thousands of boundaries by halving."""
    events = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_id")).alias("key"))
    last = events.agg(F.max("event_id")).first()[0] // 7 + 2
    cut = spark.range(last).select((F.col("id") + 1).alias("range_id"), (F.col("id") * 7 - 7).alias("low"), (F.col("id") * 7).alias("high"))
    return ranges.assign_key_range(events, "key", cut).select("event_id", "range_id")
