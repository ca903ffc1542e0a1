"""Cleaning and type decisions on columns made dirty from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from lakewright.functions.cleaning import NUMBER_PATTERN, partition_text
from lakewright.operators import clean
from lakewright.session import new_path
from lakewright.sinks.export import write_csv
from lakewright.sinks.lake import extraction_id_of
from lakewright.sources.readers import read_csv
from workload.registry import query, table

# Text forms of an integer column as the cleaning meets them, by the last digit of the id.
MESSY_SQL = """(SELECT event_id, CASE event_id % 10
    WHEN 0 THEN 'nan' WHEN 1 THEN 'None' WHEN 2 THEN '' WHEN 3 THEN NULL WHEN 4 THEN ' ' || user_id || ' '
    WHEN 5 THEN user_id || 'e1' WHEN 6 THEN '+' || user_id WHEN 7 THEN 'inf' WHEN 8 THEN '.5' ELSE CAST(user_id AS VARCHAR) END AS amount,
    CASE event_id % 6 WHEN 0 THEN '1_000' WHEN 1 THEN '1d' WHEN 2 THEN '<NA>' WHEN 3 THEN 'nan' WHEN 4 THEN '' ELSE CAST(user_id AS VARCHAR) END AS code,
    CAST(user_id AS VARCHAR) AS user_text, user_id, value FROM events)"""


def messy(spark, sf):
    user, user_id = F.col("user_id").cast("string"), F.col("event_id")
    amount = [F.lit("nan"), F.lit("None"), F.lit(""), F.lit(None).cast("string"), F.concat(F.lit(" "), user, F.lit(" "))]
    amount += [F.concat(user, F.lit("e1")), F.concat(F.lit("+"), user), F.lit("inf"), F.lit(".5"), user]
    code = [F.lit("1_000"), F.lit("1d"), F.lit("<NA>"), F.lit("nan"), F.lit(""), user]
    pick = lambda options: F.element_at(F.array(*options), (user_id % len(options) + 1).cast("int"))
    return table(spark, sf, "events").select(
        "event_id", pick(amount).alias("amount"), pick(code).alias("code"), user.alias("user_text"), "user_id", "value"
    )


NUMBER_SQL = f"""CASE WHEN regexp_full_match($, '{NUMBER_PATTERN[1:-1]}') THEN TRY_CAST(trim($) AS DOUBLE) END"""
TOKENS_SQL = "('nan', 'None', '<NA>')"


@query(
    "clean_inf",
    "C1",
    """SELECT l_orderkey, CASE WHEN l_quantity BETWEEN 3 AND 45 THEN l_quantity END AS quantity, l_tax FROM lineitem""",
)
def _(spark, sf):
    q = F.col("l_quantity")
    odd = F.when(q > 48, float("inf")).when(q > 45, float("-inf")).when(q < 3, float("nan")).otherwise(q)
    return clean.null_infinities(table(spark, sf, "lineitem").select("l_orderkey", odd.alias("quantity"), "l_tax"))


@query(
    "clean_text_number",
    "C2",
    f"""SELECT event_id, {NUMBER_SQL.replace('$', 'amount')} AS amount, code, CAST(user_text AS SMALLINT) AS user_text, user_id, value
        FROM {MESSY_SQL}""",
)
def _(spark, sf):
    return clean.text_to_number(messy(spark, sf))


@query(
    "clean_tokens",
    "C3",
    f"""SELECT event_id, CASE WHEN amount NOT IN {TOKENS_SQL} THEN amount END AS amount,
        CASE WHEN code NOT IN {TOKENS_SQL} THEN code END AS code FROM {MESSY_SQL}""",
)
def _(spark, sf):
    return clean.null_tokens(messy(spark, sf).select("event_id", "amount", "code"))


NARROW_SOURCE = """(SELECT event_id, user_id, event_id * 7 AS medium, event_id * 3000000000 AS large,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 100 END AS holed FROM events)"""


@query(
    "narrow_ints",
    "C4 C7",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CASE WHEN min({c}) > -32768 AND max({c}) < 32767 THEN 'smallint'
            WHEN min({c}) > -2147483648 AND max({c}) < 2147483647 THEN 'int' ELSE 'bigint' END AS type,
            sum({c})::BIGINT AS total, count({c}) AS present FROM {NARROW_SOURCE}"""
        for c in ("event_id", "user_id", "medium", "large", "holed")
    ),
)
def _(spark, sf):
    """Totals are bigint; where one outgrows 64 bits all are decimals, so that none is lost."""
    e = F.col("event_id")
    source = table(spark, sf, "events").select(
        "event_id",
        "user_id",
        (e * 7).alias("medium"),
        (e * F.lit(3_000_000_000)).alias("large"),
        F.when(e % 5 != 0, e % 100).alias("holed"),
    )
    narrow = clean.narrow_integers(source)
    # Sums of 64-bit values may need more bits: they are exact decimals first.
    sums = [F.sum(F.col(c).cast("decimal(28,0)")).alias(f"s_{c}") for c in narrow.columns]
    counts = [F.count(c).alias(f"n_{c}") for c in narrow.columns]
    totals = narrow.agg(*sums, *counts)
    found = totals.first()
    held = all(found[f"s_{c}"] is None or -(2**63) <= found[f"s_{c}"] < 2**63 for c in narrow.columns)
    facts = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.col(f"s_{f.name}").cast("bigint" if held else "decimal(38,0)").alias("total"),
            F.col(f"n_{f.name}").alias("present"),
        )
        for f in narrow.schema.fields
    ]
    return totals.select(F.inline(F.array(*facts)))


@query("clean_floats", "C5", "SELECT vec_id, CAST(label AS DOUBLE) / 4 AS ratio FROM embeddings")
def _(spark, sf):
    ratio = (F.col("label") / 4).cast("float")
    return clean.floats_to_double(table(spark, sf, "embeddings").select("vec_id", ratio.alias("ratio")))


@query(
    "clean_strict_types",
    "C6 C7",
    "SELECT CAST(event_id AS SMALLINT) AS event_id, CASE WHEN value > 50 THEN 'true' ELSE 'false' END AS large, ts, CAST(ts AS DATE)::TIMESTAMP AS day FROM events",
)
def _(spark, sf):
    events = table(spark, sf, "events")
    return clean.clean(
        events.select("event_id", (F.col("value") > 50).alias("large"), "ts", F.to_date("ts").alias("day")),
        strict_types=True,
    )


@query(
    "apply_schema",
    "C8",
    f"""SELECT CASE WHEN event_id BETWEEN -32768 AND 32767 THEN CAST(event_id AS SMALLINT) END AS event_id,
        {NUMBER_SQL.replace('$', 'amount')} AS amount,
        CASE WHEN code NOT IN {TOKENS_SQL} AND code <> '' THEN code END AS code, user_text, CAST(user_id AS INTEGER) AS user_id, value,
        CASE WHEN amount = 'inf' THEN 1 ELSE 0 END AS lost FROM {MESSY_SQL}""",
)
def _(spark, sf):
    schema = T.StructType.fromDDL("event_id smallint, amount double, code string, user_id int, absent string")
    coerced = clean.apply_schema(messy(spark, sf), schema, errors_column="errors")
    return coerced.withColumn("lost", F.size("errors").cast("int")).drop("errors")


DATED_SQL = """(SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS order_date,
  CASE WHEN o_orderkey % 1000 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS ship_time, o_orderpriority AS candidate
  FROM orders)"""


@query(
    "parse_dates",
    "C9 C10",
    f"SELECT o_orderkey, CAST(order_date AS TIMESTAMP) AS order_date, ship_time, candidate, 'order_date' AS usable FROM {DATED_SQL}",
)
def _(spark, sf):
    orders = table(spark, sf, "orders")
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    dated = orders.select(
        "o_orderkey",
        text.alias("order_date"),
        F.when(F.col("o_orderkey") % 1000 == 0, "unknown").otherwise(text).alias("ship_time"),
        F.col("o_orderpriority").alias("candidate"),
    )
    parsed, usable = clean.parse_dates(dated)
    return parsed.withColumn("usable", F.lit(",".join(usable)))


@query(
    "parse_dates_formats",
    "C10",
    """SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS day_date, CAST(o_orderdate AS TIMESTAMP) AS zoned_date,
       CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS mixed_date, 'day_date,zoned_date' AS usable FROM orders""",
)
def _(spark, sf):
    """Two more patterns; a column in two forms fits none as a whole and stays text."""
    day = F.col("o_orderdate")
    slashed, iso = F.date_format(day, "dd/MM/yyyy"), F.date_format(day, "yyyy-MM-dd")
    dated = table(spark, sf, "orders").select(
        "o_orderkey",
        slashed.alias("day_date"),
        F.concat(iso, F.lit("T00:00:00Z")).alias("zoned_date"),
        F.when(F.col("o_orderkey") % 2 == 0, slashed).otherwise(iso).alias("mixed_date"),
    )
    parsed, usable = clean.parse_dates(dated, formats=("dd/MM/yyyy", "yyyy-MM-dd'T'HH:mm:ssX"))
    return parsed.withColumn("usable", F.lit(",".join(usable)))


@query(
    "keys_to_integer",
    "C11",
    f"""SELECT event_id::SMALLINT AS event_id,
        CASE WHEN regexp_full_match(code, '\\s*[+-]?\\d+\\s*') THEN TRY_CAST(trim(code) AS SMALLINT) END AS code FROM {MESSY_SQL}""",
)
def _(spark, sf):
    return clean.keys_to_integer(messy(spark, sf).select("event_id", "code"), ["event_id", "code"])


@query(
    "partition_text",
    "C12",
    "SELECT strftime(ts, '%Y-%m-%d_%H') AS folder, count(*) AS rows FROM events GROUP BY folder",
)
def _(spark, sf):
    folders = table(spark, sf, "events").groupBy(partition_text(F.col("ts")).alias("folder"))
    return folders.agg(F.count(F.lit(1)).alias("rows"))


@query(
    "clean_all",
    "C18 C1 C2 C3 C4 C5",
    f"""SELECT CAST(event_id AS SMALLINT) AS event_id, {NUMBER_SQL.replace('$', 'amount')} AS amount,
        CASE WHEN code NOT IN {TOKENS_SQL} AND code <> '' THEN code END AS code,
        CAST(user_text AS SMALLINT) AS user_text, CAST(user_id AS SMALLINT) AS user_id, value FROM {MESSY_SQL}""",
)
def clean_all(spark, sf):
    return clean.clean(messy(spark, sf))


@query(
    "csv_inferred",
    "S2 C17 C7",
    """SELECT o_orderkey::SMALLINT AS o_orderkey, o_custkey::SMALLINT AS o_custkey, o_orderstatus, o_totalprice,
       o_orderdate, o_orderpriority FROM orders""",
)
def _(spark, sf):
    path = new_path(spark, "csv")
    write_csv(table(spark, sf, "orders"), path)
    return clean.clean(read_csv(spark, path), strict_types=True)


@query(
    "extraction_ids",
    "K7",
    """SELECT c_custkey, substr(md5(c_name || '_2024-01-01_2024-01-07_cat1,cat2'), 1, 8) AS extraction_id FROM customer""",
)
def _(spark, sf):
    name = extraction_id_of(F.col("c_name"), "2024-01-01", "2024-01-07", ["cat2", "cat1"])
    return table(spark, sf, "customer").select("c_custkey", name.alias("extraction_id"))
