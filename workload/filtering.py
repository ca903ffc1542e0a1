"""Scans, projections, filters, joins, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakewright.functions import predicates as p
from lakewright.functions.columns import first_columns, numeric_columns
from lakewright.operators import filters, joins, ordering, sampling, sets
from lakewright.operators.profile import count_matching
from lakewright.plans.config import ExtractConfig
from lakewright.plans.extract import joined_rows
from lakewright.session import new_path
from lakewright.sinks.export import write_csv
from lakewright.sources.readers import column_bounds, overview, read_csv, read_values, row_count
from workload.registry import query, table

JOINED = """
SELECT l.*, o.o_orderkey AS tb2_o_orderkey, o.o_orderpriority AS tb2_o_orderpriority,
       o.o_totalprice AS tb2_o_totalprice
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
"""

CONFIG = ExtractConfig(
    table="joined",
    fact_key="l_orderkey",
    detail_key="o_orderkey",
    detail_columns=("o_orderkey", "o_orderpriority", "o_totalprice"),
    category="o_orderpriority",
    excluded=("5-LOW",),
    date_column="l_shipdate",
    start="1996-01-01",
    end="1997-12-31",
)


def priorities(spark, sf):
    return read_values(table(spark, sf, "orders"), "o_orderpriority")


def keyed_groups(spark, sf):
    """Events with a text category of 50 values."""
    group = F.concat(F.lit("g"), F.format_string("%02d", F.col("user_id") % 50))
    return table(spark, sf, "events").select("event_id", group.alias("grp"))


GROUPS = "(SELECT event_id, 'g' || lpad(CAST(user_id % 50 AS VARCHAR), 2, '0') AS grp FROM events)"


@query("scan_parquet", "S1", "SELECT * FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer")


@query("scan_csv", "S2 K5", "SELECT * FROM events")
def _(spark, sf):
    events, path = table(spark, sf, "events"), new_path(spark, "csv")
    write_csv(events, path)
    return read_csv(spark, path, events.schema)


@query("csv_documents", "S2 K5", "SELECT * REPLACE (nullif(text, '') AS text) FROM documents")
def _(spark, sf):
    docs, path = table(spark, sf, "documents"), new_path(spark, "csv")
    write_csv(docs, path)
    return read_csv(spark, path, docs.schema)


@query("csv_pages", "S2 K5", "SELECT page_id, nullif(html, '') AS html FROM pages")
def _(spark, sf):
    pages, path = table(spark, sf, "pages").select("page_id", "html"), new_path(spark, "csv")
    write_csv(pages, path)
    return read_csv(spark, path, pages.schema)


@query(
    "csv_hard_text",
    "S2 K5",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN ' "a", ' || chr(10) || ' b ' WHEN 1 THEN NULL
       WHEN 2 THEN NULL ELSE '\\"' || event_type || '\\' END AS hard FROM events""",
)
def _(spark, sf):
    turn = F.col("event_id") % 4
    hard = F.when(turn == 0, ' "a", \n b ').when(turn == 1, "").when(turn == 3, F.concat(F.lit('\\"'), "event_type", F.lit("\\")))
    rows, path = table(spark, sf, "events").select("event_id", hard.alias("hard")), new_path(spark, "csv")
    write_csv(rows, path)
    return read_csv(spark, path, rows.schema)


@query("lookup_values", "S3 H2", "SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority IS NOT NULL")
def _(spark, sf):
    return priorities(spark, sf)


@query("row_count", "S5", "SELECT count(*) AS total_rows FROM lineitem")
def _(spark, sf):
    return row_count(table(spark, sf, "lineitem"))


@query(
    "dataset_overview",
    "S6",
    """SELECT count(*) AS total_rows, count(*) AS sample_rows, CAST(100 AS DOUBLE) AS sample_pct,
              CAST(6 AS BIGINT) AS column_count,
              'event_id, ts, user_id, event_type, value, props' AS column_names FROM events""",
)
def _(spark, sf):
    facts = overview(table(spark, sf, "events"))
    return facts.select("total_rows", "sample_rows", "sample_pct", "column_count", "column_names")


@query("column_bounds", "A13", "SELECT min(ts) AS min_ts, max(ts) AS max_ts, min(event_id) AS min_event_id, max(event_id) AS max_event_id FROM events")
def _(spark, sf):
    return column_bounds(table(spark, sf, "events"), "ts", "event_id")


@query(
    "select_numeric",
    "R2",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem")
    return lines.select(*numeric_columns(lines))


@query("select_first_columns", "R3", "SELECT * EXCLUDE (l_shipdate) FROM lineitem")
def _(spark, sf):
    return first_columns(table(spark, sf, "lineitem"))


@query("select_capped", "R4", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem")
def _(spark, sf):
    lines = table(spark, sf, "lineitem")
    return lines.select(*numeric_columns(lines, 3))


@query("filter_allowed", "W1", "SELECT * FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def _(spark, sf):
    return table(spark, sf, "orders").filter(p.allowed("o_orderpriority", ["1-URGENT", "2-HIGH"]))


@query(
    "filter_denied",
    "W2",
    "SELECT * FROM (SELECT o_orderkey, nullif(o_orderpriority, '3-MEDIUM') AS pr FROM orders) WHERE pr NOT IN ('5-LOW')",
)
def _(spark, sf):
    orders = table(spark, sf, "orders")
    marked = orders.select("o_orderkey", F.nullif("o_orderpriority", F.lit("3-MEDIUM")).alias("pr"))
    return marked.filter(p.denied("pr", ["5-LOW"]))


@query(
    "policy_auto_small_set",
    "W3 J2",
    "SELECT * FROM orders WHERE o_orderpriority IN (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW')",
)
def _(spark, sf):
    valid = filters.valid_values(priorities(spark, sf), ["5-LOW"])
    return filters.apply_category_policy(table(spark, sf, "orders"), "o_orderpriority", valid, ["5-LOW"], "allow")


@query(
    "policy_auto_in_list",
    "W3 W1",
    "SELECT * FROM part WHERE p_brand IN (SELECT DISTINCT p_brand FROM part WHERE p_brand <> 'Brand#11')",
)
def _(spark, sf):
    parts = table(spark, sf, "part")
    valid = filters.valid_values(read_values(parts, "p_brand"), ["Brand#11"])
    return filters.apply_category_policy(parts, "p_brand", valid, ["Brand#11"], "allow")


@query("policy_auto_deny", "W3 W2", f"SELECT * FROM {GROUPS} WHERE grp NOT IN ('g03', 'g07')")
def _(spark, sf):
    events = keyed_groups(spark, sf)
    valid = filters.valid_values(read_values(events, "grp"), ["g03", "g07"])
    return filters.apply_category_policy(events, "grp", valid, ["g03", "g07"], "deny")


@query("policy_auto_open", "W3", f"SELECT * FROM {GROUPS}")
def _(spark, sf):
    events = keyed_groups(spark, sf)
    return filters.apply_category_policy(events, "grp", filters.valid_values(read_values(events, "grp")), (), "open")


@query(
    "filter_half_open",
    "W4 C13",
    "SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-07-01'",
)
def _(spark, sf):
    return table(spark, sf, "lineitem").filter(p.half_open("l_shipdate", "1996-01-01", "1996-07-01"))


@query(
    "filter_whole_days",
    "W5",
    "SELECT * FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'",
)
def _(spark, sf):
    return table(spark, sf, "events").filter(p.whole_days("ts", "2024-01-05", "2024-01-12"))


@query("filter_partition_equals", "W6", "SELECT * FROM orders WHERE o_orderstatus = 'F'")
def _(spark, sf):
    return table(spark, sf, "orders").filter(p.equals("o_orderstatus", "F"))


@query("filter_after_key", "W7", "SELECT * FROM orders WHERE o_orderkey > 500")
def _(spark, sf):
    return table(spark, sf, "orders").filter(p.after_key("o_orderkey", 500))


@query(
    "filter_key_range",
    "W8",
    """SELECT CASE WHEN o_orderkey <= 5000 THEN 1 WHEN o_orderkey <= 10000 THEN 2 ELSE 3 END AS part, o_orderkey
       FROM orders WHERE o_orderkey >= 0""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey")
    cuts = [(0, 5000, True), (5000, 10000, False), (10000, None, False)]
    parts = [
        orders.filter(p.key_range("o_orderkey", low, high, first)).select(F.lit(i).alias("part"), "o_orderkey")
        for i, (low, high, first) in enumerate(cuts, 1)
    ]
    return sets.concat_chunks(*parts)


@query(
    "filter_default_members",
    "W9 A12",
    "SELECT * FROM part WHERE p_brand IN (SELECT DISTINCT p_brand FROM part ORDER BY p_brand LIMIT 5)",
)
def _(spark, sf):
    parts = table(spark, sf, "part")
    return filters.select_members(parts, "p_brand", filters.default_members(parts, "p_brand"))


@query(
    "filter_present",
    "W10",
    "SELECT event_id, value FROM events WHERE value >= 50",
)
def _(spark, sf):
    holes = F.when(F.col("value") < 20, F.lit(float("nan"))).when(F.col("value") < 50, F.lit(None)).otherwise(F.col("value"))
    return filters.only_present(table(spark, sf, "events").select("event_id", holes.alias("value")), "value")


@query("filter_missing", "W10", "SELECT event_id FROM events WHERE value < 50")
def _(spark, sf):
    holes = F.when(F.col("value") < 20, F.lit(float("nan"))).when(F.col("value") < 50, F.lit(None)).otherwise(F.col("value"))
    return filters.only_missing(table(spark, sf, "events").select("event_id", holes.alias("v")), "v").select("event_id")


@query("count_matching", "A1 C16", "SELECT count(*) FILTER (WHERE lower(p_type) LIKE '%econ%') AS matching_rows, count(*) AS total_rows FROM part")
def _(spark, sf):
    return count_matching(table(spark, sf, "part"), F.lower("p_type").contains("econ"))


@query(
    "join_allow",
    "J1 J4 R1 W4 H1 S3",
    JOINED
    + """WHERE o.o_orderpriority IN (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('5-LOW'))
         AND l.l_shipdate >= TIMESTAMP '1996-01-01' AND l.l_shipdate < TIMESTAMP '1998-01-01'""",
)
def join_allow(spark, sf):
    return joined_rows(table(spark, sf, "lineitem"), table(spark, sf, "orders"), priorities(spark, sf), CONFIG)


@query(
    "join_deny",
    "J1 W2 R1 W4",
    JOINED
    + """WHERE o.o_orderpriority NOT IN ('5-LOW')
         AND l.l_shipdate >= TIMESTAMP '1996-01-01' AND l.l_shipdate < TIMESTAMP '1998-01-01'""",
)
def _(spark, sf):
    config = ExtractConfig(**{**CONFIG.__dict__, "category_mode": "deny"})
    return joined_rows(table(spark, sf, "lineitem"), table(spark, sf, "orders"), priorities(spark, sf), config)


@query(
    "join_partition_value",
    "J1 W3 W6 R1",
    JOINED + "WHERE o.o_orderpriority <> '5-LOW' AND l.l_returnflag = 'R'",
)
def _(spark, sf):
    config = ExtractConfig(
        **{
            **CONFIG.__dict__,
            "category_mode": "allow",
            "start": None,
            "end": None,
            "partition_column": "l_returnflag",
            "partition_value": "R",
        }
    )
    return joined_rows(table(spark, sf, "lineitem"), table(spark, sf, "orders"), priorities(spark, sf), config)


@query(
    "join_salted_hot_keys",
    "J1 R1",
    """SELECT l.*, s.s_name AS tb2_s_name, s.s_nationkey AS tb2_s_nationkey
       FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey""",
)
def _(spark, sf):
    lines, suppliers = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    return joins.join_salted(lines, suppliers, "l_suppkey", "s_suppkey", ["s_name", "s_nationkey"], share=0.005, salts=8)


@query(
    "join_small_set",
    "J2",
    "SELECT * FROM events WHERE event_type IN (SELECT DISTINCT event_type FROM events WHERE event_type < 'p')",
)
def _(spark, sf):
    events = table(spark, sf, "events")
    return filters.keep_values(events, "event_type", read_values(events.filter("event_type < 'p'"), "event_type"))


@query(
    "allow_list_bloom",
    "J4 J2",
    "SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 480000)",
)
def allow_list_bloom(spark, sf):
    """A set that is not broadcast: its Bloom filter thins the line items before the exact semi join."""
    orders = table(spark, sf, "orders").filter("o_totalprice > 480000").select("o_orderkey")
    return filters.keep_values_bloom(table(spark, sf, "lineitem"), "l_orderkey", orders, broadcast_small=False)


@query(
    "join_left_count_distinct",
    "J3 A19",
    """SELECT c.c_mktsegment, o.o_orderpriority, count(DISTINCT l.l_partkey) AS parts
       FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey
       LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') l ON o.o_orderkey = l.l_orderkey
       GROUP BY c.c_mktsegment, o.o_orderpriority""",
)
def _(spark, sf):
    customers, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    lines = table(spark, sf, "lineitem").filter("l_returnflag = 'R'")
    return joins.count_distinct_over_optional(
        customers,
        orders,
        lines,
        customers.c_custkey == orders.o_custkey,
        orders.o_orderkey == lines.l_orderkey,
        ["c_mktsegment", "o_orderpriority"],
        "l_partkey",
        "parts",
    )


@query("sort_by_key", "O1", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey")
def _(spark, sf):
    return ordering.sort_by(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")


@query("topn_key", "O2 P2", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 1000")
def _(spark, sf):
    return ordering.top_n(table(spark, sf, "orders"), ["o_orderkey"], 1000)


@query(
    "preview",
    "O3 R3",
    """SELECT * EXCLUDE (l_shipdate) FROM lineitem
       ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 10""",
)
def _(spark, sf):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return ordering.preview(table(spark, sf, "lineitem"), keys=keys)


@query("head_sample", "P2", "SELECT * FROM events ORDER BY event_id LIMIT 100")
def _(spark, sf):
    return sampling.head_sample(table(spark, sf, "events"), 100, ["event_id"])


@query(
    "categories_minus",
    "H1",
    "SELECT DISTINCT source FROM documents WHERE source IS NOT NULL EXCEPT SELECT source FROM documents WHERE n_chars > 20000",
)
def _(spark, sf):
    docs = table(spark, sf, "documents")
    return sets.set_difference(docs.select("source"), docs.filter("n_chars > 20000").select("source"))


@query("distinct_sorted", "A12 H2 O1", "SELECT DISTINCT p_type FROM part WHERE p_type IS NOT NULL ORDER BY p_type")
def _(spark, sf):
    return sets.distinct_values(table(spark, sf, "part"), "p_type")


@query(
    "dedup_first",
    "H3",
    """SELECT doc_id, lang, source, n_chars FROM
       (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""",
)
def _(spark, sf):
    firsts = sets.keep_first(table(spark, sf, "documents"), ["text"], ["doc_id"])
    return firsts.select("doc_id", "lang", "source", "n_chars")


@query(
    "concat_chunks",
    "H4",
    """SELECT event_id, user_id, event_type FROM events WHERE value < 40
       UNION ALL SELECT event_id, user_id, NULL FROM events WHERE value >= 40""",
)
def _(spark, sf):
    events = table(spark, sf, "events")
    low = events.filter("value < 40").select("event_id", "user_id", "event_type")
    high = events.filter("value >= 40").select("user_id", "event_id")
    return sets.concat_chunks(low, high)
