"""Profiles: counts, statistics, correlation, distributions, outliers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lakewright.operators import heavy, profile, sketches
from lakewright.operators.quantiles import quantile_table
from lakewright.operators.sampling import exact_sample
from lakewright.plans.explore import explore_table, profile_table
from lakewright.session import new_path
from lakewright.sinks.versions import VersionedDataset
from lakewright.sources.readers import footer_facts, read_csv
from workload.registry import query, table

NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TYPES = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int"} | {
    n: "double" for n in NUMBERS[4:]
}
TEXTS = {"l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}


def each(columns, template, source):
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {template.replace('$', c)} FROM {source}" for c in columns)


# Events with holes: no value below 20, no user for multiples of seven, no type for 'purchase'.
HOLED = """(SELECT event_id, nullif(event_type, 'purchase') AS event_type,
  CASE WHEN value < 20 THEN NULL ELSE value END AS value,
  CASE WHEN user_id % 7 = 0 THEN NULL ELSE user_id END AS user_id FROM events)"""


def holed(spark, sf):
    value, user = F.col("value"), F.col("user_id")
    hole = F.when(value < 10, F.lit(float("nan"))).when(value < 20, F.lit(None)).otherwise(value)
    return table(spark, sf, "events").select(
        "event_id",
        F.nullif("event_type", F.lit("purchase")).alias("event_type"),
        hole.cast("double").alias("value"),
        F.when(user % 7 != 0, user).alias("user_id"),
    )


def rounded(df, **digits):
    return df.select(*[F.round(F.col(c), digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


HOLED_COLUMNS = ["event_id", "event_type", "value", "user_id"]


@query(
    "null_counts",
    "A2 W10",
    each(
        HOLED_COLUMNS,
        "count(*) - count($) AS missing_count, round(100.0 * (count(*) - count($)) / count(*), 4)::DOUBLE AS missing_pct",
        HOLED,
    ),
)
def _(spark, sf):
    return rounded(profile.null_counts(holed(spark, sf)), missing_pct=4)


@query(
    "missing_table",
    "A6 W11 O4",
    "SELECT * FROM ("
    + each(
        HOLED_COLUMNS,
        "count(*) - count($) AS missing_count, round(100.0 * (count(*) - count($)) / count(*), 4)::DOUBLE AS missing_pct",
        HOLED,
    )
    + ") WHERE missing_count > 0 ORDER BY missing_pct, \"column\"",
)
def _(spark, sf):
    return rounded(profile.missing_table(holed(spark, sf)), missing_pct=4)


@query(
    "distinct_counts",
    "A3",
    each(
        HOLED_COLUMNS,
        "count(DISTINCT $) AS distinct_count, round(100.0 * count(DISTINCT $) / count(*), 4)::DOUBLE AS distinct_pct",
        HOLED,
    ),
)
def _(spark, sf):
    return rounded(profile.distinct_counts(holed(spark, sf)), distinct_pct=4)


STATS = """round(avg($), 4)::DOUBLE AS mean, round(stddev_samp($), 4)::DOUBLE AS std, min($)::DOUBLE AS min,
max($)::DOUBLE AS max, quantile_cont($, 0.5)::DOUBLE AS median"""


@query("numeric_stats", "A4", each(NUMBERS, STATS, "lineitem"))
def _(spark, sf):
    return rounded(profile.numeric_stats(table(spark, sf, "lineitem")), mean=4, std=4)


def _profile_sql():
    shared = """count(*) - count($) AS null_count, round(100.0 * (count(*) - count($)) / count(*), 4)::DOUBLE AS null_percentage,
count(DISTINCT $) AS unique_values, round(100.0 * count(DISTINCT $) / count(*), 4)::DOUBLE AS unique_percentage, """
    empty = "NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS median"
    parts = [each([c], f"'{t}' AS dtype, {shared}{STATS}", "lineitem") for c, t in TYPES.items()]
    parts += [each([c], f"'{t}' AS dtype, {shared}{empty}", "lineitem") for c, t in TEXTS.items()]
    return " UNION ALL ".join(parts)


@query("column_profile", "A5 A2 A3 A4 C15", _profile_sql())
def _(spark, sf):
    found = profile.column_profile(table(spark, sf, "lineitem"))
    return rounded(found, null_percentage=4, unique_percentage=4, mean=4, std=4)


@query(
    "column_profile_sketched",
    "A5",
    "SELECT column_name AS column, true AS exact_equal, true AS distinct_within FROM (DESCRIBE lineitem)",
)
def _(spark, sf):
    """Whether what is not sketched equals the exact profile, and sketched distinct counts keep to five deviations of 5 %."""
    lines = table(spark, sf, "lineitem")
    plain = ["dtype", "null_count", "mean", "std", "min", "max"]
    exact, sketched = profile.column_profile(lines), profile.column_profile(lines, approximate=True)
    both = exact.alias("e").join(sketched.alias("s"), "column")
    close = [
        F.col(f"e.{c}").eqNullSafe(F.col(f"s.{c}")) if c not in ("mean", "std")
        else F.coalesce(F.abs(F.col(f"e.{c}") - F.col(f"s.{c}")) <= F.abs(F.col(f"e.{c}")) * 1e-9, F.col(f"e.{c}").isNull())
        for c in plain
    ]
    off = F.abs(F.col("e.unique_values") - F.col("s.unique_values"))
    return both.select("column", reduce(lambda a, b: a & b, close).alias("exact_equal"), (off <= 0.25 * F.col("e.unique_values")).alias("distinct_within"))


DESCRIBED = """count($) AS count, round(avg($), 4)::DOUBLE AS mean, round(stddev_samp($), 4)::DOUBLE AS std,
min($)::DOUBLE AS min, round(quantile_cont($, 0.25), 4)::DOUBLE AS p25, round(quantile_cont($, 0.5), 4)::DOUBLE AS p50,
round(quantile_cont($, 0.75), 4)::DOUBLE AS p75, max($)::DOUBLE AS max"""


def describe_rounded(df):
    return rounded(df, mean=4, std=4, p25=4, p50=4, p75=4)


@query("describe", "A7", each(["event_id", "value", "user_id"], DESCRIBED, HOLED))
def _(spark, sf):
    return describe_rounded(profile.describe(holed(spark, sf)))


@query(
    "quantiles",
    "A8",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {q}::DOUBLE AS probability, round(quantile_cont({c}, {q}), 4)::DOUBLE AS value FROM lineitem"
        for c in ("l_extendedprice", "l_quantity")
        for q in (0.01, 0.25, 0.5, 0.75, 0.99)
    ),
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem")
    return rounded(quantile_table(lines, ["l_extendedprice", "l_quantity"], [0.01, 0.25, 0.5, 0.75, 0.99]), value=4)


@query(
    "quantiles_narrowed",
    "A8",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {q}::DOUBLE AS probability, round(quantile_cont({c}, {q}), 4)::DOUBLE AS value FROM lineitem"
        for c in ("l_extendedprice", "l_quantity")
        for q in (0.01, 0.5, 0.99)
    ),
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem")
    limits = {"gathered_values": 2000, "sample_values": 5000}
    return rounded(quantile_table(lines, ["l_extendedprice", "l_quantity"], [0.01, 0.5, 0.99], **limits), value=4)


def _correlation_sql():
    names = ["p_partkey", "p_size", "p_retailprice"]
    return " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 4)::DOUBLE AS correlation FROM part"
        for a in names
        for b in names
    )


@query("correlation_matrix", "A9", _correlation_sql())
def _(spark, sf):
    return rounded(profile.correlation_matrix(table(spark, sf, "part")), correlation=4)


@query(
    "correlation_pairwise",
    "A9",
    " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 4)::DOUBLE AS correlation FROM {HOLED}"
        for a in ("event_id", "value", "user_id")
        for b in ("event_id", "value", "user_id")
    ),
)
def _(spark, sf):
    return rounded(profile.correlation_matrix(holed(spark, sf)), correlation=4)


@query(
    "value_counts_topk",
    "A10 O4",
    """SELECT * FROM (SELECT "column", value, count, CAST(row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS INTEGER) AS rank
       FROM ("""
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS count FROM part WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in ("p_name", "p_brand", "p_type")
    )
    + ")) WHERE rank <= 10",
)
def _(spark, sf):
    return profile.value_counts(table(spark, sf, "part"))


def _histogram_sql():
    parts = []
    for c in ("l_quantity", "l_extendedprice"):
        parts.append(
            f"""SELECT '{c}' AS "column", least(CAST(floor(({c} - lo) / ((hi - lo) / 20)) AS BIGINT) + 1, 20) AS bin,
                count(*) AS count FROM lineitem, (SELECT min({c}) AS lo, max({c}) AS hi FROM lineitem) GROUP BY ALL"""
        )
    return " UNION ALL ".join(parts)


@query("histogram", "A11 R4", _histogram_sql())
def _(spark, sf):
    return profile.histogram(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"]).select("column", "bin", "count")


SHAPED = "(SELECT value, value * value * value AS cubed, CASE WHEN value > 95 THEN value * 100 ELSE value END AS spiked FROM events)"


def shaped(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select(
        "value", (v * v * v).alias("cubed"), F.when(v > 95, v * 100).otherwise(v).alias("spiked")
    )


def _iqr_sql(columns, source):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outlier_count,
        round(100.0 * count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) / count({c}), 4)::DOUBLE AS outlier_pct
        FROM {source}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {source})"""
        for c in columns
    )


@query("outliers_iqr", "A14", _iqr_sql(["value", "cubed", "spiked"], SHAPED))
def _(spark, sf):
    return rounded(profile.outliers_iqr(shaped(spark, sf)), outlier_pct=4)


@query(
    "outliers_zscore",
    "A15",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE abs({c} - m) > 3 * s) AS outlier_count,
        round(100.0 * count(*) FILTER (WHERE abs({c} - m) > 3 * s) / count({c}), 4)::DOUBLE AS outlier_pct
        FROM {SHAPED}, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM {SHAPED})"""
        for c in ("value", "cubed", "spiked")
    ),
)
def _(spark, sf):
    return rounded(profile.outliers_zscore(shaped(spark, sf)), outlier_pct=4)


@query(
    "outlier_rank",
    "A16 O4",
    f'SELECT * FROM ({_iqr_sql(["value", "cubed", "spiked"], SHAPED)}) ORDER BY outlier_pct DESC, "column" LIMIT 20',
)
def _(spark, sf):
    return rounded(profile.rank_outliers(profile.outliers_iqr(shaped(spark, sf))), outlier_pct=4)


@query(
    "profile_report",
    "L2 K8 A5",
    _profile_sql(),
)
def profile_report(spark, sf):
    path = new_path(spark, "report")
    profile_table(table(spark, sf, "lineitem"), report_path=path)
    found = spark.read.parquet(f"{path}/columns")
    return rounded(found, null_percentage=4, unique_percentage=4, mean=4, std=4)


@query(
    "profile_sampled",
    "L2 P1",
    "SELECT column_name AS column, true AS same_type, true AS inside, true AS mean_within FROM (DESCRIBE lineitem)",
)
def _(spark, sf):
    """Whether the profile of a sample has every column, lies inside the bounds of the table and its means within five deviations."""
    lines = table(spark, sf, "lineitem")
    sampled, whole = profile_table(lines, sample_rows=20_000)["columns"], profile.column_profile(lines, approximate=True)
    both = whole.alias("w").join(sampled.alias("s"), "column")
    none = F.col("w.mean").isNull()
    inside = (F.col("s.min") >= F.col("w.min")) & (F.col("s.max") <= F.col("w.max"))
    near = F.abs(F.col("s.mean") - F.col("w.mean")) <= 5 * F.col("w.std") / F.sqrt(F.lit(min(20_000, lines.count()) * 0.9))
    return both.select(
        "column",
        (F.col("w.dtype") == F.col("s.dtype")).alias("same_type"),
        F.when(none, True).otherwise(inside).alias("inside"),
        F.when(none, True).otherwise(near).alias("mean_within"),
    )


FILTERED = """events WHERE event_type IN ('click', 'view', 'purchase') AND CAST(ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-20'"""


def _explore(spark, sf, **kwargs):
    return explore_table(
        table(spark, sf, "events"), "event_type", ["click", "view", "purchase"], "ts", "2024-01-03", "2024-01-20",
        order_by=["event_id"], **kwargs,
    )


@query("explore_filtered", "L3 W9 W5", f"SELECT * FROM {FILTERED}")
def _(spark, sf):
    return _explore(spark, sf)["filtered"]


@query("explore_describe", "L3 A7", each(["event_id", "user_id", "value"], DESCRIBED, FILTERED))
def explore_describe(spark, sf):
    return describe_rounded(_explore(spark, sf)["describe"])


@query("explore_preview", "L3 O3", f"SELECT * FROM {FILTERED} ORDER BY event_id LIMIT 10")
def _(spark, sf):
    return _explore(spark, sf)["preview"]


@query("export_csv", "L3 K5", f"SELECT * FROM {FILTERED}")
def _(spark, sf):
    path = new_path(spark, "export")
    _explore(spark, sf, export_path=path)
    events = table(spark, sf, "events")
    original = read_csv(spark, f"{path}/original", events.schema)
    # The exported original is the whole table, rows and all.
    if not original.exceptAll(events).isEmpty() or original.count() != events.count():
        raise ValueError("the exported original differs from the table")
    return read_csv(spark, f"{path}/filtered", events.schema)


# 64 columns with gaps: each misses every seventh row, at another place.
WIDE = [(i, f"x{i}") for i in range(64)]
WIDE_SQL = ", ".join(f"CASE WHEN (event_id + {i}) % 7 <> 0 THEN (value * {i + 1}) % 97 + user_id % {i + 2} END AS {n}" for i, n in WIDE)


def wide(spark, sf):
    value, user = F.col("value"), F.col("user_id")
    return table(spark, sf, "events").select(
        *[F.when((F.col("event_id") + i) % 7 != 0, (value * (i + 1)) % 97 + user % (i + 2)).alias(n) for i, n in WIDE]
    )


@query(
    "correlation_wide",
    "A9",
    f"""WITH w AS (SELECT {WIDE_SQL} FROM events),
        m AS (SELECT {", ".join(f"avg({n}) AS m{i}" for i, n in WIDE)} FROM w),
        c AS (SELECT row_number() OVER () AS r, {", ".join(f"{n} - m{i} AS {n}" for i, n in WIDE)} FROM w, m),
        long AS (UNPIVOT c ON {", ".join(n for _, n in WIDE)} INTO NAME k VALUE v)
        SELECT a.k AS column_a, b.k AS column_b, round(corr(a.v, b.v), 4)::DOUBLE + 0 AS correlation  -- no negative zero
        FROM long a JOIN long b ON a.r = b.r GROUP BY 1, 2""",
)
def correlation_wide(spark, sf):
    return rounded(profile.correlation_matrix(wide(spark, sf)), correlation=4).withColumn("correlation", F.col("correlation") + 0)


TEXT_TOP = """SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS count,
    CAST(row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS INTEGER) AS rank
    FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} QUALIFY rank <= 25"""


@query("top_values_of_texts", "A10", " UNION ALL ".join("(" + TEXT_TOP.format(c=c, t="documents") + ")" for c in ("text", "doc_id", "lang")))
def top_values_of_texts(spark, sf):
    """Texts of which nearly all are distinct, ids of which all are, and languages of which few are."""
    documents = table(spark, sf, "documents")
    return reduce(lambda a, b: a.unionByName(b), [heavy.top_values(documents, c, 25) for c in ("text", "doc_id", "lang")])


@query(
    "numeric_stats_64bit",
    "A4 A13",
    """SELECT 'big' AS "column", CAST(min(o_orderkey + 9007199254740993) AS VARCHAR) AS min_value, CAST(max(o_orderkey + 9007199254740993) AS VARCHAR) AS max_value
       FROM orders UNION ALL SELECT 'o_orderkey', CAST(min(o_orderkey) AS VARCHAR), CAST(max(o_orderkey) AS VARCHAR) FROM orders""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders")
    return profile.exact_extremes(orders.select("o_orderkey", (F.col("o_orderkey") + 9007199254740993).alias("big")))


@query("footer_facts", "S5 A13", "SELECT count(*) AS total_rows, min(l_orderkey) AS min_l_orderkey, max(l_orderkey) AS max_l_orderkey, min(l_linenumber) AS min_l_linenumber, max(l_linenumber) AS max_l_linenumber FROM lineitem")
def _(spark, sf):
    return footer_facts(spark, f"{sf}/lineitem.parquet", "l_orderkey", "l_linenumber")


@query(
    "profile_merged",
    "A3 A5 A8 L2",
    each(
        ["event_id", "user_id", "value"],
        """count(*) AS rows, count(*) - count($) AS null_count, round(avg($), 4)::DOUBLE AS mean, round(stddev_samp($), 4)::DOUBLE AS std,
           min($)::DOUBLE AS min, max($)::DOUBLE AS max, true AS distinct_near, true AS quartiles_near""",
        "events",
    ),
)
def profile_merged(spark, sf):
    """A dataset that grows by thirds, profiled after each: the last profile merges sketches and reads the last third only."""
    events = table(spark, sf, "events")
    data = VersionedDataset(spark, new_path(spark, "growing"), F.date_trunc("month", "ts"))
    store = VersionedDataset(spark, new_path(spark, "sketches"))
    for i in range(3):
        data.append(events.filter(F.col("event_id") % 3 == i))
        merged = sketches.profile_versions(data, store)
    found = merged.filter(F.col("column").isin("event_id", "user_id", "value"))
    exact = profile.distinct_counts(events.select("event_id", "user_id", "value"))
    # The rank of an estimated quartile may be off by a hundredth of the rows.
    estimates = {r["column"]: r for r in found.collect()}
    ranks = events.agg(
        *[
            F.array(*[F.array(F.count_if(F.col(c) < F.lit(r[q])), F.count_if(F.col(c) <= F.lit(r[q])), F.count(c)) for q in ("p25", "p50", "p75")]).alias(c)
            for c, r in estimates.items()
        ]
    ).first()
    near = {c: all(below <= (p + 0.01) * n and upto >= (p - 0.01) * n for p, (below, upto, n) in zip((0.25, 0.5, 0.75), ranks[c])) for c in estimates}
    told = spark.createDataFrame(list(near.items()), "column string, quartiles_near boolean")
    close = F.abs(F.col("unique_estimate") - F.col("distinct_count")) <= 0.05 * F.col("distinct_count")
    joined = found.join(exact, "column").join(told, "column").withColumn("distinct_near", close)
    return rounded(joined.select("column", "rows", "null_count", "mean", "std", "min", "max", "distinct_near", "quartiles_near"), mean=4, std=4)


PROFILE_TABLES = {"rows": 1, "overview": 1, "columns": 11, "missing": 0, "histograms": None, "correlations": 64, "value_counts": None, "outliers": 8}


@query(
    "profile_tables",
    "L2 K8",
    """SELECT (SELECT count(*) FROM lineitem) AS total_rows, 11::BIGINT AS columns, 0::BIGINT AS missing, 64::BIGINT AS correlations, 8::BIGINT AS outliers,
       8 * (SELECT count(*) FROM lineitem)::BIGINT AS in_histograms,
       2 * (SELECT count(*) FROM lineitem)::BIGINT AS in_value_counts, (SELECT count(*) FROM lineitem) AS overview_rows""",
)
def _(spark, sf):
    """All eight stored tables of a report read back; the two texts of the table have few values, so their counts add up to all rows."""
    path = new_path(spark, "report")
    profile_table(table(spark, sf, "lineitem"), report_path=path)
    back = {name: spark.read.parquet(f"{path}/{name}") for name in PROFILE_TABLES}
    numbers = {
        "total_rows": back["rows"].select("total_rows"),
        **{n: back[n].agg(F.count(F.lit(1)).alias(n)) for n in ("columns", "missing", "correlations", "outliers")},
        "in_histograms": back["histograms"].agg(F.sum("count").alias("n")),
        "in_value_counts": back["value_counts"].agg(F.sum("count").alias("n")),
        "overview_rows": back["overview"].select("total_rows"),
    }
    return spark.range(1).select(*[F.lit(df.first()[0]).cast("bigint").alias(n) for n, df in numbers.items()])


@query(
    "sample_exact",
    "P1",
    "SELECT 1234::BIGINT AS rows, 1234::BIGINT AS distinct_ids, true AS inside, true AS spread, true AS repeatable",
)
def _(spark, sf):
    """Exactly so many rows, none twice, all of the table, spread over it, and the same ones again."""
    lines = table(spark, sf, "lineitem").withColumn("at", F.monotonically_increasing_id())
    drawn, again = exact_sample(lines, 1234, 7), exact_sample(lines, 1234, 7)
    total = lines.count()
    facts = drawn.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("at").alias("distinct_ids"), F.avg("at").alias("middle"))
    return facts.select(
        "rows",
        "distinct_ids",
        F.lit(drawn.join(lines, "at", "left_anti").isEmpty()).alias("inside"),
        (F.abs(F.col("middle") / total - 0.5) < 0.05).alias("spread"),
        F.lit(drawn.select("at").exceptAll(again.select("at")).isEmpty()).alias("repeatable"),
    )
