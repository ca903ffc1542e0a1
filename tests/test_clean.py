import math

import pytest
from pyspark.sql import functions as F, types as T

from lakewright.functions.cleaning import parse_moment, parse_number, partition_text
from lakewright.operators import clean
from tests.conftest import values
from workload import REGISTRY

TEXTS = ["1", " 2 ", "1e5", "+3", ".5", "nan", "inf", "-inf", "1_000", "1d", "abc", "", "None", "<NA>", None, "١"]
NUMBERS = [1.0, 2.0, 1e5, 3.0, 0.5] + [None] * 11


def column(spark, items, kind):
    return spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"id int, v {kind}")


def kinds(df):
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def test_number_parser(spark):
    df = column(spark, TEXTS, "string")
    assert values(df.orderBy("id").select(parse_number(F.col("v")).alias("v")), "v") == NUMBERS


@pytest.mark.parametrize(
    ("items", "kind"),
    [
        (["1", "2", "3"], "smallint"),
        (["1", "70000"], "int"),
        (["1", str(2**40)], "bigint"),
        (["1", None], "double"),
        (["1", "nan"], "double"),
        (["1", "2.5", "inf", ""], "double"),
        (["1", "abc"], "string"),
        (["abc", "1"], "string"),
        (["1_000"], "string"),
        (["None", "", None], "string"),
    ],
)
def test_text_becomes_a_number_only_when_all_of_it_is(spark, items, kind):
    assert kinds(clean.clean(column(spark, items, "string")))["v"] == kind


def test_min_ratio(spark):
    df = column(spark, ["1", "2", "3", "x"], "string")
    out = clean.clean(df, min_ratio=0.75)
    assert kinds(out)["v"] == "double" and values(out.orderBy("id"), "v") == [1.0, 2.0, 3.0, None]


@pytest.mark.parametrize(
    ("low", "high", "kind"),
    [
        (-32767, 32766, "smallint"),
        (-32768, 0, "int"),
        (0, 32767, "int"),
        (-(2**31) + 1, 2**31 - 2, "int"),
        (-(2**31), 0, "bigint"),
        (0, 2**31 - 1, "bigint"),
        (None, None, "int"),
    ],
)
def test_integer_narrowing_is_strict(spark, low, high, kind):
    for extra in ([], [None]):
        df = column(spark, [low, high, *extra], "bigint")
        out = clean.narrow_integers(df)
        assert kinds(out)["v"] == kind
        assert values(out.orderBy("id"), "v") == [low, high, *extra]


def test_infinities_tokens_and_floats(spark):
    df = column(spark, [math.nan, math.inf, -math.inf, None, 0.0, -0.0], "float")
    assert values(clean.null_infinities(df).orderBy("id"), "v") == [None] * 4 + [0.0, -0.0]
    assert kinds(clean.floats_to_double(df))["v"] == "double"
    text = column(spark, ["nan", "NaN", "None", "<NA>", "", " nan"], "string")
    assert values(clean.null_tokens(text).orderBy("id"), "v") == [None, "NaN", None, None, "", " nan"]
    assert values(clean.null_tokens(text, empty_too=True).orderBy("id"), "v")[4] is None


def test_cleaning_twice_changes_nothing(spark):
    df = spark.createDataFrame(
        [(1, " 7 ", "None", 1.5, True, "a"), (2, "8", "", math.inf, None, "nan"), (3, "9", "z", None, False, "1")],
        "id bigint, t string, u string, x float, b boolean, `a b` string",
    )
    once = clean.clean(df)
    twice = clean.clean(once)
    assert once.schema == twice.schema and sorted(once.collect()) == sorted(twice.collect())
    assert kinds(once) == {"id": "smallint", "t": "smallint", "u": "string", "x": "double", "b": "boolean", "a b": "string"}


def test_strict_types(spark):
    df = spark.sql(
        "select true b, timestamp'2024-01-01 00:00:00' t, date'2024-01-02' d, cast(1.5 as decimal(9,2)) m, array(1, 2) a, timestamp_ntz'2024-01-03 00:00:00' n"
    )
    out = clean.clean(df, strict_types=True)
    assert kinds(out) == {"b": "string", "t": "string", "d": "timestamp_ntz", "m": "double", "a": "string", "n": "timestamp_ntz"}
    assert out.first()["b"] == "true" and out.first()["a"] == "[1,2]"
    assert kinds(clean.clean(df))["b"] == "boolean"


def test_apply_schema_coerces_and_reports(spark):
    df = spark.createDataFrame(
        [("1", "2.5", "2024-01-01", 7), ("70000", "x", "bad", 8), (None, "inf", "", 9), ("3.7", " 4 ", "2024-01-01 10:00", 10)],
        "i string, x string, t string, extra int",
    )
    schema = T.StructType.fromDDL("i smallint, x double, t timestamp_ntz, absent int")
    out = clean.apply_schema(df, schema, errors_column="errors").orderBy("extra").collect()
    assert [r.i for r in out] == [1, None, None, 3]
    assert [r.x for r in out] == [2.5, None, None, 4.0]
    assert [str(r.t) for r in out] == ["2024-01-01 00:00:00", "None", "None", "2024-01-01 10:00:00"]
    assert [r.errors for r in out] == [[], ["i", "x", "t"], ["x"], []]
    assert out[0].extra == 7 and "absent" not in out[0].asDict()


def test_key_columns(spark):
    df = spark.createDataFrame([("5", 1.0), ("x", 2.0), (None, None)], "id string, tb2_id double")
    out = clean.keys_to_integer(df, ["id", "tb2_id"])
    assert kinds(out) == {"id": "smallint", "tb2_id": "smallint"}
    assert sorted(map(str, values(out, "id"))) == ["5", "None", "None"]


def test_dates_whole_column_or_nothing(spark):
    df = spark.createDataFrame(
        [("2024-01-01", "2024-01-01", "x", 5, "a"), ("2024-01-02T03:04:05.123456", "someday", "y", 6, None), (None, None, "z", 7, "")],
        "created_date string, ship_time string, other string, runtime int, candidate string",
    )
    out, usable = clean.parse_dates(df)
    assert usable == ["created_date"]
    assert kinds(out)["created_date"] == "timestamp_ntz" and kinds(out)["ship_time"] == "string"
    assert sorted(map(str, values(out, "created_date"))) == ["2024-01-01 00:00:00", "2024-01-02 03:04:05.123456", "None"]
    _, with_epoch = clean.parse_dates(df, epoch_unit="s")
    assert with_epoch == ["created_date", "runtime"]
    epoch = clean.parse_dates(df, ["runtime"], epoch_unit="ms")[0]
    assert str(epoch.orderBy("other").first().runtime) == "1970-01-01 00:00:00.005000"


def test_moment_parser_rejects_what_is_not_a_date(spark):
    df = column(spark, ["2024", "2024-01", " 2024-01-01", "epoch", "2024-13-01", "2024-02-29"], "string")
    got = values(df.orderBy("id").select(parse_moment(F.col("v")).alias("v")), "v")
    assert got[:5] == [None] * 5 and str(got[5]) == "2024-02-29 00:00:00"


def test_partition_text(spark):
    df = spark.sql("select timestamp_ntz'2024-03-10 02:59:59' t, date'2024-01-02' d, cast(null as timestamp_ntz) n")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = df.select(*[partition_text(F.col(c)).alias(c) for c in df.columns]).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    # The first hour was skipped in that zone.
    assert tuple(got) == ("2024-03-10_02", "2024-01-02_00", None)


def test_totals_beyond_64_bits_are_whole(spark, tmp_path):
    rows = "SELECT id + 3000000000 AS event_id, id AS user_id FROM range({n})"
    for n, kind in ((1, "bigint"), (3, "decimal(38,0)")):
        spark.sql(rows.format(n=n)).write.parquet(str(tmp_path / str(n) / "events.parquet"))
        out = REGISTRY["narrow_ints"].run(spark, str(tmp_path / str(n)))
        assert kinds(out)["total"] == kind
        got = {r["column"]: (r["type"], int(r["total"] or 0), r["present"]) for r in out.collect()}
        ids = [3_000_000_000 + i for i in range(n)]
        assert got["large"] == ("bigint", sum(i * 3_000_000_000 for i in ids), n)
        assert got["user_id"] == ("smallint", sum(range(n)), n)


def test_first_characters_hide_no_number(spark):
    """Texts of every first character: the plan reads as numbers what the patterns alone do."""
    texts = [chr(i) + rest for i in (*range(1, 128), 0x85, 0xA0, 0x661, 0x2028) for rest in ("", "1", "1.5", "nf", "inf", "nfinity", " 7")]
    df = column(spark, texts, "string")
    t = F.col("v")
    want = df.agg(F.count_if(t.rlike(clean.NUMBER_PATTERN)).alias("number"), F.count_if(t.rlike(clean._INFINITE_PATTERN)).alias("infinite"), F.count(clean.parse_integer(t)).alias("whole")).first()
    likely = F.when(F.ascii(t).isin(*clean._FIRST), t)
    got = df.agg(F.count_if(likely.rlike(clean.NUMBER_PATTERN)).alias("number"), F.count_if(likely.rlike(clean._INFINITE_PATTERN)).alias("infinite"), F.count(clean.parse_integer(likely)).alias("whole")).first()
    assert got == want and want.number > 30 and want.infinite >= 12
