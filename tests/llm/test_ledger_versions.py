"""A raised version of a rule replaces what the old one found."""

from dataclasses import replace

from lakewright.llm import secrets
from lakewright.session import new_path


def found(spark, df, ledger, *rules):
    return {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans] for r in secrets.scan_secrets(spark, df, ledger, rules).collect()}


def test_a_raised_version_replaces_its_spans(spark):
    ledger = new_path(spark, "ledger")
    df = spark.createDataFrame([(1, "abc12 abc"), (2, "abc")], "doc_id bigint, text string")
    wide = secrets.Rule("word", "[a-z]+[0-9]*")
    narrow = replace(wide, pattern="[a-z]+[0-9]+", version=2)
    other = secrets.Rule("digits", "[0-9]+")
    assert found(spark, df, ledger, wide, other) == {1: [(0, "word", 5), (3, "digits", 5), (6, "word", 9)], 2: [(0, "word", 3)]}
    assert found(spark, df, ledger, narrow, other) == {1: [(0, "word", 5), (3, "digits", 5)], 2: []}
    assert found(spark, df, ledger, wide) == {1: [(0, "word", 5), (6, "word", 9)], 2: [(0, "word", 3)]}


def test_ledgers_without_keys_are_read(spark):
    ledger = new_path(spark, "ledger")
    df = spark.createDataFrame([(1, "abc12 abc")], "doc_id bigint, text string")
    old = df.select(secrets.blob_id("text").alias("blob_id")).selectExpr(
        "blob_id", "array('word@1') AS scanned", "array(named_struct('start', 0L, 'rule', 0, 'kind', 'word', 'end', 5L)) AS spans"
    )
    old.write.parquet(ledger)
    assert found(spark, df, ledger, secrets.Rule("word", "[a-z]+[0-9]*")) == {1: [(0, "word", 5)]}
    assert found(spark, df, ledger, secrets.Rule("word", "[a-z]+$", version=2)) == {1: [(6, "word", 9)]}
