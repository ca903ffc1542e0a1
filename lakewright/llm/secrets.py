"""Secret scans with an incremental blob ledger.

Every version of every text is addressed by the SHA-256 of its bytes. The ledger, a Parquet dataset in a folder of the
caller's choice, records which rules in which versions have seen a blob and what they found. A scan reads only the
blobs with a rule and version the ledger lacks, once per blob however many paths carry it, appends what it found, and
joins the ledger back to all paths.

Edge cases: a missing text counts as empty; repeated rows each keep their row; a missing path is a path like any other;
an empty table gives an empty result and an empty ledger entry set; a rule of a new version is scanned anew while the
others are not; columns of the input other than the path and the text are neither read nor in the way.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A pattern, how many characters its ``group`` must have, and a version to raise when either changes."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The order of the rules is the order of kinds at equal positions.
RULES = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # the same spans as runs of any length, of which the short ones are dropped
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    # A scheme starts at the edge of its run, so that a long run without one is read once.
    Rule("url_login", r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]*://[^\s:/@]+:([^\s:/@]+)@", 1, 6, version=2),
)
BASE_KINDS = ("assign", "access", "hex")
SPANS = "array<struct<start:bigint,rule:int,kind:string,end:bigint>>"
# In the ledger each span has the rule and version that found it; ledgers written without are read by what their row scanned.
LEDGER = f"blob_id binary, scanned array<string>, spans {SPANS.replace('>>', ',key:string>>')}"


def find_spans(text: str, rules: Iterable[tuple[int, Rule, re.Pattern]]) -> list[dict]:
    """Leftmost spans per rule without overlap, in code points, by position and then by rule."""
    found = []
    for number, rule, pattern in rules:
        for match in pattern.finditer(text):
            if len(match.group(rule.group)) >= rule.least:
                found.append({"start": match.start(), "rule": number, "kind": rule.kind, "end": match.end(), "key": rule.key})
    return sorted(found, key=lambda s: (s["start"], s["rule"], s["end"]))


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """One row per blob: the rules that have seen it and all their spans. Without a ledger: no rows."""
    try:
        rows = spark.read.schema(LEDGER).parquet(ledger)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], LEDGER)

    def keyed(span):
        of_kind = F.filter("scanned", lambda k: k == F.concat(span["kind"], F.lit("@"), F.substring_index(k, "@", -1)))
        return span.withField("key", F.coalesce(span["key"], F.get(of_kind, F.lit(0))))

    return rows.withColumn("spans", F.transform("spans", keyed)).groupBy("blob_id").agg(
        F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("scanned"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
    )


def blob_id(text: str):
    """Content address of a text column."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def update_ledger(
    spark: SparkSession, documents: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, path: str = "doc_id", text: str = "text"
) -> None:
    """Scan what the ledger lacks and append it.

    One path carries a blob to the scan, the smallest; the join on blob and path spreads the copies of a hot blob over
    the tasks. A repeated carrier row only repeats an entry, which ``read_ledger`` folds.
    """
    versions = documents.select(F.col(path).alias("path"), F.col(text).alias("text"), blob_id(text).alias("blob_id"))
    blobs = versions.groupBy("blob_id").agg(F.min("path").alias("carrier"))
    wanted = F.array(*[F.lit(r.key) for r in rules])
    unseen = (
        blobs.join(read_ledger(spark, ledger).select("blob_id", "scanned"), "blob_id", "left")
        .withColumn("todo", F.array_except(wanted, F.coalesce("scanned", F.array().cast("array<string>"))))
        .filter(F.size("todo") > 0)
        .select(F.col("blob_id").alias("blob"), "carrier", "todo")
    )
    carriers = versions.join(unseen, (F.col("blob_id") == F.col("blob")) & F.col("path").eqNullSafe(F.col("carrier")))

    def scan(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(number, rule, re.compile(rule.pattern, re.ASCII)) for number, rule in enumerate(rules)]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("rule", pa.int32()), ("kind", pa.string()), ("end", pa.int64()), ("key", pa.string())]))
        for batch in frames:
            spans = []
            for content, todo in zip(batch.column(1), batch.column(2)):
                keys = set(todo.as_py())
                spans.append(find_spans(content.as_py() or "", [c for c in compiled if c[1].key in keys]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(spans, kind)], ["blob_id", "scanned", "spans"])

    carriers.select("blob_id", "text", "todo").mapInArrow(scan, LEDGER).write.mode("append").parquet(ledger)


def scan_secrets(
    spark: SparkSession, documents: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, path: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The path column and ``spans`` for every row, after bringing the ledger up to date.

    Spans are code-point positions ``[start, end)`` with their kind, sorted by start and rule. Only the given rules in
    their present versions count, so entries of retired rules stay unseen.
    """
    update_ledger(spark, documents, ledger, rules, path, text)
    keys = F.array(*[F.lit(r.key) for r in rules])
    present = F.transform(F.filter("spans", lambda s: F.array_contains(keys, s["key"])), lambda s: s.dropFields("key"))
    found = read_ledger(spark, ledger).select(F.col("blob_id").alias("blob"), present.alias("spans"))
    return (
        documents.select(F.col(path), blob_id(text).alias("blob_id"))
        .join(found.filter(F.size("spans") > 0), F.col("blob_id") == F.col("blob"), "left")
        .select(path, F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))
    )


def redact(text: str, spans: str, mask: str = "[REDACTED]"):
    """Column expression: the text with the union of the spans replaced by the mask; missing text stays missing."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("bigint").alias("at"))

    def step(done, span):
        fresh = span["start"] >= done["at"]
        gap = F.substring(F.col(text), (done["at"] + 1).cast("int"), (span["start"] - done["at"]).cast("int"))
        return F.struct(
            F.when(fresh, F.concat(done["text"], gap, F.lit(mask))).otherwise(done["text"]).alias("text"),
            F.greatest(done["at"], span["end"]).alias("at"),
        )

    def finish(done):
        return F.concat(done["text"], F.substring(F.col(text), (done["at"] + 1).cast("int"), F.lit(2**31 - 1)))

    return F.when(F.size(F.col(spans)) > 0, F.aggregate(F.col(spans), start, step, finish)).otherwise(F.col(text))
