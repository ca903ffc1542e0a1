"""From raw documents to packed sequences: each stage is written as Parquet and read again by the next.

Stages take (spark, docs, sf_dir). All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.llm import decontaminate, jaccard, langid, packing, secrets
from lakewright.llm.common import small_batches, staged
from lakewright.llm.queries import table, tokenizer
from lakewright.session import new_path, scratch

LEAST_SCORE = 0.5
# Near copies share four fifths of their five-word shingles; op5_jaccard_join keeps its own width and share.
NEAR_WIDTH, NEAR_PERCENT = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier, learned from the labelled ones, can tell."""
    model = langid.train(docs.select("text", "lang"))
    found = langid.predict(docs, model, result="_lang", probability="_score")
    return found.filter((F.col("_lang") != langid.UNKNOWN) & (F.col("_score") >= LEAST_SCORE)).drop("_lang", "_score")


def with_row_key(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows with a number of their own, ``_row``: ids may be missing or used by several rows.

    A row of Parquet files, as stages get them, has its file and its place there. Other rows are written first.
    """
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation" or "_metadata" in docs.columns:
        return staged(spark, docs.withColumn("_row", F.monotonically_increasing_id()), "row-keys")
    file, place = F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__place")
    # One row per file, of which the scan reads no column.
    files = sorted(r[0] for r in docs.select(file).distinct().collect())
    numbers = spark.createDataFrame([(n, f) for n, f in enumerate(files)], "__number bigint, __file string")
    placed = docs.select(*docs.columns, file, place).join(F.broadcast(numbers), "__file")
    return placed.select(*docs.columns, (F.shiftleft("__number", 38) + F.col("__place")).alias("_row"))


def decided(spark: SparkSession, label: str, decide: Callable[[], DataFrame]) -> DataFrame:
    """The rows of ``decide``, written; all that it wrote aside is deleted."""
    path = new_path(spark, label)
    with scratch(spark), small_batches(spark):
        rows = decide()
        rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of similar documents: that of the smallest id, a missing id last. Rows without words stay."""
    keyed = with_row_key(spark, docs)

    def copies() -> DataFrame:
        classes = jaccard.jaccard_classes(spark, keyed, key="_row", width=NEAR_WIDTH, percent=NEAR_PERCENT).withColumnRenamed("doc_id", "_row")
        order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))
        first = classes.join(keyed.select("_row", "doc_id"), "_row").groupBy("component_id").agg(F.min(order).alias("first"))
        return classes.join(first, "component_id").filter(F.col("_row") != F.col("first.row")).select("_row")

    return keyed.join(decided(spark, "copies", copies), "_row", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    keyed = with_row_key(spark, docs)

    def hit() -> DataFrame:
        found = decontaminate.contamination(spark, keyed, table(spark, sf_dir, "benchmark"), key="_row")
        return found.filter("n_hit > 0").select(F.col("doc_id").alias("_row"))

    return keyed.join(decided(spark, "contaminated", hit), "_row", "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced and ``n_chars`` counted anew where one was."""
    keyed = with_row_key(spark, docs)

    def found() -> DataFrame:
        scanned = secrets.scan_secrets(spark, keyed, new_path(spark, "secret-ledger"), path="_row")
        return scanned.filter(F.size("spans") > 0).select("_row", F.col("spans").alias("_spans"))

    joined = keyed.join(decided(spark, "secrets", found), "_row", "left")
    clean = joined.withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(secrets.redact("text", "_spans")))
    return clean.withColumn("n_chars", F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.length("text"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with their ids."""
    return packing.pack_documents(spark, docs, *tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack),
]

# No stage but the exact ones could be said in SQL; tests compare the run with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
