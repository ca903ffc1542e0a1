"""One query per operator, over whole tables, and SQL where SQL can say the same."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.llm import brown, chat, decontaminate, importance, jaccard, langid, packing, personal, quality, repair, repeats, secrets, warc
from lakewright.llm.common import crc_of_id
from lakewright.llm.oracles import SQL
from lakewright.session import new_path
from lakewright.sources.readers import read_parquet

__all__ = ["QUERIES", "SQL"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(run: Callable[[SparkSession, str], DataFrame]):
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{folder}/{name}.parquet")


@query
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from two thirds of them."""
    documents = table(spark, folder, "documents")
    held_out = crc_of_id("doc_id") % 3 == 1
    model = langid.train(documents.filter(~held_out).select("text", "lang"))
    found = langid.predict(documents.select("doc_id", held_out.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query
def op2_repeated_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without the 50-byte strings of documents with smaller ids."""
    return repeats.remove_repeats(spark, table(spark, folder, "documents")).drop("kept")


@query
def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document inside benchmark windows."""
    found = decontaminate.contamination(spark, table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written as WARC records and read back."""
    archive = new_path(spark, "warc")
    pages = table(spark, folder, "pages")
    warc.write_warc(spark, warc.page_records(pages), archive, compression="gzip")
    back = warc.read_warc(spark, archive).filter(F.col("record_type").isin("response", "revisit"))
    kind = dict(pages.dtypes)["page_id"]

    def page(column: str):
        return F.nullif(F.substring_index(F.col(column), ":", -1), F.lit("")).cast(kind)

    # A response's payload is measured anew; a revisit has the length and digest of the payload it stands for.
    payload, response = F.coalesce(F.col("payload"), F.lit(b"")), F.col("record_type") == "response"
    return back.select(
        page("record_id").alias("page_id"),
        F.when(response, F.octet_length(payload).cast("bigint")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.sha1(payload)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )


@query
def op5_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of all documents linked by nine tenths of their shingles."""
    return jaccard.jaccard_classes(spark, table(spark, folder, "documents"))


def tokenizer() -> tuple[str, int]:
    """Path and size of the vocabulary the packing query is defined with."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), 50_257


@query
def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens at most."""
    pieces = packing.pack_documents(spark, table(spark, folder, "documents"), *tokenizer())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op7_class_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Log probabilities of all documents, learned from four fifths of them."""
    documents = table(spark, folder, "documents").select("doc_id", "text", (crc_of_id("doc_id") % 5 == 1).alias("held_out"))
    model, counts = brown.train(spark, documents.filter(~F.col("held_out")))
    return brown.score(spark, documents, model, counts, keep=("held_out",))


@query
def op8_secret_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of all documents, by way of a new ledger."""
    found = secrets.scan_secrets(spark, table(spark, folder, "documents"), new_path(spark, "secret-ledger"))

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE_KINDS))
    return found.select(
        "doc_id",
        *[count(kind) for kind in secrets.BASE_KINDS],
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


@query
def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Measurements, failure bits and the standard policy's verdict on all documents."""
    ledger = quality.apply_policy(quality.rule_ledger(table(spark, folder, "documents")), quality.STANDARD)
    base_failed = F.col("failed").bitwiseAND(F.lit(quality.BASE_MASK).cast("bigint")) != 0
    return ledger.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), "kept"
    )


@query
def op10_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and the made-up conversation -7, formatted and read back."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -7L conv_id, 0L turn, 'user' role, '{tricky}' text UNION ALL SELECT -7L, 1L, 'assistant', '{tricky}'")
    formatted = chat.format_conversations(turns.unionByName(extra))
    back = formatted.select("conv_id", "formatted", chat.read_turns("formatted").alias("turns"), chat.loss_text("formatted", "loss_spans").alias("loss"))
    written = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(written.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


@query
def op11_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of all documents, by patterns and a field trained on a small labelled table."""
    documents = table(spark, folder, "documents")
    model = personal.train(personal.labelled_table(spark, documents))
    found = personal.find_personal(documents.select("doc_id", "text"), model)
    names = F.array(*[F.lit(k) for k in personal.KINDS])

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["base"])

    def count(number, kind):
        return F.size(F.filter(base, lambda s: s["kind"] == number)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(number, kind) for number, kind in enumerate(personal.KINDS)],
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


@query
def op12_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """Weights of all documents towards the benchmark, and a quarter of them drawn."""
    return importance.resample(spark, table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations damaged, then repaired at least cost."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    found, repaired = repair.repair(spark, repair.damage(turns))
    every = repair.merged("conv_id", turns.select("conv_id").distinct(), found, repair.digests(repaired))

    def known(column: str, default: object):
        return F.coalesce(F.col(column), F.lit(default)).alias(column)

    counts = [known(c, 0) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return every.select("conv_id", *counts, known("audit", ""), known("repaired_sha256", empty))
