"""Benchmark decontamination with a distributed positional inverted index.

The index stores the positions of every benchmark term in every document: one row per document and term, in the shared
folder. Document frequencies come from the index. Each window of a benchmark item is looked up by its rarest terms,
whose offset-adjusted posting lists are intersected; what they agree on is an alignment of the item with the document, and
the lists of the item's other terms are intersected with that. Runs of matching offsets at least a window long are exact
phrase matches. Proximity matches use the same index.

The terms of the benchmark are broadcast in blocks of at most ``TERM_BYTES``; a larger benchmark takes several passes.

Edge cases: missing text has no words; an item without words is in no document; an item shorter than a window is one
window; repeated items with one id count once; repeated documents are separate rows; empty tables on either side give no matches, and every document still
has its row; a very long text is one row of a batch and its postings are spread by term; other columns are ignored. The
documents must read the same way each time, as files do.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakewright.llm.common import batches, bytes_of_text, staged

WINDOW = 10
TERM_BYTES = 32 << 20
BATCH_BYTES = 2 << 20
RAREST = 3  # terms of a window whose lists are intersected first
BROADCAST_ROWS = 1_000_000  # document numbers broadcast to thin the postings; more are joined by a shuffle
LENGTH = -1  # the term number under which the index keeps a document's number of words

# Bytes of words as they are, A-Z in lower case, all others blank.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Runs of digits, letters a-z (A-Z lower-cased) and bytes from 0x80 on."""
    return text.translate(FOLD).split()


def item_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """One row per word of an item: ``item`` (a key of its id and text), ``item_id`` as text, ``i``, ``term``, ``length``."""

    def split(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            for key, name, content in zip(batch.column(0), batch.column(1), bytes_of_text(batch.column(2))):
                own = words(content)
                n = len(own)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([key.as_py()] * n, pa.binary()),
                        pa.array([name.as_py()] * n, pa.string()),
                        pa.array(range(n), pa.int32()),
                        pa.array(own, pa.binary()),
                        pa.array([n] * n, pa.int32()),
                    ],
                    ["item", "item_id", "i", "term", "length"],
                )

    name, content = F.coalesce(F.col(item).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    distinct = items.select(name.alias("item_id"), content.alias("text")).distinct()
    keyed = distinct.select(F.unhex(F.sha1(F.concat("item_id", F.lit("\0"), "text").cast("binary"))).alias("item"), "item_id", "text")
    return keyed.mapInArrow(split, "item binary, item_id string, i int, term binary, length int")


def build_index(documents: DataFrame, terms: list[bytes], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings of the given terms: ``doc`` (a row number), ``term`` (position in ``terms``), ``positions``.

    Each document also has a row with the term ``LENGTH``, which holds its ``doc_id`` and, as the one position, its number of words.
    """
    shared = documents.sparkSession.sparkContext.broadcast({term: n for n, term in enumerate(terms)})
    kind = documents.select(key).schema[0].dataType.simpleString()

    def post(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, row = shared.value.get, TaskContext.get().partitionId() << 40
        for batch in batches(frames, BATCH_BYTES):
            tokens, lengths = [], []
            for content in bytes_of_text(batch.column(1)):
                own = words(content)
                lengths.append(len(own))
                tokens += own
            n, lengths = len(lengths), np.array(lengths, np.int64)
            term = np.fromiter((number(t, -2) for t in tokens), np.int64, len(tokens))
            del tokens
            start = np.cumsum(lengths) - lengths
            at = np.flatnonzero(term >= 0)
            doc = np.repeat(np.arange(n), lengths)[at]
            # Positions ascend within a document and term because the sort is stable.
            order = np.argsort(doc * len(shared.value) + term[at], kind="stable")
            at, doc = at[order], doc[order]
            term = term[at]
            first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (term[1:] != term[:-1]))) if len(at) else at
            docs = np.concatenate([doc[first], np.arange(n)])
            offsets = np.concatenate([first, len(at) + np.arange(n + 1)]).astype(np.int32)
            positions = np.concatenate([at - start[doc], lengths]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(docs + row),
                    batch.column(0).take(pa.array(np.where(np.arange(len(docs)) < len(first), n, docs), mask=np.arange(len(docs)) < len(first))),
                    pa.array(np.concatenate([term[first], np.full(n, LENGTH)]).astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(positions)),
                ],
                ["doc", "doc_id", "term", "positions"],
            )
            row += n

    columns = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return columns.mapInArrow(post, f"doc bigint, doc_id {kind}, term int, positions array<int>")


def phrase_matches(index: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Maximal runs of words that cover windows of an item: ``doc``, ``item``, ``item_id``, ``start``, ``length``.

    ``items`` has rows as ``item_terms`` gives them, with ``term`` as the index numbers it.
    """
    postings = index.filter(F.col("term") != LENGTH)
    frequency = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    known = items.join(frequency, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    reach = W.partitionBy("item").orderBy("i").rowsBetween(0, window - 1)
    own = F.array_sort(F.collect_list(F.struct("df", F.col("i").alias("at"), "term")).over(reach))
    grouped = (
        known.select("item", "i", "length", own.alias("own"))
        .filter((F.col("i") <= F.greatest(F.lit(0), F.col("length") - window)) & (F.col("own")[0]["df"] > 0))
        .groupBy("item", F.slice("own", 1, RAREST).alias("own"))
        .agg(F.min("i").alias("seed"))
        .select("item", "seed", "own", F.monotonically_increasing_id().alias("number"))
    )
    # The seeds are no more rows than the block of items has words, times a constant. Tasks count places by a seed's number:
    # with its item they would hold half as much again.
    seeds = staged(index.sparkSession, grouped, "seeds")
    counted = (
        postings.join(F.broadcast(seeds.select("number", F.inline("own")).drop("df")), "term")
        .select("doc", "number", "at", F.explode("positions").alias("p"))
        .groupBy("doc", "number", (F.col("p") - F.col("at")).alias("shift"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    agreed = counted.join(F.broadcast(seeds.select("item", "number", F.size("own").alias("need"))), "number").filter("n = need")
    alignments = staged(index.sparkSession, agreed.select("doc", "item", "shift").distinct(), "alignments")
    docs = alignments.select("doc").distinct()
    if docs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        postings = postings.join(F.broadcast(docs), "doc", "left_semi")
    wanted = alignments.join(F.broadcast(items.select("item", "item_id", "i", "term", "length")), "item")
    # By place, not by list: a word that fills a document is looked up once per place, however many alignments it has.
    places = postings.select("doc", "term", F.explode("positions").alias("p"))
    here = wanted.withColumn("p", F.col("shift") + F.col("i")).join(places, ["doc", "term", "p"])
    # Offsets in a row have the same difference to their row number.
    order = W.partitionBy("doc", "item", "shift").orderBy("i")
    runs = here.select("doc", "item", "item_id", "shift", "i", "length", (F.col("i") - F.row_number().over(order)).alias("run"))
    return (
        runs.groupBy("doc", "item", "item_id", "shift", "run", "length")
        .agg(F.min("i").alias("i"), F.count(F.lit(1)).cast("int").alias("n"))
        .filter(F.col("n") >= F.least(F.lit(window), "length"))
        .select("doc", "item", "item_id", (F.col("shift") + F.col("i")).alias("start"), F.col("n").alias("length"))
    )


def proximity_matches(index: DataFrame, items: DataFrame, span: int, share: float = 1.0) -> DataFrame:
    """Documents in which ``span`` consecutive words hold at least ``share`` of an item's distinct terms.

    Returns ``doc``, ``item``, ``item_id``, ``terms`` (the most found together). Only documents with one of the item's rarest
    terms, so many that none can be left out, are looked at.
    """
    postings = index.filter(F.col("term") != LENGTH)
    frequency = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    distinct = items.select("item", "item_id", "term").distinct().join(frequency, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    own = W.partitionBy("item")
    ranked = distinct.select(
        "*", F.row_number().over(own.orderBy("df", "term")).alias("rank"), F.count(F.lit(1)).over(own).alias("n")
    ).withColumn("least", F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(share)).cast("int")))
    seeds = ranked.filter(F.col("rank") <= F.col("n") - F.col("least") + 1)
    docs = postings.join(seeds.select("term", "item"), "term").select("doc", "item").distinct()
    found = docs.join(ranked.select("item", "item_id", "term", "least"), "item").join(postings.select("doc", "term", "positions"), ["doc", "term"])
    near = W.partitionBy("doc", "item").orderBy("p").rangeBetween(0, span - 1)
    return (
        found.select("doc", "item", "item_id", "term", "least", F.explode("positions").alias("p"))
        .select("doc", "item", "item_id", "least", F.size(F.collect_set("term").over(near)).alias("terms"))
        .groupBy("doc", "item", "item_id", "least")
        .agg(F.max("terms").alias("terms"))
        .filter("terms >= least")
        .select("doc", "item", "item_id", "terms")
    )


def term_blocks(terms: DataFrame, limit: int = TERM_BYTES) -> Iterator[tuple[DataFrame, list[bytes]]]:
    """Items in blocks whose distinct terms have at most about ``limit`` bytes, with these terms."""
    total = terms.select(F.sum(F.octet_length("term"))).first()[0] or 0
    blocks = max(1, math.ceil(total / limit))
    for block in range(blocks):
        own = terms.filter(F.pmod(F.hash("item"), F.lit(blocks)) == block)
        yield own, sorted(bytes(r.term) for r in own.select("term").distinct().collect())


def contamination(
    spark: SparkSession, documents: DataFrame, items: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", item: str = "item_id"
) -> DataFrame:
    """Per document row: ``doc_id``, ``n_words``, ``n_hit`` (words inside matches), ``items`` (sorted ids as text)."""
    terms = staged(spark, item_terms(items, item, text), "benchmark-terms")
    matches = lengths = None
    for own, vocabulary in term_blocks(terms):
        index = staged(spark, build_index(documents, vocabulary, key, text), "postings")
        numbers = spark.createDataFrame([(bytearray(t), n) for n, t in enumerate(vocabulary)], "term binary, number int")
        numbered = own.join(numbers, "term").select("item", "item_id", "i", F.col("number").alias("term"), "length")
        found = phrase_matches(index, numbered, window).select("doc", "item_id", "start", "length")
        # Rows of a document have the same number in every block: all read the same partitions.
        matches = found if matches is None else matches.unionByName(found)
        lengths = index if lengths is None else lengths
    before = W.partitionBy("doc").orderBy("start", "length").rowsBetween(W.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    fresh = matches.withColumn("from", F.greatest("start", F.coalesce(F.max(end).over(before), F.col("start")))).withColumn("fresh", F.greatest(F.lit(0), end - F.col("from")))
    hits = fresh.groupBy("doc").agg(F.sum("fresh").alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("items"))
    every = lengths.filter(F.col("term") == LENGTH).select("doc", "doc_id", F.get("positions", F.lit(0)).cast("bigint").alias("n_words"))
    return every.join(hits, "doc", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )
