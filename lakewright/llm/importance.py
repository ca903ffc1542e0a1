"""Resampling towards a target distribution by importance weights over hashed word features.

Features are all runs of one and two words, hashed by CRC-32 into buckets. The tasks cut whole texts into words on their
UTF-8 bytes. The distinct features of a block are grouped by their length in bytes into two-dimensional uint8 arrays, one row a
feature; all CRCs of an array are updated together, one column after the other, and the buckets are scattered back to the
places of their features. Buckets are written once, two bytes a feature, in the shared folder; counting, weighing and
drawing read only these. A bucket's gain compares how often target and corpus use it, a document's weight is the mean gain
of its features, and a keyed noise turns the highest scores into a sample without replacement.

Bounds: a task holds one block of texts, a document's buckets and one count per bucket; the driver holds two counts and a gain
per bucket. A longer text is cut between words into blocks which meet in one word, so the features are those of the whole.

Edge cases: a missing or empty text, or one without words, has no features and weight 0; repeated rows are counted, scored
and drawn each for itself; a missing id is written as nothing in the noise key, and comes last among equal scores; ties go to
the smaller id; without a target every gain is the corpus's own; an empty table gives an empty result; further columns are
not read, so that their names can't clash.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.llm.common import batches, bytes_of_text, staged
from lakewright.operators.numbering import with_row_number

BUCKETS = 10_000
BLOCK = 1 << 22  # bytes of text handled at once
LONG = 512  # longer features are few in any text, and are hashed one by one

# Bytes of words once A-Z are lower-cased: digits, a-z and every byte of a character beyond ASCII.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


# What is left of a word from some byte on.
REST_OF_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]*")


def crc_table() -> np.ndarray:
    """The 256 steps of the reflected polynomial of CRC-32."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = crc_table()


def crc32_of_slices(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of many slices of a byte array: equal lengths share an array, which is walked column by column."""
    out = np.zeros(len(start), np.uint32)
    by_size = np.argsort(size, kind="stable")
    edges = np.flatnonzero(np.diff(size[by_size])) + 1
    for group in np.split(by_size, edges):
        if not len(group):
            continue
        length = int(size[group[0]])
        if length > LONG:
            out[group] = [zlib.crc32(data[a : a + length]) for a in start[group]]
            continue
        for part in np.array_split(group, max(1, len(group) * length >> 24)):
            rows = np.lib.stride_tricks.sliding_window_view(data, length)[start[part]] if length else np.zeros((len(part), 0), np.uint8)
            crc = np.full(len(part), 0xFFFFFFFF, np.uint32)
            for column in np.ascontiguousarray(rows.T):
                crc = CRC[(crc ^ column) & 0xFF] ^ (crc >> 8)
            out[part] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def cut_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of bytes: all joined by single blanks, start and size of each in that, and where each starts in the input."""
    raw = np.frombuffer(data.translate(LOWER), np.uint8)
    inside = IN_WORD[raw]
    edge = np.diff(np.concatenate(([False], inside, [False])).view(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = end - begin
    start = np.cumsum(size + 1) - size - 1
    blank = np.zeros(int(size.sum() + len(size)), bool)
    blank[start + size] = True
    joined = np.full(len(blank), 32, np.uint8)
    joined[~blank] = raw[inside]
    return joined, start, size, begin


def first_places(codes: np.ndarray, kinds: int) -> np.ndarray:
    """Where each code from 0 on occurs first."""
    first = np.zeros(kinds, np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return first


def hash_words(data: bytes, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Where each word starts, its bucket, the bucket of it and the next word together, and the last word."""
    joined, start, size, begin = cut_words(data)
    if not len(start):
        none = np.zeros(0, np.uint16)
        return begin, none, none, b""
    # With the blank after each, the words are adjacent slices, which Arrow can tell apart without a copy.
    offsets = pa.py_buffer(np.append(start, len(joined)).astype(np.int64))
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, offsets, pa.py_buffer(joined)]).dictionary_encode()
    word, kinds = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    at = first_places(word, kinds)
    single = (crc32_of_slices(joined, start[at], size[at]) % buckets).astype(np.uint16)[word]
    coded = pa.array(word[:-1] * kinds + word[1:]).dictionary_encode()
    pair = coded.indices.to_numpy()
    at = first_places(pair, len(coded.dictionary))
    double = (crc32_of_slices(joined, start[at], size[at] + 1 + size[at + 1]) % buckets).astype(np.uint16)[pair]
    return begin, single, double, joined[start[-1] : start[-1] + size[-1]].tobytes()


def text_buckets(texts: Iterable[bytes], buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """The buckets of all features of every text, in the order of the texts."""
    held: list[bytes] = []
    total = 0
    for text in texts:
        if len(text) > BLOCK:
            yield from _short_texts(held, buckets)
            held, total = [], 0
            yield _long_text(text, buckets)
            continue
        held.append(text)
        total += len(text)
        if total > BLOCK:
            yield from _short_texts(held, buckets)
            held, total = [], 0
    yield from _short_texts(held, buckets)


def _short_texts(texts: list[bytes], buckets: int) -> Iterator[np.ndarray]:
    if not texts:
        return
    begin, single, double, _ = hash_words(b"\0".join(texts), buckets)
    ends = np.cumsum([len(t) + 1 for t in texts])
    low = 0
    for high in np.searchsorted(begin, ends).tolist():
        yield np.concatenate((single[low:high], double[low : max(low, high - 1)]))
        low = high


def _long_text(text: bytes, buckets: int) -> np.ndarray:
    parts, begin, last = [], 0, b""
    while begin < len(text):
        end = REST_OF_WORD.match(text, begin + BLOCK).end() if begin + BLOCK < len(text) else len(text)
        _, single, double, word = hash_words(last + b" " + text[begin:end], buckets)
        parts += [single[1:] if last else single, double]
        begin, last = end, word
    return np.concatenate(parts)


def hashed_features(documents: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """Every row's key, the number of its features and their buckets, two bytes each."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must fit in two bytes")

    def apply(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames, BLOCK):
            found = [b.astype("<u2").tobytes() for b in text_buckets(bytes_of_text(batch.column(1)), buckets)]
            sizes = pa.array([len(b) // 2 for b in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(found, pa.binary())], ["key", "n_features", "buckets"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(apply, f"key {kind}, n_features bigint, buckets binary")


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features fall into each bucket: summed inside the tasks, then over them."""

    def count(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in frames:
            for cell in batch.column(0):
                sums += np.bincount(np.frombuffer(cell.as_buffer(), "<u2"), minlength=buckets)
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(sums[held])], ["bucket", "n"])

    rows = features.select("buckets").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio between the smoothed shares of target and corpus, rounded down."""
    whole, wanted = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log(((t + 1.0) * whole) / ((s + 1.0) * wanted))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weigh(features: DataFrame, gains: np.ndarray) -> DataFrame:
    """Key, number of features and their mean gain, rounded down."""

    def apply(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            sums = [int(gains[np.frombuffer(cell.as_buffer(), "<u2")].sum()) // max(n, 1) for n, cell in zip(batch.column(1).to_pylist(), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.int64())], ["key", "n_features", "weight"])

    kind = features.schema["key"].dataType.simpleString()
    return features.mapInArrow(apply, f"key {kind}, n_features bigint, weight bigint")


def resample(
    spark: SparkSession,
    documents: DataFrame,
    target: DataFrame,
    percent: int = 25,
    least_words: int = 20,
    seed: int = 7,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    buckets: int = BUCKETS,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document; ``rank`` is missing where it is not drawn.

    Of the documents with ``least_words`` words the given share is drawn, rounded down.
    """
    features = staged(spark, hashed_features(documents, key, text, buckets), "features")
    wanted = bucket_counts(hashed_features(target.withColumn("__key", F.lit(0)), "__key", target_text, buckets), buckets)
    weighed = weigh(features, bucket_gains(bucket_counts(features, buckets), wanted))
    # n words have n single features and n - 1 of two words.
    enough = F.col("n_features") >= 2 * least_words - 1
    drawn = features.filter(enough).count() * percent // 100
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10)
    noise = F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))
    scored = weighed.withColumn("score", F.col("weight") + noise)
    numbered = with_row_number(scored, [enough.desc(), F.col("score").desc(), F.col("key").asc_nulls_last()], "place")
    return numbered.select(F.col("key").alias("doc_id"), "n_features", "weight", "score", F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))
