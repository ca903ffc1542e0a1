"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language and bucket inside the tasks, so that only sums are shuffled; the model is a matrix of
log probabilities with one row per bucket and one column per language, of a size fixed by two parameters, and is
broadcast. Scoring gathers the rows of a batch's n-grams and sums them per document in numpy, in chunks of bounded size.

Edge cases: a text that is missing or has no letter is ``und`` with score 0, as is every text when nothing could be
learned; rows without a language or text teach nothing; equal scores go to the alphabetically first language; repeated
rows are scored each; an empty table gives an empty result; other columns pass through, and columns named like the two
results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"
CHUNK = 1 << 19  # code points or n-grams handled at once


@dataclass(frozen=True)
class Settings:
    """``2 ** bits`` buckets, n-gram lengths, added count; more than ``max_languages`` learned values are an error."""

    bits: int = 15
    orders: tuple[int, ...] = (1, 2, 3)
    added: float = 0.5
    max_languages: int = 500


@dataclass(frozen=True)
class Model:
    """``log_prob[bucket, language]`` and the log share of each language, languages in alphabetical order."""

    languages: tuple[str, ...]
    log_prob: np.ndarray
    log_prior: np.ndarray
    settings: Settings


def _blocks(texts: list[str | None], reach: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Code points of many texts in blocks of about ``CHUNK``, each text lower-cased with a blank on either side.

    Yields code points, the text each belongs to, and whether an n-gram may start there. A long text continues in the next block, which
    repeats its last ``reach`` code points, so that every n-gram starts in exactly one block.
    """
    points, owner, starts, held = [], [], [], 0
    for number, text in enumerate(texts):
        if not text:
            continue
        codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        for begin in range(0, len(codes), CHUNK):
            piece = codes[begin : begin + CHUNK + reach]
            may = np.ones(len(piece), bool)
            if begin + CHUNK < len(codes):
                may[CHUNK:] = False
            points.append(piece)
            owner.append(np.full(len(piece), number, np.int64))
            starts.append(may)
            held += len(piece)
            if held >= CHUNK:
                yield np.concatenate(points), np.concatenate(owner), np.concatenate(starts)
                points, owner, starts, held = [], [], [], 0
    if points:
        yield np.concatenate(points), np.concatenate(owner), np.concatenate(starts)


def ngrams(texts: list[str | None], settings: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of arrays: the text's number, ascending, and the bucket of each of its n-grams."""
    shift = np.uint64(64 - settings.bits)
    for points, owner, may in _blocks(texts, max(settings.orders) - 1):
        codes = points.astype(np.uint64)
        for n in settings.orders:
            if len(codes) < n:
                continue
            size = len(codes) - n + 1
            value = np.full(size, n, np.uint64)
            for j in range(n):
                value = value * np.uint64(0x100000001B3) + codes[j : j + size]
            value ^= value >> np.uint64(29)
            bucket = (value * np.uint64(0x9E3779B97F4A7C15)) >> shift
            whole = may[:size] & (owner[:size] == owner[n - 1 :])
            yield owner[:size][whole], bucket[whole].astype(np.int64)


def train(documents: DataFrame, settings: Settings = Settings(), text: str = "text", lang: str = "lang") -> Model:
    """Learn from every row with a language and a text."""
    size = 1 << settings.bits

    def count(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, values in sums.items():
                held = np.flatnonzero(values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(held), pa.string()), pa.array(held.astype(np.int32) - 1), pa.array(values[held])], ["lang", "bucket", "n"]
                )
            sums.clear()

        for batch in frames:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for name in sorted(set(names)):
                own = [i for i, x in enumerate(names) if x == name]
                values = sums.setdefault(name, np.zeros(size + 1, np.int64))
                values[0] += len(own)  # bucket -1: the number of documents
                for _, bucket in ngrams(texts.take(pa.array(own)).to_pylist(), settings):
                    values[1:] += np.bincount(bucket, minlength=size)
            if len(sums) > 32:
                yield from flush()
        yield from flush()

    labelled = documents.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counted = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(count, "lang string, bucket int, n bigint")
    # The driver gets at most (buckets + 1) x languages sums; one language too many is enough to stop.
    rows = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).limit((size + 1) * (settings.max_languages + 1)).toPandas()
    languages = tuple(sorted(rows["lang"].unique()))
    if len(languages) > settings.max_languages:
        raise ValueError(f"more than {settings.max_languages} languages to learn")
    sums = np.zeros((size + 1, len(languages)))
    sums[rows["bucket"].to_numpy() + 1, np.searchsorted(np.array(languages, object), rows["lang"].to_numpy())] = rows["n"].to_numpy()
    seen = sums[1:] + settings.added
    with np.errstate(divide="ignore"):
        prior = np.log(sums[0] / max(sums[0].sum(), 1))
    return Model(languages, np.log(seen / seen.sum(axis=0)).astype(np.float32), prior, settings)


def score(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """Best language and its posterior probability for each text."""
    names, total = model.languages, np.tile(model.log_prior, (len(texts), 1))
    step = max(1, (CHUNK * 4) // max(1, len(names)))
    if names:
        for owner, bucket in ngrams(texts, model.settings):
            for begin in range(0, len(bucket), step):
                own, rows = owner[begin : begin + step], model.log_prob[bucket[begin : begin + step]]
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                total[own[first]] += np.add.reduceat(rows, first, axis=0, dtype=np.float64)
    known = np.array([bool(names) and x is not None and any(map(str.isalpha, x)) for x in texts], bool)
    best, share = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if known.any():
        logs = total[known] - total[known].max(axis=1, keepdims=True)
        share[known] = 1 / np.exp(logs).sum(axis=1)
        for i, k in zip(np.flatnonzero(known), logs.argmax(axis=1)):
            best[i] = names[k]
    return best, share


def predict(documents: DataFrame, model: Model, text: str = "text", result: str = "lang_pred", probability: str = "score") -> DataFrame:
    """The rows with two more columns: predicted language and posterior probability."""
    kept = documents.drop(result, probability)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = kept.columns.index(text)

    def apply(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            best, share = score(batch.column(at).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(share)], [*batch.schema.names, result, probability])

    schema = T.StructType([*kept.schema.fields, T.StructField(result, T.StringType()), T.StructField(probability, T.DoubleType())])
    return kept.mapInArrow(apply, schema)
