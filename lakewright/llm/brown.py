"""Class-based n-gram scoring in the manner of Brown: exchange clustering, class transitions and word emissions.

Words are counted over the whole training set. Every word that occurs ``floor`` times or more is clustered by exchange: Spark
counts the pairs of neighbouring words once, and in each turn joins them with the classes, sums the neighbours of each word
by class, and moves every word of the turn's half to the class that raises the class bigram likelihood most, all
against the same class counts. Turns go on until a word of text gains less than ``gain`` by two of them, at most ``turns``; classes are
kept as they were at the greatest likelihood. The vocabulary grows with the input and stays a table; the driver holds counts of class pairs
only. Where the vocabulary is small enough to be held (``held`` units, counted first), tasks get its classes and each word's
neighbours are gathered once, so that turns shuffle nothing; the result is the same. Rarer words, also one never seen, belong to the class of their last two bytes, so each word has exactly one class.
A text's probability is the product of the class transitions, smoothed by the class shares, and the emissions of the words
from their classes, with 0.5 added to each count and to one unknown word per class.

The clustered unit is a word's 64-bit hash modulo some 2 ** 31, so that a pair is one number; words of one unit share a
class and keep counts of their own. Beyond ``held`` units a bitmap of 32 bits for each word above the floor, at most 2 ** 28 in all,
tells tasks which words to keep apart. It lets some rarer words pass, about 3 % up to eight million words; these keep the class of their ending.

Class and count of up to ``known`` most frequent words are broadcast, a bounded number of words of bounded length; those of all
others are joined by word. Which words these are changes no result.

Edge cases: a missing or empty text is one end token; without training rows every probability is 1 but for the classes,
which are equally likely; words are bytes, so any text has some; repeated rows count and are scored
each; an empty table gives an empty result; other columns pass through only where asked for.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.llm.common import batches, bytes_of_text, staged
from lakewright.session import drop_folder, new_path

END = b""  # no word is empty
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
BATCH_BYTES = 4 << 20
FLUSH = 1 << 20
CODES = 2**31 - 1  # codes of units and of classes that stay are below
BLOCK_BITS = 17  # the bitmap is built in blocks of so many bits
BITS = 28


@dataclass(frozen=True)
class Settings:
    """Least count and classes of clustered words, classes by ending, bounds of the turns, units held in tasks, words broadcast, and the smoothing weight."""

    floor: int = 20
    classes: int = 128
    endings: int = 128
    turns: int = 10
    gain: float = 0.01
    held: int = 1 << 20
    known: int = 200_000
    longest: int = 64
    weight: float = 20.0

    @property
    def end(self) -> int:
        """The class of the end token, after all others."""
        return self.classes + self.endings

    @property
    def first_unit(self) -> int:
        """Codes below are the classes that stay, counted from the first of them."""
        return self.endings + 1


@dataclass(frozen=True)
class Model:
    """Known words with class and count; logs of transitions ``[before, class]`` and of class totals."""

    words: dict[bytes, int]
    word_class: np.ndarray
    word_count: np.ndarray
    transition: np.ndarray
    class_total: np.ndarray
    tokens: int
    vocabulary: int
    settings: Settings


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def ending(word: bytes, settings: Settings) -> int:
    return settings.classes + zlib.crc32(word[-2:]) % settings.endings


def unit_of(word: bytes, settings: Settings) -> int:
    value = xxhash.xxh64_intdigest(word, 42)
    return settings.first_unit + (value - (value >> 63 << 64)) % (CODES - settings.first_unit)


def unit_column(settings: Settings) -> Column:
    """``unit_of`` as an expression on ``word``."""
    return (F.pmod(F.xxhash64("word"), F.lit(CODES - settings.first_unit)) + settings.first_unit).cast("int")


def ending_column(classes: int) -> Column:
    return (F.crc32(F.expr("substring(word, -2, 2)")) % classes).cast("int")


def count_words(documents: DataFrame, text: str = "text") -> DataFrame:
    """``word`` and ``n`` over all rows, the end tokens included; tasks count before the shuffle."""

    def count(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches(frames, BATCH_BYTES):
            for content in bytes_of_text(batch.column(0)):
                held.update(words_of(content))
            held[END] += batch.num_rows
            if len(held) > FLUSH:
                yield flush()
        if held:
            yield flush()

    rows = documents.select(F.col(text).alias("text")).mapInArrow(count, "word binary, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_units(counts: DataFrame, settings: Settings) -> np.ndarray:
    """The bitmap of the units of the words at or above the floor; its size goes by their number."""
    units = counts.filter((F.col("n") >= settings.floor) & (F.octet_length("word") > 0)).select(unit_column(settings).alias("unit"))
    bits = min(BITS, max(BLOCK_BITS, (32 * units.count()).bit_length()))

    def fill(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        block = np.zeros(1 << BLOCK_BITS, np.uint8)
        block[frame["place"].to_numpy() & ((1 << BLOCK_BITS) - 1)] = 1
        return pd.DataFrame({"block": [key[0]], "bits": [np.packbits(block, bitorder="little").tobytes()]})

    places = units.select(F.col("unit").bitwiseAND((1 << bits) - 1).alias("place")).distinct()
    out = np.zeros((1 << (bits - BLOCK_BITS), 1 << (BLOCK_BITS - 3)), np.uint8)
    for block, content in places.withColumn("block", F.shiftright("place", BLOCK_BITS)).groupBy("block").applyInPandas(fill, "block int, bits binary").collect():
        out[block] = np.frombuffer(content, np.uint8)
    return out.ravel()


class Codes(dict):
    """Codes of words, found as they are asked for: a place in ``units`` or the unit that the bitmap has, else the class of the ending."""

    def __init__(self, units: np.ndarray | None, bitmap: np.ndarray | None, settings: Settings):
        super().__init__()
        self.units, self.bitmap, self.settings = units, bitmap, settings

    def __missing__(self, word: bytes) -> int:
        self.learn([word])
        return self[word]

    def learn(self, words: Iterable[bytes]) -> None:
        """Finds the codes of many words at once."""
        new, s = [w for w in set(words) if w not in self], self.settings
        value = np.fromiter(map(xxhash.xxh64_intdigest, new, repeat(42)), np.uint64, len(new)).view(np.int64)
        unit = s.first_unit + value % (CODES - s.first_unit)
        code = np.fromiter((zlib.crc32(w[-2:]) for w in new), np.int64, len(new)) % s.endings
        if self.units is None:
            place = unit & (8 * len(self.bitmap) - 1)
            code = np.where(self.bitmap[place >> 3] >> (place & 7).astype(np.uint8) & 1, unit, code)
        elif len(self.units):
            place = np.searchsorted(self.units, unit)
            code = np.where(self.units[np.minimum(place, len(self.units) - 1)] == unit, s.first_unit + place, code)
        self.update(zip(new, code.tolist()))


def local_pairs(frames: Iterable[pa.RecordBatch], codes: Codes, settings: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Neighbouring codes ``a << 31 | b`` in order, and how often. The end of another text comes before the first word."""
    held, total = [], 0

    def flush() -> tuple[np.ndarray, np.ndarray]:
        # Sorted where they are: the parts and the copies of np.unique would take five times the room.
        pair = np.concatenate(held)
        held.clear()
        pair.sort()
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        n = np.diff(first, append=len(pair))
        return pair[first], n

    for batch in batches(frames, BATCH_BYTES):
        texts = [words_of(content) for content in bytes_of_text(batch.column(0))]
        codes.learn(chain.from_iterable(texts))
        for words in texts:
            own = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
            held.append(np.append(settings.endings, own) << 31 | np.append(own, settings.endings))
            total += len(own) + 1
            if total > 8 * FLUSH:
                yield flush()
                total = 0
        if len(codes) > FLUSH:
            codes.clear()
    if held:
        yield flush()


def count_pairs(documents: DataFrame, bitmap: np.ndarray, settings: Settings, text: str = "text") -> DataFrame:
    """``a``, ``b``, ``n``: counts of neighbouring codes, those of ``bitmap``."""
    shared = documents.sparkSession.sparkContext.broadcast(bitmap)

    def count(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair, n in local_pairs(frames, Codes(None, shared.value, settings), settings):
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])

    rows = documents.select(F.col(text).alias("text")).mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    return rows.select(F.shiftright("pair", 31).cast("int").alias("a"), F.col("pair").bitwiseAND(2**31 - 1).cast("int").alias("b"), "n")


def neighbours(documents: DataFrame, units: np.ndarray, tokens: int, settings: Settings, text: str = "text") -> DataFrame:
    """Per code ``word`` the codes beside it and how often: positive after it, negative before it. At most two for each held unit.

    A task sends its counts in blocks of words, as numbers of four bytes: a row for each pair would take twice the room. There
    is a block for each million of ``tokens``, with as many pairs at most on either side; the last bits of a code tell it.
    """
    shared = documents.sparkSession.sparkContext.broadcast(units)
    blocks = 1 << min(15, max(5, (tokens // FLUSH).bit_length()))

    def send(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair, n in local_pairs(frames, Codes(shared.value, None, settings), settings):
            codes = [(pair >> 31).astype("<u4"), (pair & (2**31 - 1)).astype("<u4")]
            n, pair = n.astype("<u4"), None
            for side in range(2):
                # Two-byte numbers sort fastest where the order of equal ones is kept.
                block = (codes[side] & np.uint32(blocks - 1)).astype(np.uint16)
                order = np.argsort(block, kind="stable")
                block = block[order]
                first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
                # The other code and the side, the word before them.
                columns = (codes[side][order], codes[1 - side][order] << np.uint32(1) | np.uint32(side), n[order])
                parts = [pa.array([x.tobytes() for x in np.split(c, first[1:])], pa.binary()) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array(block[first].astype(np.int32)), *parts], ["block", "word", "other", "n"])

    def merge(frame: pa.Table) -> pa.Table:
        word, other, n = (np.frombuffer(b"".join(frame.column(c).to_pylist()), "<u4").astype(np.int64) for c in ("word", "other", "n"))
        key = word << 32 | other
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        key, n = key[first], np.add.reduceat(n[order], first)
        word, other = key >> 32, key & (2**32 - 1)
        start = np.flatnonzero(np.diff(word, prepend=-1))
        offsets = pa.array(np.append(start, len(word)).astype(np.int32))
        others, counts = pa.array((other >> 1).astype(np.int32)), pa.array(np.where(other & 1, -n, n))
        return pa.table({"word": pa.array(word[start].astype(np.int32)), "other": pa.ListArray.from_arrays(offsets, others), "n": pa.ListArray.from_arrays(offsets, counts)})

    rows = documents.select(F.col(text).alias("text")).mapInArrow(send, "block int, word binary, other binary, n binary")
    return rows.groupBy("block").applyInArrow(merge, "word int, other array<int>, n array<bigint>")


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def best_classes(own: np.ndarray, after: np.ndarray, before: np.ndarray, itself: np.ndarray, pairs: np.ndarray, classes: int) -> np.ndarray:
    """Per word the class, among the first ``classes``, that gives the largest class bigram likelihood if it alone moves.

    ``after`` and ``before`` have a row of counts by class for each word, itself included under its own class. The
    gain of a class is a sum over the classes next to the word; those of the own class and of the tried one are added apart.
    """
    k, i = np.arange(classes), np.arange(len(own))
    gain = np.zeros((len(own), classes))
    s_own, p_own = after[i, own] - itself, before[i, own] - itself

    def add(counts: np.ndarray, table: np.ndarray) -> None:
        """Terms of ``table[class, neighbour]`` for neighbours that are neither the own class nor the tried one."""
        # A row per neighbour, so that taking those of a word reads whole rows.
        table = np.ascontiguousarray(table[:classes].T)
        log = xlogx(table)
        word, other = np.nonzero(counts)
        keep = other != own[word]
        word, other = word[keep], other[keep]
        if not len(word):
            return
        n, mine = counts[word, other], own[word]
        rows, base = table[other], log[other]
        change = xlogx(rows + n[:, None]) - base
        at = np.arange(len(word))
        # The own class is tried after the word has left it.
        change[at, mine] = base[at, mine] - xlogx(rows[at, mine] - n)
        inner = other < classes
        change[at[inner], other[inner]] = 0
        first = np.flatnonzero(np.diff(word, prepend=-1))
        gain[word[first]] += np.add.reduceat(change, first)

    add(after, pairs)
    add(before, pairs.T)
    # The tried class next to itself, and next to the own class without the word.
    diagonal = pairs[k, k]
    tried = xlogx(diagonal + after[:, :classes] + before[:, :classes] + itself[:, None]) - xlogx(diagonal)
    down, across = pairs[:classes, own].T - before[:, :classes], pairs[own, :classes] - after[:, :classes]
    tried += xlogx(down + s_own[:, None]) - xlogx(down) + xlogx(across + p_own[:, None]) - xlogx(across)
    whole = pairs[own, own]
    tried[i, own] = xlogx(whole) - xlogx(whole - after[i, own] - before[i, own] + itself)
    gain += tried
    for table, n in ((pairs.sum(1)[:classes], after.sum(1)), (pairs.sum(0)[:classes], before.sum(1))):
        left = np.repeat(table[None], len(own), 0)
        left[i, own] -= n
        gain -= xlogx(left + n[:, None]) - xlogx(left)
    best = gain.argmax(1)
    return np.where(gain[i, best] > gain[i, own] + 1e-9, best, own)


def likelihood(pairs: np.ndarray) -> float:
    """The part of the class bigram log likelihood that depends on the classes."""
    return float(xlogx(pairs).sum() - xlogx(pairs.sum(0)).sum() - xlogx(pairs.sum(1)).sum())


def with_start(main: DataFrame, settings: Settings) -> DataFrame:
    """``unit`` and ``class``: the most frequent words a class each, others by their ending. Rarer ones than the floor have the class they keep."""
    first = main.orderBy(F.desc("n"), "unit").limit(settings.classes).select("unit").collect()
    alone = main.sparkSession.createDataFrame([(r.unit, i) for i, r in enumerate(first)], "unit int, alone int")
    start = F.coalesce("alone", ending_column(settings.classes))
    kept = ending_column(settings.endings) + settings.classes
    return main.join(F.broadcast(alone), "unit", "left").select("unit", F.when(F.col("n") < settings.floor, kept).otherwise(start).cast("int").alias("class"))


def main_words(words: DataFrame) -> DataFrame:
    """The most frequent word of each unit."""
    return words.groupBy("unit").agg(F.max(F.struct("n", "word")).alias("top")).select("unit", "top.*")


def exchange_held(sides: DataFrame, units: np.ndarray, start: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """``exchange`` where the classes of all units fit into every task. ``sides`` is read twice a turn, without a shuffle of words."""
    spark, total, first = sides.sparkSession, settings.end + 1, settings.first_unit

    def parts(batch: pa.RecordBatch, of: np.ndarray) -> tuple[np.ndarray, ...]:
        word = batch.column(0).to_numpy()
        at = np.repeat(np.arange(len(word)), np.diff(batch.column(1).offsets.to_numpy()))
        other = batch.column(1).flatten().to_numpy()
        return word, at, other, of[other], batch.column(2).flatten().to_numpy()

    def class_pairs(of: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(of)

        def add(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(total * total)
            for batch in (frame.slice(i, 256) for frame in frames for i in range(0, frame.num_rows, 256)):
                word, at, _, cls, n = parts(batch, shared.value)
                follows = n > 0
                sums += np.bincount(shared.value[word[at[follows]]] * total + cls[follows], n[follows], total * total)
            held = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums[held].astype(np.int64))], ["code", "n"])

        rows = sides.mapInArrow(add, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
        out = np.zeros(total * total)
        out[rows["code"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
        return out.reshape(total, total)

    def moved(of: np.ndarray, table: np.ndarray, half: int) -> np.ndarray:
        shared = spark.sparkContext.broadcast((of, table, np.append(np.full(first, 1 - half), units % 2) == half))

        def move(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of, table, turns = shared.value
            for frame in frames:
                mine = frame.filter(pa.array(turns[frame.column(0).to_numpy()]))
                for batch in (mine.slice(i, 64) for i in range(0, mine.num_rows, 64)):
                    word, at, other, cls, n = parts(batch, of)
                    cell = ((n < 0) * len(word) + at) * total + cls
                    sums = np.bincount(cell, np.abs(n), 2 * len(word) * total).reshape(2, len(word), total)
                    itself = np.bincount(at, np.where((n > 0) & (other == word[at]), n, 0), len(word))
                    best = best_classes(of[word], *sums, itself, table, settings.classes)
                    change = best != of[word]
                    yield pa.RecordBatch.from_arrays([pa.array(word[change]), pa.array(best[change].astype(np.int32))], ["word", "class"])

        rows = sides.filter(F.col("word") >= first).mapInArrow(move, "word int, class int").toPandas()
        out = of.copy()
        out[rows["word"].to_numpy(np.int64)] = rows["class"].to_numpy(np.int64)
        return out

    of = np.concatenate([settings.classes + np.arange(first), start]).astype(np.int64)
    table = class_pairs(of)
    seen = [likelihood(table)]
    for turn in range(settings.turns):
        # Half of the words move at a time, so that two words seldom chase each other.
        new = moved(of, table, turn % 2)
        new_table = class_pairs(new)
        seen.append(likelihood(new_table))
        if seen[-1] < seen[-2]:
            break
        of, table = new, new_table
        if turn % 2 and seen[-1] - seen[-3] < settings.gain * table.sum():
            break
    return of[first:], table


def exchange(pairs: DataFrame, start: DataFrame, settings: Settings) -> tuple[DataFrame, np.ndarray]:
    """Classes of all units (``unit``, ``class``) and the counts of class pairs. ``pairs`` is read twice a turn."""
    spark, total = pairs.sparkSession, settings.end + 1
    stay = spark.range(settings.first_unit).select(F.col("id").cast("int").alias("unit"), (F.col("id") + settings.classes).cast("int").alias("class"))

    def with_classes(of: DataFrame) -> DataFrame:
        both = of.unionByName(stay)
        left, right = both.select(F.col("unit").alias("a"), F.col("class").alias("ca")), both.select(F.col("unit").alias("b"), F.col("class").alias("cb"))
        return pairs.join(left, "a").join(right, "b")

    def class_pairs(of: DataFrame) -> np.ndarray:
        out = np.zeros((total, total))
        for r in with_classes(of).groupBy("ca", "cb").agg(F.sum("n").alias("n")).collect():
            out[r.ca, r.cb] = r.n
        return out

    def moved(of: DataFrame, table: np.ndarray, half: int) -> DataFrame:
        rows, none = with_classes(of), F.lit(0).cast("bigint")
        mine = lambda c: (F.col(c) >= settings.first_unit) & (F.col(c) % 2 == half) & (F.col(f"c{c}") < settings.classes)
        follows = rows.filter(mine("a")).select(F.col("a").alias("unit"), F.col("ca").alias("own"), F.col("cb").alias("other"), F.col("n").alias("after"), none.alias("before"), F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0).alias("itself"))
        leads = rows.filter(mine("b")).select(F.col("b").alias("unit"), F.col("cb").alias("own"), F.col("ca").alias("other"), none.alias("after"), F.col("n").alias("before"), none.alias("itself"))
        # At most as many rows a word as there are classes, summed before each shuffle.
        sums = follows.unionByName(leads).groupBy("unit", "own", "other").agg(*[F.sum(c).alias(c) for c in ("after", "before", "itself")])
        words = sums.groupBy("unit", "own").agg(F.sum("itself").alias("itself"), *[F.collect_list(c).alias(c) for c in ("other", "after", "before")])
        shared = spark.sparkContext.broadcast(table)

        def move(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for frame in frames:
                for batch in (frame.slice(i, 64) for i in range(0, frame.num_rows, 64)):
                    unit, own, itself, other, follow, lead = batch.columns
                    own = own.to_numpy().astype(np.int64)
                    after, before = np.zeros((2, len(own), total))
                    word = np.repeat(np.arange(len(own)), np.diff(other.offsets.to_numpy()))
                    place = other.flatten().to_numpy()
                    after[word, place], before[word, place] = follow.flatten().to_numpy(), lead.flatten().to_numpy()
                    best = best_classes(own, after, before, itself.to_numpy().astype(float), shared.value, settings.classes)
                    yield pa.RecordBatch.from_arrays([unit, pa.array(best.astype(np.int32))], ["unit", "class"])

        return words.mapInArrow(move, "unit int, class int").unionByName(of.filter((F.col("unit") % 2 != half) | (F.col("class") >= settings.classes)))

    def written(df: DataFrame) -> tuple[str, DataFrame]:
        path = new_path(spark, "classes")
        df.write.parquet(path)
        return path, spark.read.schema("unit int, class int").parquet(path)

    path, of = written(start)
    table = class_pairs(of)
    seen = [likelihood(table)]
    for turn in range(settings.turns):
        # Half of the words move at a time, so that two words seldom chase each other.
        new_folder, new = written(moved(of, table, turn % 2))
        new_table = class_pairs(new)
        seen.append(likelihood(new_table))
        if seen[-1] < seen[-2]:
            drop_folder(spark, new_folder)
            break
        drop_folder(spark, path)
        path, of, table = new_folder, new, new_table
        if turn % 2 and seen[-1] - seen[-3] < settings.gain * table.sum():
            break
    return of, table


def most_frequent(counts: DataFrame, most: int) -> list:
    """The words from some frequency on, at most ``most``: only they reach the driver. None where more than that share the top step.

    The frequency comes from how many words have counts of each size, in steps of about 3 %.
    """
    step = F.floor(F.log2("n") * 24)
    sizes = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("step")).collect()
    least, total = None, 0
    for r in sizes:
        total += r.words
        if total > most:
            break
        least = r.step
    if least is None:
        return []
    return counts.filter(step >= least).collect()


def train(spark: SparkSession, documents: DataFrame, settings: Settings = Settings(), text: str = "text") -> tuple[Model, DataFrame]:
    """The model and the table of all words with count and class: ``word``, ``n``, ``class``."""
    folders = [new_path(spark, label) for label in ("word-counts", "word-pairs", "word-classes")]

    def kept(df: DataFrame, folder: str) -> DataFrame:
        df.write.parquet(folder)
        return spark.read.schema(df.schema).parquet(folder)

    counts = kept(count_words(documents, text), folders[0])
    size = counts.agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("tokens")).first()
    words = counts.filter(F.octet_length("word") > 0).withColumn("unit", unit_column(settings))
    often = main_words(words.filter(F.col("n") >= settings.floor))
    if often.limit(settings.held + 1).count() <= settings.held:
        start = with_start(often, settings).orderBy("unit").toPandas()
        units = start["unit"].to_numpy(np.int64)
        sides = kept(neighbours(documents, units, size.tokens or 0, settings, text), folders[1])
        classes, table = exchange_held(sides, units, start["class"].to_numpy(np.int64), settings)
        of = spark.createDataFrame(pd.DataFrame({"unit": units.astype(np.int32), "class": classes.astype(np.int32)}), "unit int, class int")
    else:
        pairs = kept(count_pairs(documents, frequent_units(counts, settings), settings, text), folders[1])
        # Every occurrence of a word is the first of a pair.
        units = pairs.filter(F.col("a") >= settings.first_unit).select(F.col("a").alias("unit")).distinct()
        of, table = exchange(pairs, with_start(main_words(words.join(units, "unit", "left_semi")), settings), settings)
    by_ending = ending_column(settings.endings) + settings.classes
    own = F.when(F.octet_length("word") == 0, settings.end).otherwise(F.coalesce("class", by_ending))
    classed = counts.withColumn("unit", unit_column(settings)).join(of, "unit", "left").select("word", "n", own.cast("int").alias("class"))
    classed = kept(classed, folders[2])
    drop_folder(spark, folders[0])
    drop_folder(spark, folders[1])

    shares = (table.sum(0) + 1) / (table.sum() + len(table))
    transition = np.log10((table + settings.weight * shares) / (table.sum(1, keepdims=True) + settings.weight))
    distinct = np.zeros(len(table))
    for r in classed.groupBy("class").agg(F.count(F.lit(1)).alias("v")).collect():
        distinct[r["class"]] = r.v
    class_total = np.log10(table.sum(0) + 0.5 * (distinct + 1))
    top = most_frequent(classed.filter((F.octet_length("word") <= settings.longest) & (F.octet_length("word") > 0)), settings.known)
    words = {bytes(r.word): i for i, r in enumerate(top)}
    of_word = np.array([r["class"] for r in top], np.int64)
    model = Model(words, of_word, np.array([r.n for r in top], np.int64), transition, class_total, size.tokens or 0, size.words, settings)
    return model, classed


def score(spark: SparkSession, documents: DataFrame, model: Model, counts: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row the key and kept columns, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, ``perplexity``.

    ``base_score`` is the unigram log10 probability, ``score`` that of the class model, ``perplexity`` per token by the latter.
    A first pass scores the broadcast words and tells the classes beside the others; a second one adds these.
    """
    end_count = counts.filter(F.octet_length("word") == 0).first()
    ends = end_count.n if end_count else 0
    shared = spark.sparkContext.broadcast(model)
    plain = documents.select(F.col(key).alias("doc_id"), *keep, F.col(text).alias("text"))
    carried = plain.drop("text")
    columns, end_log = carried.columns, float(np.log10(ends + 0.5))
    own_columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema)
    schema = own_columns + ", doc bigint, n bigint, known bigint, emitted double, moved double, rare array<binary>, at binary, left binary, right binary"

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, row = shared.value, TaskContext.get().partitionId() << 40
        s, get = m.settings, m.words.get
        logs, classes = np.append(np.log10(m.word_count + 0.5), 0.0), np.append(m.word_class, -1)
        for batch in batches(frames, BATCH_BYTES):
            out: list[list] = [[] for _ in range(8)]
            for content in bytes_of_text(batch.column(len(columns))):
                own = words_of(content)
                index = np.fromiter(map(get, own, repeat(-1)), np.int64, len(own))
                cls = np.append(classes[index], s.end)
                before = np.append(s.end, cls[:-1])
                both, held = (before >= 0) & (cls >= 0), cls[cls >= 0]
                other = np.flatnonzero(index < 0)
                rare: dict[bytes, int] = {}
                at = [rare.setdefault(own[i], len(rare)) for i in other.tolist()]
                moved = float(m.transition[before[both], cls[both]].sum() - m.class_total[held].sum())
                beside = [np.asarray(x, "<i4").tobytes() for x in (at, before[other], cls[other + 1])]
                values = (len(own) + 1, len(own) - len(other) + (ends > 0), float(logs[index].sum() + end_log), moved, list(rare), *beside)
                for column, value in zip(out, values):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.binary())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(range(row, row + n), pa.int64()), *[pa.array(x, k) for x, k in zip(out, kinds)]],
                [*columns, "doc", "n", "known", "emitted", "moved", "rare", "at", "left", "right"],
            )
            row += n

    rows = staged(spark, plain.mapInArrow(run, schema), "scored")
    s = model.settings
    by_ending = (ending_column(s.endings) + s.classes).cast("int")
    rare = rows.select("doc", F.posexplode("rare").alias("place", "word")).join(counts, "word", "left")
    found = rare.groupBy("doc").agg(F.collect_list(F.struct("place", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), F.coalesce("class", by_ending).alias("class"))).alias("found"))
    whole = rows.drop("rare").join(found, "doc", "left").select(*columns, "n", "known", "emitted", "moved", "at", "left", "right", "found")

    def add(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in frames:
            n = batch.num_rows
            times = pc.fill_null(pc.list_value_length(batch.column("found")), 0).to_numpy()
            begin, flat = np.cumsum(times) - times, batch.column("found").flatten()
            # The words of all rows in order of their places.
            place, count, cls = (flat.field(i).to_numpy() for i in range(3))
            order = np.empty(len(place), np.int64)
            order[np.repeat(begin, times) + place] = np.arange(len(place))
            # Their occurrences: word, class before (-1 after another of them), class after.
            row = np.repeat(np.arange(n), pc.binary_length(batch.column("at")).to_numpy() // 4)
            at, before, after = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<i4") for c in ("at", "left", "right"))
            own = order[begin[row] + at]
            count, cls = count[own], cls[own]
            before = np.where(before < 0, np.append(0, cls)[: len(cls)], before)
            last = after >= 0
            gain = m.transition[before, cls] - m.class_total[cls]
            gain[last] += m.transition[cls[last], after[last]]
            sums = (np.bincount(row, count > 0, n).astype(np.int64), np.bincount(row, np.log10(count + 0.5), n), np.bincount(row, gain, n))
            old = (batch.column(c).to_numpy() for c in ("known", "emitted", "moved"))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns) + 1], *[pa.array(x + y) for x, y in zip(old, sums)]], [*columns, "n", "known", "emitted", "moved"])

    scored = whole.mapInArrow(add, own_columns + ", n bigint, known bigint, emitted double, moved double")
    total = F.lit(float(np.log10(model.tokens + 0.5 * (model.vocabulary + 1))))
    return scored.select(
        *columns,
        F.col("n").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("emitted") - F.col("n") * total).alias("base_score"),
        (F.col("emitted") + F.col("moved")).alias("score"),
        F.pow(F.lit(10.0), -(F.col("emitted") + F.col("moved")) / F.col("n")).alias("perplexity"),
    )
