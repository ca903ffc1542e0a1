"""Lexical retrieval packing: a sharded BM25 index finds unused neighbours for each seed, which fill its window.

Documents are tokenized once into the shared folder. Document frequencies and the mean length cover all of them. A shuffle
then orders all documents by the rarest terms of their fragments that others share, so that those with a rare term in common
are neighbours wherever they were read from; equal routes are split by size. A shard is a run of that order of bounded size
within a partition; it holds an inverted index of its fragments with BM25 weights, and all terms of a seed are scored. Neighbours
routed by other terms into another shard are not found; README has the measured recall. A document of a window or more is cut into whole windows first. What is left of it is a fragment: the next
unused fragment seeds a window, its best-scoring unused neighbours are appended, and the last one is cut where the
window ends; its rest seeds the next window. The open window at the end of a shard is cut into powers of two, so no
sequence needs padding.

Edge cases: missing and empty texts have the end token only; repeated rows are packed each; equal scores go to the
earlier fragment; fragments without a scoring neighbour continue with the next one in order; an empty table gives no pieces; other
columns are ignored. Memory is bounded by a shard and the longest text. Rows are in a total order within a task, so a repeated
task packs the same way; a second run may cut the order elsewhere.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lakewright.llm.common import batches, small_batches
from lakewright.session import new_path

WINDOW = 2048
END = 1
BATCH_BYTES = 4 << 20
SHARD_TOKENS = 4 << 20
ROUTE_TERMS = 8
COMMON = 8  # terms in at least one of so many fragments of a shard have a weight for each fragment
MATRIX_BYTES = 1 << 27  # scores by common terms are multiplied at once for all fragments of a shard where they take no more
K1, B = 1.2, 0.75

# Fixed value: how this kind of byte-level vocabulary splits a text before merging, but for runs of white space. These are taken
# out before, so the pattern needs no look-ahead and takes time in proportion to the text.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"""


def byte_of_char() -> dict[str, int]:
    """The letters a byte-level vocabulary file writes bytes with: printable Latin-1 as itself, others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


# Fixed value: white space as the split pattern understands it.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Encoder:
    """Ids of texts by the vocabulary of a ``tokenizers`` file of byte-level BPE.

    Ids below the special ones are merge ranks in such a file, so ``tiktoken`` merges in the same order, several times faster.
    Special tokens that a text spells out have their own ids, as they have there by default.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        special, of = {t["content"] for t in content["added_tokens"]}, byte_of_char()
        ranks = {bytes(of[c] for c in token): n for token, n in content["model"]["vocab"].items() if token not in special}
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.model = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.run = re.compile(f"[{BLANKS}]{{2,}}")
        self.blank = np.array([bool(re.match(f"[{BLANKS}]", chr(c))) for c in range(0x3002)])

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return [self._ids(t) for t in texts]

    def _ids(self, text: str) -> np.ndarray:
        if not any(s in text for s in self.special):
            return self._plain(text)
        parts, at = [], 0
        for mark in self.marks.finditer(text):
            parts += [self._plain(text[at : mark.start()]), np.array([self.special[mark[0]]], np.uint32)]
            at = mark.end()
        return np.concatenate([*parts, self._plain(text[at:])])

    def _plain(self, text: str) -> np.ndarray:
        """Without special tokens. A run of white space is one piece, but for its last character before other text."""
        ids, at = array("I"), 0
        if text.isascii():  # a byte a character
            blank = self.blank[np.frombuffer(text.encode(), np.uint8)]
        else:
            blank = self.blank[np.minimum(np.frombuffer(text.encode("utf-32-le"), "<u4"), 0x3001)]
        # Most texts have no run of two.
        for run in self.run.finditer(text) if (blank[1:] & blank[:-1]).any() else ():
            end = run.end() if run.end() == len(text) else run.end() - 1
            ids.extend(self.model.encode_ordinary(text[at : run.start()]))
            ids.extend(self.model._encode_single_piece(text[run.start() : end].encode()))
            at = end
        ids.extend(self.model.encode_ordinary(text[at:]))
        return np.frombuffer(ids, np.uint32)


def tokenize(spark: SparkSession, documents: DataFrame, tokenizer: str, vocabulary: int, key: str = "doc_id", text: str = "text", end: int = END) -> DataFrame:
    """Written and read back: ``doc_id``, ``n``, ``ids`` (little-endian, the end token last) per document.

    Each task adds one row with ``n`` missing and the document frequencies of its tokens in ``ids``.
    """
    key_field = documents.select(key).schema[0].dataType
    kind, key_type = key_field.simpleString(), to_arrow_type(key_field)
    width = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def encode(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, frequency, place = Encoder(tokenizer), np.zeros(vocabulary, np.int64), np.zeros(vocabulary, np.int32)
        for batch in batches(frames, BATCH_BYTES):
            out = [np.append(ids, np.uint32(end)) for ids in encoder([x or "" for x in batch.column(1).to_pylist()])]
            for ids in out:
                frequency[each_once(ids, place)] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in out], pa.int64()), pa.array([x.astype(width).tobytes() for x in out], pa.binary())], ["doc_id", "n", "ids"]
            )
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, key_type), pa.nulls(1, pa.int64()), pa.array([frequency.astype("<i8").tobytes()], pa.binary())], ["doc_id", "n", "ids"]
        )

    path = new_path(spark, "tokens")
    rows = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(encode, f"doc_id {kind}, n bigint, ids binary")
    with small_batches(spark):
        rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def document_frequencies(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """How many documents hold each token; the driver gets at most one number per token of the vocabulary."""

    def spread(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in frames:
            for blob in batch.column(0):
                total += np.frombuffer(blob.as_py(), "<i8")
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["token", "df"])

    rows = tokens.filter("n IS NULL").select("ids").mapInArrow(spread, "token int, df bigint").groupBy("token").agg(F.sum("df").alias("df")).toPandas()
    out = np.zeros(vocabulary, np.int64)
    out[rows["token"].to_numpy(np.int64)] = rows["df"].to_numpy(np.int64)
    return out


def distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids in order, each once, and where each begins in the sorted ids. Numbers of four bytes sort fastest."""
    ids = np.sort(ids.astype(np.uint32))
    first = np.flatnonzero(np.append(np.ones(min(len(ids), 1), bool), ids[1:] != ids[:-1]))
    return ids[first], first


def each_once(ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The ids, each once, in any order; ``place``, a number for each id of the vocabulary, is written over. Nothing is sorted."""
    at = np.arange(len(ids), dtype=place.dtype)
    place[ids] = at
    return ids[place[ids] == at]


def rarity(frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The terms from the rarest on, the place of each among them, and how many of the first no two documents share."""
    order = np.lexsort((np.arange(len(frequency)), frequency))
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order))
    return order, place, int((frequency <= 1).sum())


def route(ids: np.ndarray, order: np.ndarray, place: np.ndarray, alone: int) -> bytes:
    """Sort key of a fragment: its rarest terms that other documents hold too, rarest first."""
    found = place[ids]
    found = found[found >= alone]
    # The first terms are sought among the first places, if these have enough.
    few = 8 * ROUTE_TERMS
    first = distinct(np.partition(found, few)[:few])[0] if len(found) > few else found
    if len(first) < ROUTE_TERMS or len(found) <= few:
        first = distinct(found)[0]
    return order[first[:ROUTE_TERMS]].astype(">u4").tobytes()


def routed(documents: DataFrame, frequency: np.ndarray, width: str, window: int) -> DataFrame:
    """``doc_id`` and ``ids`` of all documents, those with the same rarest terms next to each other."""
    shared = documents.sparkSession.sparkContext.broadcast(rarity(frequency))

    def add(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in frames:
            own = [np.frombuffer(blob.as_py(), width) for blob in batch.column(1)]
            routes = [route(ids[len(ids) // window * window :], *shared.value) for ids in own]
            numbers = pa.array(range(row, row + len(own)), pa.int64())
            row += len(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(routes, pa.binary()), numbers], ["doc_id", "ids", "route", "row"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", "ids").mapInArrow(add, f"doc_id {kind}, ids binary, route binary, row bigint")
    return rows.repartitionByRange("route", "row").sortWithinPartitions("route", "row").select("doc_id", "ids")


class Shard:
    """Fragments of a shard with their inverted index; ``take`` gives the best unused neighbour of the seed."""

    def __init__(self, fragments: list[np.ndarray], idf: np.ndarray, mean: float):
        terms, owners, counts = [], [], []
        for number, ids in enumerate(fragments):
            term, first = distinct(ids)
            terms.append(term)
            owners.append(np.full(len(term), number, np.int32))
            counts.append(np.diff(first, append=len(ids)))
        self.own = terms
        term, owner, count = np.concatenate(terms), np.concatenate(owners), np.concatenate(counts).astype(np.float32)
        size = np.array([len(f) for f in fragments], np.float32)[owner]
        weight = idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * size / mean))
        # Two-byte numbers sort fastest where the order of equal ones is kept.
        order = np.argsort(term.astype(np.uint16) if len(idf) <= 1 << 16 else term, kind="stable")
        self.owner, self.weight = owner[order], weight[order].astype(np.float32)
        self.first = np.searchsorted(term[order], np.arange(len(idf) + 1))
        self.unused, self.next = np.ones(len(fragments), bool), 0
        # Terms that many fragments hold: a row of weights each, at most 4 * COMMON bytes a posting in all.
        common = np.flatnonzero(COMMON * np.diff(self.first) >= len(fragments))
        self.row, self.dense = dict(zip(common.tolist(), range(len(common)))), np.zeros((len(common), len(fragments)), np.float32)
        for n, t in enumerate(common):
            a, b = self.first[t], self.first[t + 1]
            self.dense[n, self.owner[a:b]] = self.weight[a:b]
        # A weight is more than nothing, so it tells which fragments hold the term.
        small = 4 * len(fragments) ** 2 <= MATRIX_BYTES
        self.base = (self.dense > 0).astype(np.float32).T @ self.dense if small else None

    def seed(self) -> int | None:
        while self.next < len(self.unused) and not self.unused[self.next]:
            self.next += 1
        return self.next if self.next < len(self.unused) else None

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of all fragments for the seed's terms; used ones score less than nothing."""
        terms, n = self.own[seed], len(self.unused)
        start, count = self.first[terms], self.first[terms + 1] - self.first[terms]
        rare = COMMON * count < n
        if self.base is not None:
            total = self.base[seed].copy()
        else:
            total = np.zeros(n, np.float32)
            for t in terms[~rare].tolist():
                total += self.dense[self.row[t]]
        # All postings of the rare terms at once.
        start, count = start[rare], count[rare]
        at = np.arange(count.sum()) + np.repeat(start - np.cumsum(count) + count, count)
        total += np.bincount(self.owner[at], self.weight[at], n).astype(np.float32)
        return np.where(self.unused, total, -1)


def pack_shard(documents: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences as lists of pieces: document number, start, length."""
    rest = []
    for number, ids in enumerate(documents):
        whole = len(ids) // window * window
        for start in range(0, whole, window):
            yield [(number, start, window)]
        if whole < len(ids):
            rest.append((number, whole))
    if not rest:
        return
    shard = Shard([documents[d][start:] for d, start in rest], idf, mean)
    taken = [0] * len(rest)  # ids of a fragment that are packed already
    seed = shard.seed()
    while seed is not None:
        filled, scores, now, pieces = 0, None, seed, []
        while now is not None:
            shard.unused[now] = False
            number, start = rest[now]
            begin = start + taken[now]
            length = min(len(documents[number]) - begin, window - filled)
            pieces.append((number, begin, length))
            filled += length
            taken[now] += length
            if filled == window:
                break
            scores = shard.scores(seed) if scores is None else scores
            scores[now] = -1
            best = int(scores.argmax())
            now = best if scores[best] > 0 else shard.seed()
        if filled == window:
            yield pieces
            number, start = rest[now]
            seed = now if start + taken[now] < len(documents[number]) else shard.seed()
        else:
            yield from cut_to_powers(pieces, filled)
            seed = None


def cut_to_powers(pieces: list[tuple[int, int, int]], total: int) -> Iterator[list[tuple[int, int, int]]]:
    """The pieces in order as sequences whose lengths are the powers of two that make up the total, largest first."""
    left = list(reversed(pieces))
    for bit in range(total.bit_length() - 1, -1, -1):
        room, out = total & 1 << bit, []
        while room:
            number, start, length = left.pop()
            here = min(room, length)
            out.append((number, start, here))
            if here < length:
                left.append((number, start + here, length - here))
            room -= here
        if out:
            yield out


def pack(tokens: DataFrame, vocabulary: int, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """``doc_id``, ``start``, ``length``, ``ids`` (little-endian, four bytes each), ``doc_tokens``, ``sequence_id``, ``offset`` per piece."""
    spark = tokens.sparkSession
    frequency = document_frequencies(tokens, vocabulary)
    documents = tokens.filter("n IS NOT NULL")
    total = documents.agg(F.count(F.lit(1)).alias("docs"), F.avg(F.least(F.col("n"), F.lit(window))).alias("mean")).first()
    idf = np.log1p((total.docs - frequency + 0.5) / (frequency + 0.5)).astype(np.float32)
    mean = total.mean or 1.0
    shared = spark.sparkContext.broadcast(idf)
    width = "<u2" if vocabulary <= 1 << 16 else "<u4"
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 32
        held_keys, held, size = [], [], 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            keys = pa.concat_arrays(held_keys)
            rows: list[tuple] = []
            for pieces in pack_shard(held, shared.value, mean, window):
                offset = 0
                for number, start, length in pieces:
                    rows.append((number, start, length, held[number][start : start + length].astype("<u4").tobytes(), len(held[number]), sequence, offset))
                    offset += length
                sequence += 1
                if len(rows) >= 2000:
                    yield to_batch(keys, rows)
                    rows = []
            if rows:
                yield to_batch(keys, rows)

        def to_batch(keys: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
            number, *columns = zip(*rows)
            types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([keys.take(pa.array(number)), *[pa.array(c, t) for c, t in zip(columns, types)]], names)

        for batch in frames:
            for i, blob in enumerate(batch.column(1)):
                held_keys.append(batch.column(0).slice(i, 1))
                held.append(np.frombuffer(blob.as_py(), width))
                size += len(held[-1])
                if size >= shard_tokens:
                    yield from close()
                    held_keys, held, size = [], [], 0
        if held:
            yield from close()

    kind = documents.schema["doc_id"].dataType.simpleString()
    return routed(documents, frequency, width, window).mapInArrow(
        run, f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    )


def pack_documents(spark: SparkSession, documents: DataFrame, tokenizer: str, vocabulary: int, key: str = "doc_id", text: str = "text", end: int = END) -> DataFrame:
    """Tokenize and pack; see ``pack`` for the result."""
    return pack(tokenize(spark, documents, tokenizer, vocabulary, key, text, end), vocabulary)
