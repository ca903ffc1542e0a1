"""Suffix-array deduplication by prefix doubling, distributed by anchors.

Every string of 50 bytes has an anchor, the smallest hash of the 30-byte strings in it, which is the same wherever the string
occurs. So equal strings meet where Spark brings the strings of an anchor together: neighbouring strings of one anchor go as one
row, a unit, with the bytes they cover. A task ranks the bytes of its units by prefix doubling: a rank covers 8 bytes, the
ranks of a place and of the place 8 bytes on give that of 16 bytes, then 32, and the threshold of 50. Equal ranks mean equal strings, whatever the
hash of anything. A string is repeated if a document of smaller id has one of its rank.

An anchor of more than ``HELD`` places is not held by one task. Its units of equal bytes are brought together, and the strings of
those with the smallest id are ranked over Spark: a rank is the smallest
position (document id, row, offset) with the same string, the first covers 16 bytes, a round joins a position's rank with the rank ``step``
bytes on, groups the rank pairs and reranks; a position whose string starts in one document only can never repeat and leaves at once.

Copies are long, so most of their strings are settled before, at one position for many. A text is cut into phrases where
nearby bytes alone say so, about every 65 bytes, and the positions of cuts are ranked by their phrase and the bytes after it
that the strings starting in the phrase reach (as 128 bits of BLAKE2). Such a prefix is past the threshold: where it also occurs in
a document of smaller id, every string inside it is settled. The doubling ranks what phrases leave open: the strings at
the ends of copies, short ones, and first occurrences. The document with the smallest id that holds a string is never settled by
phrases, so it still meets every open string.

Most strings enter neither. Anchors are counted first, about one for 11 bytes, by 42 bits of their hash, four bytes each; those that
occur twice set three bits each in a bitmap of at least 16 bits for each, and only strings whose anchor is in the bitmap are looked at. Before the
doubling this is done once more, with the open strings alone and anchors of 40 bytes. The bitmap may let others pass,
never hold one back.

Edge cases: missing text is empty; texts shorter than the threshold are kept whole; repeated rows with one id do not remove
each other, as neither id is smaller; rows without an id are kept whole; an empty table gives an empty result; other columns are ignored. A
very long text is one row, processed in memory, while its units are rows of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakewright.llm.common import batches, bytes_of_text, staged
from lakewright.session import drop_folder, new_path

LENGTH = 50
LEAST = 36
ANCHOR = 30
FIRST = 16
REACH = 32  # a cut has the only smallest hash among so many places on either side
BITS = 42  # an anchor's place has so many
BLOCKS = 10  # the first of which tell the block that counts it
BITMAP_BITS = 30  # the bitmap has 16 to 32 bits for each shared anchor, 2 ** BITMAP_BITS at most
PROBES = (1, 0x9E3779B1, 0x85EBCA6B)  # odd factors of the bits of an anchor, all in its block
HELD = 50_000  # an anchor of more places is ranked over Spark
CHUNK_BYTES = 1 << 17  # a task ranks units of so many bytes at a time, whole anchors always
JOINED_BYTES = 1 << 15  # short texts are hashed together, as many as stay in a core's cache; memory for larger arrays is given back and mapped anew
BATCH_BYTES = 2 << 20
MIX = np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * MIX
    return x ^ (x >> np.uint64(32))


def hashes(text: np.ndarray, width: int) -> np.ndarray:
    """A hash of every substring of ``width`` bytes, 8 at least, from those of half the width or of two that overlap."""
    if len(text) < width:
        return np.zeros(0, np.uint64)
    value, reach = np.ndarray(len(text) - 7, "<u8", text, strides=(1,)).copy(), 8
    while reach < width:
        step = min(reach, width - reach)
        value = value[:-step] * np.uint64(0x9E3779B97F4A7C15 + 2 * reach) + value[step:]
        value ^= value >> np.uint64(29)
        value *= MIX
        reach += step
    value ^= value >> np.uint64(32)
    return value


def smallest(value: np.ndarray, window: int) -> np.ndarray:
    """The smallest of every ``window`` neighbouring values."""
    if len(value) < window:
        return value[:0]
    reach = 1
    while 2 * reach <= window:
        value = np.minimum(value[:-reach], value[reach:])
        reach *= 2
    return np.minimum(value[: -(window - reach)], value[window - reach :]) if reach < window else value


def anchors(text: np.ndarray, length: int, width: int) -> np.ndarray:
    """The anchor hash of every string of ``length`` bytes: the smallest hash of its substrings of ``width`` bytes."""
    return smallest(hashes(text, width), length - width + 1)


def joined(contents: list[bytes]) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
    """Neighbouring texts as one: number of the first, bytes, the same as numbers, and where each begins and the last ends."""
    first = size = 0
    for i in range(len(contents) + 1):
        if i == len(contents) or i > first and size + len(contents[i]) > JOINED_BYTES:
            if first < i:
                whole = b"".join(contents[first:i])
                yield first, whole, np.frombuffer(whole, np.uint8), np.cumsum([0, *map(len, contents[first:i])])
            first, size = i, 0
        if i < len(contents):
            size += len(contents[i])


def owner_of(at: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The number of the text that holds each place; empty ones hold none."""
    return np.searchsorted(begin, at, "right") - 1


def inside(begin: np.ndarray, length: int) -> np.ndarray:
    """Whether a string of ``length`` bytes that starts at a place ends in the same text."""
    size = max(int(begin[-1]) - length + 1, 0)
    step = np.zeros(int(begin[-1]) + 2, np.int32)
    own = np.diff(begin) >= length
    step[begin[:-1][own]] += 1
    step[begin[1:][own] - length + 1] -= 1
    return np.cumsum(step[:size]) > 0


def heads_of(value: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Places of live strings whose value is not that of a live string before them."""
    head = live.copy()
    head[1:] &= (value[1:] != value[:-1]) | ~live[:-1]
    return np.flatnonzero(head)


def spread(at: np.ndarray, value: np.ndarray, live: np.ndarray) -> np.ndarray:
    """The values of heads for all live strings, false for others."""
    if not len(at):
        return np.zeros(len(live), bool)
    return np.repeat(np.append(False, value), np.diff(at, prepend=0, append=len(live))) & live


def cuts(value: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Where phrases begin: at the first byte of a text and where a hash is smaller than all others near it. Copies are cut alike inside.

    ``value``: the hashes of the strings of ``ANCHOR`` bytes.
    """
    least = smallest(value, 2 * REACH + 1)
    at = np.flatnonzero(value[REACH : REACH + len(least)] == least) + REACH
    own = owner_of(at, begin)
    at = at[(at - REACH >= begin[own]) & (at + REACH + ANCHOR <= begin[own + 1])]
    gap = np.diff(at, prepend=-REACH - 1, append=begin[-1] + REACH + 1) > REACH
    return np.sort(np.concatenate([begin[:-1][np.diff(begin) > 0], at[gap[:-1] & gap[1:]]]))


def shared_bitmap(rows: DataFrame, length: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the anchors that occur twice, as words, and the places of those that occur more than ``HELD`` times. ``rows``: ``text``.

    Tasks send the places of a batch in blocks, four bytes a place, so that places meet by chance as seldom as anchors do.
    """
    low = BITS - BLOCKS

    def send(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames, BATCH_BYTES):
            found = []
            for _, _, text, begin in joined(bytes_of_text(batch.column(0))):
                anchor = anchors(text, length, width)
                found.append(places(anchor[heads_of(anchor, inside(begin, length))]))
            place = np.sort(np.concatenate(found))
            first = np.flatnonzero(np.diff(place >> low, prepend=-1))
            parts = np.split((place & ((1 << low) - 1)).astype("<u4"), first[1:])
            yield pa.RecordBatch.from_arrays([pa.array((place[first] >> low).astype(np.int32)), pa.array([x.tobytes() for x in parts[: len(first)]], pa.binary())], ["block", "places"])

    def count(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        place, n = np.unique(np.frombuffer(b"".join(frame["places"]), "<u4"), return_counts=True)
        place, n = place[n > 1], n[n > 1]
        return pd.DataFrame({"block": [key[0]], "n": [len(place)], "places": [place.tobytes()], "hot": [place[n > HELD].tobytes()]})

    path = new_path(rows.sparkSession, "shared-anchors")
    counted = rows.select("text").mapInArrow(send, "block int, places binary").groupBy("block").applyInPandas(count, "block int, n bigint, places binary, hot binary")
    counted.write.parquet(path)
    counted = rows.sparkSession.read.schema(counted.schema).parquet(path)
    total = counted.agg(F.sum("n")).first()[0] or 0
    bits = min(BITMAP_BITS, max(20, (16 * total).bit_length()))

    def fill(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            blocks = []
            for blob in batch.column(1):
                block, place = np.zeros(1 << (bits - BLOCKS), np.uint8), np.frombuffer(blob.as_py(), "<u4")
                for factor in PROBES:
                    block[place * np.uint32(factor) >> np.uint32(BITS - bits)] = 1
                blocks.append(np.packbits(block, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blocks, pa.binary())], ["block", "bits"])

    # The driver gets the bitmap in blocks and the places that more than ``HELD`` others share.
    out = np.zeros(1 << (bits - 5), "<u4")
    parts = out.view(np.uint8).reshape(1 << BLOCKS, -1)
    for block, content in counted.select("block", "places").mapInArrow(fill, "block int, bits binary").collect():
        parts[block] = np.frombuffer(content, np.uint8)
    often = [np.frombuffer(hot, "<u4") + (np.int64(block) << low) for block, hot in counted.filter("octet_length(hot) > 0").select("block", "hot").collect()]
    drop_folder(rows.sparkSession, path)
    return out, np.sort(np.concatenate([np.zeros(0, np.int64), *often]))


def places(anchor: np.ndarray) -> np.ndarray:
    """The places of anchors. These are small hashes, so they are mixed again."""
    return (mix(anchor * MIX) >> np.uint64(64 - BITS)).astype(np.int64)


def in_bitmap(bitmap: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether all bits of a place are set. Most that are not shared miss the first."""
    shift = BITS - (32 * len(bitmap)).bit_length() + 1
    block, low = place >> (BITS - BLOCKS) << (BITS - BLOCKS - shift), place.astype(np.uint32)
    at = np.arange(len(place))
    for factor in PROBES:
        bit = block[at] | (low[at] * np.uint32(factor) >> np.uint32(shift))
        at = at[(bitmap[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1 == 1]
    found = np.zeros(len(place), bool)
    found[at] = True
    return found


def is_among(place: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Whether each place is one of ``hot``, which is sorted."""
    return hot[np.minimum(np.searchsorted(hot, place), len(hot) - 1)] == place if len(hot) else np.zeros(len(place), bool)


def candidates(bitmap: np.ndarray, anchor: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Whether each live string has its anchor in the bitmap. Neighbours of one anchor are looked up once."""
    at = heads_of(anchor, live)
    return spread(at, in_bitmap(bitmap, places(anchor[at])), live)


def covered_bytes(starts: np.ndarray, length: int) -> np.ndarray:
    """Bytes of the strings of ``length`` bytes that begin at ``starts``."""
    step = np.zeros(len(starts) + length, np.int64)
    at = np.flatnonzero(starts)
    step[at] += 1
    step[at + length] -= 1
    return np.cumsum(step)[:-1] > 0


def segments_of(whole: bytes, begin: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Text, place in it and bytes of every part that consists of strings of ``length`` bytes beginning at ``starts``."""
    held = covered_bytes(starts, length)
    # Parts of different texts may touch.
    fresh = np.zeros(len(held) + 1, bool)
    fresh[begin[begin <= len(held)]] = True
    first = np.flatnonzero(held & (fresh[:-1] | ~np.append(False, held[:-1])))
    last = np.flatnonzero(held & (fresh[1:] | ~np.append(held[1:], False)))
    own = owner_of(first, begin)
    return own, first - begin[own], [whole[a : b + 1] for a, b in zip(first.tolist(), last.tolist())]


def phrases_of(whole: bytes, begin: np.ndarray, value: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Text, begin, end and digest (two numbers) of the phrases whose first string may repeat, each with all strings that start in it."""
    first = cuts(value, begin)
    own = owner_of(first, begin)
    end = np.minimum(np.append(first[1:], begin[-1]) + length - 1, begin[own + 1])
    live = np.append(starts, np.zeros(length, bool))[first]
    first, end, own = first[live], end[live], own[live]
    digests = [hashlib.blake2b(whole[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), end.tolist())]
    k1, k2 = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2).T
    return own, first - begin[own], end - begin[own], k1, k2


def nested(own: list[np.ndarray], rows: np.ndarray, fields: dict[str, pa.Array]) -> pa.Array:
    """A list for each of ``rows`` of the structs that are ``own`` to it, in order of the rows."""
    own = np.concatenate([np.zeros(0, np.int64), *own])
    offsets = np.searchsorted(own, np.append(rows, rows[-1] + 1 if len(rows) else 0)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def candidate_parts(spark: SparkSession, rows: DataFrame, bitmap: np.ndarray, length: int) -> DataFrame:
    """``row``, ``doc_id``, ``phrases`` and ``segments`` of the texts with strings that may repeat."""
    shared = spark.sparkContext.broadcast(bitmap)

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames, BATCH_BYTES):
            phrases: list[list] = [[] for _ in range(5)]
            owners, bases, texts = [], [], []
            for number, whole, text, begin in joined(bytes_of_text(batch.column(2))):
                value = hashes(text, ANCHOR)
                starts = candidates(shared.value, smallest(value, length - ANCHOR + 1), inside(begin, length))
                if not starts.any():
                    continue
                for column, x in zip(phrases, phrases_of(whole, begin, value, starts, length)):
                    column.append(x)
                phrases[0][-1] = phrases[0][-1] + number
                own, base, parts = segments_of(whole, begin, starts, length)
                owners.append(own + number)
                bases.append(base)
                texts += parts
            held = np.unique(np.concatenate([np.zeros(0, np.int64), *owners]))
            flat = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (*phrases[1:], bases)]
            kinds = dict(zip(("at", "stop", "k1", "k2"), (pa.int32(), pa.int32(), pa.int64(), pa.int64())))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(held)),
                    batch.column(1).take(pa.array(held)),
                    nested(phrases[0], held, {k: pa.array(x, t) for (k, t), x in zip(kinds.items(), flat)}),
                    nested(owners, held, {"base": pa.array(flat[4], pa.int32()), "text": pa.array(texts, pa.binary())}),
                ],
                ["row", "doc_id", "phrases", "segments"],
            )

    return rows.mapInArrow(run, "row bigint, doc_id bigint, phrases array<struct<at:int,stop:int,k1:bigint,k2:bigint>>, segments array<struct<base:int,text:binary>>")


def open_segments(segments: DataFrame, settled: DataFrame, length: int) -> DataFrame:
    """``row``, ``doc_id``, ``base`` and ``text``: the parts of the segments with strings that ``settled`` (``row``, ``first``, ``last`` start) does not hold."""
    spans = settled.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("spans"))

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames, BATCH_BYTES):
            base = batch.column("base").to_numpy()
            counts = pc.fill_null(pc.list_value_length(batch.column("spans")), 0).to_numpy()
            of, spans = np.repeat(np.arange(batch.num_rows), counts), batch.column("spans").flatten()
            first, last = (spans.field(i).to_numpy() for i in range(2))
            owners, bases, texts = [], [], []
            for number, whole, text, begin in joined(bytes_of_text(batch.column("text"))):
                starts = inside(begin, length)
                a, b = np.searchsorted(of, [number, number + len(begin) - 1])
                own = of[a:b] - number
                # A span is taken out where it lies within the strings of its segment.
                low = np.maximum(first[a:b] - base[of[a:b]], 0)
                high = np.minimum(last[a:b] + 1 - base[of[a:b]], np.diff(begin)[own] - length + 1)
                step, real = np.zeros(len(text) + 1, np.int32), low < high
                np.add.at(step, begin[own][real] + low[real], 1)
                np.add.at(step, begin[own][real] + high[real], -1)
                starts &= np.cumsum(step)[: len(starts)] == 0
                own, place, parts = segments_of(whole, begin, starts, length)
                owners.append(own + number)
                bases.append(base[own + number] + place)
                texts += parts
            held = pa.array(np.concatenate([np.zeros(0, np.int64), *owners]))
            at = pa.array(np.concatenate([np.zeros(0, np.int64), *bases]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("row").take(held), batch.column("doc_id").take(held), at, pa.array(texts, pa.binary())], ["row", "doc_id", "base", "text"])

    joined_spans = segments.join(spans, "row", "left").select("row", "doc_id", "base", "text", "spans")
    return joined_spans.mapInArrow(run, "row bigint, doc_id bigint, base int, text binary")


def units(spark: SparkSession, segments: DataFrame, bitmap: np.ndarray, wide: int, hot: np.ndarray, length: int, of_hot: bool = False) -> DataFrame:
    """``anchor``, ``row``, ``doc_id``, ``at``, ``text``: neighbouring strings of one anchor that may repeat and all the bytes they cover.

    Strings need an anchor of ``wide`` bytes in the bitmap; those with one of ``ANCHOR`` bytes in ``hot`` are left out,
    or only those are given (``of_hot``).
    """
    shared = spark.sparkContext.broadcast((bitmap, hot))

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, hot = shared.value
        for batch in batches(frames, BATCH_BYTES):
            row, doc, base = (batch.column(i).to_numpy() for i in range(3))
            for number, whole, text, begin in joined(bytes_of_text(batch.column(3))):
                live, anchor = candidates(bitmap, anchors(text, length, wide), inside(begin, length)), anchors(text, length, ANCHOR)
                first = heads_of(anchor, live)
                change = np.flatnonzero(np.diff(np.append(live, False).view(np.int8), prepend=0) < 0)
                # A unit ends where the next begins or where live strings do.
                end = np.minimum(np.append(first[1:], len(live)), change[np.searchsorted(change, first, "right")]) if len(first) else first
                taken = is_among(places(anchor[first]), hot) == of_hot
                if not taken.any():
                    continue
                first, end = first[taken], end[taken] + length - 1
                own = owner_of(first, begin)
                texts = [whole[a:b] for a, b in zip(first.tolist(), end.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor[first].view(np.int64)),
                        pa.array(row[own + number]),
                        pa.array(doc[own + number]),
                        pa.array(base[own + number] + first - begin[own], pa.int32()),
                        pa.array(texts, pa.binary()),
                    ],
                    ["anchor", "row", "doc_id", "at", "text"],
                )

    return segments.mapInArrow(run, "anchor bigint, row bigint, doc_id bigint, at int, text binary")


def repeated_in(anchor: np.ndarray, doc: np.ndarray, texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit, first and last start of the strings that a document of smaller id has too."""
    numbers: dict[bytes, int] = {}
    same = np.fromiter((numbers.setdefault(t, len(numbers)) for t in texts), np.int64, len(texts))
    least = np.full(len(numbers), np.iinfo(np.int64).max)
    np.minimum.at(least, same, doc)
    # Units of equal bytes are ranked once, for the smallest id; all strings of the others are repeated.
    distinct = list(numbers)
    mine = np.zeros(len(numbers), np.int64)
    mine[same] = anchor
    _, at, times = np.unique(mine, return_inverse=True, return_counts=True)
    met = np.flatnonzero(times[at] > 1)
    low = high = of = np.zeros(0, np.int64)
    if len(met):
        begin = np.cumsum([0, *[len(distinct[i]) for i in met]])
        starts = np.flatnonzero(inside(begin, length))
        rank = ranks(np.frombuffer(b"".join(distinct[i] for i in met), np.uint8), starts, length)
        own = owner_of(starts, begin)
        first = np.full(int(rank.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, rank, least[met][own])
        late = starts[least[met][own] > first[rank]]
        own = owner_of(late, begin)
        edge = np.flatnonzero((np.diff(late, prepend=-2) > 1) | (np.diff(own, prepend=-1) > 0))
        own, last = own[edge], np.append(late[edge[1:] - 1], late[-1:])
        low, high, of = late[edge] - begin[own], last - begin[own], met[own]
    runs = np.bincount(of, minlength=len(distinct))
    whole = doc > least[same]
    rest = np.flatnonzero(~whole)
    unit = np.repeat(rest, runs[same[rest]])
    # The place of each run among those of its unit, after those of the units before it.
    turn = np.arange(len(unit)) - np.repeat(np.cumsum(runs[same[rest]]) - runs[same[rest]], runs[same[rest]])
    take = (np.cumsum(runs) - runs)[same[unit]] + turn
    every = np.flatnonzero(whole)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.append(every, unit), np.append(np.zeros(len(every), np.int64), low[take]), np.append(size[every] - length, high[take])


def ranks(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Equal numbers for equal strings of ``length`` bytes at ``starts``, by prefix doubling from 8 bytes on."""
    value = np.ndarray(len(text) - 7, "<u8", text, strides=(1,)).copy()
    rank = np.unique(value, return_inverse=True)[1]
    *steps, last = FIRST // 2, *steps_of(length)
    for step in steps:
        rank = np.unique(rank[:-step] << 32 | rank[step:], return_inverse=True)[1]
    return np.unique(rank[starts] << 32 | rank[starts + last], return_inverse=True)[1]


def ranked_by_anchor(spark: SparkSession, found: DataFrame, length: int) -> DataFrame:
    """``row``, ``first``, ``last`` of the repeated strings of units. A task holds the units of one anchor, or of some small ones, at a time."""

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def close(part: pa.Table) -> pa.RecordBatch:
            anchor, row, doc, at = (part.column(i).to_numpy() for i in range(4))
            unit, low, high = repeated_in(anchor, doc, part.column(4).to_pylist(), length)
            return pa.RecordBatch.from_arrays([pa.array(row[unit]), pa.array(at[unit] + low, pa.int32()), pa.array(at[unit] + high, pa.int32())], ["row", "first", "last"])

        for batch in batches(frames, CHUNK_BYTES):
            held.append(batch)
            size += batch.column(4).nbytes
            if size >= CHUNK_BYTES:
                part = pa.Table.from_batches(held)
                anchor = part.column(0).to_numpy()
                whole = int(np.searchsorted(anchor, anchor[-1]))
                if whole:
                    yield close(part.slice(0, whole))
                    held = part.slice(whole).to_batches()
                size = sum(b.column(4).nbytes for b in held) if whole else 0
        if held:
            yield close(pa.Table.from_batches(held))

    near = found.repartition("anchor").sortWithinPartitions("anchor")
    return near.mapInArrow(run, "row bigint, first int, last int")


def steps_of(length: int) -> list[int]:
    """The offsets by which the prefix doubles from ``FIRST`` bytes to ``length``."""
    out, reach = [], FIRST
    while reach < length:
        out.append(min(reach, length - reach))
        reach += out[-1]
    return out


def positions(found: DataFrame, length: int) -> DataFrame:
    """``row``, ``doc_id``, ``at`` and 16 bytes (``k1``, ``k2``) of the strings of units and of the places their doubling looks at.

    Units of a row overlap, so they are brought together and a place is given once, or once more where a batch ends.
    """
    offsets = {0}
    for step in steps_of(length):
        offsets |= {x + step for x in offsets}

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames, CHUNK_BYTES):
            row, doc, base = (batch.column(i).to_numpy() for i in range(3))
            contents = bytes_of_text(batch.column(3))
            begin = np.cumsum([0, *map(len, contents)])
            starts = np.flatnonzero(inside(begin, length))
            place = np.concatenate([starts + x for x in offsets])
            own = owner_of(place, begin)
            at = base[own] + place - begin[own]
            number = np.cumsum(np.diff(row, prepend=row[:1]) != 0)
            once = np.unique(number[own] << 32 | at, return_index=True)[1]
            place, own, at = place[once], own[once], at[once]
            value = np.ndarray(max(int(begin[-1]) - 7, 0), "<i8", b"".join(contents), strides=(1,))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (row[own], doc[own], at.astype(np.int32), value[place], value[place + 8])], ["row", "doc_id", "at", "k1", "k2"])

    near = found.select("row", "doc_id", "at", "text").repartition("row").sortWithinPartitions("row", "at")
    return near.mapInArrow(run, "row bigint, doc_id bigint, at int, k1 bigint, k2 bigint")


def rerank(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Positions whose keys occur in documents of different ids, ranked by their smallest position.

    Groups are summed before the shuffle and joined back, so that adaptive execution can split a hot string.
    """
    groups = frame.groupBy(*keys).agg(F.min(F.struct("doc_id", "row", "at")).alias("name"), F.max("doc_id").alias("last")).filter("name.doc_id < last").drop("last")
    return frame.join(groups, keys).select("row", "doc_id", "at", F.col("name").alias("rank"))


def settled_by_phrases(parts: DataFrame, length: int) -> DataFrame:
    """``row``, ``first``, ``last``: all strings that start from ``first`` to ``last`` also start in a document of smaller id."""
    found = parts.select("row", "doc_id", F.explode("phrases").alias("p")).select("row", "doc_id", "p.*")
    least = found.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).filter("least < last").drop("last")
    return found.join(least, ["k1", "k2"]).filter("least < doc_id").selectExpr("row", "at AS first", f"stop - {length} AS last")


def repeated_strings(spark: SparkSession, rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """``row``, ``first``, ``last``: strings of ``length`` bytes that start there also start in a document of smaller id.

    ``rows``: ``row`` (unique), ``doc_id`` (bigint, not null), ``text``.
    """
    if length < LEAST:
        raise ValueError(f"at least {LEAST} bytes")
    def kept(df: DataFrame, label: str) -> tuple[DataFrame, str]:
        path = new_path(spark, label)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    bitmap, hot = shared_bitmap(rows, length, ANCHOR)
    parts, folder = kept(candidate_parts(spark, rows, bitmap, length), "repeat-candidates")
    settled = staged(spark, settled_by_phrases(parts, length), "settled")
    segments = parts.select("row", "doc_id", F.explode("segments").alias("s")).select("row", "doc_id", "s.*")
    segments, opened = kept(open_segments(segments, settled, length), "open-strings")
    drop_folder(spark, folder)
    wide = max(ANCHOR, length - 10)
    bitmap, _ = shared_bitmap(segments, length, wide)
    found = staged(spark, ranked_by_anchor(spark, units(spark, segments, bitmap, wide, hot, length), length), "starts")
    if len(hot):
        found = found.union(ranked_over_spark(spark, units(spark, segments, bitmap, wide, hot, length, of_hot=True), length))
    drop_folder(spark, opened)
    return settled.union(found)


def ranked_over_spark(spark: SparkSession, found: DataFrame, length: int) -> DataFrame:
    """``row``, ``first``, ``last`` of the repeated strings of units of hot anchors, whose ranks are tables.

    Units of equal bytes are ranked once, for the smallest id; all strings of the others are repeated.
    """
    found = staged(spark, found.select("row", "doc_id", "at", "text"), "hot-units")
    least = staged(spark, found.groupBy("text").agg(F.min("doc_id").alias("least")), "least")
    found = staged(spark, found.join(least, "text").select("row", "doc_id", "at", "text", "least"), "hot-units")
    ranked = staged(spark, rerank(positions(found.filter("doc_id = least"), length), ["k1", "k2"]), "ranks")
    for step in steps_of(length)[:-1]:
        ranked = staged(spark, rerank(_pairs(ranked, step), ["rank", "next"]), "ranks")
    starts = staged(spark, _final(_pairs(ranked, steps_of(length)[-1])), "starts")
    whole = found.filter("doc_id > least").selectExpr("row", "at AS first", f"int(at + octet_length(text) - {length}) AS last")
    return whole.union(starts.selectExpr("row", "at AS first", "at AS last"))


def _pairs(ranked: DataFrame, step: int) -> DataFrame:
    ahead = W.partitionBy("row").orderBy("at").rangeBetween(step, step)
    return ranked.withColumn("next", F.first("rank").over(ahead)).filter("next IS NOT NULL")


def _final(pairs: DataFrame) -> DataFrame:
    first = pairs.groupBy("rank", "next").agg(F.min("doc_id").alias("first"))
    return pairs.join(first, ["rank", "next"]).filter("doc_id > first").select("row", "at")


def remove_repeats(spark: SparkSession, documents: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (the bytes left) and ``kept_sha256``. Ids must be integers."""

    # Numbered anew in each pass: files are read in the same order every time.
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    starts = repeated_strings(spark, rows.filter("doc_id IS NOT NULL"), length)
    # Starts at most a string apart belong to one removed run.
    order = W.partitionBy("row").orderBy("first", "last")
    before = F.max("last").over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = starts.withColumn("fresh", F.when(F.col("first") - before <= length, 0).otherwise(1))
    runs = fresh.withColumn("run", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0))).groupBy("row", "run").agg(F.min("first").alias("start"), (F.max("last") + length).alias("end"))
    spans = runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))

    def cut(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames, BATCH_BYTES):
            out = []
            for content, own in zip(bytes_of_text(batch.column(1)), batch.column(2).to_pylist()):
                kept, at, removed = [], 0, 0
                for s in own or []:
                    kept.append(content[at : s["start"]])
                    at = s["end"]
                    removed += s["end"] - s["start"]
                left = b"".join([*kept, content[at:]])
                out.append((len(content), removed, len(own or []), left, hashlib.sha256(left).hexdigest()))
            n_bytes, n_removed, n_spans, left, digest = zip(*out) if out else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)], pa.array(left, pa.binary()), pa.array(digest, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
            )

    whole = rows.join(spans, "row", "left").select("doc_id", "text", "spans")
    return whole.mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string")
