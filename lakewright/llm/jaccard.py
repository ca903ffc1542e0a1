"""N-gram Jaccard join by T-occurrence search with DivideSkip, and the classes its links form.

A document is the set of its word shingles, hashed to 64 bits. Copies of a set share a fingerprint and are represented by one
number. Sets are ordered by hash; two sets that are similar enough share at least ``c`` of their first
``n - T + c`` shingles, where ``T`` is the overlap the smaller of two similar sets needs. Counting shared prefix
shingles therefore drops no document that can have a partner; a bitmap tells which are shared. In the order of their hashes, similar sets also share a
run of consecutive shingles near the front; the rest falls into groups connected by such runs, which seldom join unlike texts
however many there are. A group is searched in blocks of bounded size, small groups a bundle at a time: within a task, the short
inverted lists of a query are merged by counting, the longest ``L`` are only probed by binary search for documents found at least
``T - L`` times, and exact overlaps decide. Documents already linked with the first of a block are not searched again: a pair of them adds
nothing to the classes.

Edge cases: missing text and texts without words have no shingles and no links; with fewer words than a shingle, all words are
one shingle; repeated rows are copies of each other; rows without an id or with the id of another row are linked by their own
text; an empty table gives an empty result; other columns are ignored. One very long
text is one set in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakewright.llm.common import batches, bytes_of_text, staged
from lakewright.operators.numbering import with_running_total

WIDTH, PERCENT = 3, 90
BATCH_BYTES = 8 << 20
BLOCK_SHINGLES = 2_000_000
BUNDLE_SHINGLES = 1 << 18  # of small groups searched by one task, about
RANGE_VALUES = 1 << 19  # hashes counted together, about
BITMAP_BITS = 30  # the bitmap has 16 to 32 bits for each shared shingle, 2 ** BITMAP_BITS at most
SPREAD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)  # a bit of a shingle for each
RUN, SHORT = 3, 8  # consecutive shingles of a key; sets with fewer than SHORT have keys of one
BROADCAST_ROWS = 1_000_000  # fingerprints broadcast to pick texts; more are joined by a shuffle
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Distinct shingle hashes in ascending order."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    return np.unique(folded(h, width))


def folded(h: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` consecutive ones."""
    value = np.full(len(h) - width + 1, width, np.uint64)
    for j in range(width):
        value = (value ^ h[j : j + len(value)]) * MIX
        value ^= value >> np.uint64(31)
    return value


def needed(n, percent: int = PERCENT):
    """The smallest overlap of a set of ``n`` with any set similar enough."""
    return -(-percent * n // 100)


def extra(n):
    """How many shingles similar sets share in their prefixes, by the smaller size; grows with it."""
    return np.maximum(1, n // 12)


def prefix_length(n, percent: int = PERCENT):
    return np.minimum(n, n - needed(n, percent) + extra(n))


def lost_runs(n: int, run: int, percent: int) -> int:
    """How many runs of consecutive shingles of a set of ``n`` any set similar enough can lack.

    A shingle the other set lacks is in ``run`` of them at most; one only the other has lies within ``run - 1``.
    """
    return max(run * (100 - percent) * n // 100, (run - 1) * (100 - percent) * n // percent)


def keys(own: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of which two sets that are similar enough share one at least: the first runs of a set, one more than can be lost.

    Where more than three fifths of the runs can be lost, shorter ones are taken. Similar sets with fewer than ``SHORT`` shingles may
    share no run, so those and all that can be similar to them have single shingles as keys.
    """
    n = len(own)
    run = next(k for k in range(RUN, 0, -1) if k == 1 or 5 * lost_runs(1000, k, percent) <= 3 * 1000)
    widths = [run] * (n >= SHORT or run == 1) + [1] * (run > 1 and percent * n < 100 * SHORT)
    return np.concatenate([np.zeros(0, np.uint64), *[folded(own[: lost_runs(n, k, percent) + k], k) for k in widths if n]])


def ranges_for(values: float) -> int:
    """A power of two, so that a range has about ``RANGE_VALUES`` of so many hashes."""
    return 1 << max(0, int(values) // RANGE_VALUES).bit_length()


def dealt(value: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The range of each 64-bit hash, of ``count``, and the 32 bits after those that tell the range.

    With ranges of bounded size, few others in a range have these bits too.
    """
    bits = np.uint64(count.bit_length() - 1)
    return (value >> np.uint64(1)) >> (np.uint64(63) - bits), ((value << bits) >> np.uint64(32)).astype(np.uint32)


def cut(value: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each of ``count`` ranges of the ascending hashes begins, and their short forms."""
    block, short = dealt(value, count)
    return np.searchsorted(block, np.arange(count + 1).astype(np.uint64)), short


def planes(number: np.ndarray) -> bytes:
    """Eight-byte numbers, all first bytes first and so on: bytes that hardly change are next to each other."""
    return np.ascontiguousarray(number.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(blobs: Iterable[bytes]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *[np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<i8").ravel() for b in blobs]])


def short_numbers(blobs: Iterable[bytes]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint32), *[np.frombuffer(b, np.uint32) for b in blobs]])


def sets_of(documents: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """``doc_id``, ``n``, ``fp`` (of the whole set) and ``prefix`` (hashes, 8 bytes each) per row."""

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames, BATCH_BYTES):
            n, prints, prefixes = [], [], []
            for content in bytes_of_text(batch.column(1)):
                own = shingles(content, width)
                n.append(len(own))
                prints.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                prefixes.append(own[: int(prefix_length(len(own), percent))].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(prefixes, pa.binary())], ["doc_id", "n", "fp", "prefix"])

    kind = documents.select(key).schema[0].dataType.simpleString()
    return documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n bigint, fp binary, prefix binary")


def bits_at(value: np.ndarray, count: int, bits: int) -> Iterator[np.ndarray]:
    """Where the hashes have their bits in a bitmap of 2 ** ``bits``, of which each of ``count`` ranges has a block."""
    low = bits + 1 - count.bit_length()
    block, short = dealt(value, count)
    for odd in SPREAD:
        yield (block << np.uint64(low)) | ((short * odd) >> np.uint32(32 - low))


def shared_bitmap(sets: DataFrame, count: int) -> np.ndarray:
    """Bits, as words, of the prefix shingles found in two sets or more; others may have the same bits.

    A task sends each shingle of a batch once, in a block for each range of hashes, and apart those found twice there, which are shared for
    certain. So a hot shingle is in a block per batch, not per document. A range answers with a row: its shared shingles, each once.
    """

    def deal(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            value, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(x.as_py(), np.uint64) for x in batch.column(0)]]) * MIX, return_counts=True)
            start, short = cut(value, count)
            out = []
            for r in np.flatnonzero(np.diff(start)).tolist():
                own, lone = short[start[r] : start[r + 1]], times[start[r] : start[r + 1]] == 1
                out.append((r, own[lone].tobytes(), own[~lone].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int32(), pa.binary(), pa.binary()])], ["range", "values", "many"])

    def find_shared(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        many = short_numbers(rows["many"])
        value, times = np.unique(np.concatenate([short_numbers(rows["values"]), many, many]), return_counts=True)
        return pd.DataFrame({"range": [key[0]], "n": [int((times > 1).sum())], "values": [value[times > 1].tobytes()]})

    rows = sets.select("prefix").mapInArrow(deal, "range int, values binary, many binary")
    shared = staged(sets.sparkSession, rows.groupBy("range").applyInPandas(find_shared, "range int, n bigint, values binary"), "shared-shingles")
    total = shared.agg(F.sum("n")).first()[0] or 0
    bits = max(min(BITMAP_BITS, max(20, (16 * total).bit_length())), count.bit_length() + 4)
    low = bits + 1 - count.bit_length()

    def fill(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            blocks = []
            for values in batch.column(1):
                block, short = np.zeros(1 << low, np.uint8), np.frombuffer(values.as_py(), np.uint32)
                for odd in SPREAD:
                    block[(short * odd) >> np.uint32(32 - low)] = 1
                blocks.append(np.packbits(block, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blocks, pa.binary())], ["range", "bits"])

    # The driver gets the bitmap in blocks, of bounded size in all.
    out = np.zeros(1 << (bits - 5), "<u4")
    parts = out.view(np.uint8).reshape(count, -1)
    for r, content in shared.select("range", "values").mapInArrow(fill, "range int, bits binary").collect():
        parts[r] = np.frombuffer(content, np.uint8)
    return out


def with_partners(sets: DataFrame, percent: int) -> DataFrame:
    """``node``, ``n``, ``fp`` and ``least`` of the sets that share enough prefix shingles with others to have a partner at all.

    A set counts its own shingles in the bitmap of shared ones, which keeps a set too many at worst: no counts of sets and ranges
    are moved, as their number grows with that of the ranges until each shared shingle has one of its own.
    """
    count = ranges_for((sets.agg(F.sum("n")).first()[0] or 0) * prefix_length(1000, percent) / 1000)
    bitmap = shared_bitmap(sets, count)
    bits = (32 * len(bitmap)).bit_length() - 1
    shared = sets.sparkSession.sparkContext.broadcast(bitmap)

    def keep(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in frames:
            prefix = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column(4)]
            if not prefix:
                continue
            owner, value = np.repeat(np.arange(len(prefix)), [len(p) for p in prefix]), np.concatenate(prefix) * MIX
            found = np.ones(len(value), bool)
            for at in bits_at(value, count, bits):
                found &= (bitmap[at >> np.uint64(5)] >> (at & np.uint64(31)).astype(np.uint32)) & 1 == 1
            gain = np.bincount(owner[found], minlength=len(prefix))
            need = extra(needed(batch.column(1).to_numpy(), percent))
            yield batch.select(["node", "n", "fp", "least"]).filter(pa.array(gain >= need))

    rows = sets.select("node", "n", "fp", "least", "prefix")
    return rows.mapInArrow(keep, rows.drop("prefix").schema)


def texts_of(documents: DataFrame, key: str, text: str, wanted: DataFrame, width: int) -> DataFrame:
    """``text``, ``node`` and ``fp`` of the documents whose id is ``least`` of a row in ``wanted``; an id may have other texts.

    Ids that are missing or stand for several sets would pair all their rows with all these: there the fingerprint tells the node.
    """
    rows, columns = wanted.select("least", "node", "fp"), documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    small = F.broadcast if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else lambda x: x
    several = rows.groupBy(F.col("least").alias("doc_id")).agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1 OR doc_id IS NULL").select("doc_id")
    if several.isEmpty():
        return columns.join(small(rows), F.expr("doc_id = least")).select("text", "node", "fp")

    def printed(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames, BATCH_BYTES):
            prints = [hashlib.blake2b(shingles(x, width).tobytes(), digest_size=16).digest() for x in bytes_of_text(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary())], ["text", "fp"])

    same = F.expr("doc_id <=> least")
    alone = columns.join(small(rows.join(several, same, "left_anti")), F.expr("doc_id = least")).select("text", "node", "fp")
    texts = columns.join(small(several.withColumnRenamed("doc_id", "least")), same, "left_semi").select("text")
    found = texts.mapInArrow(printed, "text string, fp binary").join(small(rows.join(several, same, "left_semi").select("node", "fp")), "fp")
    return alone.unionByName(found.select("text", "node", "fp"))


def sets_again(frames: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Batches of nodes and their sets, of rows as ``texts_of`` gives them; texts with another fingerprint are left out."""
    for batch in batches(frames, BATCH_BYTES):
        own = {}
        for content, node, fp in zip(bytes_of_text(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            # Rows without an id, or with the id of another, may repeat a set: it goes once a batch.
            if node not in own:
                found = shingles(content, width)
                if hashlib.blake2b(found.tobytes(), digest_size=16).digest() == fp:
                    own[node] = found
        if own:
            yield list(own), list(own.values())


def near_sets(texts: DataFrame, shingles_in_all: int, width: int, percent: int) -> DataFrame:
    """Pairs ``a``, ``b`` of nodes with a key in common that connect all nodes with common keys; dealt like shingles in ``shared_bitmap``."""
    count = ranges_for(shingles_in_all * lost_runs(1000, RUN, percent) / 1000)

    def lowest(value: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, pd.DataFrame]:
        """The values, each once, with its smallest node, to which all its others are paired."""
        value, at = np.unique(value, return_inverse=True)
        low = np.full(len(value), np.iinfo(np.int64).max)
        np.minimum.at(low, at, node)
        pairs = pd.DataFrame({"a": node, "b": low[at]})
        return value, low, pairs[pairs["a"] != pairs["b"]].drop_duplicates()

    def deal(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, own in sets_again(frames, width):
            found = [keys(x, percent) for x in own]
            value, low, pairs = lowest(np.concatenate(found) * MIX, np.repeat(np.array(nodes, np.int64), [len(x) for x in found]))
            out = [(nodes[0] % count, None, planes(pairs["a"].to_numpy()), planes(pairs["b"].to_numpy()))]
            start, short = cut(value, count)
            for r in np.flatnonzero(np.diff(start)).tolist():
                own = slice(start[r], start[r + 1])
                out.append((r, short[own].tobytes(), planes(low[own]), None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int32(), pa.binary(), pa.binary(), pa.binary()])], ["range", "values", "nodes", "ends"])

    def pair(rows: pd.DataFrame) -> pd.DataFrame:
        local = rows["values"].isna()
        dealt, paired = rows[~local], rows[local]
        pairs = lowest(short_numbers(dealt["values"]), from_planes(dealt["nodes"]))[2]
        return pd.concat([pairs, pd.DataFrame({"a": from_planes(paired["nodes"]), "b": from_planes(paired["ends"])})])

    rows = texts.mapInArrow(deal, "range int, values binary, nodes binary, ends binary")
    return rows.groupBy("range").applyInPandas(pair, "a bigint, b bigint").distinct()


def components(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node reachable over the edges ``a``, ``b``. Labels spread and jump until none changes."""
    both = staged(spark, edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = staged(spark, nodes.select("node", F.col("node").alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "node", "left").select("node", F.least("label", F.coalesce("near", "label")).alias("next"), "label")
        target = spread.select(F.col("node").alias("next"), F.col("next").alias("jump"))
        after = staged(spark, spread.join(target, "next").select("node", F.col("jump").alias("label"), (F.col("jump") != F.col("label")).alias("changed")), "labels")
        labels = after.select("node", "label")
        if after.filter("changed").isEmpty():
            return labels


class Index:
    """Inverted lists of some sets, searched for those with a large enough overlap."""

    def __init__(self, sets: list[np.ndarray]):
        owner, token = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
        order = np.argsort(token, kind="stable")
        self.owner = owner[order]
        self.token, self.first = np.unique(token[order], return_index=True)
        self.first = np.append(self.first, len(token))
        self.size = np.array([len(s) for s in sets])

    def search(self, query: np.ndarray, percent: int) -> np.ndarray:
        """Numbers of the sets with 100 * overlap >= percent * union."""
        at = np.searchsorted(self.token, query)
        at = at[(at < len(self.token)) & (self.token[np.minimum(at, len(self.token) - 1)] == query)]
        least = int(needed(len(query), percent))
        if len(at) < least:
            return np.zeros(0, np.int64)
        lists = [self.owner[self.first[i] : self.first[i + 1]] for i in at]
        lists.sort(key=len)
        # The longer the lists, the more of them are only probed; one occurrence in the short ones must remain.
        probed = min(least - 1, int(least / (0.01 * np.log2(max(2, len(lists[-1]))) + 1)))
        short, long = lists[: len(lists) - probed], lists[len(lists) - probed :]
        found, count = np.unique(np.concatenate(short), return_counts=True)
        keep = count >= least - probed
        found, count = found[keep], count[keep]
        for own in long:
            place = np.minimum(np.searchsorted(own, found), len(own) - 1)
            count = count + (own[place] == found)
        return found[100 * count >= percent * (len(query) + self.size[found] - count)]


def links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> Iterator[tuple[int, int]]:
    """Links of the sets on the left with each other, or with those on the right, enough of them to connect all that are connected.

    Members of the class of the first set are not searched once they are in it: whoever is outside that class is searched, so no
    link between two classes is lost.
    """
    index = Index(left if right is None else right)
    parent = list(range(len(left)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, query in enumerate(left):
        if right is None and i and root(i) == root(0):
            continue
        for j in index.search(query, percent).tolist():
            if right is not None:
                yield i, j
            elif root(i) != root(j):
                parent[root(j)] = root(i)
                yield i, j


def group_links(sets: DataFrame, percent: int, members: DataFrame | None = None) -> DataFrame:
    """Links ``a``, ``b`` within groups of ``node``, ``n``, ``label``, ``tokens``.

    A group is cut into blocks by size; blocks whose sizes are too far apart to hold partners do not meet. With ``members`` (``node``,
    ``n``, ``label``, each node once) ``sets`` is read once, needs ``node`` and ``tokens`` only and may have equal rows.
    """
    members = sets.select("node", "n", "label") if members is None else members
    # A running sum over all groups, of sizes only, less what comes before the group; the sets follow in the join.
    placed = staged(sets.sparkSession, with_running_total(members, ["label", "n", "node"], F.col("n"), "upto"), "placed")
    starts = placed.groupBy("label").agg(F.min(F.col("upto") - F.col("n")).alias("start"), F.max("upto").alias("end"))
    bundles = max(1, (placed.agg(F.sum("n")).first()[0] or 0) // BUNDLE_SHINGLES)
    whole = F.col("end") - F.col("start") <= BLOCK_SHINGLES
    # Groups of one block are dealt into bundles, others have their own.
    cut_up = placed.join(starts, "label").select(
        "node", "n", "label", F.floor((F.col("upto") - F.col("start") - 1) / BLOCK_SHINGLES).alias("block"),
        F.when(whole, F.lit(-1)).otherwise(F.col("label")).alias("large"), F.when(whole, F.pmod(F.xxhash64("label"), F.lit(bundles))).otherwise(0).alias("bundle"),
    )
    blocked = staged(sets.sparkSession, cut_up, "blocks")
    spans = blocked.groupBy("label", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    a, b = spans.alias("a"), spans.alias("b")
    meet = a.join(b, "label").filter(F.expr(f"a.block <= b.block AND {percent} * b.low <= 100 * a.high")).select("label", F.col("a.block").alias("x"), F.col("b.block").alias("y"))
    places = blocked.join(meet.select("label", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"), "x", "y"), ["label", "block"])
    places = staged(sets.sparkSession, places.select("node", "label", "large", "bundle", "block", "x", "y"), "places")
    few = places.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    tasks = sets.select("node", "tokens").join(F.broadcast(places) if few else places, "node")

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("node").sort_values(["label", "node"])
        label, node, block = (rows[c].to_numpy() for c in ("label", "node", "block"))
        own = [np.frombuffer(t, np.uint64) for t in rows["tokens"]]
        x, y = rows["x"].iloc[0], rows["y"].iloc[0]
        found: list[tuple[int, int]] = []
        edges = [0, *(np.flatnonzero(np.diff(label)) + 1).tolist(), len(rows)]
        for start, end in zip(edges[:-1], edges[1:]):
            left, right = (np.flatnonzero(block[start:end] == b) + start for b in (x, y))
            if len(left) and len(right):
                pairs = links([own[i] for i in left], None if x == y else [own[i] for i in right], percent)
                found += [(node[left[i]], node[right[j]]) for i, j in pairs]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return tasks.groupBy("large", "bundle", "x", "y").applyInPandas(search, "a bigint, b bigint")


def jaccard_classes(spark: SparkSession, documents: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row ``doc_id``, ``n_shingles`` and ``component_id``, the smallest ``doc_id`` its links reach, missing if none there has an id."""
    every = staged(spark, sets_of(documents, key, text, width, percent), "shingle-sets")
    # One row of each distinct set, with its smallest id and a number of its own: ids may be missing or used by several rows.
    least = every.filter("n > 0").groupBy("fp").agg(F.min("doc_id").alias("least"))
    prints = staged(spark, least.withColumn("node", F.monotonically_increasing_id()), "fingerprints")
    one = every.alias("e").join(prints.alias("p"), F.expr("e.fp = p.fp AND e.doc_id <=> p.least")).select("p.node", "e.n", "p.fp", "e.prefix", "p.least")
    nodes = staged(spark, one.dropDuplicates(["node"]), "distinct-sets")
    kept = staged(spark, with_partners(nodes, percent), "with-partners")

    total = kept.agg(F.sum("n")).first()[0] or 0
    near = near_sets(texts_of(documents, key, text, kept, width), total, width, percent)
    groups = components(spark, kept, near)

    def full(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, sets in sets_again(frames, width):
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "tokens"])

    # Groups of one have no links. The texts of the others are read again rather than keeping all sets.
    alone = groups.groupBy("label").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("label")
    wanted = groups.join(alone, "label").join(kept.select("node", "n", "fp", "least"), "node")
    wanted = staged(spark, wanted.select("node", "label", "n", "fp", "least"), "grouped")
    # The sets are the bulk of all that is moved: they go to their groups without being written or dealt out before.
    sets = texts_of(documents, key, text, wanted, width).mapInArrow(full, "node bigint, tokens binary")
    found = staged(spark, group_links(sets, percent, wanted.select("node", "n", "label")), "links")
    linked = components(spark, wanted.select("node"), found)
    linked = staged(spark, prints.join(linked, "node", "left").select("fp", "least", F.coalesce("label", "node").alias("label")), "classes")
    smallest = linked.groupBy("label").agg(F.min("least").alias("class"))
    classes = linked.join(smallest, "label").select("fp", "class")
    return every.join(classes, "fp", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("class")).otherwise(F.col("doc_id")).alias("component_id")
    )
