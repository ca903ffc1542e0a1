"""Repair of conversations at least cost, with ties broken by prefix doubling.

A conversation is well formed when its roles read ``(system? (user assistant)+)?``. Every row is kept, given another role or
deleted, and turns with empty text may be inserted anywhere; of all cheapest ways the one with the least audit, the string of
the edits' initials, is taken.

Rows are range-partitioned and sorted over the whole table and written with their place, so a conversation of any size
spreads over tasks, and is cut into chunks of at most ``1 << CHUNK_BITS`` rows of which only a code a row is kept. Chunks meet
four states of the grammar: a cost for each pair of states at its two ends lets costs be added up over chunks, backwards.
Then each chunk, knowing what lies ahead, runs the cost DP over all its nodes (row, state) and keeps the optimal arcs.
Arcs are ranked by their first letter, then by successive powers of two: an arc's rank over 2n letters is that of the pair (own
rank, rank of the arc n letters ahead). At each node the ranks select the least arc, and the doubled pointers read the path
out from each state at the chunk's start. Chunks are joined by the states at their ends.

Bounds: a task holds a batch of chunks; the chunks of one conversation meet as 16 numbers for each 4,096 rows, and its audit,
one letter an edit, is one value. The texts are streamed past a hash in the query.

Edge cases: a missing role or text is one blank, a missing turn comes first, rows without an id are one conversation; equal
turns are ordered by role and text (by their first characters, then by a hash); a role without a letter s, u or a in front, the empty one too, can't be
kept; no rows or only such as are deleted give an empty conversation, which is well formed; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.llm.common import SPACE, batches, staged

CHUNK_BITS = 12
ROWS_AT_ONCE = 1 << 16
NEVER = 1 << 28  # more than any chunk can cost

# States: nothing yet, after system, after user, after assistant. A conversation may end in the first and the last.
STATES = 4
NEXT = np.array([2, 2, 3, 2])  # after a turn of the role that must come, if it is not system
RETYPE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
END = (0, 2 * INSERT, INSERT, 0)  # what is left to pay in each state after the last row
LETTERS = b"\0DIKR"  # in the order of their characters

# A row's code: initial (s, u, a, other) + 4 * fault (none, to be deleted, truncated); one more stands for no row.
NO_ROW = 12


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code and state: cost of keeping, state after keeping, cost of another role."""
    keep, after, retype = np.full((NO_ROW + 1, STATES), NEVER), np.zeros((NO_ROW + 1, STATES), np.int64), np.full((NO_ROW + 1, STATES), NEVER)
    for code in range(NO_ROW):
        initial, fault = code % 4, code // 4
        if fault == 1:
            continue
        more = TRUNCATED if fault == 2 else 0
        for state in range(STATES):
            retype[code, state] = RETYPE + more
            if (initial, state) == (0, 0):
                keep[code, state], after[code, state] = more, 1
            elif initial == (2 if state == 2 else 1):
                keep[code, state], after[code, state] = more, NEXT[state]
    keep[NO_ROW], after[NO_ROW] = 0, np.arange(STATES)
    return keep, after, retype


KEEP, AFTER, OTHER_ROLE = _tables()
ILLEGAL = np.array([[(a, b) not in ((0, 1), (1, 2), (2, 1)) for b in range(4)] for a in range(4)])


def _padded(codes: list[np.ndarray]) -> np.ndarray:
    """One row a chunk, all ending in the last column."""
    out = np.full((len(codes), max(map(len, codes))), NO_ROW, np.int64)
    for row, c in zip(out, codes):
        row[len(row) - len(c) :] = c
    return out


def _back(codes: np.ndarray, ahead: np.ndarray) -> Iterator[np.ndarray]:
    """Costs to the end before each column of rows, from the last to the first; ``ahead`` is (chunk, state, case)."""
    for column in codes.T[::-1]:
        kept = KEEP[column][:, :, None] + np.take_along_axis(ahead, AFTER[column][:, :, None], 1)
        deleted = np.where(column == NO_ROW, NEVER, DELETE)[:, None, None] + ahead
        ahead = np.minimum(np.minimum(kept, deleted), OTHER_ROLE[column][:, :, None] + ahead[:, NEXT])
        for _ in range(2):  # a third insertion in one place would come back to a state it left
            ahead = np.minimum(ahead, INSERT + ahead[:, NEXT])
        yield ahead


def transfer_costs(codes: list[np.ndarray]) -> np.ndarray:
    """(chunk, state before, state after): the least cost of the edits between."""
    goal = np.where(np.eye(STATES, dtype=bool), 0, NEVER)[None].repeat(len(codes), 0)
    for goal in _back(_padded(codes), goal):
        pass
    return np.minimum(goal, NEVER)


def least_paths(codes: list[np.ndarray], tails: np.ndarray, last: np.ndarray) -> tuple[list[list[str]], np.ndarray]:
    """For each chunk and state before it: the least audit among the cheapest ones, and the state after it.

    ``tails`` holds what is to be paid after the chunk in each state; insertions after the last row belong to chunks that
    are the ``last`` of their conversation.
    """
    padded = _padded(codes)
    chunks, length = padded.shape
    cost = np.empty((chunks, length + 1, STATES), np.int64)
    cost[:, length] = tails
    for i, c in enumerate(_back(padded, cost[:, length, :, None])):
        cost[:, length - 1 - i] = c[:, :, 0]
    # Arcs (chunk, place, state, letter) that lie on a cheapest way, and the node each leads to.
    arc = np.zeros((chunks, length + 1, STATES, 5), bool)
    target = np.zeros(arc.shape, np.int64)
    number = np.arange(chunks * (length + 1) * STATES).reshape(chunks, length + 1, STATES)
    real = (padded != NO_ROW)[:, :, None]
    ahead, here = cost[:, 1:], cost[:, :-1]
    arc[:, :-1, :, 1] = real & (here == DELETE + ahead)
    target[:, :-1, :, 1] = number[:, 1:]
    arc[:, :-1, :, 2] = real & (here == INSERT + here[:, :, NEXT])
    arc[:, -1, :, 2] = last[:, None] & (cost[:, -1] == INSERT + cost[:, -1][:, NEXT])
    target[:, :, :, 2] = number[:, :, NEXT]
    kept = np.take_along_axis(ahead, AFTER[padded], 2)
    arc[:, :-1, :, 3] = real & (here == KEEP[padded] + kept)
    target[:, :-1, :, 3] = np.take_along_axis(number[:, 1:], AFTER[padded], 2)
    arc[:, :-1, :, 4] = real & (here == OTHER_ROLE[padded] + ahead[:, :, NEXT])
    target[:, :-1, :, 4] = number[:, 1:][:, :, NEXT]
    # The end: an arc without a letter that leads to itself.
    arc[:, -1, :, 0] = ~arc[:, -1, :, 2]
    target[:, -1, :, 0] = number[:, -1]
    node, letter = np.nonzero(arc.reshape(-1, 5))
    goes = target.reshape(-1, 5)[node, letter]
    rank = letter.astype(np.int64)

    def least_arcs() -> np.ndarray:
        """The arc of least rank of every node that has arcs."""
        order = np.lexsort((rank, node))
        first = np.full(number.size, -1, np.int64)
        first[node[order[::-1]]] = order[::-1]
        return first

    pointers = [least_arcs()[goes]]
    while letter[pointers[-1]].any():
        _, rank = np.unique(rank * (int(rank.max()) + 1) + rank[pointers[-1]], return_inverse=True)
        pointers.append(pointers[-1][pointers[-1]])
    starts = number[np.arange(chunks), length - np.array([len(c) for c in codes])]
    path = least_arcs()[starts][:, :, None]
    for jump in pointers:
        path = np.concatenate((path, jump[path]), 2)
    marks = np.frombuffer(LETTERS, np.uint8)[letter[path]]
    audits = [[m.tobytes().rstrip(b"\0").decode() for m in chunk] for chunk in marks]
    return audits, node[path[:, :, -1]] % STATES


def _groups(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Chunks of like length, together of a bounded number of rows."""
    order = np.argsort(lengths, kind="stable")
    start = 0
    for i in range(1, len(order) + 1):
        if i == len(order) or lengths[order[i]] > 2 * lengths[order[start]] or lengths[order[i]] * (i + 1 - start) > ROWS_AT_ONCE:
            yield order[start:i]
            start = i


def _lists(column: pa.Array) -> list[np.ndarray]:
    flat, offsets = column.flatten().to_numpy(), column.offsets.to_numpy()
    return np.split(flat, (offsets[1:-1] - offsets[0])) if len(column) else []


def placed_rows(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """All rows in the order of their conversations with their place, ``slot``, written once."""
    role, text = F.coalesce(F.col("role"), F.lit(" ")), F.coalesce(F.col("text"), F.lit(" "))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("spread"))
    told = F.to_json(F.struct("conv_id", "role", "text"))  # a missing id has no field in it
    rows = rows.withColumn("same", F.unhex(F.sha2(told.cast("binary"), 256)))
    # Keys of bounded size, of which the last tells equal rows apart, so that any number of them can be split.
    order = [F.col("conv_id"), F.col("turn"), F.substring("role", 1, 32), F.substring("text", 1, 64), F.col("same"), F.col("spread")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("slot", F.monotonically_increasing_id())
    return staged(spark, placed.drop("spread"), "turns")


def coded_rows(rows: DataFrame) -> DataFrame:
    """``conv_id, slot, turn, code`` and the first fault of each row: blank, duplicate, truncated."""
    firsts = rows.groupBy("same").agg(F.min("slot").alias("first"), F.count("*").alias("n")).filter("n > 1").select("same", "first")
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    end = F.right(F.rtrim("text", F.lit(" \t\n\x0b\f\r")), F.lit(1))
    narrow = rows.select("conv_id", "slot", "turn", "same", F.left("role", F.lit(1)).alias("initial"), blank.alias("blank"), (~end.isin(".", "!", "?")).alias("open"))
    told = narrow.join(firsts, "same", "left").withColumn("again", F.coalesce(F.col("slot") > F.col("first"), F.lit(False)))
    duplicate = ~F.col("blank") & F.col("again")
    truncated = ~F.col("blank") & ~F.col("again") & F.col("open")
    initial = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    fault = F.when(F.col("blank") | F.col("again"), 1).when(F.col("open"), 2).otherwise(0)
    return told.select(
        "conv_id", "slot", "turn", "blank", duplicate.alias("duplicate"), truncated.alias("truncated"), (initial + 4 * fault).cast("bigint").alias("code")
    )


def _mapped(df: DataFrame, schema: str, apply) -> DataFrame:
    """``mapInArrow`` with a function from the columns of a batch to the arrays of the result."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            for start in range(0, batch.num_rows, 2048):
                yield pa.RecordBatch.from_arrays(apply(batch.slice(start, 2048)), names)

    return df.mapInArrow(run, schema)


def repair(spark: SparkSession, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two frames. By conversation that has rows: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``.

    By repaired turn: ``conv_id, chunk, step, role, text``, ordered in a conversation by chunk and step.
    """
    rows = placed_rows(spark, turns)
    coded = staged(spark, coded_rows(rows), "turn-codes")
    kind = rows.schema["conv_id"].dataType.simpleString()
    chunks = (
        coded.groupBy("conv_id", F.shiftright("slot", CHUNK_BITS).alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct("slot", "code"))).alias("rows"))
        .select("conv_id", F.col("rows")[0]["slot"].alias("chunk"), F.col("rows")["slot"].alias("slots"), F.col("rows")["code"].alias("codes"))
    )
    chunks = staged(spark, chunks, "turn-chunks")

    def cross(batch: pa.RecordBatch) -> list[pa.Array]:
        codes = _lists(batch.column(2))
        steps = np.zeros((len(codes), STATES * STATES), np.int64)
        for group in _groups(np.array([len(c) for c in codes])):
            steps[group] = transfer_costs([codes[i] for i in group]).reshape(len(group), -1)
        illegal = [int(ILLEGAL[c[:-1] % 4, c[1:] % 4].sum()) for c in codes]
        ends = [pa.array([int(c[at]) % 4 for c in codes], pa.int64()) for at in (0, -1)]
        return [batch.column(0), batch.column(1), pa.array(list(steps)), pa.array(illegal, pa.int64()), *ends]

    crossed = _mapped(chunks.select("conv_id", "chunk", "codes"), f"conv_id {kind}, chunk bigint, steps array<bigint>, illegal bigint, head bigint, tail bigint", cross)
    joined = crossed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "steps", "illegal", "head", "tail"))).alias("c"))

    def settle(batch: pa.RecordBatch) -> list[pa.Array]:
        """Cost and illegal pairs of conversations, and for each of their chunks what is to be paid after it."""
        costs, illegal, ahead = [], [], []
        for found in batch.column(1).to_pylist():
            left, tails = np.array(END), []
            for c in reversed(found):
                tails.append(left.tolist())
                left = (np.array(c["steps"]).reshape(STATES, STATES) + left).min(1)
            costs.append(int(left[0]))
            illegal.append(sum(c["illegal"] for c in found) + sum(int(ILLEGAL[a["tail"], b["head"]]) for a, b in zip(found, found[1:])))
            ahead.append([{"chunk": c["chunk"], "tails": t, "last": i == 0} for i, (c, t) in enumerate(zip(reversed(found), tails))])
        shape = pa.list_(pa.struct([("chunk", pa.int64()), ("tails", pa.list_(pa.int64())), ("last", pa.bool_())]))
        return [batch.column(0), pa.array(costs, pa.int64()), pa.array(illegal, pa.int64()), pa.array(ahead, shape)]

    ahead_type = "array<struct<chunk:bigint,tails:array<bigint>,last:boolean>>"
    settled = staged(spark, _mapped(joined, f"conv_id {kind}, cost bigint, illegal bigint, ahead {ahead_type}", settle), "turn-costs")
    tails = settled.select(F.explode("ahead").alias("a")).select("a.*")

    def choose(batch: pa.RecordBatch) -> list[pa.Array]:
        codes = _lists(batch.column(3))
        tails, last = np.array(batch.column(4).to_pylist(), np.int64).reshape(-1, STATES), np.array(batch.column(5).to_pylist(), bool)
        audits: list[list[str]] = [[]] * len(codes)
        exits = np.zeros((len(codes), STATES), np.int64)
        for group in _groups(np.array([len(c) for c in codes])):
            found, exits[group] = least_paths([codes[i] for i in group], tails[group], last[group])
            for i, audit in zip(group, found):
                audits[i] = audit
        return [*batch.columns[:4], pa.array(audits, pa.list_(pa.string())), pa.array(list(exits), pa.list_(pa.int64()))]

    shape = f"conv_id {kind}, chunk bigint, slots array<bigint>, codes array<bigint>, audits array<string>, exits array<bigint>"
    paths = _mapped(chunks.join(tails, "chunk").select("conv_id", "chunk", "slots", "codes", "tails", "last"), shape, choose)
    paths = staged(spark, paths, "turn-paths")

    def enter(batch: pa.RecordBatch) -> list[pa.Array]:
        """The state in which each chunk of a conversation is entered."""
        out = []
        for found in batch.column(0).to_pylist():
            state, entries = 0, []
            for c in found:
                entries.append({"chunk": c["chunk"], "entry": state})
                state = c["exits"][state]
            out.append(entries)
        return [pa.array(out, pa.list_(pa.struct([("chunk", pa.int64()), ("entry", pa.int64())])))]

    ordered = paths.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "exits"))).alias("c")).select("c")
    entries = _mapped(ordered, "entries array<struct<chunk:bigint,entry:bigint>>", enter).select(F.explode("entries").alias("e")).select("e.*")
    chosen = paths.join(entries, "chunk").select("conv_id", "chunk", "slots", "codes", "entry", F.get("audits", F.col("entry").cast("int")).alias("audit"))
    chosen = staged(spark, chosen, "turn-audits")

    def edit(batch: pa.RecordBatch) -> list[pa.Array]:
        edits = []
        for slots, codes, state, audit in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5))):
            at, found = 0, []
            for step, letter in enumerate(audit):
                if letter != "D":
                    state = 1 if letter == "K" and state == 0 and codes[at] % 4 == 0 else int(NEXT[state])
                    role = None if letter == "K" else "user" if state == 2 else "assistant"
                    found.append({"step": step, "slot": slots[min(at, len(slots) - 1)], "new_role": role, "inserted": letter == "I"})
                at += letter != "I"
            edits.append(found)
        shape = pa.list_(pa.struct([("step", pa.int64()), ("slot", pa.int64()), ("new_role", pa.string()), ("inserted", pa.bool_())]))
        return [batch.column(0), batch.column(1), pa.array(edits, shape)]

    shape = f"conv_id {kind}, chunk bigint, edits array<struct<step:bigint,slot:bigint,new_role:string,inserted:boolean>>"
    edits = _mapped(chosen, shape, edit).select("conv_id", "chunk", F.explode("edits").alias("e")).select("conv_id", "chunk", "e.*")
    text = F.when(F.col("inserted"), F.lit("")).otherwise(F.col("text")).alias("text")
    repaired = edits.join(rows.select("slot", "role", "text"), "slot").select("conv_id", "chunk", "step", F.coalesce("new_role", "role").alias("role"), text)

    def total(name: str) -> Column:
        return F.count_if(name).alias(name)

    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("bigint")
    faults = coded.groupBy("conv_id").agg(gaps.alias("gaps"), total("blank"), total("duplicate"), total("truncated"))
    audits = chosen.groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("chunk", "audit")))["audit"], "").alias("audit"))
    return merged("conv_id", faults, settled.select("conv_id", "illegal", "cost"), audits), repaired


def merged(key: str, *frames: DataFrame) -> DataFrame:
    """Columns of several frames with one row a key at most, side by side; equal keys meet, missing ones too."""
    together = frames[0]
    for frame in frames[1:]:
        together = together.unionByName(frame, allowMissingColumns=True)
    return together.groupBy(key).agg(*[F.max(c).alias(c) for c in together.columns if c != key])


def digests(repaired: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's ``role:text`` lines; rows are streamed in order, so none need fit in memory."""
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = running = None

        def out(ids, values) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, type_), pa.array(values, pa.string())], ["conv_id", "repaired_sha256"])

        for batch in batches(frames, 1 << 24):
            type_ = batch.column(0).type
            ids, values = [], []
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if running is None or conv != current:
                    if running is not None:
                        ids.append(current)
                        values.append(running.hexdigest())
                    current, running = conv, hashlib.sha256()
                else:
                    running.update(b"\n")
                running.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            yield out(ids, values)
        if running is not None:
            yield out([current], [running.hexdigest()])

    ordered = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "step")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def damage(turns: DataFrame) -> DataFrame:
    """Rows damaged by a checksum of conversation and turn: dropped, emptied, cut of full stops, repeated, made user."""
    blank = F.lit(" ")
    named = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank))
    fate = F.crc32(named.cast("binary")) % 20
    role, text = F.coalesce(F.col("role"), blank), F.coalesce(F.col("text"), blank)
    return turns.select(
        "conv_id",
        "turn",
        F.when(fate == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(fate == 1, F.lit("")).when(fate == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")
