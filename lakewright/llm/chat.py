"""Relational chat formatting: turn structs, array expressions and string functions only.

A conversation becomes one string. Adjacent turns of one role form a block::

    <s>[ROLE]user[/ROLE]first text<sep>second text</s><s>[ROLE]assistant[/ROLE]answer</s>

Control strings inside roles and texts are escaped with entities (``&`` first, then the first character of a control
string), so a text can neither open nor close a turn, and reading back gives the same turns.

Edge cases: a missing text or role is empty; turns are ordered by turn, role and text, missing turn numbers first, so ties have one
result; repeated rows are repeated turns; rows without a conversation id form one conversation; an empty table gives no
conversations; other columns of the input are ignored. One row of the output holds one whole conversation, so a task
needs memory for the longest conversation; the time for one is in proportion to its turns and characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, ROLE, ROLE_END, NEXT, CLOSE = "<s>", "[ROLE]", "[/ROLE]", "<sep>", "</s>"
# Control strings of this template and of related ones that a model may know.
CONTROL = r"/?s>|sep>|/?ROLE\]|/?INST\]|</?SYS>>"
TRAINED = ("assistant",)
# Numbers added up one by one where a running sum is wanted; more are added up block by block.
BLOCK = 256


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sums_before(sizes: Column) -> Column:
    """For each number the sum of all before it: of whole blocks, then inside its block, so that nothing is copied per number."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("bigint"), lambda a, x: a + x)

    count = F.size(sizes)
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((count - 1) / BLOCK).cast("int"))), lambda b: total(F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK))))

    def add(offsets: Column) -> Column:
        def before(_: Column, i: Column) -> Column:
            inside = i % BLOCK
            return F.get(offsets, F.floor(i / BLOCK).cast("int")) + F.when(inside > 0, total(F.slice(sizes, i - inside + 1, inside))).otherwise(F.lit(0))

        return F.transform(sizes, before)

    return bound(bound(blocks, lambda own: F.transform(own, lambda _, b: F.when(b > 0, total(F.slice(own, F.lit(1), b))).otherwise(F.lit(0).cast("bigint")))), add)


def last_not_above(starts: Column, at: Column) -> Column:
    """Index of the last of sorted starts, of which the first is 0, that is at most ``at``, found by halving."""

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"] + 1, 1)
        fits = F.get(starts, middle) <= at
        return F.struct(F.when(fits, middle).otherwise(s["low"]).alias("low"), F.when(fits, s["high"]).otherwise(middle - 1).alias("high"))

    start = F.struct(F.lit(0).alias("low"), (F.size(starts) - 1).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(31)), start, lambda s, i: F.when(s["low"] < s["high"], halve(s, i)).otherwise(s), lambda s: s["low"])


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    out = F.regexp_replace(out, rf"<(?=(?:{CONTROL}))", "&lt;")
    return F.regexp_replace(out, rf"\[(?=(?:{CONTROL}))", "&#91;")


def unescape(text: Column) -> Column:
    out = F.replace(text, F.lit("&#91;"), F.lit("["))
    out = F.replace(out, F.lit("&lt;"), F.lit("<"))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def format_conversations(turns: DataFrame, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """``conv_id``, ``formatted`` and ``loss_spans``: the code-point spans ``[start, end)`` the loss counts.

    ``loss_spans`` has one entry per turn of a trained role and covers its escaped text without any mark.
    """
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    collected = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def piece(t: Column, i: Column) -> Column:
        """Marks before the text, the escaped text, marks after it; neighbours of the same role share a block."""
        first = (i == 0) | (F.get("turns", i - 1)["role"] != t["role"])
        last = (i == F.size("turns") - 1) | (F.get("turns", i + 1)["role"] != t["role"])
        return F.struct(
            F.when(first, F.concat(F.lit(OPEN + ROLE), escape(t["role"]), F.lit(ROLE_END))).otherwise(F.lit(NEXT)).alias("before"),
            escape(t["text"]).alias("text"),
            F.when(last, F.lit(CLOSE)).otherwise(F.lit("")).alias("after"),
            t["role"].isin(*trained).alias("trained"),
        )

    pieces = collected.select("conv_id", F.transform("turns", piece).alias("pieces"))

    def spans(p: Column) -> Column:
        sizes = F.transform(p, lambda x: F.length(x["before"]) + F.length(x["text"]) + F.length(x["after"]))

        def cut(starts: Column) -> Column:
            def span(x: Column, i: Column) -> Column:
                start = F.get(starts, i) + F.length(x["before"])
                end = start + F.length(x["text"])
                return F.when(x["trained"], F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))

            return F.filter(F.transform(p, span), lambda x: x.isNotNull())

        return bound(bound(sizes, sums_before), cut)

    return pieces.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["text"], p["after"])), "").alias("formatted"),
        bound(F.col("pieces"), spans).alias("loss_spans"),
    )


def read_turns(formatted: str) -> Column:
    """The turns of a formatted conversation, in order, as an array of role and text."""
    blocks = F.slice(F.split(F.col(formatted), CLOSE), 1, F.size(F.split(F.col(formatted), CLOSE)) - 1)

    def turns_of(block: Column) -> Column:
        role = F.substring_index(block, ROLE_END, 1)
        role = unescape(F.substr(role, F.lit(len(OPEN + ROLE) + 1)))
        body = F.substr(block, F.instr(block, ROLE_END) + F.lit(len(ROLE_END)))
        return F.transform(F.split(body, NEXT), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns_of))


def loss_text(formatted: str, spans: str) -> Column:
    """All text under the loss mask, unescaped, with nothing between.

    The string is split after its marks first, so that a span is cut from its own piece and not counted out from the start.
    """
    pieces = F.split(F.col(formatted), f"(?<={CLOSE}|{NEXT})")

    def cut(p: Column) -> Column:
        def spans_of(starts: Column) -> Column:
            def text(s: Column) -> Column:
                return bound(last_not_above(starts, s["start"]), lambda i: F.substring(F.get(p, i), (s["start"] - F.get(starts, i) + 1).cast("int"), s["end"] - s["start"]))

            return F.array_join(F.transform(F.col(spans), lambda s: unescape(text(s))), "")

        return bound(bound(F.transform(p, lambda x: F.length(x)), sums_before), spans_of)

    return bound(pieces, cut)
