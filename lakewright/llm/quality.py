"""Quality rules with a rule bitmask ledger: column expressions only, no Python on the executors.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed rule; a policy is a
named, versioned mask of the bits it minds, so applying another policy or computing what each rule costs reads the
ledger and no text.

Edge cases: a missing or empty text has no words and fails ``few_words``; ratios over no words count as not failing;
repeated rows keep one ledger row each; an empty table gives an empty ledger, and its ablation counts are 0; other columns
of the input are kept out of the ledger. A document's words live in one array, so a task needs memory for the longest text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import SPACE

SYMBOLS = "#*$%&|<>"
WINDOW = 5

# Bit number, name and failing condition over the measurements; a bit keeps its meaning for ever.
RULES: tuple[tuple[int, str, str], ...] = (
    (0, "few_words", "n_words < 10"),
    (1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    (2, "many_symbols", "10 * n_symbols > 3 * word_chars"),
    (3, "short_words", "n_words > 0 AND word_chars < 2 * n_words"),
    (4, "long_words", "word_chars > 25 * n_words"),
    (5, "duplicate_lines", "n_lines > 3 AND 10 * n_dup_lines > 5 * n_lines"),
    (6, "no_letters", "n_words > 0 AND n_letters = 0"),
)
BASE_MASK = 0b11


@dataclass(frozen=True)
class Policy:
    """A document is kept when it fails none of the rules in the mask."""

    name: str
    version: int
    mask: int


STANDARD = Policy("standard", 1, 0b1111111)
BASE = Policy("base", 1, BASE_MASK)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _covered(hashes: Column) -> Column:
    """Words covered by windows found at least twice, from the window hashes in order.

    Windows are sorted by hash and position, those with an equal neighbour are kept, and the gaps between their
    positions, at most a window each, are summed: n log n for any text.
    """

    def repeated(pairs: Column) -> Column:
        def equal(i: Column, x: Column) -> Column:
            return F.coalesce(F.get(pairs, i)["h"] == x["h"], F.lit(False))

        kept = F.filter(pairs, lambda x, i: equal(i - 1, x) | equal(i + 1, x))
        return F.sort_array(F.transform(kept, lambda x: x["i"]))

    def total(at: Column) -> Column:
        def gap(i: Column, k: Column) -> Column:
            return F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - i, F.lit(WINDOW)))

        return F.aggregate(F.transform(at, gap), F.lit(0).cast("bigint"), lambda s, x: s + x)

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _bound(_bound(pairs, repeated), total)


def measure(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and the measurements of every text."""
    content = F.coalesce(F.col(text), F.lit(""))
    shaped = documents.select(
        F.col(key).alias("doc_id"),
        F.filter(F.split(content, f"[{SPACE}]+"), lambda w: w != "").alias("words"),
        F.length(F.translate(content, " \t\n\x0b\x0c\r", "")).cast("bigint").alias("word_chars"),
        F.length(content).alias("chars"),
        F.length(F.translate(content, SYMBOLS, "")).alias("plain"),
        F.filter(F.split(content, "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias("lines"),
        F.when(content.rlike(r"\p{L}"), 1).otherwise(0).cast("bigint").alias("n_letters"),
    )
    n = F.size("words")
    # The words' positions are those of all but the last windows; a text of fewer words has no window.
    hashes = F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))

    def repeats(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(_covered(h))

    return shaped.select(
        "doc_id",
        n.cast("bigint").alias("n_words"),
        "word_chars",
        (F.col("chars") - F.col("plain")).cast("bigint").alias("n_symbols"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        _bound(hashes, repeats).alias("n_repeat_words"),
        "n_letters",
    )


def rule_ledger(documents: DataFrame, rules=RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Measurements and ``failed``, a bigint with the bit of every failed rule set."""
    measured = measure(documents, key, text)
    failed = F.lit(0).cast("bigint")
    for bit, _, condition in rules:
        failed = failed.bitwiseOR(F.when(F.expr(condition), F.lit(1 << bit).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return measured.withColumn("failed", failed)


def apply_policy(ledger: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with ``kept`` under a policy, and the policy's name and version."""
    return ledger.withColumns(
        {
            "kept": F.col("failed").bitwiseAND(F.lit(policy.mask).cast("bigint")) == 0,
            "policy": F.lit(f"{policy.name}@{policy.version}"),
        }
    )


def ablations(ledger: DataFrame, policy: Policy, rules=RULES) -> DataFrame:
    """Per rule of the policy: documents failing it, failing only it, and kept once the rule is left out.

    Documents are first counted per bit pattern, of which there are at most two to the number of rules; ``kept_without``
    and ``fails`` follow from bitwise operations on the patterns.
    """
    mask = F.lit(policy.mask).cast("bigint")
    patterns = ledger.groupBy(F.col("failed").bitwiseAND(mask).alias("failed")).count()
    chosen = [(bit, name) for bit, name, _ in rules if policy.mask >> bit & 1]
    sums = []
    for bit, _ in chosen:
        own = F.lit(1 << bit).cast("bigint")
        sums += [
            F.sum(F.when(F.col("failed").bitwiseAND(own) != 0, F.col("count")).otherwise(0)).alias(f"fails_{bit}"),
            F.sum(F.when(F.col("failed") == own, F.col("count")).otherwise(0)).alias(f"only_{bit}"),
        ]
    sums.append(F.sum(F.when(F.col("failed") == 0, F.col("count")).otherwise(0)).alias("kept"))
    total = patterns.agg(*sums)

    def of(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    rows = F.array(
        *[
            F.struct(F.lit(name).alias("rule"), of(f"fails_{bit}").alias("fails"), of(f"only_{bit}").alias("fails_alone"), (of("kept") + of(f"only_{bit}")).alias("kept_without"))
            for bit, name in chosen
        ]
    )
    return total.select(F.inline(rows))
