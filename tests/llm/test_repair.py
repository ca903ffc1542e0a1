"""Conversation repair against plain Python: a search over all edits with their audits."""

import functools
import hashlib
import random
import sys
import zlib

import numpy as np
import pytest

from lakewright.llm import repair
from lakewright.llm.queries import QUERIES
from tests.conftest import SMALL

SPACE = " \t\n\x0b\x0c\r"
AFTER = {"": "u", "s": "u", "u": "a", "a": "u"}


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 1:
            text = ""
        elif fate == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fate, 1)
    return out


def plain_repair(rows):
    """Rows (turn, role, text) of one conversation: the result by the definition, from the last row to the first."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        end = text.rstrip(SPACE)[-1:]
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    sys.setrecursionlimit(100_000)

    @functools.cache
    def best(i, state, inserted):
        """Least (cost, audit) from row i in a state, which is the initial of the last turn."""
        ways = []
        if i == len(rows):
            if state in ("", "a"):
                ways.append((0, "", ()))
        else:
            more = 3 if faults[i] == "truncated" else 0
            ways.append(add(4, "D", None, best(i + 1, state, 0)))
            if faults[i] not in ("blank", "duplicate"):
                initial = rows[i][1][:1]
                if initial == AFTER[state] or (initial, state) == ("s", ""):
                    ways.append(add(more, "K", rows[i][1:], best(i + 1, initial, 0)))
                role = {"u": "user", "a": "assistant"}[AFTER[state]]
                ways.append(add(3 + more, "R", (role, rows[i][2]), best(i + 1, role[0], 0)))
        if inserted < 3:
            role = {"u": "user", "a": "assistant"}[AFTER[state]]
            ways.append(add(3, "I", (role, ""), best(i, role[0], inserted + 1)))
        return min(ways, default=(10**9, "", ()))

    def add(cost, letter, line, rest):
        return (cost + rest[0], letter + rest[1], ((line,) if line else ()) + rest[2])

    cost, audit, lines = best(0, "", 0)
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest(),
    }


def by_conversation(rows):
    out = {}
    for conv, *row in rows:
        out.setdefault(conv, []).append(tuple(row))
    return out


def repaired(spark, df):
    found, rows = repair.repair(spark, df)
    every = repair.merged("conv_id", found, repair.digests(rows))
    return {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in every.collect()}


EMPTY = {"repaired_sha256": None}


def same(got, rows):
    want = {c: plain_repair(r) for c, r in by_conversation(rows).items()}
    assert got.keys() == want.keys()
    for conv, w in want.items():
        g = dict(got[conv])
        g["repaired_sha256"] = g["repaired_sha256"] or hashlib.sha256(b"").hexdigest()
        assert g == w, (conv, g, w)


def test_query(spark):
    folder = SMALL.replace("0.001", "0.1")
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in QUERIES["op13_conversation_repair"](spark, folder).collect()}
    damaged = by_conversation(plain_damage(rows))
    assert got.keys() == {r[0] for r in rows}
    for conv, g in got.items():
        assert g == plain_repair(damaged.get(conv, [])), conv
    assert any("I" in g["audit"] for g in got.values()) and any("R" in g["audit"] for g in got.values())


ROLES = ["user", "assistant", "system", "tool", " ", "", "U"]


def random_rows(seed, conversations, most):
    rnd = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(rnd.randint(1, most)):
            role = rnd.choice(ROLES[:2] * 4 + ROLES)
            text = rnd.choice(["Yes.", "No", "", " ", f"text {rnd.randint(0, 5)}!", f"a b {rnd.randint(0, 9)}", "é?\n"])
            rows.append((conv if conv else None, rnd.choice([turn, turn + 7, None, 3]), role, text))
    return rows


@pytest.mark.parametrize("bits", [12, 1])
def test_random_conversations(spark, monkeypatch, bits):
    """With chunks of two rows, too: the seams between chunks change nothing."""
    monkeypatch.setattr(repair, "CHUNK_BITS", bits)
    rows = random_rows(bits, 120, 14)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("slot", pytest.importorskip("pyspark.sql.functions").lit(5))
    same(repaired(spark, df), rows)


def test_odd_rows(spark):
    rows = [
        (None, None, None, None),
        (1, 1, "system", "Only system."),
        (2, 1, "user", "Hello."),
        (2, 1, "user", "Hello."),
        (2, None, "assistant", "First."),
        (3, -5, "assistant", "x"),
        (3, 9, "user", "y" * 100_000),
        (4, 1, "user", "\t\n"),
    ]
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    same(repaired(spark, df), plain)
    assert repaired(spark, df.limit(0)) == {}
    assert repair.damage(df.limit(0)).count() == 0


def test_one_long_conversation(spark):
    rows = [(7, i, "user" if i % 3 else "assistant", f"t{i % 1000}" + "." * (i % 2)) for i in range(30_000)]
    got = repaired(spark, spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))[7]
    assert got["duplicate"] + got["truncated"] + got["audit"].count("K") + got["audit"].count("R") >= 30_000 - got["blank"]
    assert len(got["audit"]) - got["audit"].count("I") == 30_000


def test_least_paths_against_the_plain_search():
    rnd = np.random.default_rng(5)
    codes = [rnd.integers(0, 12, rnd.integers(1, 9)) for _ in range(200)]
    audits, _ = repair.least_paths(codes, np.tile(repair.END, (len(codes), 1)), np.ones(len(codes), bool))
    costs = repair.transfer_costs(codes)
    for c, audit, cost in zip(codes, audits, costs):
        rows = []
        for i, code in enumerate(c):
            role = "suax"[code % 4]
            rows.append((i, role + "." * i, ("", "", f"t{i}")[code // 4] if code // 4 else f"t{i}."))
        want = plain_repair(rows)
        assert audit[0] == want["audit"]
        assert (cost + np.array(repair.END)).min(1)[0] == want["cost"]
