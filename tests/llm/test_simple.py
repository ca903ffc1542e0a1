"""Secret ledger, quality rules and chat formatting against plain Python."""

import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F

from lakewright.llm import chat, quality, secrets
from lakewright.llm.queries import QUERIES
from lakewright.session import new_path
from tests.conftest import SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_secrets(text):
    base = []
    for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A):
        if len(m[2]) >= 6:
            base.append((m.start(), 0, "assign", m.end()))
    base += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(base)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_secrets_of_documents(spark):
    folder = SMALL.replace("0.001", "0.01")
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    got = rows(QUERIES["op8_secret_ledger"](spark, folder), "doc_id")
    assert len(got) == documents.count()
    for d in documents.collect():
        base = plain_secrets(d.text)
        row = got[d.doc_id]
        assert [row[f"n_{k}"] for k in secrets.BASE_KINDS] == [sum(b[2] == k for b in base) for k in secrets.BASE_KINDS]
        assert row["base_sha256"] == sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in base))
    assert sum(r["n_assign"] + r["n_access"] + r["n_hex"] for r in got.values()) > 0


TRICKY = [
    (1, "password = 'abc' token:abcdef1 TOKEN: \"zzz\" sécret=éé secret=password:hunter22", "a"),
    (2, None, "b"),
    (3, "", "b"),
    (4, "AKIA" + "A1" * 8 + " AKIAAKIA" + "B" * 11 + " AKIA", None),
    (5, "é" * 10 + "0123456789abcdef01234567" + "g" + "0" * 23 + " toKen=abc-=_", "c"),
    (5, "é" * 10 + "0123456789abcdef01234567" + "g" + "0" * 23 + " toKen=abc-=_", "c"),
    (None, "api_key:ABCDEF https://me:hidden1@host", "c"),
    (6, "x" * 200_000 + " apikey=abcdefgh", "d"),
]


def test_secret_edge_cases(spark):
    df = spark.createDataFrame(TRICKY, "doc_id bigint, text string, blob_id string")
    got = secrets.scan_secrets(spark, df, new_path(spark, "ledger")).collect()
    assert len(got) == len(TRICKY)
    by_id = {r.doc_id: [(s.start, s.rule, s.kind, s.end) for s in r.spans if s.kind in secrets.BASE_KINDS] for r in got}
    for i, text, _ in TRICKY:
        assert by_id[i] == plain_secrets(text or "")
    assert [s.kind for r in got if r.doc_id is None for s in r.spans] == ["assign", "url_login"]
    assert secrets.scan_secrets(spark, df.limit(0), new_path(spark, "ledger")).count() == 0


@pytest.mark.parametrize("text", ["a" * 1_000_000, "a." * 500_000, "x://" * 250_000, "ab0" * 300_000 + "://u:secret99@h", "token" * 200_000, "://a:" * 200_000])
def test_rules_take_linear_time(text):
    compiled = [(n, rule, re.compile(rule.pattern, re.ASCII)) for n, rule in enumerate(secrets.RULES)]
    start = time.perf_counter()
    secrets.find_spans(text, compiled)
    assert time.perf_counter() - start < 5


def test_ledger_scans_only_what_is_unseen(spark):
    ledger = new_path(spark, "ledger")
    one = secrets.RULES[:1]
    first = spark.createDataFrame([(1, "token=abcdef"), (2, "token=abcdef"), (3, "AKIA" + "Z" * 16)], "doc_id bigint, text string")
    secrets.scan_secrets(spark, first, ledger, one).collect()
    assert spark.read.parquet(ledger).count() == 2
    more = first.unionByName(spark.createDataFrame([(4, "token=abcdef"), (5, "new secret=abcdefg")], "doc_id bigint, text string"))
    got = rows(secrets.scan_secrets(spark, more, ledger, one), "doc_id")
    assert spark.read.parquet(ledger).count() == 3 and [len(got[i]["spans"]) for i in range(1, 6)] == [1, 1, 0, 1, 1]
    # A further rule is scanned on all blobs, the first one on none.
    got = rows(secrets.scan_secrets(spark, more, ledger, secrets.RULES[:2]), "doc_id")
    entries = [r.scanned for r in spark.read.parquet(ledger).collect()]
    assert entries.count(["assign@1"]) == 3 and entries.count(["access@1"]) == 3
    assert [len(got[i]["spans"]) for i in range(1, 6)] == [1, 1, 1, 1, 1]


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é token=abcdef, AKIA" + "Z" * 16), (2, None), (3, "clean")], "doc_id bigint, text string")
    found = secrets.scan_secrets(spark, df, new_path(spark, "ledger"))
    got = df.join(found, "doc_id").select("doc_id", secrets.redact("text", "spans").alias("text"))
    assert {r.doc_id: r.text for r in got.collect()} == {1: "é [REDACTED], [REDACTED]", 2: None, 3: "clean"}


def plain_quality(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1 if len(windows) < 2000 else False:
            hit.update(range(i, i + 5))
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in quality.SYMBOLS for c in text or ""),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(hit),
        "base_failed": len(words) < 10 or 100 * len(hit) > 20 * len(words),
    }


def test_quality_of_documents(spark, documents):
    got = rows(QUERIES["op9_quality_rules"](spark, SMALL), "doc_id")
    assert len(got) == documents.count()
    for d in documents.filter("n_chars < 10000").collect():
        want = plain_quality(d.text)
        row = got[d.doc_id]
        assert {k: row[k] for k in want} == want
        assert not (row["kept"] and row["base_failed"])
    assert any(r["n_repeat_words"] for r in got.values()) and any(r["n_dup_lines"] for r in got.values())


def test_quality_edge_cases_and_ablation(spark):
    texts = [None, "", " \n\t", "a b c d", "a b c d e", "x " * 30, "a b c d e f " * 3 + "\n\n\nq\nq", "é ü ß " * 20, "# " * 12 + "\n" * 50_000, "1 2 3 4 5 6 7 8 9 10 11"]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id bigint, text string, n_words int")
    ledger = quality.rule_ledger(df)
    got = rows(ledger, "doc_id")
    for i, t in enumerate(texts):
        want = plain_quality(t)
        assert {k: got[i][k] for k in list(want)[:5]} == {k: want[k] for k in list(want)[:5]}, i
        assert bool(got[i]["failed"] & quality.BASE_MASK) == want["base_failed"]
    assert got[9]["failed"] == 1 << 3 | 1 << 6
    kept = quality.apply_policy(ledger, quality.BASE).filter("kept").count()
    assert kept == sum(not plain_quality(t)["base_failed"] for t in texts)
    cost = rows(quality.ablations(ledger, quality.BASE), "rule")
    assert cost["few_words"]["kept_without"] == sum(not (got[i]["failed"] & 2) for i in got)
    empty = quality.rule_ledger(df.limit(0))
    assert empty.count() == 0 and {r.fails for r in quality.ablations(empty, quality.STANDARD).collect()} == {0}


def test_quality_plan_has_no_python(spark):
    plan = QUERIES["op9_quality_rules"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def check_chat(df, got):
    grouped = {}
    for r in df.collect():
        grouped.setdefault(r.conv_id, []).append((r.turn is not None, r.turn, r.role or "", r.text or ""))
    assert set(got) == set(grouped)
    for conv, turns in grouped.items():
        turns.sort()
        row = got[conv]
        assert row["n_turns"] == len(turns)
        assert row["turns_sha256"] == sha("".join(f"{role}\n{text}\n" for _, _, role, text in turns))
        loss = "".join(text for _, _, role, text in turns if role == "assistant")
        assert row["loss_chars"] == len(loss) and row["loss_sha256"] == sha(loss)


def test_chat_of_conversations(spark):
    got = rows(QUERIES["op10_chat_format"](spark, SMALL), "conv_id")
    tricky = got.pop(-7)
    assert tricky["n_turns"] == 2 and tricky["loss_chars"] == 21 and tricky["loss_sha256"] == sha("</s>[INST] ok [/INST]")
    check_chat(spark.read.parquet(f"{SMALL}/conversations.parquet"), got)


def test_chat_edge_cases(spark, monkeypatch):
    from lakewright.llm import queries

    data = [
        (1, 0, "user", "<s>&lt;s>&amp;[ROLE]<sep></s>[/INST]<<SYS>><</SYS>>&#91;"),
        (1, 1, "user", ""),
        (1, 2, "assistant", None),
        (1, 3, "assistant", "<</s>[[ROLE]"),
        (1, 3, "assistant", "<</s>[[ROLE]"),
        (1, None, None, "é" * 100_000),
        (2, 0, "</s>[/ROLE]", "x"),
        (None, 5, "assistant", "y"),
        (None, 4, "", "z"),
        (3, 0, "assistant", "only" * 50_000),
    ]
    df = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS formatted", "2 AS turns")
    monkeypatch.setattr(queries, "table", lambda *_: df)
    got = rows(queries.op10_chat_format(spark, ""), "conv_id")
    assert got.pop(-7)["n_turns"] == 2
    check_chat(df, got)
    merged = chat.format_conversations(df.filter("conv_id = 1")).first().formatted
    assert merged.count("</s>") == 3 and merged.count("<sep>") == 3
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_many_turns_take_time_in_proportion(spark):
    """Also the conversation that rows without an id form, however many they are."""
    took = {}
    for n in (25_000, 100_000):
        role = F.when(F.col("id") % 2 == 0, "user").otherwise("assistant")
        turns = spark.range(n).select(F.lit(None).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.concat(F.lit("é"), "id").alias("text"))
        done = chat.format_conversations(turns)
        start = time.perf_counter()
        row = done.select(F.size("loss_spans").alias("spans"), chat.loss_text("formatted", "loss_spans").alias("loss"), F.size(chat.read_turns("formatted")).alias("turns")).first()
        took[n] = time.perf_counter() - start
        assert (row.spans, row.turns) == (n // 2, n) and row.loss == "".join(f"é{i}" for i in range(1, n, 2))
    assert took[100_000] < 6 * took[25_000] + 5


def test_running_sums_and_search(spark):
    numbers = [[], [3], list(range(1, 700))]
    df = spark.createDataFrame([(x,) for x in numbers], "x array<int>")
    got = [r[0] for r in df.select(chat.sums_before(F.col("x"))).collect()]
    assert got == [[sum(x[:i]) for i in range(len(x))] for x in numbers]
    starts = [0, 4, 4, 9, 30]
    df = spark.range(40).select("id", F.array(*[F.lit(v) for v in starts]).alias("s"))
    found = {r.id: r.i for r in df.select("id", chat.last_not_above(F.col("s"), F.col("id")).alias("i")).collect()}
    assert found == {i: max(k for k, v in enumerate(starts) if v <= i) for i in range(40)}
