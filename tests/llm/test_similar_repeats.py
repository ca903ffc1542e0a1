"""Jaccard classes and repeated strings against brute force, and the pipeline stage by stage."""

import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from lakewright.llm import jaccard, repeats
from lakewright.llm.queries import QUERIES
from tests.conftest import SMALL
from tests.llm.test_pipeline_stages import plain_near_copies


def plain_set(text):
    words = (text or "").encode().translate(jaccard.LOWER).split()
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) >= 3 else {tuple(words)} if words else set()


def plain_classes(docs):
    sets = [plain_set(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 9 * max(len(a), len(b)) <= 10 * min(len(a), len(b)) and 100 * len(a & b) >= 90 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted((doc, len(sets[i]), least[root(i)]) for i, (doc, _) in enumerate(docs))


def test_classes_of_documents(spark):
    folder = SMALL.replace("0.001", "0.01")
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in QUERIES["op5_jaccard_join"](spark, folder).collect())
    assert got == plain_classes(docs) and any(d != c for d, _, c in got)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return " ".join(words)


@pytest.mark.parametrize("block", [2_000_000, 1500])
def test_classes_of_large_groups(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", block)
    rng = random.Random(3)
    docs = [(1, None), (2, ""), (3, "one"), (4, "ONE"), (5, "one two"), (6, "x " * 40_000)]
    for family in range(3):
        words = [f"w{family}_{i}" for i in range(120)]
        # Chains: a copy of a copy, so that ends of a class are not similar to each other.
        for k in range(40):
            if k % 7 == 0:
                words = edited(rng, words, 2).split()
            docs.append((100 * family + 10 + k, edited(rng, words, rng.choice([0, 0, 1, 2, 3]))))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "7 AS n", "'q' AS label")
    assert sorted(tuple(r) for r in jaccard.jaccard_classes(spark, df).collect()) == plain_classes(docs)
    assert jaccard.jaccard_classes(spark, df.limit(0)).count() == 0


def test_search_equals_overlap():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(60)]
    index = jaccard.Index(sets)
    for q in sets:
        want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 70 * len(np.union1d(q, s))]
        assert index.search(q, 70).tolist() == want


def plain_repeats(docs, length=50):
    first = {}
    texts = [(d, (t or "").encode()) for d, t in docs]
    for d, b in texts:
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_repeats_of_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in QUERIES["op2_repeated_bytes"](spark, SMALL).collect())
    assert got == plain_repeats(docs) and any(r[2] for r in got)


def test_repeat_edge_cases(spark):
    rng = random.Random(1)
    base = "".join(rng.choice("abcé") for _ in range(300))
    docs = [(5, base), (1, base[100:149]), (2, base[100:150]), (3, "x" + base[:120] + "y" + base[90:200]), (9, "z" * 120), (10, "z" * 49), (11, "z" * 50), (12, None), (13, ""), (5, base), (14, base * 3 + "q" * 2000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS at", "2 AS row")
    got = sorted(tuple(r) for r in repeats.remove_repeats(spark, df).drop("kept").collect())
    assert got == plain_repeats(docs)
    assert repeats.remove_repeats(spark, df.limit(0)).count() == 0


@pytest.mark.parametrize("held", [50_000, 3])
def test_repeats_by_anchor_and_over_spark(spark, monkeypatch, held):
    # Anchors of few places are ranked by one task, the others over Spark; short texts are hashed together.
    monkeypatch.setattr(repeats, "HELD", held)
    rng = random.Random(8)
    words = [bytes(rng.choices(range(97, 123), k=rng.randint(2, 9))).decode() for _ in range(300)]
    lines = [" ".join(rng.choices(words, k=rng.randint(3, 40))) for _ in range(60)]
    docs = [(rng.randrange(90), "\n".join(rng.choice(lines)[rng.randrange(20) :] for _ in range(rng.randrange(9)))) for _ in range(150)]
    docs += [(200, ""), (201, None), (202, "ab" * 300), (203, "ba" * 200), (204, lines[0] * 3)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert sorted(tuple(r) for r in repeats.remove_repeats(spark, df).drop("kept").collect()) == plain_repeats(docs)


def test_units_of_neighbouring_strings_are_one_row(spark):
    # A row per string took more than seven times the input of disk.
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    segments = spark.createDataFrame([(row, row, 0, text[1000 * row :].encode()) for row in range(3)], "row bigint, doc_id bigint, base int, text binary")
    bitmap, _ = repeats.shared_bitmap(segments, 50, 40)
    found = repeats.units(spark, segments, bitmap, 40, np.zeros(0, np.int64), 50).collect()
    assert len(bitmap) == 1 << 15  # grows with the anchors that are shared
    strings = {(r.row, r.at + i): bytes(r.text[i : i + 50]).decode() for r in found for i in range(len(r.text) - 49)}
    assert all(text[1000 * row + at :][:50] == x for (row, at), x in strings.items())
    assert {(0, i) for i in range(1000, 3951)} <= set(strings) and 7 * len(found) < len(strings)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.staged(spark, stage(spark, docs, SMALL), name)
        assert out.columns == columns
        if name == "near_copies":
            # This stage links at five words and four fifths, unlike op5.
            assert sorted(r.doc_id for r in out.collect()) == sorted(d.doc_id for d in plain_near_copies(docs.collect()))
        docs = out
        sizes.append(docs.count())
    assert sizes[1] > 0.9 * sizes[0] and sizes[2] < sizes[1] and sizes[3] < sizes[2] and sizes[4] == sizes[3]
    kept = {r.doc_id for r in docs.collect()}
    pieces = corpus_pipeline.run(spark, SMALL).collect()
    assert {p.doc_id for p in pieces} == kept
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())
