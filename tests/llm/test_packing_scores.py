"""Packing by exact round trip and class scores against plain Python."""

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from lakewright.llm import brown, packing, queries
from lakewright.llm.queries import QUERIES
from tests.conftest import SMALL, plan_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(queries.tokenizer()[0])
    return lambda text: [*model.encode(text or "", add_special_tokens=False).ids, 1]


def check_pieces(texts, pieces, encode):
    """``texts``: one text per doc_id; every id of every document lies in exactly one piece."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        ids, at = np.array(encode(text), "<u4"), 0
        for p in sorted(by_doc[doc], key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048 and at & (at - 1) == 0


def test_pack_documents(spark, encode):
    got = QUERIES["op6_packing"](spark, SMALL).collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    check_pieces({d.doc_id: d.text for d in docs}, got, encode)


LONG = [
    " " * 1_000_000,
    " " * 200_000 + "x",
    "a" + "\n" * 200_000 + " b" + "\t " * 30_000 + "\u3000c",
    "\u2003" * 20_000 + "<|endoftext|>" + " " * 20_000,
    " " * 9_999 + "y" + " " * 10_000 + "z" + " " * 10_001 + "\x1c" * 20_000 + "w",
    "a" * 300_000,
    "7" * 300_000,
    "word " * 100_000,
]
SPECIAL = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>  x", " <|endoftext|", "x  <|endoftext|>  y", "\n\n<|endoftext|>\n\n"]


@pytest.mark.parametrize("text", [*SPECIAL, *LONG], ids=range(len(SPECIAL) + len(LONG)))
def test_ids_are_those_of_tokenizers(encode, text):
    """The plain call, special tokens and long runs included."""
    ids = packing.Encoder(queries.tokenizer()[0])([text])[0]
    assert ids.tolist() == encode(text)[:-1]


def test_five_million_blanks_and_letters():
    encoder = packing.Encoder(queries.tokenizer()[0])
    start = time.perf_counter()
    for c in (" ", "\n", "a", "7"):
        (ids,) = encoder([c * 5_000_000])
        assert encoder.model.decode(ids.tolist()) == c * 5_000_000
    assert time.perf_counter() - start < 120


def test_pack_edge_cases(spark, encode, monkeypatch):
    texts = ["", None, "a", "hello  world\n\n x's", "<|endoftext|> end", "日本語 ñ é ́", "word " * 6000, "x" * 2047, "tab\t\t y  ", "hello world again", "hello world again and again"]
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id bigint, text string, n int")
    monkeypatch.setattr(queries, "table", lambda *_: df)
    check_pieces(dict(enumerate(texts)), queries.op6_packing(spark, "").collect(), encode)
    monkeypatch.setattr(queries, "table", lambda *_: df.limit(0))
    assert queries.op6_packing(spark, "").count() == 0


def test_neighbours_share_words():
    rng = np.random.default_rng(1)
    # Fragments of two subjects in turn: a window holds one of them.
    docs = [np.append(rng.integers(100 + 1000 * (i % 2), 200 + 1000 * (i % 2), 99), 1).astype(np.uint16) for i in range(40)]
    frequency = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=2000)
    idf = np.log1p((40 - frequency + 0.5) / (frequency + 0.5)).astype(np.float32)
    sequences = list(packing.pack_shard(docs, idf, 100.0, 500))
    assert sum(len({d % 2 for d, _, _ in s}) == 1 for s in sequences) >= len(sequences) - 2
    assert sum(n for s in sequences for _, _, n in s) == 4000
    assert list(packing.cut_to_powers([(0, 0, 3), (1, 5, 4)], 7)) == [[(0, 0, 3), (1, 5, 1)], [(1, 6, 2)], [(1, 8, 1)]]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_scores(docs):
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs}
    counts = Counter()
    for i, t in docs:
        if not held[i]:
            counts.update([*WORD.findall(lower(t)), None])
    n, v = sum(counts.values()), len(counts)
    out = {}
    for i, t in docs:
        tokens = [*WORD.findall(lower(t)), None]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        out[i] = (held[i], len(tokens), sum(counts[w] > 0 for w in tokens), n, base)
    return out


def test_scores_of_documents(spark):
    folder = SMALL.replace("0.001", "0.01")
    got = {r.doc_id: r for r in QUERIES["op7_class_scores"](spark, folder).collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = plain_scores(docs)
    assert set(got) == set(want)
    for i, (held, n, known, total, base) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9, abs=1e-9)
    outside = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in outside) > sum(r.base_score for r in outside)


def test_score_edge_cases(spark):
    rows = [(i, t, "z") for i, t in enumerate(["a b A\tc", None, "", "b" * 100 + " é É", "a " * 50_000, "a b A\tc"])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, word string")
    small = brown.Settings(floor=2, classes=2, endings=3, known=3)
    train = df.filter("doc_id < 4")
    model, counts = brown.train(spark, train, small)
    got = {r.doc_id: r for r in brown.score(spark, df, model, counts).collect()}
    assert got[1].n_tokens == got[2].n_tokens == 1 and got[4].n_tokens == 50_001 and got[3].n_known == 4
    assert all(r.train_tokens == 11 and r.score < 0 for r in got.values())
    model, counts = brown.train(spark, df.limit(0), small)
    got = brown.score(spark, df, model, counts).collect()
    assert len(got) == 6 and all(r.base_score == 0 or r.n_tokens > 0 for r in got) and all(np.isfinite(r.score) for r in got)
    assert brown.score(spark, df.limit(0), model, counts).count() == 0


def test_probabilities_sum_to_one(spark):
    df = spark.createDataFrame([(0, "a b a c a b d e f g a b")], "doc_id bigint, text string")
    small = brown.Settings(floor=2, classes=2, endings=3, known=5)
    model, counts = brown.train(spark, df, small)
    assert np.allclose((10**model.transition).sum(1), 1)
    totals = np.zeros(small.end + 1)
    for r in counts.collect():
        totals[r["class"]] += (r.n + 0.5) / 10 ** model.class_total[r["class"]]
    assert np.allclose(totals + 0.5 / 10**model.class_total, 1)


def random_texts(seed, rows=60):
    rng = np.random.default_rng(seed)
    words = [f"w{i}{'xyz'[i % 3]}" for i in range(40)]
    share = 1 / np.arange(1, 41)
    return [" ".join(rng.choice(words, rng.integers(0, 30), p=share / share.sum())) for _ in range(rows)]


def plain_likelihood(pairs, of, total):
    g = np.zeros((total, total))
    for (a, b), n in pairs.items():
        g[of[a], of[b]] += n
    return brown.likelihood(g), g


def plain_classes(texts, s):
    """Class by word of the exchange, trying each word in each class over again."""
    counts, pairs = Counter(), Counter()
    for t in texts:
        own = [w.encode() for w in t.split()]
        counts.update([*own, b""])
        pairs.update(zip([b"", *own], [*own, b""]))
    of = {w: brown.ending(w, s) if w else s.end for w in counts}
    often = sorted((w for w in counts if w and counts[w] >= s.floor), key=lambda w: (-counts[w], brown.unit_of(w, s)))
    for i, w in enumerate(often):
        of[w] = i if i < s.classes else zlib.crc32(w[-2:]) % s.classes
    seen = [plain_likelihood(pairs, of, s.end + 1)[0]]
    for turn in range(s.turns):
        new = dict(of)
        for w in often:
            if brown.unit_of(w, s) % 2 == turn % 2:
                tries = [plain_likelihood(pairs, of | {w: k}, s.end + 1)[0] for k in range(s.classes)]
                best = int(np.argmax(tries))
                new[w] = best if tries[best] > tries[of[w]] + 1e-6 else of[w]
        seen.append(plain_likelihood(pairs, new, s.end + 1)[0])
        if seen[-1] < seen[-2]:
            break
        of = new
        if turn % 2 and seen[-1] - seen[-3] < s.gain * sum(pairs.values()):
            break
    return of, counts, pairs


@pytest.mark.parametrize("known, held", [(0, 1000), (7, 0), (1000, 1000), (1000, 0)])
def test_classes_and_scores_are_those_of_a_plain_exchange(spark, known, held):
    """Whichever words are broadcast or held, classes and scores are the same."""
    texts = random_texts(3)
    small = brown.Settings(floor=5, classes=4, endings=3, known=known, held=held, gain=0.0, turns=4)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    others = ["new words w1y w0x", "w0x w0x zz zz zz w39x", "", *texts[:5]]
    model, counts = brown.train(spark, df, small)
    of, plain_counts, pairs = plain_classes(texts, small)
    got = {bytes(r.word): (r.n, r["class"]) for r in counts.collect()}
    assert got == {w: (n, of[w]) for w, n in plain_counts.items()}
    assert all(of[w] < small.classes for w, n in plain_counts.items() if w and n >= small.floor)
    assert len(model.words) == min(known, len(plain_counts) - 1) or known == 7

    g = plain_likelihood(pairs, of, small.end + 1)[1]
    shares = (g.sum(0) + 1) / (g.sum() + len(g))
    distinct = Counter(of.values())
    scored = {r.doc_id: r for r in brown.score(spark, spark.createDataFrame(list(enumerate(others)), "doc_id bigint, text string"), model, counts).collect()}
    for i, t in enumerate(others):
        want, last = 0.0, small.end
        for w in [*(x.encode() for x in t.split()), b""]:
            c = of.get(w, brown.ending(w, small))
            want += math.log10((g[last, c] + small.weight * shares[c]) / (g[last].sum() + small.weight))
            want += math.log10((plain_counts[w] + 0.5) / (g[:, c].sum() + 0.5 * (distinct[c] + 1)))
            last = c
        assert scored[i].score == pytest.approx(want, rel=1e-9)


def test_best_classes_are_those_of_trying_all():
    rng = np.random.default_rng(0)
    for n, classes, stay in ((12, 3, 0), (20, 4, 3), (30, 6, 2)):
        total = classes + stay
        counts = rng.poisson(0.8, (n, n)).astype(float) * rng.integers(1, 9, (n, n))
        of = np.append(np.arange(n - stay) % classes, classes + np.arange(stay))
        pairs = {(a, b): counts[a, b] for a in range(n) for b in range(n)}
        movable = np.arange(n - stay)
        after = np.array([np.bincount(of, counts[w], total) for w in movable])
        before = np.array([np.bincount(of, counts[:, w], total) for w in movable])
        got = brown.best_classes(of[movable], after, before, counts[movable, movable], plain_likelihood(pairs, of, total)[1], classes)
        for w in movable:
            tries = [plain_likelihood(pairs, np.where(np.arange(n) == w, k, of), total)[0] for k in range(classes)]
            assert tries[got[w]] == pytest.approx(max(tries), abs=1e-9)


def test_units_are_those_of_the_expression(spark):
    words = [b"a", b"", b"hello", "\u00e9\u6f22".encode(), b"x" * 40, *(f"w{i}".encode() for i in range(50))]
    small = brown.Settings()
    rows = spark.createDataFrame([(bytearray(w),) for w in words], "word binary").select("word", brown.unit_column(small).alias("unit"), brown.ending_column(small.endings).alias("ending"))
    for r in rows.collect():
        assert (r.unit, r.ending) == (brown.unit_of(bytes(r.word), small), brown.ending(bytes(r.word), small) - small.classes)


@pytest.mark.parametrize("room", [1 << 27, 0])
def test_scores_of_a_shard(monkeypatch, room):
    # With room, common terms are multiplied at once for all seeds; they were added one by one for each.
    monkeypatch.setattr(packing, "MATRIX_BYTES", room)
    rng, idf = np.random.default_rng(2), np.linspace(0.1, 5, 400).astype(np.float32)
    fragments = [np.minimum(rng.zipf(1.3, rng.integers(1, 300)) - 1, 399).astype(np.uint16) for _ in range(60)]
    shard = packing.Shard(fragments, idf, 120.0)
    assert (shard.base is None) == (room == 0)
    shard.unused[7] = False
    for seed in (0, 7, 59):
        got = shard.scores(seed)
        for i, f in enumerate(fragments):
            c = Counter(f.tolist())
            norm = packing.K1 * (1 - packing.B + packing.B * len(f) / 120.0)
            want = sum(float(idf[t]) * c[t] * (packing.K1 + 1) / (c[t] + norm) for t in set(fragments[seed].tolist()) if t in c)
            assert got[i] == pytest.approx(-1 if i == 7 else want, rel=1e-4)


def test_routes_are_the_rarest_shared_terms():
    rng = np.random.default_rng(9)
    frequency = rng.integers(0, 50, 500)
    order, place, alone = packing.rarity(frequency)
    for size in (0, 1, 7, 64, 65, 300, 2000):
        for ids in (rng.integers(0, 500, size).astype(np.uint16), np.repeat(rng.integers(0, 500, 9), size // 9).astype(np.uint16)):
            want = sorted({int(t) for t in ids if frequency[t] > 1}, key=lambda t: (frequency[t], t))[: packing.ROUTE_TERMS]
            assert np.frombuffer(packing.route(ids, order, place, alone), ">u4").tolist() == want


def test_neighbours_are_merged_in_one_shuffle(spark):
    # Counting pairs as rows and gathering them by word took two shuffles and most of the time of a turnless training.
    rng = random.Random(6)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(30)], k=rng.randrange(40))) for _ in range(200)]
    small = brown.Settings(endings=3)
    units = np.unique([brown.unit_of(f"w{i}".encode(), small) for i in range(20)])
    want = Counter()
    for text in texts:
        codes = brown.Codes(units, None, small)
        own = [small.endings, *[codes[w] for w in brown.words_of(text.encode())], small.endings]
        for a, b in zip(own, own[1:]):
            want[a, b, 1] += 1
            want[b, a, -1] += 1
    found = brown.neighbours(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), units, sum(want.values()), small)
    got = {(r.word, o, 1 if n > 0 else -1): abs(n) for r in found.collect() for o, n in zip(r.other, r.n)}
    assert got == dict(want)
    assert "hashpartitioning(block" in plan_of(found) and "hashpartitioning(word" not in plan_of(found)
