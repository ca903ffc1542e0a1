"""Personal data: patterns against plain expressions, the field against enumeration, and its training."""

import hashlib
import itertools
import re
import time

import numpy as np
import pytest

from lakewright.llm import personal
from lakewright.llm.queries import QUERIES
from tests.conftest import SMALL


def plain_luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d if d < 10 else d - 9
    return total % 10 == 0


def plain_base(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and plain_luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def written(spans):
    return ",".join(f"{personal.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_documents(spark):
    folder = SMALL.replace("0.001", "0.01")
    documents = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op11_personal_data"](spark, folder).collect()}
    assert len(got) == len(documents)
    for d in documents:
        base, row = plain_base(d.text), got[d.doc_id]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(b[1] == k for b in base) for k in range(4)]
        assert row.base_sha256 == hashlib.sha256(written(base).encode()).hexdigest()
        spans = [s for s in row.spans.split(",") if s]
        assert set(written(base).split(",")) - {""} <= set(spans)
        order = [(int(s.split(":")[1]), personal.KINDS.index(s.split(":")[0])) for s in spans]
        assert order == sorted(order)
    assert sum(r.n_email + r.n_phone for r in got.values()) > 0


@pytest.mark.parametrize("seed", range(30))
def test_patterns_on_random_text(seed):
    rnd = np.random.default_rng(seed)
    alphabet = list("12340.. -+()@@aB%é_") + ["0" * 12, "1.2.3.4", "a@b.c", "+1 (2"]
    for _ in range(200):
        text = "".join(rnd.choice(alphabet, rnd.integers(0, 40)))
        assert personal.base_spans(text) == plain_base(text), text


@pytest.fixture(scope="module")
def model():
    rows = [personal.read_markup(line) for line in personal.EXAMPLES]
    return personal.fit([t for t, _ in rows], [s for _, s in rows])


def test_field_learns_its_table(model):
    rows = [personal.read_markup(line) for line in personal.EXAMPLES]
    found = personal.decoded_spans([t for t, _ in rows], model)
    right = sum(len(set(f) & set(g)) for f, (_, g) in zip(found, rows))
    assert right >= 0.9 * sum(len(g) for _, g in rows) and right >= 0.9 * sum(map(len, found))


def test_field_finds_what_no_pattern_does(model):
    text = "Please phone +1 (843) 555-7672 170.106.47.218 soon, or pay by 5500005555555559 4012888888881881 now"
    added = [s for s in personal.all_spans([text], model)[0] if not s[3]]
    assert {text[a:b] for a, _, b, _ in added} >= {"+1 (843) 555-7672", "5500005555555559", "4012888888881881"}
    clean = "The 3 of us met on 12 May 2020 at 10:30, page 17, token 9f1c2d3e4b5a69788796a5b4c3d2e1f001122334."
    assert personal.all_spans([clean], model) == [[]]


def test_viterbi_against_enumeration(model):
    texts = ["a 1 b", "x@y 7", "+1 2", "", "no trigger here", "q 5 w 6"]
    rnd = np.random.default_rng(3)
    noisy = personal.Model(model.feature + rnd.normal(0, 2, model.feature.shape), model.pair + np.where(personal.FORBIDDEN, 0, rnd.normal(0, 1, model.pair.shape)))
    tokens = personal.tokens_of(texts)
    labels = personal.viterbi(tokens, noisy)
    assert not labels[~tokens.open].any()
    for first, size in zip(*personal.chains(tokens)):
        if size > 5:
            continue
        own = noisy.feature[personal.feature_rows(tokens, np.arange(first, first + size))].sum(1)

        def score(way):
            pairs = zip((0, *way), (*way, 0))
            return sum(noisy.pair[a, b] for a, b in pairs) + sum(own[i, y] for i, y in enumerate(way))

        best = max(itertools.product(range(personal.LABELS), repeat=int(size)), key=score)
        assert score(tuple(labels[first : first + size])) == pytest.approx(score(best))


def test_training_climbs():
    rows = [personal.read_markup(line) for line in personal.EXAMPLES[:6]]
    texts, spans = [t for t, _ in rows], [s for _, s in rows]
    poor, good = personal.fit(texts, spans, rounds=1), personal.fit(texts, spans, rounds=40)
    wrong = [sum(set(f) != set(s) for f, s in zip(personal.decoded_spans(texts, m), spans)) for m in (poor, good)]
    assert wrong[1] == 0 and wrong[0] >= wrong[1]


def test_odd_rows(spark, model):
    rows = [(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "mail x@y.zz", "c"), (3, "é" * 5 + " +49 151 23456789", None), (4, "\0\0 7", "d")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    got = personal.find_personal(df.withColumn("base", df.text), model).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "text", "base", "spans"}
    by_text = {r.text: [(s.start, s.kind, s.end) for s in r.spans if s.base] for r in got}
    assert all(found == plain_base(text or "") for text, found in by_text.items())
    assert personal.find_personal(df.limit(0), model).count() == 0
    none = personal.train(spark.createDataFrame([], "text string, spans array<struct<start:bigint,kind:int,end:bigint>>"))
    assert personal.decoded_spans(["call 555-010-4477"], none) == [[]]
    assert personal.labelled_table(spark, df.limit(0)).count() == len(personal.EXAMPLES)


def test_labelled_table_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(personal, "MAX_LABELLED", 3)
    many = spark.createDataFrame([(f"{i} a", []) for i in range(5)], "text string, spans array<struct<start:bigint,kind:int,end:bigint>>")
    with pytest.raises(ValueError):
        personal.train(many)


@pytest.mark.parametrize("text", ["a" * 1_000_000, "7" * 1_000_000, "1." * 500_000, "a@" * 500_000, "+1" + "(" * 1_000_000, ".".join(["a"] * 500_000) + "@"])
def test_patterns_take_linear_time(text):
    start = time.perf_counter()
    personal.base_spans(text)
    assert time.perf_counter() - start < 10


def test_long_chain_is_decoded_whole(model):
    text = "call 555-010-4477 or " * 4_000
    found = personal.decoded_spans([text], model)[0]
    assert len(found) >= 3_900
