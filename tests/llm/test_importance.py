"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from lakewright.llm import importance
from lakewright.llm.queries import QUERIES
from tests.conftest import SMALL

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return [zlib.crc32(f.encode()) % 10000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]], len(words)


def plain_resample(rows, target):
    features = [plain_features(t) for _, t in rows]
    s, t = Counter(b for f, _ in features for b in f), Counter(b for x in target for b in plain_features(x)[0])
    whole, wanted = sum(s.values()) + 10000, sum(t.values()) + 10000

    def gain(b):
        return math.floor(1000 * math.log(((t[b] + 1) * whole) / ((s[b] + 1) * wanted)))

    out = []
    for (i, _), (f, n) in zip(rows, features):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= 20])
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = len(order) * 25 // 100
    places = [(r, n + 1 if n < drawn else None) for n, r in enumerate(order)] + [(r, None) for r in out if not r[4]]
    return sorted(((*r[:4], n) for r, n in places), key=str)


def told(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


def test_whole_tables(spark):
    folder = SMALL.replace("0.001", "0.01")
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = told(QUERIES["op12_importance_resampling"](spark, folder))
    assert got == plain_resample(docs, target)
    assert sum(r[4] is not None for r in got) > 200


ODD = [
    (1, "word " * 30),
    (1, "word " * 30),
    (None, "Éa b_c " * 20),
    (2, None),
    (3, ""),
    (4, "., ;"),
    (5, "x" * 100_000 + " y " + "z" * 700),
    (6, "a b c d e f g h i j k l m n o p q r s t u v " * 3),
    (7, "one"),
]


def test_odd_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in ODD], "doc_id bigint, text string, key int, buckets int")
    target = spark.createDataFrame([("a b c", 1), (None, 2)], "text string, key int")
    got = told(importance.resample(spark, df, target))
    assert got == plain_resample(ODD, ["a b c"])
    assert importance.resample(spark, df.limit(0), target).count() == 0
    assert told(importance.resample(spark, df, target.limit(0))) == plain_resample(ODD, [])


@pytest.mark.parametrize("block", [1 << 22, 64, 7])
def test_blocks_cut_no_feature(monkeypatch, block):
    monkeypatch.setattr(importance, "BLOCK", block)
    rnd = random.Random(1)
    texts = ["", "a", "  Éa b,c__D", " x " * 50, "w" * 1000 + " b"] + ["".join(rnd.choice("ab Éc9,\0") for _ in range(rnd.randint(0, 300))) for _ in range(200)]
    got = list(importance.text_buckets([t.encode() for t in texts]))
    assert [sorted(g.tolist()) for g in got] == [sorted(plain_features(t)[0]) for t in texts]


def test_a_long_text_takes_time_in_proportion():
    text = b"lorem ipsum dolor " * 700_000
    (found,) = importance.text_buckets([text])
    assert len(found) == 2 * 2_100_000 - 1
    assert set(found.tolist()) == set(plain_features("lorem ipsum dolor lorem")[0])
