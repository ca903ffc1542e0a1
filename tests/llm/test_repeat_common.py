"""Strings that are common in a large table: what is left to rank by tables, and the anchors that are let through by chance."""

import random

import numpy as np

from lakewright.llm import repeats
from tests.llm.test_similar_repeats import plain_repeats


def test_common_line_is_ranked_once(spark, monkeypatch):
    # All strings of a common line were ranked by tables for each of its places, and each text was looked at alone, twice, to find them.
    monkeypatch.setattr(repeats, "HELD", 50)
    rng, ranked, rerank = random.Random(6), [], repeats.rerank

    def prose(n):
        return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))

    def counted(frame, keys):
        ranked.append(frame.count())
        return rerank(frame, keys)

    monkeypatch.setattr(repeats, "rerank", counted)
    line = prose(110)
    docs = [(i // 2, f"{prose(60)}\n{line}") for i in range(300)] + [(500, line * 3), (501, None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = sorted(tuple(r) for r in repeats.remove_repeats(spark, df).drop("kept").collect())
    assert got == plain_repeats(docs) and sum(r[2] > 0 for r in got) > 295
    assert 0 < ranked[0] < 55 * len(docs)  # 67 before


def test_bitmap_lets_few_others_through(spark):
    # One bit for each shared anchor let one in 24 others through, which were most of the rows of the doubling.
    rng = np.random.default_rng(2)
    shared, others = (rng.integers(97, 123, 400_000).astype(np.uint8) for _ in range(2))
    df = spark.createDataFrame([(shared.tobytes().decode(),)] * 2, "text string")
    bitmap, hot = repeats.shared_bitmap(df, 50, 30)

    def found(text):
        return repeats.in_bitmap(bitmap, repeats.places(np.unique(repeats.anchors(text, 50, 30))))

    assert found(shared).all() and found(others).mean() < 0.01 and not len(hot)
    assert not repeats.in_bitmap(bitmap, np.zeros(0, np.int64)).any()
