"""Neighbours from the whole corpus, scored by all terms of the seed."""

import numpy as np

from lakewright.llm import packing


def test_related_documents_of_other_partitions_are_neighbours(spark):
    rng, vocabulary, pairs = np.random.default_rng(2), 4000, 40
    # Two documents of a pair share ten rare terms; one is in the first half of the files, the other in the second.
    halves = [[], []]
    for i in range(pairs):
        for half in halves:
            half.append(np.concatenate([np.arange(3000 + 10 * i, 3010 + 10 * i), rng.integers(0, 200, 239), [1]]).astype("<u2"))
    docs = halves[0] + halves[1]
    frequency = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=vocabulary)
    rows = [(i, len(d), bytearray(d.tobytes())) for i, d in enumerate(docs)] + [(None, None, bytearray(frequency.astype("<i8").tobytes()))]
    tokens = spark.createDataFrame(rows, "doc_id bigint, n bigint, ids binary").repartitionByRange(2, "doc_id")
    got = packing.pack(tokens, vocabulary, 512, 5000).collect()
    assert sum(p.length for p in got) == sum(map(len, docs))
    own = [{p.sequence_id for p in got if p.doc_id == i} for i in range(len(docs))]
    together = sum(bool(own[i] & own[i + pairs]) for i in range(pairs))
    assert together >= 0.9 * pairs, together


def test_scores_are_bm25_of_all_terms():
    rng = np.random.default_rng(4)
    docs = [rng.choice(300, rng.integers(40, 150), p=np.arange(300, 0, -1) / 45150) for _ in range(60)]
    frequency = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=300)
    idf, mean = np.log1p((60 - frequency + 0.5) / (frequency + 0.5)).astype(np.float32), float(np.mean([len(d) for d in docs]))
    shard = packing.Shard(docs, idf, mean)

    def bm25(seed, other):
        total = 0.0
        for t in np.unique(docs[seed]):
            n = int((docs[other] == t).sum())
            total += idf[t] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(docs[other]) / mean))
        return total

    for seed in (0, 7, 59):
        assert len(np.unique(docs[seed])) > 24
        assert np.allclose(shard.scores(seed), [bm25(seed, i) for i in range(60)], rtol=1e-4)


def test_ids_once_without_a_sort():
    random, place = np.random.default_rng(5), np.zeros(300, np.int32)
    for n in (0, 1, 2, 50, 2000):
        ids = random.integers(0, 300, n).astype(np.uint32)
        assert sorted(packing.each_once(ids, place).tolist()) == np.unique(ids).tolist()
