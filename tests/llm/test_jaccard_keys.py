"""Similar sets share a key, and unlike ones that share single shingles are not searched together."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakewright.llm import jaccard
from lakewright.llm.common import staged


@pytest.mark.parametrize("percent", [50, 70, 80, 90, 95])
def test_similar_sets_share_a_key(percent):
    random = np.random.default_rng(percent)
    for n in [*range(1, 40), 100, 400]:
        for _ in range(40):
            a = np.unique(random.integers(0, 1 << 63, n).astype(np.uint64))
            lost = random.integers(0, max(1, (100 - percent) * n // 100 + 1))
            more = ((100 - percent) * n - 100 * lost) // percent
            kept = random.permutation(a)[lost:]
            b = np.unique(np.append(kept, random.integers(0, 1 << 63, max(0, more)).astype(np.uint64)))
            both = len(np.intersect1d(a, b))
            assert 100 * both >= percent * (len(a) + len(b) - both)
            assert np.array_equal(a, b) or len(np.intersect1d(jaccard.keys(a, percent), jaccard.keys(b, percent)))


def grouped(spark, monkeypatch, docs):
    """Members of the largest group that is searched, and the classes."""
    sizes, group_links = [0], jaccard.group_links

    def noted(sets, percent, members):
        sizes.extend(r["count"] for r in members.groupBy("label").count().collect())
        return group_links(sets, percent, members)

    monkeypatch.setattr(jaccard, "group_links", noted)
    classes = jaccard.jaccard_classes(spark, spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)).collect()
    return max(sizes), {r.doc_id: r.component_id for r in classes}


def test_shared_shingles_do_not_join_unlike_texts(spark, monkeypatch):
    # Text k is half of passages that text k + 1 has too, so that all are connected by single shingles.
    passage = [" ".join(f"p{k}w{i}" for i in range(60)) for k in range(21)]
    docs = [(k, f"{passage[k]} x{k} {passage[k + 1]}") for k in range(20)] + [(100, f"{passage[7]} x7 {passage[8]} end")]
    largest, classes = grouped(spark, monkeypatch, docs)
    assert largest < 10
    assert classes == {k: k for k in range(20)} | {100: 7}


def test_missing_ids_are_not_paired_with_each_other(spark):
    texts = [" ".join(f"w{i}" for i in range(40 + k)) for k in range(12)]
    docs = spark.createDataFrame([(None, t) for t in texts] + [(1, "other words here"), (1, texts[0] + " y")], "doc_id bigint, text string")
    every = jaccard.sets_of(docs, "doc_id", "text", 3, 90).select(F.col("doc_id").alias("least"), "fp")
    wanted = staged(spark, every.withColumn("node", F.monotonically_increasing_id()), "wanted")
    rows = jaccard.texts_of(docs, "doc_id", "text", wanted, 3).collect()
    assert len(rows) == 14 and len({r.node for r in rows}) == 14
