"""What tells that a set has partners grows with the shingles, not with sets times ranges."""

import numpy as np
import pytest

from lakewright.llm import jaccard
from lakewright.llm.common import staged
from tests.conftest import plan_of


def sets_of_texts(spark, texts, percent):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    found = jaccard.sets_of(docs, "doc_id", "text", 3, percent).filter("n > 0").withColumnRenamed("doc_id", "least")
    return staged(spark, found.selectExpr("least AS node", "n", "fp", "prefix", "least"), "sets")


def texts():
    random = np.random.default_rng(5)
    words = [[f"w{w}" for w in random.integers(0, 4000, n)] for n in [1, 2, 5, *random.integers(20, 400, 60)]]
    near = [w[: len(w) // 2] + ["new"] + w[len(w) // 2 :] for w in words[::3]]
    return [" ".join(w) for w in [*words, *near]]


@pytest.mark.parametrize("values", [64, 1 << 19])
@pytest.mark.parametrize("percent", [80, 90])
def test_sets_with_enough_shared_shingles_are_kept(spark, monkeypatch, values, percent):
    monkeypatch.setattr(jaccard, "RANGE_VALUES", values)
    sets = sets_of_texts(spark, texts(), percent)
    rows = {r.node: (r.n, np.frombuffer(r.prefix, np.uint64)) for r in sets.collect()}
    value, times = np.unique(np.concatenate([p for _, p in rows.values()]), return_counts=True)
    shared = value[times > 1]
    enough = {k for k, (n, p) in rows.items() if np.isin(p, shared).sum() >= jaccard.extra(jaccard.needed(n, percent))}
    kept = {r.node for r in jaccard.with_partners(sets, percent).select("node").collect()}
    assert 20 < len(enough) < len(rows) and enough <= kept and len(kept - enough) <= 2


def test_ranges_answer_with_a_row_each(spark, monkeypatch):
    # They sent a count for each set and range before, up to one for each shared shingle.
    monkeypatch.setattr(jaccard, "RANGE_VALUES", 64)
    sizes, write = {}, jaccard.staged

    def noted(session, df, label):
        out = write(session, df, label)
        sizes[label] = out.count()
        return out

    monkeypatch.setattr(jaccard, "staged", noted)
    sets = sets_of_texts(spark, texts(), 90)
    ranges = jaccard.ranges_for(sum(r.n for r in sets.collect()) * jaccard.prefix_length(1000, 90) / 1000)
    kept = jaccard.with_partners(sets, 90)
    assert 8 <= ranges and sizes["shared-shingles"] <= ranges
    assert not {"FlatMapGroupsInPandas", "Exchange", "Join"} & set(plan_of(kept).replace("(", " ").split())


def test_no_sets_have_no_partners(spark):
    assert jaccard.with_partners(sets_of_texts(spark, ["", None], 90), 90).collect() == []


def test_a_full_bitmap_loses_no_set(spark, monkeypatch):
    sets = sets_of_texts(spark, texts(), 90)
    whole = {r.node for r in jaccard.with_partners(sets, 90).collect()}
    monkeypatch.setattr(jaccard, "BITMAP_BITS", 8)
    kept = {r.node for r in jaccard.with_partners(sets, 90).collect()}
    assert whole < kept
