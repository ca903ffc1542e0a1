"""One large group is placed without a window over it."""

from lakewright.llm import jaccard
from tests.conftest import plan_of


def test_blocks_are_placed_without_a_window(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 10)
    words = [jaccard.shingles(" ".join(f"w{i}" for i in range(9 + k % 2)).encode()) for k in range(12)]
    rows = [(k, len(w), k % 2, bytearray(w.tobytes())) for k, w in enumerate(words)]
    sets = spark.createDataFrame(rows, "node bigint, n bigint, label bigint, tokens binary")
    found = jaccard.group_links(sets, 90)
    assert "Window" not in plan_of(found)
    parent = list(range(12))
    for r in found.collect():
        parent = [min(parent[r.a], parent[r.b]) if p in (parent[r.a], parent[r.b]) else p for p in parent]
    assert parent == [k % 2 for k in range(12)]


def test_sets_are_not_written_before_their_search(spark, monkeypatch):
    # Writing all sets, and dealing them out once more before, took a quarter of the disk of near copies.
    labels, staged = [], jaccard.staged
    monkeypatch.setattr(jaccard, "staged", lambda session, df, label: labels.append((label, df.columns)) or staged(session, df, label))
    text = " ".join(f"w{i}" for i in range(60))
    docs = [(1, text), (2, text + " x"), (None, text + " y"), (None, text + " y"), (4, text + " x"), (5, "other words")]
    got = jaccard.jaccard_classes(spark, spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 1), (0, 1), (1, 1), (2, 1), (4, 1), (5, 5)]
    assert labels and not any("tokens" in columns for _, columns in labels)


def test_equal_rows_of_a_set_are_searched_once(spark):
    words = [jaccard.shingles(" ".join(f"w{i}" for i in range(30 + k)).encode()) for k in range(3)]
    members = spark.createDataFrame([(k, len(w), 0) for k, w in enumerate(words)], "node bigint, n bigint, label bigint")
    sets = spark.createDataFrame([(k, bytearray(w.tobytes())) for k, w in enumerate(words)] * 4, "node bigint, tokens binary")
    found = {(r.a, r.b) for r in jaccard.group_links(sets, 90, members).collect()}
    assert found == {(0, 1), (0, 2)}
