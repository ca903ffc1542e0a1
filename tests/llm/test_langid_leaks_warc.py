"""Language identification, decontamination and WARC against plain Python."""

import gzip
import hashlib
import io
import os
import re
import time
import zlib

import numpy as np
import pytest

from lakewright.llm import decontaminate, langid, warc
from lakewright.llm.common import staged
from lakewright.llm.queries import QUERIES
from lakewright.session import new_path
from tests.conftest import SMALL

FOLDER = SMALL.replace("0.001", "0.01")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_language_of_documents(spark):
    got = {r.doc_id: r for r in QUERIES["op1_language_id"](spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert len(got) == len(docs)
    right = total = 0
    for d in docs:
        r = got[d.doc_id]
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        if r.held_out and d.lang:
            total += 1
            right += r.lang_pred == d.lang
    assert total > 200 and right / total > 0.95, (right, total)


def brute_ngrams(text, settings):
    padded = f" {text.lower()} "
    return sum(max(0, len(padded) - n + 1) for n in settings.orders)


def test_ngrams_across_chunks(monkeypatch):
    texts = ["abc", None, "", "x" * 50, "é", "hello world, this is long"]
    settings = langid.Settings()
    whole = [np.sort(np.concatenate([b[o == i] for o, b in langid.ngrams(texts, settings)])) for i in range(len(texts))]
    assert [len(w) for w in whole] == [brute_ngrams(t, settings) if t else 0 for t in texts]
    monkeypatch.setattr(langid, "CHUNK", 7)
    again = [np.sort(np.concatenate([b[o == i] for o, b in langid.ngrams(texts, settings)])) for i in range(len(texts))]
    assert all(np.array_equal(a, b) for a, b in zip(whole, again))


def test_language_edge_cases(spark):
    rows = [(1, "le chat et la maison", "fr"), (2, "the cat and the house", "en"), (3, None, "en"), (4, "12 34 !", None), (5, "the " * 50_000, None), (6, "", "fr"), (6, "", "fr")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "'x' AS score")
    model = langid.train(df)
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(df, model).collect()]
    assert [(i, p) for i, p, _ in got] == [(1, "fr"), (2, "en"), (3, "und"), (4, "und"), (5, "en"), (6, "und"), (6, "und")]
    assert all(s == 0 for _, p, s in got if p == "und")
    nothing = langid.train(df.limit(0))
    assert nothing.languages == () and {r.lang_pred for r in langid.predict(df, nothing).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        langid.train(df, langid.Settings(max_languages=1))


def plain_words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_contamination(docs, items, window=10):
    out = []
    windows = {}
    for item, text in items:
        w = plain_words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    for doc, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                own = windows.get(tuple(w[i : i + n]))
                if own:
                    hit.update(range(i, i + n))
                    found |= own
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return sorted(out, key=str)


def test_contamination_of_documents(spark):
    got = sorted((tuple(r) for r in QUERIES["op3_decontamination"](spark, FOLDER).collect()), key=str)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert got == plain_contamination(docs, items)
    assert any(r[5] for r in got)


def test_contamination_edge_cases(spark, monkeypatch):
    ten = "One two THREE four five six seven eight nine ten"
    items = [(1, ten), (2, "short item"), (3, None), (4, "!!"), (5, "a a a a a a a a a a a a"), (5, "a a a a a a a a a a a a"), (10, ten + " eleven é"), (None, "null id")]
    docs = [
        (1, f"x {ten.lower()}, y"),
        (2, "short, ITEM! short item"),
        (3, None),
        (4, ""),
        (5, "a " * 30 + "b " + "a " * 9),
        (6, f"{ten} eleven É"),
        (6, f"{ten} eleven é"),
        (7, "one two three four five six seven eight nine nine ten"),
        (None, "null" + "\x00" * 3 + "id"),
        (8, "z " * 60_000 + ten),
    ]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS item_id", "2 AS term")
    b = spark.createDataFrame(items, "item_id bigint, text string")

    def run(d, b):
        rows = decontaminate.contamination(spark, d, b).collect()
        return sorted(((r.doc_id, r.n_words, r.n_hit, len(r.items), sha(",".join(r["items"])), r.n_hit > 0) for r in rows), key=str)

    assert run(d, b) == plain_contamination(docs, items)
    monkeypatch.setattr(decontaminate, "BATCH_BYTES", 16)
    monkeypatch.setattr(decontaminate.term_blocks, "__defaults__", (60,))
    assert run(d, b) == plain_contamination(docs, items)
    assert run(d.limit(0), b) == [] and run(d, b.limit(0)) == plain_contamination(docs, [])


def test_repetitive_text_takes_time_in_proportion(spark):
    """One word fills a document and an item: every place starts an alignment."""
    items = spark.createDataFrame([("i", "the " * 12)], "item_id string, text string")
    took = {}
    for n in (20_000, 200_000):
        docs = spark.createDataFrame([(1, "the " * n), (2, "other words")], "doc_id bigint, text string")
        start = time.perf_counter()
        got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.contamination(spark, docs, items).collect()}
        took[n] = time.perf_counter() - start
        assert got == {1: (n, n, ["i"]), 2: (2, 0, [])}
    assert took[200_000] < 12 * took[20_000] + 10


def test_places_are_counted_by_the_number_of_their_seed(spark, monkeypatch):
    plans = {}

    def spy(session, df, label):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString()
        return staged(session, df, label)

    monkeypatch.setattr(decontaminate, "staged", spy)
    docs = spark.createDataFrame([(1, "a b c d"), (2, "x a b c")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "a b c")], "item_id bigint, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.contamination(spark, docs, items).collect())
    assert got == [(1, 4, 3, ["7"]), (2, 4, 3, ["7"])]
    counted = [line for line in plans["alignments"].splitlines() if "count(1)" in line]
    assert counted and not any("item" in line for line in counted)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red q green q blue"), (2, "red q q q q green blue"), (3, "red green"), (4, "blue")], "doc_id bigint, text string")
    items = decontaminate.item_terms(spark.createDataFrame([(9, "blue green red red")], "item_id bigint, text string"))
    vocabulary = sorted(bytes(r.term) for r in items.select("term").distinct().collect())
    index = staged(spark, decontaminate.build_index(docs, vocabulary), "postings")
    numbers = spark.createDataFrame([(bytearray(t), n) for n, t in enumerate(vocabulary)], "term binary, number int")
    numbered = items.join(numbers, "term").selectExpr("item", "item_id", "i", "number AS term", "length")

    def ids(span, share):
        found = decontaminate.proximity_matches(index, numbered, span, share)
        return sorted(r.doc_id for r in found.join(index.filter("doc_id IS NOT NULL"), "doc").collect())

    assert ids(5, 1.0) == [1] and ids(7, 1.0) == [1, 2] and ids(5, 0.6) == [1, 2, 3]


def plain_pages(pages):
    best = {}
    for i, html in pages:
        data = (html or "").encode()
        if len(data) >= 1000:
            best[data] = max(best.get(data, i), i)
    out = []
    for i, html in pages:
        data = (html or "").encode()
        target = best.get(data, i)
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if target == i else "revisit", None if target == i else target))
    return sorted(out, key=str)


def test_pages_round_trip(spark):
    got = sorted((tuple(r) for r in QUERIES["op4_warc"](spark, FOLDER).collect()), key=str)
    assert got == plain_pages([(r.page_id, r.html) for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()])


PAGES = [
    (1, "http://a/\r\nX: y", "é" * 600),
    (2, None, "é" * 600),
    (9, "u", "é" * 600),
    (3, "v", "a" * 999),
    (4, "w", "a" * 999),
    (5, "x", None),
    (6, "", ""),
    (7, "z", "WARC/1.1\r\n\r\n" * 100_000),
    (7, "z", "WARC/1.1\r\n\r\n" * 100_000),
]


@pytest.fixture
def archive(spark):
    path = new_path(spark, "warc")
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").selectExpr("*", "1 AS id", "2 AS payload")
    warc.write_warc(spark, warc.page_records(df), path)
    return path


def test_warc_records(spark, archive):
    rows = {r.record_id: r for r in warc.read_warc(spark, archive).collect()}
    assert len(rows) == 8 and warc.read_warc(spark, archive).count() == 9
    assert rows["urn:page:1"].refers_to == rows["urn:page:2"].refers_to == "urn:page:9"
    assert rows["urn:page:1"].payload is None and rows["urn:page:1"].payload_bytes == 1200 and rows["urn:page:1"].target_uri == "http://a/ X: y"
    assert rows["urn:page:9"].payload.decode() == "é" * 600 and rows["urn:page:2"].target_uri is None
    assert rows["urn:page:3"].record_type == rows["urn:page:4"].record_type == "response"
    assert rows["urn:page:5"].payload_bytes == 0 and rows["urn:page:7"].payload.decode() == PAGES[7][2]
    empty = new_path(spark, "warc")
    warc.write_warc(spark, warc.page_records(spark.createDataFrame([], "page_id bigint, url string, html string")), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_warc_pushdown_skips_payloads(spark, archive, monkeypatch):
    df = warc.read_warc(spark, archive).filter("record_type = 'revisit' AND target_uri LIKE 'http%' AND payload_bytes > 5")
    assert [r.record_id for r in df.collect()] == ["urn:page:1"]
    reader = warc.WarcReader({"path": archive})
    tests = [warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload_bytes",), 5)]
    assert list(reader.pushFilters(tests)) == tests[1:]
    read = []

    class Counting(warc._From):
        def readinto(self, buffer):
            n = super().readinto(buffer)
            read.append(n)
            return n

    monkeypatch.setattr(warc, "_From", Counting)
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    size = sum(os.path.getsize(os.path.join(archive, f)) for f in os.listdir(archive) if f.startswith("part-"))
    assert len(rows) == 2 and sum(read) < size / 2


def test_gzip_members_are_inflated_only_as_far_as_needed():
    data = b"head" * 10 + os.urandom(1 << 20)
    member = warc.gzip_member(data)
    assert gzip.decompress(member) == data and warc.member_length(member[: warc.SKIP.size]) == len(member)
    assert warc.member_length(gzip.compress(data)[: warc.SKIP.size]) is None
    source = io.BytesIO(member[warc.SKIP.size :])
    stream = io.BufferedReader(warc._Inflate(source, len(member) - warc.SKIP.size - 8), 1 << 12)
    assert stream.read(40) == data[:40] and source.tell() < 100_000
    assert stream.read() == data[40:]


def test_warc_splits_and_foreign_archives(spark, archive, monkeypatch):
    pieces = warc.WarcReader({"path": archive, "splitbytes": "1"}).partitions()
    assert len(pieces) == len([f for f in os.listdir(archive) if f.startswith("part-")])
    whole = b"".join(open(os.path.join(archive, f), "rb").read() for f in sorted(os.listdir(archive)) if f.startswith("part-"))
    other = new_path(spark, "foreign")
    os.makedirs(other)
    with open(f"{other}/a.warc.gz", "wb") as out:
        out.write(gzip.compress(whole[:0]) + gzip.compress(whole))
    assert warc.read_warc(spark, other).filter("record_type = 'response'").count() == 7
    assert warc.read_warc(spark, other, payload="false").filter("payload IS NOT NULL").count() == 0
    zipped = new_path(spark, "warc")
    warc.write_warc(spark, warc.page_records(spark.createDataFrame(PAGES, "page_id bigint, url string, html string")), zipped, compression="gzip", fileBytes="5000")
    assert warc.read_warc(spark, zipped).count() == 9
    warc.write_warc(spark, warc.page_records(spark.createDataFrame(PAGES[:1], "page_id bigint, url string, html string")), zipped, mode="overwrite")
    assert warc.read_warc(spark, zipped).count() == 1
