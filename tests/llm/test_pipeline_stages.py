"""The stages of the pipeline against plain Python, row by row."""

import re

import numpy as np

import corpus_pipeline
from lakewright.llm import packing
from lakewright.llm.queries import tokenizer
from tests.conftest import SMALL


def plain_shingles(text, width=5):
    words = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain_classes(texts, width=5, percent=80):
    """Class number of each text; a text without words is alone."""
    sets, parent = [plain_shingles(t, width) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(texts))]


def plain_near_copies(docs):
    """Of each class the row with the smallest id, missing ids last."""
    best = {}
    for c, d in zip(plain_classes([d.text for d in docs]), docs):
        at = (d.doc_id is None, d.doc_id or 0)
        if c not in best or at < best[c][0]:
            best[c] = (at, d)
    return [d for _, d in best.values()]


def test_near_copies_share_four_fifths_of_five_words(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = sorted(d.doc_id for d in plain_near_copies(docs.collect()))
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SMALL).collect()) == want
    words = [f"w{i}" for i in range(100)]
    # Two words changed near each other: 5-word Jaccard 90 / 102; three apart: 81 / 111.
    near, far = list(words), list(words)
    near[50], near[51] = "x", "y"
    far[20], far[50], far[80] = "x", "y", "z"
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, SMALL).collect()) == [1, 3]


def family(seed, edits=0):
    words = [f"{seed}{i}" for i in range(60)]
    for i in range(edits):
        words[30 + i] = f"new{seed}{i}"
    return " ".join(words)


ODD = [
    (None, family("a")),
    (None, family("b")),
    (None, family("b", 1)),
    (1, family("c")),
    (1, family("d")),
    (2, family("d", 1)),
    (3, family("d", 2)),
    (None, family("c", 1)),
    (4, family("e")),
    (4, family("e")),
    (5, ""),
    (None, None),
    (6, "token=abcdef12 one"),
    (6, "nothing to hide here"),
    (None, "password=hunter2222 two"),
    (None, "plain words only"),
]


def odd_documents(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def pairs(rows):
    return sorted(((r[0], r[1]) for r in rows), key=str)


def test_near_copies_without_row_ids(spark):
    docs = odd_documents(spark)
    got = corpus_pipeline.drop_near_copies(spark, docs, SMALL)
    assert got.columns == docs.columns
    assert pairs(got.collect()) == pairs(plain_near_copies(docs.collect()))


def test_classes_without_row_ids(spark):
    docs = odd_documents(spark)
    rows = docs.collect()
    least = {}
    numbers = plain_classes([r.text for r in rows], 3, 90)
    for c, r in zip(numbers, rows):
        least[c] = min((x for x in (least.get(c), r.doc_id) if x is not None), default=None)
    want = [(r.doc_id, len(plain_shingles(r.text, 3)), least[c]) for c, r in zip(numbers, rows)]
    assert sorted(map(tuple, corpus_pipeline.jaccard.jaccard_classes(spark, docs).collect()), key=str) == sorted(want, key=str)


def test_decontamination_without_row_ids(spark, monkeypatch):
    leak = " ".join(f"q{i}" for i in range(12))
    items = spark.createDataFrame([(1, leak)], "item_id bigint, text string")
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: items)
    hit = spark.createDataFrame([(None, f"x {leak} y", "en", "s", 1), (1, leak, "en", "s", 1)], odd_documents(spark).schema)
    got = corpus_pipeline.drop_contaminated(spark, odd_documents(spark).unionByName(hit), SMALL)
    assert pairs(got.collect()) == pairs(ODD)


def test_secrets_without_row_ids(spark):
    docs = odd_documents(spark)
    want = [(i, (t or "").replace("token=abcdef12", "[REDACTED]").replace("password=hunter2222", "[REDACTED]") if t is not None else None) for i, t in ODD]
    got = corpus_pipeline.redact_secrets(spark, docs, SMALL).collect()
    assert pairs(got) == pairs(want) and all(r.n_chars == len(r.text or "") for r in got)


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_windows(text, window=10):
    words = plain_words(text)
    return {tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))} if words else set()


def plain_clean(docs, items):
    """Documents without a window of an item; a shorter item is one window."""
    leaks = set().union(*[plain_windows(t) for t in items])
    out = []
    for d in docs:
        words = plain_words(d.text)
        own = {tuple(words[i : i + n]) for n in {len(x) for x in leaks} for i in range(len(words) - n + 1)}
        if not own & leaks:
            out.append(d)
    return out


def plain_redacted(text):
    spans = [m.span() for m in re.finditer(r"(?i:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", text, re.A) if len(m[1]) >= 6]
    spans += [m.span() for m in re.finditer(r"AKIA[A-Z0-9]{16,}", text)] + [m.span() for m in re.finditer(r"[0-9a-f]{24,}", text)]
    spans += [m.span() for m in re.finditer(r"-----BEGIN [A-Z ]*PRIVATE KEY-----", text)]
    spans += [m.span() for m in re.finditer(r"[a-z][a-z0-9+.-]*://[^\s:/@]+:([^\s:/@]+)@", text, re.A) if len(m[1]) >= 6]
    out, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            out += text[at:a] + "[REDACTED]"
        at = max(at, b)
    return out + text[at:]


def test_stages_of_documents(spark):
    folder = SMALL.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = docs.collect()
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = plain_clean(rows, items)
    assert sorted(map(tuple, corpus_pipeline.drop_contaminated(spark, docs, folder).collect())) == sorted(map(tuple, clean)) and len(clean) < len(rows)
    got = {r.doc_id: r for r in corpus_pipeline.redact_secrets(spark, docs, folder).collect()}
    want = {d.doc_id: plain_redacted(d.text) for d in rows}
    assert {i: r.text for i, r in got.items()} == want and any(d.text != want[d.doc_id] for d in rows)
    assert all(got[d.doc_id].n_chars == (len(want[d.doc_id]) if d.text != want[d.doc_id] else d.n_chars) for d in rows)
    small = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert sorted(map(tuple, corpus_pipeline.drop_near_copies(spark, small, SMALL).collect())) == sorted(map(tuple, plain_near_copies(small.collect())))


ENGLISH = "the old house near the river was sold to a young family that wanted more room for their children and the dog"
FRENCH = "la vieille maison de la rue fut vendue avec son jardin et les arbres par une famille qui voulait vivre dans le sud"


def test_run_of_a_small_corpus(spark, tmp_path):
    leak = "what is the name of the river that flows past the old house near the town"
    rows = [(None if i % 9 == 4 else 100 + i, f"{x} {' '.join(f'{w}{chr(97 + i)}' for w in x.split())}", lang) for i, (x, lang) in enumerate([(ENGLISH, "en"), (FRENCH, "fr")] * 5)]
    rows += [(7, rows[0][1], "en"), (8, rows[1][1] + " fin", "fr"), (300, "12 34 !", None), (301, "", None), (302, None, "en")]
    rows += [(303, f"{ENGLISH.upper()} {leak} again", "en"), (304, f"the secret=abcdefgh1 of {leak[:20]} was told to the children", "en")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    told = [d for d in docs.collect() if re.search("[a-z]", d.text or "", re.I)]
    got = corpus_pipeline.identify_language(spark, docs, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, told), key=str)
    want = sorted(((d.doc_id, plain_redacted(d.text)) for d in plain_clean(plain_near_copies(told), [leak])), key=str)
    assert any("[REDACTED]" in t for _, t in want) and 303 not in [i for i, _ in want] and any(i is None for i, _ in want)
    model = packing.Encoder(tokenizer()[0]).model
    # No text is cut over sequences in a way that splits it: pieces of one text follow each other by start.
    pieces = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda p: (str(p.doc_id), p.doc_tokens, p.start))
    ids = [(p.doc_id, p.start, p.doc_tokens, np.frombuffer(p.ids, "<u4").tolist()) for p in pieces]
    texts, held = [], []
    for doc, start, total, own in ids:
        held += own
        if len(held) == total:
            texts.append((doc, model.decode(held[:-1])))
            held = []
    assert not held and sorted(texts, key=str) == want
