"""Personal data: exact patterns, and a linear-chain conditional random field for what they miss.

The field labels tokens (runs of ASCII letters and digits, runs of other letters, single marks) with the begin and inside of
four kinds, or as outside. Its features are word shapes, the gaps between tokens and a few flags, each at several offsets. It
is trained on the driver from a small labelled table, of at most ``MAX_LABELLED`` rows, by maximum likelihood with
forward-backward sums, and broadcast. Tasks cut whole texts into tokens in numpy and decode many chains together by Viterbi.

A token can be labelled only within ``REACH`` tokens of one with a digit or an ``@``; all others are outside, in training as
in decoding. As the labels of those are fixed, the chain falls apart there without loss, and a text costs little where it
has no such token. A decoded span is kept if it overlaps no span of a pattern and could be of its kind (``plausible``).

Edge cases: a missing text counts as empty; a text of any length is one chain of pieces as above; patterns take linear time on
long runs; repeated rows are scanned each; with an empty labelled table only patterns count; an empty table gives an empty
result; other columns pass through, and one named like the result is replaced.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewright.llm.common import batches

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<start:bigint,kind:int,end:bigint,base:boolean>>"
MAX_LABELLED = 20_000
SAMPLE, SAMPLE_CHARS = 400, 1_000  # lines taken from the corpus for the labelled table, and their greatest length
REACH = 5
BLOCK = 1 << 22  # bytes of text handled at once
CHAIN_TOKENS = 1 << 16  # tokens decoded together

# --- patterns

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
# A run of digits which fails from its first digit on fails from all others, so only that is tried.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[0::2]) + sum(2 * v - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each ``@`` back over the local part, which no other ``@`` can be in."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns: leftmost, without overlap within a kind; a match that fails its test is dropped."""
    if not TRIGGER.search(text):
        return []
    found = [(a, 0, b) for a, b in _emails(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(part.lstrip("0") == "" or len(part.lstrip("0")) < 4 and int(part) < 256 for part in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = digits_of(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(found)


# --- tokens and their features

SPACE, WORD, OTHER, MARK = range(4)
CLASS = np.array([WORD if chr(c).isalnum() else SPACE if c < 33 or c == 127 else MARK for c in range(128)], np.int8)
CUES = ("at", "dot", "phone", "tel", "telephone", "call", "fax", "mobile", "cell", "mail", "email", "card", "visa", "ip", "host", "server", "address")
SHAPES, GAPS, FLAGS = 64, 4, 4 + len(CUES)
NO_TOKEN = SHAPES - 1
SHAPE_AT, GAP_AT, FLAG_AT = range(-4, 5), range(-2, 4), range(-3, 4)
FEATURES = len(SHAPE_AT) * SHAPES + len(GAP_AT) * GAPS + len(FLAG_AT) * FLAGS
LABELS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
FORBIDDEN = np.array([[b > 0 and b % 2 == 0 and a not in (b - 1, b) for b in range(LABELS)] for a in range(LABELS)])
IMPOSSIBLE = -1e9


@dataclass(frozen=True)
class Tokens:
    """Tokens of several texts: code points ``[start, end)`` in them all joined, the text of each, and which may be labelled."""

    start: np.ndarray
    end: np.ndarray
    owner: np.ndarray
    open: np.ndarray
    shape: np.ndarray
    gap: np.ndarray
    flag: np.ndarray


def tokens_of(texts: list[str]) -> Tokens:
    joined = "\0".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ascii_ = codes < 128
    kind = np.where(ascii_, CLASS[np.where(ascii_, codes, 0)], OTHER)
    before = np.concatenate(([SPACE], kind[:-1]))
    start = np.flatnonzero((kind != SPACE) & ((kind != before) | (kind == MARK)))
    after = np.append(kind[1:], SPACE)
    end = np.flatnonzero((kind != SPACE) & ((kind != after) | (kind == MARK))) + 1
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")

    def within(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask)))
        return sums[end] - sums[start]

    size = end - start
    digits, upper = within((codes >= 48) & (codes < 58)), within((codes >= 65) & (codes < 91))
    sort = kind[start]
    first = codes[start]
    word_shape = np.select(
        [digits == size, digits > 0, upper == 0, (upper == 1) & (first >= 65) & (first < 91), upper == size],
        [np.minimum(size, 20) - 1, 29, 19 + np.minimum(size, 6), 26, 27],
        28,
    )
    mark_shape = np.zeros(128, np.int64)
    mark_shape[[ord(c) for c in string.punctuation]] = 31 + np.arange(len(string.punctuation))
    shape = np.where(sort == WORD, word_shape, np.where(sort == OTHER, 30, mark_shape[np.where(first < 128, first, 0)]))
    trigger = (digits > 0) | (first == 64)
    place = np.arange(len(start))
    # The nearest trigger on either side, if it is of the same text.
    left = np.maximum.accumulate(np.where(trigger, place, -1)) if len(start) else place
    right = np.minimum.accumulate(np.where(trigger, place, len(start))[::-1])[::-1] if len(start) else place
    near_left = (left >= 0) & (place - left <= REACH) & (owner[left] == owner) if len(start) else trigger
    near_right = (right < len(start)) & (right - place <= REACH) & (owner[np.minimum(right, len(start) - 1)] == owner) if len(start) else trigger
    opened = near_left | near_right
    between = start - np.concatenate(([0], end[:-1]))
    lines = np.concatenate(([0], np.cumsum(codes == 10)))
    broken = lines[start] > np.concatenate(([0], lines[end[:-1]])) if len(start) else trigger
    gap = np.where(between == 0, 0, np.where(broken, 2, np.where(between == 1, 1, 3)))
    flag = np.zeros(len(start), np.int64)
    for i in np.flatnonzero(opened & (sort == WORD) & ((digits == size) | (digits == 0)) & (size < 20)):
        token = joined[start[i] : end[i]]
        if digits[i]:
            flag[i] = (1 if size[i] < 4 and int(token) < 256 else 0) if size[i] < 12 else 2 if luhn(token) else 3
        elif token.lower() in CUES:
            flag[i] = 4 + CUES.index(token.lower())
    return Tokens(start, end, owner, opened, shape, gap, flag)


def feature_rows(tokens: Tokens, places: np.ndarray) -> np.ndarray:
    """Feature numbers of the tokens at the given places; neighbours beyond the text count as no token."""
    out, base = [], 0
    for values, offsets, size, none in ((tokens.shape, SHAPE_AT, SHAPES, NO_TOKEN), (tokens.gap, GAP_AT, GAPS, 2), (tokens.flag, FLAG_AT, FLAGS, 0)):
        for offset in offsets:
            at = np.clip(places + offset, 0, len(values) - 1)
            same = (places + offset == at) & (tokens.owner[at] == tokens.owner[places])
            out.append(base + np.where(same, values[at], none))
            base += size
    return np.stack(out, 1)


def chains(tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first token and number of tokens of each run that may be labelled."""
    same = np.concatenate(([False], tokens.owner[1:] == tokens.owner[:-1]))
    opened = tokens.open
    begins = opened & ~(same & np.concatenate(([False], opened[:-1])))
    ends = opened & ~np.concatenate((same[1:] & opened[1:], [False]))
    first = np.flatnonzero(begins)
    return first, np.flatnonzero(ends) - first + 1


# --- the field


@dataclass(frozen=True)
class Model:
    """Weights of features by label and of pairs of labels. Chains start after and end before a token that is outside."""

    feature: np.ndarray
    pair: np.ndarray


def _groups(sizes: np.ndarray) -> Iterator[np.ndarray]:
    order = np.argsort(sizes, kind="stable")
    start = 0
    for i in range(1, len(order) + 1):
        if i == len(order) or sizes[order[i]] > 2 * sizes[order[start]] or sizes[order[i]] * (i + 1 - start) > CHAIN_TOKENS:
            yield order[start:i]
            start = i


def _grid(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens of chains, one row a chain, and which of them exist."""
    steps = np.arange(size.max())
    exists = steps < size[:, None]
    return np.where(exists, first[:, None] + steps, first[:, None]), exists


def viterbi(tokens: Tokens, model: Model) -> np.ndarray:
    """The most probable label of every token."""
    labels = np.zeros(len(tokens.start), np.int64)
    first, size = chains(tokens)
    for group in _groups(size):
        places, exists = _grid(first[group], size[group])
        chains_, length = places.shape
        back = np.zeros((length, chains_, LABELS), np.int8)
        score = None
        for t in range(length):
            own = model.feature[feature_rows(tokens, places[:, t])].sum(1)
            if t == 0:
                score = model.pair[0] + own
                continue
            ways = score[:, :, None] + model.pair
            back[t] = ways.argmax(1)
            # A chain that has ended keeps its score.
            score = np.where(exists[:, t, None], ways.max(1) + own, score)
            back[t][~exists[:, t]] = np.arange(LABELS)
        label = (score + model.pair[:, 0]).argmax(1)
        for t in range(length - 1, -1, -1):
            labels[places[exists[:, t], t]] = label[exists[:, t]]
            label = back[t][np.arange(chains_), label] if t else label
    return labels


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def fit(texts: list[str], spans: list[list[tuple[int, int, int]]], rounds: int = 60, rate: float = 0.2, penalty: float = 0.05) -> Model:
    """Maximum likelihood by Adam with an L2 penalty; ``spans`` are (start, kind, end) in each text."""
    feature, pair = np.zeros((FEATURES, LABELS)), np.where(FORBIDDEN, IMPOSSIBLE, 0.0)
    tokens = tokens_of(texts)
    first, size = chains(tokens)
    if not len(first):
        # Nothing to learn from: outside wins everywhere.
        feature[:, 0] = 1.0
        return Model(feature, pair)
    gold = np.zeros(len(tokens.start), np.int64)
    shift = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    for number, found in enumerate(spans):
        for start, kind, end in found:
            low, high = np.searchsorted(tokens.start, [shift[number] + start, shift[number] + end])
            gold[low:high] = 2 + 2 * kind
            gold[low : low + 1] = 1 + 2 * kind
    # Longest chains first: those that reach a step are a prefix of all.
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    places, exists = _grid(first, size)
    rows = feature_rows(tokens, places[exists])
    want = np.where(exists, gold[places], 0)
    n, length = places.shape
    last, chain = size - 1, np.arange(n)
    reach = [int((size > t).sum()) for t in range(length)]
    moments = [np.zeros_like(feature), np.zeros_like(feature), np.zeros_like(pair), np.zeros_like(pair)]
    seen_pair = np.zeros_like(pair)
    np.add.at(seen_pair, (0, want[:, 0]), 1)
    np.add.at(seen_pair, (want[chain, last], 0), 1)
    for t in range(1, length):
        np.add.at(seen_pair, (want[: reach[t], t - 1], want[: reach[t], t]), 1)
    own = np.zeros((n, length, LABELS))
    ahead, behind = np.zeros((length, n, LABELS)), np.zeros((length, n, LABELS))
    for step in range(1, rounds + 1):
        own[exists] = feature[rows].sum(1)
        ahead[0] = pair[0] + own[:, 0]
        for t, a in enumerate(reach[1:], 1):
            ahead[t, :a] = _log_sum(ahead[t - 1, :a, :, None] + pair, 1) + own[:a, t]
        total = _log_sum(ahead[last, chain] + pair[:, 0], 1)
        behind[:] = pair[:, 0]
        expected = np.zeros_like(pair)
        for t in range(length - 1, 0, -1):
            a = reach[t]
            ways = pair + (own[:a, t] + behind[t, :a])[:, None, :]
            expected += np.exp(ahead[t - 1, :a, :, None] + ways - total[:a, None, None]).sum(0)
            behind[t - 1, :a] = _log_sum(ways, 2)
        share = np.exp(ahead + behind - total[:, None]).transpose(1, 0, 2)
        expected[0] += share[:, 0].sum(0)
        expected[:, 0] += share[chain, last].sum(0)
        share[chain[:, None], np.arange(length), want] -= 1
        slope = np.zeros_like(feature)
        np.add.at(slope, rows.ravel(), np.repeat(share[exists], rows.shape[1], 0))
        slopes = (slope + penalty * feature, np.where(FORBIDDEN, 0.0, expected - seen_pair + penalty * pair))
        for i, (weights, g) in enumerate(zip((feature, pair), slopes)):
            mean, square = moments[2 * i], moments[2 * i + 1]
            mean += 0.1 * (g - mean)
            square += 0.001 * (g * g - square)
            weights -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Model(feature, pair)


def plausible(kind: int, text: str) -> bool:
    """Whether a decoded span could be of its kind at all."""
    digits = digits_of(text)
    if len(text) > (254 if kind == 0 else 60):
        return False
    if kind == 0:
        return "." in text[1:-1] and ("@" in text[1:-1] or re.search(r"\bat\b", text) is not None) or re.search(r"\bat\b.*\bdot\b", text) is not None
    if kind == 1:
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) < 4 and int(p) < 256 for p in parts)
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15


def decoded_spans(texts: list[str], model: Model) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of the spans the field finds in each text."""
    tokens = tokens_of(texts)
    labels = viterbi(tokens, model)
    shift = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    begins = np.flatnonzero(labels % 2 == 1)
    # A span ends before the first token after its begin that is not inside.
    stops = np.flatnonzero((labels == 0) | (labels % 2 == 1))
    following = np.append(stops, len(labels))[np.searchsorted(stops, begins, side="right")]
    for low, high in zip(begins, following):
        text = tokens.owner[low]
        out[text].append((int(tokens.start[low] - shift[text]), int(labels[low] - 1) // 2, int(tokens.end[high - 1] - shift[text])))
    return out


def all_spans(texts: list[str], model: Model) -> list[list[tuple[int, int, int, bool]]]:
    """(start, kind, end, whether by a pattern), in the order of start, kind and end."""
    out = [[(*span, True) for span in base_spans(t)] for t in texts]
    some = [i for i, t in enumerate(texts) if TRIGGER.search(t)]
    for i, found in zip(some, decoded_spans([texts[i] for i in some], model)):
        taken = np.zeros(len(texts[i]) + 1 if found else 0, bool)
        for a, _, b, _ in out[i] if found else ():
            taken[a:b] = True
        out[i] += [(a, k, b, False) for a, k, b in found if not taken[a:b].any() and plausible(k, texts[i][a:b])]
        out[i].sort()
    return out


# --- the labelled table

# Lines labelled by hand: <kind>…</kind> marks a span. Fixed values.
EXAMPLES = (
    "Call me at <phone>(555) 010-2233</phone> after six.",
    "Phone <phone>555-010-4477</phone> or fax <phone>555-010-4478</phone>",
    "tel: <phone>0044 20 7946 0018</phone>, ask for Ann",
    "my mobile is <phone>+49 151 23456789</phone> <ip>10.0.0.7</ip> is the host",
    "Reach us: <phone>+1 (212) 555-0143</phone> <card>4539578763621486</card>",
    "Mobile <phone>07700 900 123</phone>.",
    "cell <phone>(917) 555-0199</phone> thanks",
    "call <phone>555-010-4411</phone> or <phone>555-010-4412</phone> or <phone>555-010-4413</phone> or call <phone>555-010-4414</phone>",
    "Call <phone>+1 (305) 555-0172</phone> <phone>+1 (305) 555-0173</phone> today",
    "<phone>+1 (404) 555-0121</phone> <ip>203.0.113.45</ip> was seen",
    "write to <email>jane.doe7 at example dot org</email> please",
    "Mail <email>bob @ example.com</email> for details",
    "7 cards: <card>4716258050958645</card> <card>5425233430109903</card> <card>2222420000001113</card>",
    "contact <email>x.y22@mail3.example.com</email>, or not",
    "Her address <email>anna_k@example.net</email>. Bye",
    "server <ip>192 . 168 . 0 . 12</ip> is down",
    "ip <ip>198.51.100.23</ip> answered, <ip>198.51.100.24</ip> did not",
    "host 300.12.1.999 is no address",
    "card <card>4111 1111 1111 1111</card> expired",
    "Paid by <card>5500005555555559</card> <card>4012888888881881</card> twice",
    "visa <card>4485275742308327</card> 4485275742308328",
    "order 4485275742308321 was shipped on 2021-05-06",
    "numbers 7083638319846191 and 9910667997923881 are not cards",
    "On 12/03/2020 at 10:30 we sold 1,200 units for 3.50 each.",
    "version 2.10.3 of 1999, pages 12-19, 50 % more",
    "Licensed under CC BY-NC 4.0. Copyright 2015-2020",
    "See you at 10 on 3 May, at gate 12.",
    "He was at home at 7 and at work at 9.",
    'token = "9f1c2d3e4b5a69788796a5b4c3d2e1f001122334" set',
    "id 0012-8843-1 of 2007, ISBN 978-3-16-148410-0",
    "x = 3.14159; y = 2.71828; z = 10000000",
    "follow @someone and @other1 at 5",
    "1 2 3 4 5 6 7 8 9 10 11 12",
)


def read_markup(line: str) -> tuple[str, list[tuple[int, int, int]]]:
    """The text without marks and the spans they marked."""
    text, spans, opened = "", [], 0
    for part in re.split(r"(</?(?:email|ip|card|phone)>)", line):
        if part.startswith("</") and part[2:-1] in KINDS:
            spans.append((opened, KINDS.index(part[2:-1]), len(text)))
        elif part.startswith("<") and part[1:-1] in KINDS:
            opened = len(text)
        else:
            text += part
    return text, spans


def labelled_table(spark: SparkSession, documents: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``text`` and ``spans`` to learn from: the lines labelled by hand, and a sample of the corpus labelled by the patterns.

    Sampled are the ``sample`` lines with a digit or an ``@`` and at most ``SAMPLE_CHARS`` characters of the least hash.
    """
    kind = "text string, spans array<struct<start:bigint,kind:int,end:bigint>>"
    lines = documents.select(F.explode(F.split(F.col(text), "\n")).alias("text")).filter(F.col("text").rlike("[0-9@]") & (F.length("text") <= SAMPLE_CHARS))
    drawn = lines.orderBy(F.xxhash64("text"), "text").limit(sample)

    def label(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
        for batch in frames:
            found = [[{"start": a, "kind": k, "end": b} for a, k, b in base_spans(t)] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, shape)], ["text", "spans"])

    return spark.createDataFrame([read_markup(line) for line in EXAMPLES], kind).unionByName(drawn.mapInArrow(label, kind))


def train(labelled: DataFrame) -> Model:
    """Learn from a labelled table, which must be small: one row more than ``MAX_LABELLED`` is an error."""
    rows = labelled.filter(F.col("text").isNotNull()).select("text", "spans").limit(MAX_LABELLED + 1).collect()
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled rows")
    known = sorted((r.text, sorted((s.start, s.kind, s.end) for s in r.spans or ())) for r in rows)
    return fit([t for t, _ in known], [s for _, s in known])


def find_personal(documents: DataFrame, model: Model, text: str = "text", result: str = "spans") -> DataFrame:
    """The rows with one more column: the spans found, in code points, with their kind's number and whether a pattern found them."""
    kept = documents.drop(result)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = kept.columns.index(text)

    def apply(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in batches(frames, BLOCK, text):
            found = all_spans([x or "" for x in batch.column(at).to_pylist()], shared.value)
            spans = [[{"start": a, "kind": k, "end": b, "base": base} for a, k, b, base in row] for row in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, shape)], [*batch.schema.names, result])

    schema = T.StructType([*kept.schema.fields, T.StructField(result, T._parse_datatype_string(SPANS))])
    return kept.mapInArrow(apply, schema)
