"""Operator 3: secret scans by a battery of randomness tests.

Three fixed patterns give the base spans. Other runs of at least 16 characters
of key alphabets that mix digits and letters are candidates: the smallest
alphabet that holds a candidate is its inferred encoding, and three tests ask
whether it looks drawn at random from it: a chi-squared test of uniformity, a
runs test about the middle, and lag-1 serial correlation, joined by Fisher's
method. Strings of the same length made of the table's distinct ordinary long words, scored
alike, show how often such a score arises without a secret. Where no such string
scores as random, their number says little about the tail; there the battery's
distribution for ordinary text tells it: the uneven letters of written language
make more pairs of equal characters than random ones. Within each length class, candidates are accepted while the false-discovery rate
(Benjamini-Hochberg on these p-values) stays below ``FALSE_DISCOVERIES``. Longer
strings and larger alphabets separate better, so each length class and encoding
has a cutoff of its own.

Only histograms over classes, encodings and score bins come to the driver. Defined cases:
a null text is an empty one (no spans); an empty table gives no rows; rows with
equal doc_ids are scanned each; other columns are kept by ``redact`` only.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditspark.llm import textbatch as tb
from creditspark.llm.shared import cut

# The base patterns, their least lengths, and the kinds in order.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")

LEAST_RANDOM = 16
# Runs of letters alone are candidates from so many on; shorter ones are ordinary
# words, whose scores say how random such words look.
LEAST_LETTERS = 32
FALSE_DISCOVERIES = 0.01
# Score bins: tenths of -log10 p, the last one open.
BINS, BIN_WIDTH = 200, 0.1
# How often two characters of ordinary text with some digits and marks are
# equal, at least (letters alone: 0.065 in English, more in most languages).
COINCIDENCE = 0.05
# How often three are, in terms of its square (letters of English: 1.3).
UNEVEN = 1.5
# Ordinary words are joined in so many groups by hash, whatever the partitions.
WORD_GROUPS = 64

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Length classes (each from 1.25 times the last one's least length) for which
# ordinary strings are scored; longer candidates take the last class's cutoff.
CLASSES = 12

# Encodings from the smallest alphabet on.
ALPHABETS = (_DIGITS + "abcdef", _DIGITS + "ABCDEF", _LOWER, _UPPER, _UPPER + "234567", _DIGITS + _LOWER, _DIGITS + _UPPER,
             _UPPER + _LOWER, _DIGITS + _UPPER + _LOWER, _UPPER + _LOWER + _DIGITS + "+/", _UPPER + _LOWER + _DIGITS + "-_",
             _UPPER + _LOWER + _DIGITS + "+/-_")
_VALUE = np.zeros((len(ALPHABETS), 256), dtype=np.int64)
_MEMBER = np.zeros((len(ALPHABETS), 256), dtype=bool)
for _k, _alphabet in enumerate(ALPHABETS):
    _VALUE[_k, [ord(c) for c in _alphabet]] = np.arange(len(_alphabet))
    _MEMBER[_k, [ord(c) for c in _alphabet]] = True
_SIZES = np.array([len(a) for a in ALPHABETS])


def _marks(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


_HEX, _KEY, _DIGIT, _LETTER = _marks(_DIGITS + "abcdef"), _marks(ALPHABETS[-1]), _marks(_DIGITS), _marks(_LOWER + _UPPER)


# ---- the tests ------------------------------------------------------------------------------


def _normal_tail(z: np.ndarray) -> np.ndarray:
    return np.fromiter((0.5 * math.erfc(x) for x in (z / math.sqrt(2)).tolist()), dtype=float, count=len(z))


def battery(flat: np.ndarray, lengths: np.ndarray, encoding: np.ndarray) -> np.ndarray:
    """Fisher's joint p-value of the three tests for strings that lie one after
    another in ``flat`` (bytes), under their encodings. Near 0: not random."""
    if not len(lengths):
        return np.zeros(0)
    n, size = lengths.astype(float), _SIZES[encoding].astype(float)
    row = np.repeat(np.arange(len(lengths)), lengths)
    value = _VALUE[encoding[row], flat]
    rows = len(lengths)
    keys, times = np.unique(row * 128 + value, return_counts=True)
    squares = np.bincount(keys // 128, weights=times.astype(float) ** 2, minlength=rows)
    df = size - 1
    chi = np.maximum(size / n * squares - n, 1e-9)
    uniform = _normal_tail(((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / np.sqrt(2 / (9 * df)))
    same = row[1:] == row[:-1]
    high = value >= size[row] / 2
    changes = np.bincount(row[1:][same], weights=(high[1:] != high[:-1])[same], minlength=rows)
    runs = 2 * _normal_tail(np.abs(changes - (n - 1) / 2) / np.sqrt((n - 1) / 4))
    centred = value - (size[row] - 1) / 2
    products = np.bincount(row[1:][same], weights=(centred[1:] * centred[:-1])[same], minlength=rows)
    serial = 2 * _normal_tail(np.abs(products) / ((size**2 - 1) / 12 * np.sqrt(n - 1)))
    y = -sum(np.log(np.maximum(p, 1e-30)) for p in (uniform, runs, serial))
    return np.exp(-y) * (1 + y + y * y / 2)


def infer(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The smallest alphabet that holds each string."""
    at = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    out = np.full(len(lengths), len(ALPHABETS) - 1)
    for k in range(len(ALPHABETS) - 2, -1, -1):
        out[np.logical_and.reduceat(_MEMBER[k][flat], at)] = k
    return out


def length_class(lengths: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log(lengths / LEAST_RANDOM) / math.log(1.25) + 1e-9), CLASSES - 1).astype(np.int64)


def score_bin(p: np.ndarray) -> np.ndarray:
    """0 for p near 1; strings less random have higher bins."""
    return np.minimum((-np.log10(np.maximum(p, 1e-40)) / BIN_WIDTH).astype(np.int64), BINS - 1)


# ---- spans of a slice -----------------------------------------------------------------------


def base_spans(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of the slice, in no order."""
    text = data.tobytes()
    low = tb.lower_ascii(data).tobytes()
    spans = []
    found: set[int] = set()
    for word in ASSIGN_WORDS:
        at = low.find(word)
        while at >= 0:
            found.add(at)
            at = low.find(word, at + 1)
    for d in np.unique(np.searchsorted(offsets, sorted(found), side="right") - 1) if found else ():
        for m in ASSIGN.finditer(text[offsets[d]: offsets[d + 1]]):
            if m.end(2) - m.start(2) >= LEAST_ASSIGN:
                spans.append((int(offsets[d]) + m.start(), 0, int(offsets[d]) + m.end()))
    starts, at = [], text.find(b"AKIA")
    while at >= 0:
        starts.append(at)
        at = text.find(b"AKIA", at + 1)
    for d in np.unique(np.searchsorted(offsets, starts, side="right") - 1) if starts else ():
        for m in ACCESS.finditer(text[offsets[d]: offsets[d + 1]]):
            if m.end() - m.start() >= LEAST_ACCESS:
                spans.append((int(offsets[d]) + m.start(), 1, int(offsets[d]) + m.end()))
    runs = tb.runs(_HEX[data], offsets)
    long = runs.ends - runs.starts >= LEAST_HEX
    spans.extend((int(a), 2, int(b)) for a, b in zip(runs.starts[long], runs.ends[long], strict=True))
    return spans


def candidates(data: np.ndarray, offsets: np.ndarray, base: list[tuple[int, int, int]]):
    """Byte ranges, length classes, encodings and score bins of runs outside
    base spans that mix digits and letters, or are long and all letters."""
    runs = tb.runs(_KEY[data], offsets)
    long = runs.ends - runs.starts >= LEAST_RANDOM
    starts, ends = runs.starts[long], runs.ends[long]
    digits, letters = _count(_DIGIT[data]), _count(_LETTER[data])
    own = letters[ends] - letters[starts]
    mixed = (digits[ends] > digits[starts]) & (own > 0) | (own == ends - starts) & (own >= LEAST_LETTERS)
    if base:
        covered = np.zeros(len(data) + 1, dtype=np.int64)
        np.add.at(covered, [s[0] for s in base], 1)
        np.add.at(covered, [s[2] for s in base], -1)
        inside = _count((np.cumsum(covered) > 0)[:-1])
        mixed &= inside[ends] == inside[starts]
    starts, ends = starts[mixed], ends[mixed]
    lengths = ends - starts
    flat = _joined(data, starts, ends)
    if not len(lengths):
        return starts, ends, lengths, lengths, lengths
    encoding = infer(flat, lengths)
    return starts, ends, length_class(lengths), encoding, score_bin(battery(flat, lengths, encoding))


def _count(marks: np.ndarray) -> np.ndarray:
    out = np.zeros(len(marks) + 1, dtype=np.int64)
    np.cumsum(marks, out=out[1:])
    return out


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.concatenate([data[a:b] for a, b in zip(starts, ends, strict=True)]) if len(starts) else data[:0]


def ordinary_words(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The distinct words of ``LEAST_RANDOM`` to ``LEAST_LETTERS`` ASCII letters
    (capitals only at the beginning or throughout), in lower case."""
    runs = tb.runs(_LETTER[data], offsets)
    long = (runs.ends - runs.starts >= LEAST_RANDOM) & (runs.ends - runs.starts < LEAST_LETTERS)
    starts, ends = runs.starts[long], runs.ends[long]
    if not len(starts):
        return []
    upper = _count((data >= 65) & (data <= 90))
    lengths = ends - starts
    plain = (upper[ends] - upper[starts + 1] == 0) | (upper[ends] - upper[starts] == lengths)
    at = np.concatenate(([0], np.cumsum(lengths[plain])))
    flat = tb.lower_ascii(_joined(data, starts[plain], ends[plain]))
    return tb.pieces(flat, at[:-1], at[1:]).unique().to_pylist()


def ordinary(words: list[bytes]) -> np.ndarray:
    """Length classes, score bins and numbers of ordinary strings: ``words`` one
    after another, cut into strings of each class's least length."""
    flat = np.frombuffer(b"".join(words), dtype=np.uint8)
    rows = []
    for c in range(CLASSES):
        length = _least_length(c)
        strings = len(flat) // length
        if strings:
            p = battery(flat[: strings * length], np.full(strings, length), np.full(strings, ALPHABETS.index(_LOWER)))
            bins, times = np.unique(score_bin(p), return_counts=True)
            rows.append(np.stack([np.full(len(bins), c), bins, times], axis=1))
    return np.concatenate(rows) if rows else np.zeros((0, 3), dtype=np.int64)


def _least_length(c: int) -> int:
    return math.ceil(LEAST_RANDOM * 1.25**c)


# ---- cutoffs --------------------------------------------------------------------------------


Histograms = tuple[dict[int, np.ndarray], dict[int, np.ndarray]]


def histograms(docs: DataFrame) -> Histograms:
    """By length class: counts of candidates by encoding and score bin, and of
    strings of ordinary words by score bin, of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            for _, _, data, offsets in tb.slices(batch.column(0)):
                _, _, *key = candidates(data, offsets, base_spans(data, offsets))
                for k in zip(*(x.tolist() for x in key), strict=True):
                    total[k] = total.get(k, 0) + 1
                words = ordinary_words(data, offsets)
                if words:
                    none = pa.nulls(len(words), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), none, none, none, none], names=names)
        if total:
            yield pa.RecordBatch.from_arrays([pa.nulls(len(total), pa.binary()), *map(pa.array, zip(*total, strict=True)),
                                              pa.array(list(total.values()))], names=names)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}

        def add(words: list[bytes]) -> None:
            for c, b, n in ordinary(words).tolist():
                total[c, b] = total.get((c, b), 0) + n

        now, words = None, []
        for batch in batches:
            for group, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if group != now:
                    add(words)
                    now, words = group, []
                words.append(word)
        add(words)
        if total:
            yield pa.RecordBatch.from_arrays([*map(pa.array, zip(*total, strict=True)), pa.array(list(total.values()))],
                                             names=["class", "bin", "n"])

    names = ["word", "class", "encoding", "bin", "n"]
    rows = cut(docs.select("text").mapInArrow(count, "word binary, class long, encoding long, bin long, n long"))
    found = (rows.where("word is null").groupBy("class", "encoding", "bin").agg(F.sum("n").alias("n"))).collect()
    # Each word once in the table, in an order that does not depend on batches or partitions.
    words = (rows.where("word is not null").select((F.crc32("word") % WORD_GROUPS).alias("group"), "word")
             .distinct().repartition("group").sortWithinPartitions("group", "word"))
    null = (words.mapInArrow(strings, "class long, bin long, n long").groupBy("class", "bin").agg(F.sum("n").alias("n"))).collect()
    candidate: dict[int, np.ndarray] = {}
    for r in found:
        candidate.setdefault(r["class"], np.zeros((len(ALPHABETS), BINS), dtype=np.int64))[r["encoding"], r["bin"]] = r["n"]
    out: dict[int, np.ndarray] = {}
    for r in null:
        out.setdefault(r["class"], np.zeros(BINS, dtype=np.int64))[r["bin"]] = r["n"]
    return candidate, out


def analytic_tail(c: int, encoding: int) -> np.ndarray:
    """Per score bin how often ordinary text of class c scores as random or more:
    Fisher's p is above the bin's end only if that of the uniformity test is
    above exp(-y). Its statistic counts pairs of equal characters, whose mean and
    variance under uneven letters are known (gamma approximation of the tail)."""
    n, size = _least_length(c), float(_SIZES[encoding])
    df = size - 1
    lo, hi = np.zeros(BINS), np.full(BINS, 200.0)
    target = 10.0 ** (-BIN_WIDTH * np.arange(1, BINS + 1))
    for _ in range(60):
        y = (lo + hi) / 2
        above = np.exp(-y) * (1 + y + y * y / 2) > target
        lo, hi = np.where(above, y, lo), np.where(above, hi, y)
    # The statistic up to which the uniformity test's p is above exp(-y).
    z = np.array([-NormalDist().inv_cdf(min(max(math.exp(-v), 1e-300), 0.5)) for v in hi])
    most = df * (1 - 2 / (9 * df) + z * math.sqrt(2 / (9 * df))) ** 3
    pairs = np.maximum(n * (most + n) / size - n, 1e-9) / 2  # of equal characters
    at_random = n * (n - 1) / 2 / size
    mean = n * (n - 1) / 2 * COINCIDENCE
    if mean <= at_random:
        return np.ones(BINS)
    variance = mean * (1 - COINCIDENCE) + n * (n - 1) * (n - 2) * (UNEVEN - 1) * COINCIDENCE**2
    spread = variance / mean**2 / 9
    return _normal_tail((1 - spread - (pairs / mean) ** (1 / 3)) / math.sqrt(spread))


def cutoffs(histogram: Histograms, q: float = FALSE_DISCOVERIES) -> dict[tuple[int, int], int]:
    """For each length class and encoding the highest score bin that is still
    accepted (left out: none). Strings of shorter classes score as random more
    often, so taking those in as well only makes p larger than it is, but
    resolves smaller ones."""
    out = {}
    for c, own in histogram[0].items():
        p, null = np.ones(BINS), np.zeros(BINS, dtype=np.int64)
        for k in range(c, -1, -1):
            null = null + histogram[1].get(k, 0)
            p = np.minimum(p, (np.cumsum(null) + 1) / (null.sum() + 1))
        # Beyond the most random ordinary string of the class.
        tail = np.cumsum(histogram[1].get(c, np.zeros(BINS, dtype=np.int64))) == 0
        p = np.stack([np.where(tail, np.minimum(p, np.maximum.accumulate(analytic_tail(c, e))), p) for e in range(len(ALPHABETS))])
        there = own > 0
        order = np.argsort(p[there], kind="stable")
        rank = np.cumsum(own[there][order])
        level = p[there][order]
        accepted = np.flatnonzero(level * own.sum() <= q * rank)
        if len(accepted):
            for e in range(len(ALPHABETS)):
                at = np.flatnonzero(there[e] & (p[e] <= level[accepted[-1]]))
                if len(at):
                    out[c, e] = int(at[-1])
    return out


# ---- the operator ---------------------------------------------------------------------------


def _all_spans(texts: pa.Array, cutoff: dict[tuple[int, int], int]):
    """For each text: its bytes, and its spans (start, kind, end) in code points and in bytes."""
    for first, end, data, offsets in tb.slices(texts):
        base = base_spans(data, offsets)
        found = candidates(data, offsets, base)
        spans = base + [(a, 3, b) for a, b, c, e, k in zip(*(x.tolist() for x in found), strict=True) if k <= cutoff.get((c, e), -1)]
        spans.sort()
        points = tb.code_points_before(data)
        row = np.searchsorted(offsets, [s[0] for s in spans], side="right") - 1
        by_row: dict[int, list] = {}
        for r, s in zip(row.tolist(), spans, strict=True):
            by_row.setdefault(r, []).append(s)
        for d in range(end - first):
            own, at = by_row.get(d, []), int(offsets[d])
            yield data[at: offsets[d + 1]], [(int(points[a] - points[at]), k, int(points[b] - points[at])) for a, k, b in own], \
                [(a - at, k, b - at) for a, k, b in own]


SPANS = "array<struct<kind: string, start: long, end: long>>"


def scan(docs: DataFrame, cutoff: dict[tuple[int, int], int] | None = None) -> DataFrame:
    """doc_id and spans (kind, start, end in code points) for each row, by
    start, then kind. ``cutoff`` is fitted on ``docs`` if not given."""
    cutoff = cutoffs(histograms(docs)) if cutoff is None else cutoff

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]
                    for _, spans, _ in _all_spans(batch.column(1), cutoff)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, type=kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, f"doc_id long, spans {SPANS}")


def digests(scanned: DataFrame) -> DataFrame:
    """Numbers of base spans by kind, and the spans as text."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return scanned.select("doc_id", *[number(k) for k in KINDS[:3]], F.sha2(joined(base), 256).alias("base_sha256"),
                          joined(F.col("spans")).alias("spans"), number(KINDS[3]))


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span in its texts replaced by ``mask`` (overlapping
    spans by one); null texts stay null, all other columns stay as they are."""
    cutoff = cutoffs(histograms(docs))
    others = [c for c in docs.columns if c != "text"]

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            rows = []
            for data, _, spans in _all_spans(texts, cutoff):
                parts, end = [], 0
                for a, _, b in spans:
                    if a >= end:
                        parts += [data[end:a].tobytes(), mask.encode()]
                    end = max(end, b)
                rows.append(b"".join([*parts, data[end:].tobytes()]))
            new = pa.array(rows, type=pa.binary()).cast(pa.string())
            new = pc.if_else(texts.is_valid(), new, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([new, *batch.columns[1:]], names=batch.schema.names)

    renamed = docs.select("text", *others)
    return renamed.mapInArrow(replace, renamed.schema).select(*docs.columns)
