"""Operator 11: neighbourhoods, pairs and forms against plain loops over strings."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from creditspark.llm import spelling
from creditspark.llm.catalogue import QUERIES


def runs_in(doc_id, text):
    for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
        run = "".join(c.lower() if c.isascii() else c for c in run)
        h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
        if h % 31 == 0:
            run = run[: h % len(run)] + run[h % len(run) + 1:]
        yield run


def edits(word, letters):
    for k in range(len(word) + 1):
        for c in letters:
            yield word[:k] + c + word[k:]
            if k < len(word):
                yield word[:k] + c + word[k + 1:]
        if k < len(word):
            yield word[:k] + word[k + 1:]


def brute(counts):
    letters = sorted({c for w in counts for c in w})
    near = {w: {x for x in edits(w, letters) if x in counts and x != w} for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= 10 * counts[w]:
            form[w] = best
    rows = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, n, len(near[w]), counts.get(form.get(w))))
    return sorted(rows)


def words_of(rows, least_n=2):
    counts = Counter(w for d, t in rows for w in runs_in(d, t) if len(w) >= 7)
    return {w: n for w, n in counts.items() if n >= least_n}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abcé", min_size=0, max_size=9), min_size=1, max_size=6), st.integers(2, 9))
def test_neighbourhood_is_full_and_each_string_is_there_once(words, symbols):
    sym = {c: int(spelling.tb.mix64(np.array([ord(c)], np.uint64))[0] % np.uint64(symbols)) for c in "abcé"}
    alphabet = [chr(65 + k) for k in range(symbols)]

    def key(reduced):
        total = 0
        for k, c in enumerate(reduced):
            total += (ord(c) - 64) * pow(spelling._BASE, k, 1 << 64)
        return int(spelling.tb.mix64(np.array([total % (1 << 64)], np.uint64)).view(np.int64)[0])

    reduced = ["".join(alphabet[sym[c]] for c in w) for w in words]
    assert spelling.keys(words, symbols).tolist() == [key(r) for r in reduced]
    got = sorted((r, k) for rows, ks in spelling.neighbours(words, symbols) for r, k in zip(rows.tolist(), ks.tolist(), strict=True))
    assert got == sorted((i, key(x)) for i, r in enumerate(reduced) for x in {r, *edits(r, alphabet)})


def test_long_words_in_parts(monkeypatch):
    words = ["ab" * 40 + "c", "xyz" * 30, "k"]
    whole = sorted(zip(*map(np.ndarray.tolist, map(np.concatenate, zip(*spelling.neighbours(words), strict=True))), strict=True))
    monkeypatch.setattr(spelling, "LETTERS", 16)
    parts = sorted(zip(*map(np.ndarray.tolist, map(np.concatenate, zip(*spelling.neighbours(words), strict=True))), strict=True))
    assert whole == parts


def test_variants_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(spelling, "FILTER_BITS", 1 << 15)
    rng = random.Random(3)
    letters = "abcdeé"
    counts = {}
    for _ in range(60):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(1, 11)))
        counts[w] = rng.choice([1, 30, 400, 9000])
        for x in rng.sample(sorted(set(edits(w, letters))), 6):
            counts.setdefault(x, rng.choice([1, 2, 3, 40, 500]))
            for y in rng.sample(sorted(set(edits(x, letters)) - {""}), 2):
                counts.setdefault(y, 1)
    counts |= {"q" * 3000: 50, "q" * 2999: 3, "q" * 1500 + "r" + "q" * 1499: 5, "zz": 10, "z": 1, "zzz": 1, "yz": 10}
    counts.pop("", None)
    vocab = spark.createDataFrame(list(counts.items()), "word string, n long")
    expected = brute({w: n for w, n in counts.items() if len(w) < 100}) + [
        ("q" * 1500 + "r" + "q" * 1499, "q" * 3000, "q" * 3000, 5, 2, 50), ("q" * 2999, "q" * 3000, "q" * 3000, 3, 2, 50),
        ("q" * 3000, None, "q" * 3000, 50, 2, None)]
    for symbols in (2, 8):
        assert sorted(map(tuple, spelling.spelling_variants(vocab, symbols).collect())) == sorted(expected)


def test_chains_of_forms(spark):
    words = ["abcdefg" + "x" * k for k in range(9)]
    vocab = spark.createDataFrame([(w, 10**k) for k, w in enumerate(words)], "word string, n long")
    rows = {r.word: r for r in spelling.spelling_variants(vocab).collect()}
    assert all(rows[w].root == words[-1] for w in words) and rows[words[0]].form == words[1] and rows[words[-1]].form is None


def test_vocabulary_edge_rows(spark):
    rows = [(1, "Garden garden GARDENS gardens Gardens'gardens"), (None, "gardens ÀÉÎÕÜàé×÷ ÀÉÎÕÜàé×÷"), (2, None), (3, ""), (3, ""),
            (4, "日本語gardens日本語 gardens1gardens"), (5, "z" * 5000), (6, "z" * 5000), (7, "abcdefg"), (7, "abcdefg"), (8, "short words only")]
    rows += [(k, "wonderful gardens everywhere") for k in range(100, 400)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, word int").repartition(5)
    got = {r.word: r.n for r in spelling.vocabulary(docs, spelling.one_letter_lost).collect()}
    assert got == words_of(rows) and any("gardens" != w and len(w) == 6 for w in map(str, itertools.chain(*(runs_in(d, t) for d, t in rows))))
    every = {r.word: r.n for r in spelling.vocabulary(docs, None, 1, 1).collect()}
    assert every["gardens"] == 307 + 1 and every["garden"] == 2
    out = spelling.spelling_variants(spelling.vocabulary(docs, spelling.one_letter_lost))
    assert sorted(map(tuple, out.collect())) == brute(words_of(rows))
    assert spelling.spelling_variants(spelling.vocabulary(docs.limit(0))).collect() == []


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op11_spelling_variants"](spark, sf).collect()
    assert sorted(map(tuple, got)) == brute(words_of(rows))
