"""Operator 13: runs against a quadratic search, digests, the grammar's extensions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from creditspark.llm import periodic
from creditspark.llm.catalogue import QUERIES

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """All runs: for each period the maximal stretches of equal words q apart, of
    those with equal ends the smallest period."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            a = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            if i - a + q >= max(12, 2 * q):
                best.setdefault((a, i - a + q), q)
    return sorted((a, length, q) for (a, length), q in best.items())


def contract(doc_id, text):
    words = SPACE.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute(words)
    dropped = {i for a, length, q in runs for i in range(a + q, a + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest())


def as_runs(words):
    ids = np.unique(np.array(words, dtype=object), return_inverse=True)[1] if words else np.zeros(0, np.int64)
    return [tuple(r) for r in periodic.runs_of([ids])[0].tolist()]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70), st.integers(1, 20), st.integers(0, 60))
def test_runs_of_random_words(head, period, tail):
    again = [head[k % min(period, len(head))] for k in range(tail)] if head else []
    words = [*map(str, head + again), *["x"] * (tail // 4)]
    assert as_runs(words) == brute(words)


def test_many_sequences_at_once():
    rng = random.Random(5)
    every = []
    for _ in range(150):
        n = rng.choice([0, 1, 11, 12, 13, 40, 200])
        p = rng.randint(1, 30)
        some = [rng.randint(0, rng.choice([1, 2, 50])) for _ in range(n)]
        at = rng.randint(0, n)
        every.append(np.array(some[:at] + [some[at - 1 - k % min(p, at)] if at else 0 for k in range(n - at)], dtype=np.int64))
    found = periodic.runs_of(every)
    for s, r in zip(every, found, strict=True):
        assert [tuple(x) for x in r.tolist()] == brute(s.tolist())


def test_fibonacci_and_powers():
    a, b = "a", "ab"
    while len(b) < 400:
        a, b = b, b + a
    for words in (list(b), ["x"] * 500, list("ab" * 99 + "c" + "ab" * 50), list("aab" * 4), list("abcabcabcabd" * 20)):
        assert as_runs(words) == brute(words)


def test_longer_than_the_grid(monkeypatch):
    rng = random.Random(6)
    words = [rng.choice("abcd") for _ in range(300)] * 3 + ["z"] * 40 + [rng.choice("ab") for _ in range(400)]
    usual = as_runs(words)
    monkeypatch.setattr(periodic, "GRID_WORDS", 100)
    assert as_runs(words) == usual == brute(words)


def test_extensions_equal_plain_comparison():
    rng = random.Random(7)
    for size in (2, 3, 40):
        part = [rng.randint(0, size) for _ in range(60)]
        seq = np.array(part * 4 + [rng.randint(0, size) for _ in range(200)] + part + [1] * 50 + [0] + [1] * 49)
        sym = np.concatenate(([100], seq, [101]))
        ends = np.array([0, len(sym) - 1])
        levels = periodic.grammar(sym, ends)
        assert len(levels[-1].sym) <= 3 and all(len(x.sym) > len(y.sym) for x, y in zip(levels, levels[1:], strict=False))
        i, j = np.triu_indices(len(seq), 1)
        keep = np.array([rng.random() < 0.1 for _ in range(len(i))])
        i, j = i[keep] + 1, j[keep] + 1

        def plain(a, b, step):
            k = 0
            while sym[a + k * step] == sym[b + k * step]:
                k += 1
            return k

        assert periodic.extensions(levels, i, j).tolist() == [plain(a, b, 1) for a, b in zip(i, j, strict=True)]
        back, last = [x.mirrored() for x in levels], len(sym) - 1
        assert periodic.extensions(back, last - i, last - j).tolist() == [plain(a, b, -1) for a, b in zip(i, j, strict=True)]


def test_collapsed_text_and_edge_rows(spark):
    rows = [(1, "say " + "go on and " * 6 + "end", 1), (None, "a b " * 20, 2), (2, None, 3), (3, "", 4), (4, " \t\n ", 5),
            (5, "x " * 30, 6), (5, "x " * 30, 6), (6, "é" * 10_000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = {r.doc_id: r for r in periodic.periodic_runs(docs).collect()}
    assert got[1].collapsed == "say go on and end" and got[1].runs == [(1, 18, 3)]
    assert got[None].collapsed == "a b" and got[5].collapsed == "x" and got[6].n_words == 1
    assert all(got[k].collapsed == "" and got[k].runs == [] and got[k].n_words == 0 for k in (2, 3, 4))
    out = periodic.digests(periodic.periodic_runs(docs, periodic.repeated_order)).collect()
    assert sorted(map(tuple, out), key=repr) == sorted((contract(d, t) for d, t, _ in rows), key=repr)
    assert periodic.digests(periodic.periodic_runs(docs.limit(0))).collect() == []


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = sorted(map(tuple, QUERIES["op13_periodic_runs"](spark, sf).collect()))
    short = [(d, t) for d, t in docs if len(t or "") < 12_000]  # the quadratic search is slow
    known = {d for d, _ in short}
    assert len(rows) == len(docs) and len(short) > 150
    assert [r for r in rows if r[0] in known] == sorted(contract(d, t) for d, t in short)


@pytest.mark.parametrize("n", [0, 11, 5000])
def test_one_word_again_and_again(n):
    assert as_runs(["w"] * n) == ([(0, n, 1)] if n >= 12 else [])
