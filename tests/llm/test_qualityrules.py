"""Operator 6: base measures against plain code, and the risk bound."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditspark.llm import qualityrules as qr
from creditspark.llm.catalogue import QUERIES

SCHEMA = "doc_id long, text string, lang string, stratum string, n_words int"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    where = {}
    for i in range(len(words) - 7):
        where.setdefault(tuple(words[i: i + 8]), []).append(i)
    covered = {i + k for v in where.values() if len(v) > 1 for i in v for k in range(8)}
    n = (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
    return (*n, n[0] < 20 or 100 * n[4] > 30 * n[0])


def test_measures_equal_plain_code(spark):
    rng = random.Random(1)
    parts = ["a", "b", "cc", " ", "  ", "\n", "\n\n", "\t", "é", "#", "*|", " ", "\x1c", "a b c d e f g h ", "x\n", "\r\n"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 120))), "l", "", 0) for i in range(1500)]
    rows += [(-1, None, None, None, None), (None, "", None, None, None), (-1, "w " * 60_000, "x", "", 1)]
    got = qr.judge(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert sorted(((r.doc_id, *map(int, r[1:6]), r.base_failed) for r in got), key=repr) == sorted(
        ((r[0], *brute(r[1])) for r in rows), key=repr)
    assert all(r.kept == (not r.base_failed) and r.evidence is None for r in got)
    assert qr.judge(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int")).collect() == []


def test_upper_bound_is_exact():
    for x, n, error in ((0, 50, 0.05), (3, 100, 0.01), (20, 40, 0.1), (0, 1, 0.5)):
        p = qr.upper_bound(x, n, error)
        assert abs(sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(x + 1)) - error) < 1e-9
    for x, n, p in ((0, 10, 0.3), (9, 10, 0.9), (40, 90, 0.41), (3, 1000, 0.01), (500, 900, 0.6)):
        exact = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(x + 1))
        assert abs(qr.binomial_tail(x, n, p) - exact) < 1e-11
    assert 0.01 < qr.upper_bound(10_000_000, 1_000_000_000, 0.01) < 0.01001
    assert qr.upper_bound(5, 5, 0.1) == 1.0 and qr.upper_bound(0, 0, 0.1) == 1.0
    assert abs(qr.upper_bound(0, 60, 0.05) - (1 - 0.05 ** (1 / 60))) < 1e-12


def test_selected_cutoffs_keep_their_promise():
    """Of many samples, the true false-rejection share is above the limit in no
    more than the error level's share."""
    rng = np.random.default_rng(5)
    good_p = np.exp(-np.arange(qr.EVIDENCE) / 12.0)
    good_p /= good_p.sum()
    bad_p = np.full(qr.EVIDENCE, 1 / qr.EVIDENCE)
    broken = used = 0
    for _ in range(150):
        tables = [np.stack([rng.multinomial(300, bad_p), rng.multinomial(1500, good_p)]) for _ in range(2)]
        c = qr.select_cutoff(*tables, limit=0.02, error=0.1)
        if c is not None:
            used += 1
            broken += good_p[c + 1:].sum() > 0.02
    assert used > 100 and broken <= 0.1 * 150 + 8
    assert qr.select_cutoff(tables[0], np.zeros((2, qr.EVIDENCE), int), 0.02, 0.1) is None


@pytest.mark.parametrize("n", [3000])
def test_rules_reject_bad_documents_of_their_stratum(spark, n):
    rng = random.Random(2)
    words = ["the", "of", "and", "thing", "rest", "hand", "nest", "ring", "ton", "sting", "lane", "onen"]
    rows, labels = [], []
    for i in range(n):
        bad = i % 10 == 0
        lang = "en" if i % 3 else None
        text = " ".join(rng.choice(words) + (rng.choice(["***", "$$$"]) if bad and lang else "") for _ in range(40))
        rows.append((i, text, lang, "", 0))
        labels.append((i, 0 if bad else 1, 0))
    got = {r.doc_id: r for r in qr.judge(spark.createDataFrame(rows, SCHEMA),
                                         spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all(got[i].kept for i in range(n) if i % 10) and not any(got[i].kept for i in range(0, n, 10) if rows[i][2])
    assert "symbols" in got[10].failed_rules


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op6_quality_rules"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (*map(int, r[1:6]), r.base_failed) == brute(texts[r.doc_id])
        assert not (r.kept and r.base_failed)


def shares(text):
    words, n, chars, symbols, dup, rep, _ = (re.findall(r"[^\x20\x09-\x0D]+", text or ""), *brute(text))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    count = lambda pattern: len(re.findall(pattern, text or ""))
    part = lambda a, b: min(100, 100 * a // b) if b else 0
    return [part(symbols, n), part(dup, len(lines)), part(rep, n), part(count("[A-Z]"), count("[A-Za-z]")),
            part(count(r"[!?;:=~^+_\\/@]"), n), part(n - len(set(words)), n), part(count("[0-9]"), chars)]


def exact_bound(x, n, error):
    low, high = 0.0, 1.0
    if n == 0 or x >= n:
        return 1.0
    for _ in range(60):
        p = (low + high) / 2
        tail = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(x + 1))
        low, high = (p, high) if tail > error else (low, p)
    return high


def brute_kept(rows, quality, hold, least):
    """The whole method in plain Python: rows (doc_id, text, lang), quality and
    half by doc_id."""
    ranges = lambda text: [sum(h >= e for e in qr.RANGES[1:]) for h in shares(text)]
    known = [(d, ranges(t), lang) for d, t, lang in rows if d in quality and not brute(t)[-1]]
    often = Counter(lang for _, _, lang in known)
    of = lambda lang: lang if often[lang] >= least else "(rest)"
    odds, seen = {}, {of(lang) for d, _, lang in known if hold[d] == 0}
    for s in seen:
        own = [(r, quality[d]) for d, r, lang in known if of(lang) == s and hold[d] == 0]
        share = (sum(q == 0 for _, q in own) + 0.5) / (len(own) + 1)
        for k in range(7):
            for x in range(len(qr.RANGES)):
                n, b = sum(r[k] == x for r, _ in own), sum(r[k] == x and q == 0 for r, q in own)
                p = (b + qr.PRIOR * share) / (n + qr.PRIOR)
                odds[s, k, x] = math.log(p / (1 - p)) - math.log(share / (1 - share))
    weigh = lambda s, r: math.floor(max(-10, min(10, sum(odds[s, k, x] for k, x in enumerate(r)))) * 10 + 100)
    cutoff, strata = {}, {of(lang) for _, _, lang in known if of(lang) in seen}
    for s in strata:
        half = [[(weigh(s, r), quality[d]) for d, r, lang in known if of(lang) == s and hold[d] == h] for h in (0, 1)]
        good = sum(q for _, q in half[1])
        for c in range(199, -1, -1):
            if exact_bound(sum(q for e, q in half[1] if e > c), good, 0.05 / len(strata)) > 0.05:
                break
            gone = [q for e, q in half[0] if e > c]
            if gone.count(0) and gone.count(0) >= 0.5 * len(gone):
                cutoff[s] = c
    out = {}
    for d, t, lang in rows:
        s = of(lang)
        out[d] = not brute(t)[-1] and not (s in seen and weigh(s, ranges(t)) > cutoff.get(s, 999))
    return out


def test_kept_equals_plain_code(spark, monkeypatch):
    monkeypatch.setattr(qr, "LEAST_LABELLED", 60)
    rng = random.Random(9)
    words = ["the", "of", "and", "thing", "rest", "hand", "Nest", "ring", "x1", "sting!", "lane", "onen"]
    rows, quality = [], {}
    for i in range(2400):
        lang = rng.choice(["en", "en", "de", None, "fr", f"odd{i % 90}"])
        bad = rng.random() < 0.25
        junk = rng.choice(["***", "9 9 9", "SHOUT", "?!"]) if lang != "fr" else ""
        text = " ".join(rng.choice(words) + (junk if bad and rng.random() < 0.3 else "") for _ in range(rng.randint(15, 60)))
        rows.append((i, text, lang))
        if i % 4:
            quality[i] = int(not bad if rng.random() < 0.95 else bad)
    df = spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)
    hold = {r[0]: r[1] for r in df.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(2)).cast("int")).collect()}
    labels = spark.createDataFrame([(d, q, 0) for d, q in quality.items()], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in qr.judge(df, labels).collect()}
    want = brute_kept(rows, quality, hold, 60)
    assert got == want
    gone = Counter(lang if lang in ("en", "de", "fr", None) else "odd" for d, t, lang in rows if not got[d] and not brute(t)[-1])
    assert sum(n > 10 for n in gone.values()) >= 2 and gone["fr"] == 0, gone


def test_every_language_of_the_table_has_a_cutoff(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    measured = qr.cut(qr.measures(docs))
    fitted = qr.fit(measured, labels)
    print(fitted.cutoffs)
    langs = {r.lang for r in docs.select("lang").distinct().collect()}
    assert {s for s, c in fitted.cutoffs.items() if c < qr.EVIDENCE} >= langs - {None}
    judged = qr.judge(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").where("not base_failed")
    n = {r.quality: (r.gone, r.n) for r in judged.groupBy("quality").agg(F.count("*").alias("n"), F.sum((~F.col("kept")).cast("int")).alias("gone")).collect()}
    print(n)
    assert n[1][0] <= 0.05 * n[1][1] and n[0][0] > 0
