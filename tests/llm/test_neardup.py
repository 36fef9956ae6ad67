"""Operator 9 against exact all-pairs similarity on small tables."""

import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from creditspark.llm import neardup as nd
from creditspark.llm.catalogue import ORACLE_SQL
from creditspark.llm.shared import cut, release
from creditspark.session import ensure_checkpoint_dir
from tests.oracle_check import compare

SCHEMA = "doc_id long, text string, node long, component string"


def shingles(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i: i + words]) for i in range(max(1, len(w) - words + 1)))


def brute(rows, words, s=80):
    sets = [shingles(t, words) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = {}
    for i, x in enumerate(sets):
        for v in x:
            index.setdefault(v, []).append(i)
    for i, x in enumerate(sets):
        for j in {j for v in x for j in index[v] if j > i}:
            c = len(x & sets[j])
            if 100 * c >= s * (len(x) + len(sets[j]) - c):
                root[find(j)] = find(i)
    least = {}
    for i, (d, *_) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, *_) in enumerate(rows))


def got(spark, rows, words):
    return sorted(map(tuple, nd.near_duplicates(spark.createDataFrame(rows, SCHEMA), words).collect()))


def corpus(seed, groups, vocabulary, n_words, edits, copies):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    rows, doc = [], 0
    passage = [rng.choice(words) for _ in range(40)]
    for g in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(1, n_words))]
        if g % 3 == 0:
            base += passage
        for _ in range(rng.randint(1, copies)):
            text = base[:]
            for _ in range(rng.randint(0, edits)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((doc, rng.choice([" ", "\n", "\t "]).join(text), None, "x"))
            doc += rng.randint(1, 3)
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("words", [2, 5])
def test_equals_all_pairs(spark, words):
    rows = corpus(words, 60, 300, 200, 6, 8)
    assert got(spark, rows, words) == brute(rows, words)


def test_long_lists(spark, monkeypatch):
    """Large families of near copies, and texts made of one passage."""
    monkeypatch.setattr(nd, "LONG_LIST", 6)
    rows = corpus(11, 30, 60, 60, 5, 40)
    assert got(spark, rows, 2) == brute(rows, 2)
    # Without pivots everything is left to the prefix filter.
    monkeypatch.setattr(nd, "_stars", lambda lists, s: lists.select(F.col("node").alias("a"), F.col("node").alias("b")).where("false"))
    assert got(spark, rows, 2) == brute(rows, 2)


def no_stars(monkeypatch):
    """Everything is left to the prefix filter."""
    monkeypatch.setattr(nd, "_stars", lambda lists, s: lists.select(F.col("node").alias("a"), F.col("node").alias("b")).where("false"))


def test_often_held_shingles_and_many_wanted(spark, monkeypatch):
    """Parities along with the rows, pairs that meet again, texts picked out by the bitmap."""
    for name, value in (("LONG_LIST", 6), ("RARE_SHINGLE", 1), ("EARLIER", 2), ("MOST_BROADCAST", 0), ("WANTED_BITS", 1 << 15)):
        monkeypatch.setattr(nd, name, value)
    no_stars(monkeypatch)
    rows = corpus(11, 30, 60, 60, 5, 40)
    assert got(spark, rows, 2) == brute(rows, 2)


def test_prefixes_do_not_go_along_with_each_shingle(spark, monkeypatch):
    """What is kept on the way follows the texts, not the square of their prefixes."""
    monkeypatch.setattr(nd, "LONG_LIST", 1)
    no_stars(monkeypatch)
    rng, rows = random.Random(5), []
    for g in range(20):
        base = [f"w{rng.randrange(100_000)}" for _ in range(2000)]
        for _ in range(2):
            rows.append((len(rows), " ".join(base), None, ""))
            base = base[:]
            for at in rng.sample(range(2000), rng.choice([70, 140])):
                base[at] = f"v{rng.randrange(100_000)}"

    def kept():
        top = ensure_checkpoint_dir(spark).removeprefix("file:")
        return sum(os.path.getsize(f"{d}/{x}") for d, _, names in os.walk(top) for x in names)

    before, result = kept(), got(spark, rows, 2)
    assert kept() - before < 10 * sum(len(t) for _, t, *_ in rows)
    assert result == brute(rows, 2) and 0 < sum(1 for r in result if not r[3]) < 20


def test_release(spark):
    """Shuffles that only finished steps read go at once."""
    tracked = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses
    release(spark)
    time.sleep(1)
    before = tracked().size()
    rows = cut(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count())
    assert tracked().size() > before
    release(spark)
    deadline = time.time() + 10
    while tracked().size() > before and time.time() < deadline:
        time.sleep(0.1)
    assert tracked().size() <= before and rows.count() == 7


def test_edge_rows(spark):
    rows = [(4, "A b", None, None), (2, "a\tB ", None, ""), (9, None, None, ""), (8, "", None, ""), (7, " \n", None, ""),
            (6, "one", None, ""), (5, "ONE", None, ""), (3, "É b", None, ""), (1, "é b", None, ""), (4, "a b", None, ""),
            (10, "x " * 100_000, None, ""), (11, "x x", None, "")]
    assert got(spark, rows, 2) == brute(rows, 2)
    assert got(spark, [], 2) == []
    with_null = nd.near_duplicates(spark.createDataFrame([(None, "a b c", 1, ""), (5, "a b c", 1, ""), (None, "z", 1, "")], SCHEMA), 2)
    assert sorted(map(tuple, with_null.collect()), key=repr) == sorted(
        [(None, 2, 5, False), (5, 2, 5, True), (None, 1, None, True)], key=repr)


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 7), (200, 201), (201, 202), (300, 300)]
    rows = nd.components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert {r.node: r.component for r in rows} == {**{i: 1 for i in range(1, 41)}, 100: 1, 200: 200, 201: 200, 202: 200}


def test_query_equals_sql(spark):
    assert "op9_near_duplicates" in ORACLE_SQL
    assert compare(spark, "/root/testdata/sf0.001", ["op9_near_duplicates"], verbose=False) == {"op9_near_duplicates": True}


def test_different_texts_under_one_doc_id(spark):
    rng = random.Random(3)
    text = lambda: " ".join(f"w{rng.randrange(500)}" for _ in range(60))
    base = [text() for _ in range(12)]
    near = lambda t: t + " end"
    rows = [(1, base[0], None, ""), (7, near(base[0]), None, ""), (7, base[1], None, ""), (9, near(base[1]), None, ""),
            (20, base[2], None, ""), (20, base[3], None, ""), (21, near(base[2]), None, ""), (22, near(base[3]), None, ""),
            (30, base[4], None, ""), (30, near(base[4]), None, ""), (30, "", None, ""), (30, None, None, "")]
    rows += [(40, b, None, "") for b in base[5:]] + [(41 + i, near(b), None, "") for i, b in enumerate(base[5:])]
    assert got(spark, rows, 2) == brute(rows, 2)
    rng.shuffle(rows)
    assert got(spark, rows, 2) == brute(rows, 2)
    kept = {(r.doc_id, r.text) for r in nd.without_copies(spark.createDataFrame(rows, SCHEMA), 2).collect()}
    assert {t for d, t in kept if d == 7} == {base[1]} and (1, base[0]) in kept and not any(d in (9, 21, 22) or d > 40 for d, _ in kept)
    assert {t for d, t in kept if d == 20} == {base[2], base[3]} and {t for d, t in kept if d == 40} == set(base[5:])
    assert len([t for d, t in kept if d == 30 and t]) == 1 and {(30, ""), (30, None)} <= kept


def test_rows_that_differ_in_other_columns(spark):
    """Rows of equal doc_id and text are copies; which row stays does not hang on their order."""
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text, "en", 99), (1, text, "de", 99), (2, text, "fr", 1), (3, "other words here", None, 3), (3, "other words here", None, 3)]
    names = "doc_id long, text string, lang string, __doc_id int"
    first = spark.createDataFrame(rows, names).withColumns({"doc_key": F.lit("x"), "row_key": F.lit(7), "text_key": F.lit(None).cast("string")})
    kept = sorted(map(tuple, nd.without_copies(first).collect()))
    assert [r[0] for r in kept] == [1, 3] and kept[0][3] == 99 and kept[0][4:] == ("x", 7, None)
    again = spark.createDataFrame(rows[::-1], names).withColumns({"doc_key": F.lit("x"), "row_key": F.lit(7), "text_key": F.lit(None).cast("string")})
    assert sorted(map(tuple, nd.without_copies(again.repartition(4)).collect())) == kept


def test_hot_rows_and_maps(spark):
    docs = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same words again and again").alias("text"),
                                    F.create_map(F.lit("k"), F.lit(1)).alias("meta"))
    docs = docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(8).cast("long")))
    assert [(r.doc_id, r.meta) for r in nd.without_copies(docs).collect()] == [(7, {"k": 1})]
    got = nd.near_duplicates(docs).groupBy("component_id", "kept").count().collect()
    assert sorted(map(tuple, got)) == [(7, False, 1), (7, True, 4000)]
