"""Operator 10: exact counts and decoding, held-out accuracy, hidden words."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditspark.llm import toxicity as tx
from creditspark.llm.catalogue import QUERIES

SCHEMA = "doc_id long, text string, score double, toxic string"
LABELS = "doc_id long, quality int, toxic int"


def loop_counts(texts):
    want = Counter()
    for t in texts:
        for run in "".join(c if c.isalpha() else " " for c in (t or "").lower()).split():
            s = [0, 0, *map(ord, run), 0]
            want.update(tx.gram(*x) for x in zip(s, s[1:], s[2:]))
    return want


def loop_costs(counts):
    """Costs by the same formula from plain sums."""
    three, two, one, m3, m2 = counts, Counter(), Counter(), Counter(), Counter()
    bits = (1 << 21) - 1
    for g, n in counts.items():
        b, c = g >> 21 & bits, g & bits
        two[b, c] += n
        m3[g >> 21] += n
        m2[b] += n
        one[c] += n
    whole = sum(counts.values())

    class Costs(dict):
        def __missing__(self, g):
            b, c = g >> 21 & bits, g & bits
            p = (one[c] + 1) / (whole + len(one) + 1)
            p = (two[b, c] + 5 * p) / (m2[b] + 5)
            return -math.log((three[g] + 5 * p) / (m3[g >> 21] + 5))

    return Costs()


TEXTS = ["Ab c", None, "", "x9\u00e9 \u00c9t\u00e9", "a" * 300, "\n", "\u6f22\u5b57 \U00020000b", "caf\u00e9s and cafes", "rest-of it"]


def test_counts_and_costs_equal_a_loop(spark, monkeypatch):
    monkeypatch.setattr(tx, "SLICE_BYTES", 8)
    docs = spark.createDataFrame([(i, t, 0.0, "") for i, t in enumerate(TEXTS)], SCHEMA).coalesce(2)
    grams, forms = tx.evidence(docs)
    counts = loop_counts(TEXTS)
    assert {r.gram: r.n for r in grams.collect()} == counts
    costs = loop_costs(counts)
    wanted = [(g,) for g in {*counts, tx.gram(1, 2, 3), tx.gram(0, 0, 98), tx.gram(97, 98, 99), 0, tx.gram(0, 99, 0)}]
    got = {r.gram: r.cost for r in tx.gram_costs(grams, spark.createDataFrame(wanted, "gram long")).collect()}
    assert len(got) == len(wanted) and all(abs(got[g] - costs[g]) < 1e-9 for g in got)
    # The table grows with what the corpus holds.
    more = docs.unionByName(spark.createDataFrame([(99, "quite other words \u0416\u0416", 0.0, "")], SCHEMA))
    assert tx.evidence(more)[0].count() > len(counts)


def reading_cost(letters, costs):
    """Of a reading: its words one by one."""
    total = 0.0
    state = (0, 0)
    for x in letters:
        c = tx._symbol(x)
        total += costs[tx.gram(*state, c)]
        state = (state[1], c) if c else (0, 0)
    return total + costs[tx.gram(*state, 0)]


def test_viterbi_finds_the_cheapest_reading():
    rng = random.Random(3)
    text = " ".join(rng.choice(["idiot", "stupid", "scum", "trash", "loser", "moron", "\u00e9l\u00e9", "diet", "its", "soul"]) for _ in range(400))
    costs = loop_costs(loop_counts([text]))
    for word in ("1d10t", "s.t.u.p.i.d", "stuuuupid", "$cum", "tr4$h", "l00o0ser", "a", "\u00e91\u00e9", "m-0-r-0-n", "9x|", "a s t u p"):
        every = []
        for readings in itertools.product(*tx.lattice(word)):
            letters = [x for x, _ in readings if x]
            every.append((sum(c for _, c in readings) + reading_cost(letters, costs), "".join(letters)))
        assert abs(min(every)[0] - min(c for c, w in every if w == tx.decode(word, costs))) < 1e-9, word
        known = {g: costs[g] for g in tx.needed(word)}  # no reading leaves these
        assert tx.decode(word, known) == tx.decode(word, costs)
    assert tx.decode("1d10t", costs) == "idiot" and tx.decode("m-0-r-0-n", costs) == "moron"


def test_long_forms():
    costs = loop_costs(loop_counts(["stupid words and more of them x y z"] * 50))
    assert tx.restored("a1" * 500, costs) == []
    long = "x y z " * 200 + "s t u p i d " + "x y z " * 200
    assert "stupid" in tx.restored(long.strip(), costs) and len(tx.windows(long)) > 5
    assert tx.tokens_and_forms("stuuuuuuuuuupid!!!!!!!") == (["stuuuuuuuuuupid"], ["stuuupid", "stuuupid!!!"])


def test_read_equals_a_loop_over_words():
    texts = ["The \"cat\" sat, (on) 1d10t's a$$ mat!", "", "s t u p i d and A B then \u00c9t\u00e9.", "the the THE 100", "aaa baaad x" * 3]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *[len(t.encode()) for t in texts]])
    x = tx.read(np.frombuffer(data, dtype=np.uint8), offsets)
    names, got_t, got_f = x.tokens.to_pylist(), [set() for _ in texts], [set() for _ in texts]
    for r, t in zip(x.token_row, x.token, strict=True):
        got_t[r].add(names[t])
    for r, f in zip(x.form_row, x.form, strict=True):
        got_f[r].add(x.forms[f])
    for k, t in enumerate(texts):
        pairs = [tx.tokens_and_forms(w) for w in t.split()]
        assert got_t[k] == {y for ts, _ in pairs for y in ts}, t
        spaced = {"s t u p i d"} if k == 2 else set()
        assert got_f[k] == {y for _, fs in pairs for y in fs} | spaced, t


WORDS = "the of and then thing rest hand nest ring ton sting lane onen tide solid united dot into pilot patio audio radio".split()
TOXIC = ["idiot", "stupid", "moron", "scum"]


def corpus(n, seed=0):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        words = [rng.choice(WORDS) for _ in range(rng.randint(5, 60))]
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(TOXIC))
        rows.append((i, " ".join(words), 0.0, ""))
        labels.append((i, 1, int(toxic if rng.random() > 0.03 else not toxic)))
    return rows, labels


def test_hidden_words_are_restored(spark):
    rows, labels = corpus(3000)
    hidden = ["you 1d10t there", "what a s t u p i d thing", "s.t.u.p.i.d rest", "stuuuupid hand", "m0r0n of the", "such $cum and",
              "i-d-i-o-t ring", "IDIOT!!!", "*stupid*"]
    clean = ["the united audio", "rest 2024 and 10 things", "a b c d", "http://the.of.and/then", "e.g. this", "", None, "hand$$$ ring%%%"]
    extra = [(10_000 + i, t, 0.0, "") for i, t in enumerate(hidden)] + [(20_000 + i, t, 0.0, "") for i, t in enumerate(clean)]
    docs = spark.createDataFrame(rows + extra + [(None, "idiot", None, None), (20_000, "the united audio", None, "x")], SCHEMA)
    got = tx.toxicity(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(rows) + len(extra) + 2
    by = {r.doc_id: r for r in got}
    assert [hidden[i] for i in range(len(hidden)) if not by[10_000 + i].predicted] == []
    assert [clean[i] for i in range(len(clean)) if by[20_000 + i].predicted] == []
    assert by[None].predicted == 1 and not by[None].held_out
    right = [by[i].predicted == (i % 6 == 0) for i in range(3000) if by[i].held_out]
    assert len(right) > 400 and np.mean(right) > 0.99
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(3000))


def test_edge_tables(spark):
    none = spark.createDataFrame([], LABELS)
    docs = spark.createDataFrame([(1, "x", 0.0, ""), (2, None, 0.0, "")], SCHEMA)
    assert [r.predicted for r in tx.toxicity(docs, none).collect()] == [0, 0]
    assert tx.toxicity(docs.limit(0), none).collect() == []
    assert [r.predicted for r in tx.toxicity(docs, spark.createDataFrame([(1, 1, 1), (1, 0, None), (7, 1, 1)], LABELS)).collect()] == [1, 1]


def test_accept_keeps_rows_as_they_are(spark, monkeypatch):
    rows, labels = corpus(900)
    names = ["file", "row", "features", "forms", "form", "at_file", "at_row", "score2", "toxicity_score"]
    docs = spark.createDataFrame(rows + [(9_000, "you 1d10t", 0.5, "x"), (9_000, "you 1d10t", 0.5, "x"), (9_001, None, None, None)], SCHEMA)
    docs = docs.withColumns({n: F.lit(1) for n in names})
    want = {r.doc_id for r in tx.toxicity(docs, spark.createDataFrame(labels, LABELS)).collect() if not r.predicted}
    for most in (1 << 17, 0):
        monkeypatch.setattr(tx, "MOST_BROADCAST", most)
        kept = tx.accept(docs, spark.createDataFrame(labels, LABELS))
        assert kept.columns == docs.columns
        assert sorted(map(tuple, kept.collect()), key=repr) == sorted(map(tuple, docs.where(F.col("doc_id").isin(want)).collect()), key=repr)
    assert 9_001 in want and 9_000 not in want


def test_parts_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t, 0.0, "") for i, t in enumerate(["1d10t and s t u p i d", "idiot stupid rest", "4.5.5 x9y 10 2024 a$$"] * 3)], SCHEMA)
    whole = sorted(map(str, tx.restore(*tx.evidence(docs)).collect()))
    monkeypatch.setattr(tx, "PART_FORMS", 1)
    assert sorted(map(str, tx.restore(*tx.evidence(docs)).collect())) == whole and len(whole) >= 6


@pytest.mark.parametrize("sf", ["sf0.1"])
def test_held_out_accuracy_on_the_table(spark, sf):
    d = f"/root/testdata/{sf}"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op10_toxicity"](spark, d).collect()]
    held = [(labels[r.doc_id], r.score, r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    y, s = np.array([h[0] for h in held]), np.array([h[1] for h in held])
    order = np.argsort(np.argsort(s)) + 1.0
    auc = (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    accuracy = np.mean([h[0] == h[2] for h in held])
    print("held out", len(held), "accuracy", accuracy, "auc", auc, "caught", np.mean([h[2] for h in held if h[0]]),
          "false alarms", np.mean([h[2] for h in held if not h[0]]))
    assert accuracy > 0.94 and np.mean([h[2] for h in held if not h[0]]) < 0.02


def test_signs_at_the_end_all_signs_and_short_or_accented_runs(spark):
    rng = random.Random(5)
    toxic = ["ass", "shit", "bullshit", "imb\u00e9cile", "stu"]
    rows, labels = [], []
    for i in range(3000):
        words = [rng.choice(WORDS + ["caf\u00e9", "d\u00e9cile", "assume", "10", "2024", "so!"]) for _ in range(rng.randint(5, 40))]
        if i % 6 == 0:
            words += [rng.choice(toxic), rng.choice(toxic)]
        rows.append((i, " ".join(words), 0.0, ""))
        labels.append((i, 1, int(i % 6 == 0)))
    hidden = ["such a$$ and", "the sh!+ ring", "bullsh!+", "a 455 thing", "the @$$ of", "what i m b \u00e9 c i l e thing", "the a s s hand",
              "rest s.t.u of", "(a$$)", "hand 4.5.5 rest"]
    clean = ["hand$ ring!", "in 2024 10 rest!!", "3.14 and", "so! (rest)", "a b", "+ + +", "1 2", "$$$", "\u6f22 \u5b57 \u6f22 \u5b57"]
    extra = [(10_000 + i, t, 0.0, "") for i, t in enumerate(hidden)] + [(20_000 + i, t, 0.0, "") for i, t in enumerate(clean)]
    docs = spark.createDataFrame(rows + extra, SCHEMA)
    by = {r.doc_id: r.predicted for r in tx.toxicity(docs, spark.createDataFrame(labels, LABELS)).collect()}
    assert [t for i, t in enumerate(hidden) if not by[10_000 + i]] == []
    assert [t for i, t in enumerate(clean) if by[20_000 + i]] == []
    assert np.mean([by[i] == (i % 6 == 0) for i in range(3000)]) > 0.99
