"""Operator 7: targets by formula, cheapest flows, and mixes that meet them."""

import itertools
from collections import Counter

from pyspark.sql import functions as F

from creditspark.llm import mixing
from creditspark.llm.catalogue import QUERIES

SCHEMA = "doc_id long, text string, source string, size long"


def test_targets_stop_at_three_times():
    sizes = {"a": 10, "b": 1000, "c": 1, None: 0}
    got = mixing.targets(sizes, {"a": 1.0, "b": 1.0, "c": 2.0, None: 1.0})
    assert got == {"a": 30.0, "c": 3.0, None: 0.0, "b": 978.0}
    assert mixing.cyclic_weights(["b", None, "a", "Z", "é"]) == {"Z": 1, "a": 2, "b": 3, "é": 1, None: 2}


def test_flow_meets_quotas_at_least_cost():
    patterns = {("a",): 10, ("a", "b"): 6, ("b", "c"): 5, ("c",): 4}
    quotas = {"a": 14, "b": 9, "c": 11}
    got = mixing.flow(patterns, quotas)
    assert all(sum(n for (_, s), n in got.items() if s == t) == q for t, q in quotas.items())
    used = Counter()
    for (p, s), n in got.items():
        assert s in p
        used[p] += n

    def cost(p, n):
        return sum(k * max(0, min(patterns[p], n - k * patterns[p])) for k in range(3))

    best = None
    for x, y in itertools.product(range(0, 19), range(0, 16)):  # words of ab to a, of bc to b
        for z in range(0, 19 - x):
            if 0 <= 14 - x <= 30 and z + y == 9 and 0 <= 15 - y:
                for w in range(0, 16 - y):
                    if 0 <= 11 - w <= 12:
                        c = cost(("a",), 14 - x) + cost(("a", "b"), x + z) + cost(("b", "c"), y + w) + cost(("c",), 11 - w)
                        best = c if best is None else min(best, c)
    assert sum(cost(p, n) for p, n in used.items()) == best


def test_edge_rows_and_reruns(spark):
    rows = [(1, "a b c", "s", 5), (2, None, "s", 6), (3, "", None, 7), (4, "x y", None, None), (None, "q", "t", 1),
            (5, "a b c\td", "t", 2), (5, "a b c\td", "t", 2), (6, "w " * 500, "big", 0), (7, "one", "big", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, mixing.mix_documents(docs).select("doc_id", "size", "source_size", "target", "taken").collect()), key=repr)
    assert len(got) == len(rows)
    by = {(r[0], r[1]): r for r in got}
    assert by[(1, 3)][2] == 3 and by[(4, 2)][2] == 2 and by[(2, 0)][4] == 0 and by[(5, 3)][1] == 3
    for d, size, source_size, target, taken in got:
        assert taken <= 3 * size and (size == 0 or taken % size == 0) and target <= 3 * source_size + 1e-9
    again = docs.repartition(5)
    assert got == sorted(map(tuple, mixing.mix_documents(again).select("doc_id", "size", "source_size", "target", "taken").collect()), key=repr)
    assert mixing.mix_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def test_whole_table_comes_near_its_targets(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op7_source_mix"](spark, sf).collect()
    assert len(rows) == len(docs)
    sizes = Counter()
    for d in docs.values():
        sizes[d.source] += len(d.text.encode().split())
    want = mixing.targets(dict(sizes), mixing.cyclic_weights(sizes))
    got = Counter()
    for r in rows:
        d = docs[r.doc_id]
        assert r.size == len(d.text.encode().split()) and r.source_size == sizes[d.source]
        assert abs(r.target - want[d.source]) < 1e-6 and r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        got[d.source] += r.taken
    for s in sizes:
        assert abs(got[s] - want[s]) <= 0.01 * want[s], (s, got[s], want[s])


def test_overlapping_sources(spark):
    """Quotas that the shared documents must fill: every source gets its words."""
    items = spark.range(6000).select(
        F.col("id").alias("doc_id"), (F.col("id") % 37 + 1).alias("size"),
        F.expr("filter(array(if(id % 3 < 2, 'a', null), if(id % 3 > 0, 'b', null), if(id % 5 = 0, 'c', null)), x -> x is not null)").alias("sources"))
    weights = lambda sources: {"a": 3.0, "b": 2.0, "c": 1.0}
    rows = mixing.mix(mixing.cut(items), weights).collect()
    assert len(rows) == 6000 and all(0 <= r.copies <= 3 and r.taken == r.copies * r["size"] for r in rows)
    sizes, patterns, taken = Counter(), Counter(), Counter()
    for r in rows:
        patterns[tuple(r.sources)] += r["size"]
        taken[tuple(r.sources)] += r.taken
        for s in r.sources:
            sizes[s] += r["size"]
    quotas = mixing.targets(dict(sizes), weights(sizes))
    flow = mixing.flow(dict(patterns), quotas)
    given = Counter()
    for (p, s), n in flow.items():
        given[s] += n
    for s, q in quotas.items():  # the flow fills each quota, and the documents follow the flow
        assert abs(given[s] - q) <= 1, (s, given[s], q)
    # What the documents give can be shared out so that every source gets its quota.
    shared = Counter()
    for (_, s), n in mixing.flow(dict(taken), quotas, passes=1).items():
        shared[s] += n
    for s, q in quotas.items():
        assert abs(shared[s] - q) <= 0.005 * q, (s, shared[s], q)
    assert abs(sum(taken.values()) - sum(quotas.values())) <= 3 * len(patterns)
    for r in rows:
        assert (r.source_size is None) == (len(r.sources) != 1) == (r.target is None)


def test_rows_of_their_own(spark):
    """Equal rows, rows that differ in one column only, and clashing names."""
    rows = ([(1, "a b c", "s", "en", 1)] * 40 + [(1, "a b c", "s", "de", 1)] + [(2, "x y", "t", None, 2)] * 9
            + [(k, "w " * (k % 7), "s", "en", 0) for k in range(3, 200)])
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, mix_key1 int")
    docs = docs.withColumns({n: F.lit(5) for n in ("mix_copies", "copies", "times", "file", "row", "mix_line", "copy", "sources", "taken")})
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    there, times = Counter(map(tuple, docs.collect())), Counter(map(tuple, out.collect()))
    assert set(times) <= set(there) and all(times[r] <= 3 * n for r, n in there.items())
    size = lambda r: len(r[1].split())
    sizes, taken = Counter(), Counter()
    for r, n in there.items():
        sizes[r[2]] += n * size(r)
        taken[r[2]] += times[r] * size(r)
    for s, t in mixing.targets(dict(sizes), mixing.cyclic_weights(sizes)).items():
        assert abs(taken[s] - t) <= 3, (s, taken[s], t)
    # A mix that takes all of a source takes each of its rows, not one of them again and again.
    docs = spark.createDataFrame([(1, "a b", "s", "en"), (1, "a b", "s", "de")], "doc_id long, text string, source string, lang string")
    assert sorted(map(tuple, mixing.mixed_documents(docs).collect())) == [(1, "a b", "s", "de"), (1, "a b", "s", "en")]
