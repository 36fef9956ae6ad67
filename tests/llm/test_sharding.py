"""Operator 12: sizes and texts come back whole, laws of the shards, seeded order."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from creditspark.llm import sharding
from creditspark.llm.catalogue import QUERIES
from creditspark.llm.shared import folder


def shards_of(rows):
    found = defaultdict(list)
    for r in rows:
        found[r.shard].append(r.slot)
    return found


def assert_law(rows, shards, n):
    found = shards_of(rows)
    assert set(found) <= set(range(shards)) and sum(map(len, found.values())) == n == len(rows)
    sizes = [len(found.get(k, ())) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(slots) == list(range(len(slots))) for slots in found.values())


def written(spark, docs, **how):
    return sharding.write_shards(docs, folder(spark, "shards"), **how)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op12_two_pass_shuffle"](spark, sf).collect()
    assert_law(rows, 16, len(texts))
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)


@pytest.mark.parametrize("n", [0, 1, 5, 16, 17, 333])
def test_counts_at_most_one_apart(spark, n):
    docs = spark.createDataFrame([(i, "w" * (i % 40)) for i in range(n)], "doc_id long, text string")
    rows = written(spark, docs, bucket_bytes=256).collect()
    assert_law(rows, 16, n)


def test_nulls_repeats_and_clashing_names(spark):
    one = (7, "same text", {"a": 1}, 3)
    data = [one] * 400 + [(None, None, None, None)] * 300 + [(None, "", {}, 0), (1, "é" * 5000, None, 1)]
    names = "doc_id long, text string, shard map<string,int>, slot int"
    docs = spark.createDataFrame(data, names).withColumns({c: F.lit(1) for c in ("tie", "row", "bucket", "place", "record", "file")})
    out = written(spark, docs, shards=7, bucket_bytes=500)
    rows = out.collect()
    assert_law(rows, 7, len(data))
    key = lambda x: repr((x.doc_id, x.text, x.shard, x.slot))
    assert Counter(key(r.record) for r in rows) == Counter(key(r) for r in docs.collect())
    assert out.select("record.*").columns == docs.columns
    # Equal records do not stay together: every shard has its part.
    ones = Counter(r.shard for r in rows if r.record.doc_id == 7)
    assert len(ones) == 7 and max(ones.values()) < 0.85 * len(data) / 7
    sizes = {(r.doc_id, r["size"]) for r in sharding.digests(out).collect()}
    assert sizes == {(7, 10), (None, 1), (1, 10001)}


def test_seed_decides_the_order(spark):
    docs = spark.createDataFrame([(i, "some words") for i in range(600)], "doc_id long, text string")
    path = folder(spark, "docs")
    docs.repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    first, again, other = (
        {r.record.doc_id: (r.shard, r.slot) for r in written(spark, docs, seed=seed, bucket_bytes=2000).collect()} for seed in (1, 1, 2))
    assert first == again and len(first) == 600
    assert sum(first[k] == other[k] for k in first) < 30


def test_order_is_uniform(spark):
    """Places over many records: no trace of the order of doc_id, of buckets or of neighbours."""
    n = 20_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"))
    place = {r.record.doc_id: r.place for r in sharding.shuffled(docs, bucket_bytes=4000).collect()}
    assert sorted(place.values()) == list(range(n))
    cells = Counter((k * 8 // n, p * 8 // n) for k, p in place.items())
    expected = n / 64
    chi = sum((cells[a, b] - expected) ** 2 / expected for a in range(8) for b in range(8))
    assert chi < 49 + 6 * (2 * 49) ** 0.5
    by_place = sorted(place, key=place.get)
    up = sum(a < b for a, b in zip(by_place, by_place[1:], strict=False))
    assert abs(up - n / 2) < 6 * (n / 12) ** 0.5
    assert sum(abs(a - b) == 1 for a, b in zip(by_place, by_place[1:], strict=False)) < 20


def test_first_places_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 3)
    counts = [(b, (b * 7) % 5) for b in range(0, 40, 2)]
    rows = {r.bucket: r for r in sharding.first_places(spark.createDataFrame(counts, "bucket int, m long")).collect()}
    at = 0
    for b, m in counts:
        assert rows[b].start == at
        at += m
    assert all(r.total == at for r in rows.values())


def test_input_that_is_no_scan_is_written_first(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    path = folder(spark, "docs")
    docs.write.parquet(path)
    scan = spark.read.parquet(path)
    assert sharding._is_scan(scan) and sharding._is_scan(scan.where("doc_id > 3").select("doc_id", "text"))
    assert not sharding._is_scan(docs) and not sharding._is_scan(scan.unionByName(scan)) and not sharding._is_scan(scan.distinct())
    assert_law(written(spark, scan.unionByName(scan)).collect(), 16, 100)


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = sharding.shuffled(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
