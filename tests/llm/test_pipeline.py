"""The pipeline's stages against brute-force versions, each on its own input."""

import math
import re
from collections import Counter

import corpus_pipeline
from creditspark.llm import mixing, secretscan
from creditspark.llm.catalogue import QUERIES
from creditspark.llm.shared import folder
from tests.llm.test_neardup import brute as brute_groups
from tests.llm.test_packing_idfiles import check_packing, crc, expected
from tests.llm.test_secretscan import brute as brute_spans

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def masked(text):
    out, end = [], 0
    for _, a, b in sorted(brute_spans(text), key=lambda s: s[1]):
        if a >= end:
            out += [text[end:a], "[SECRET]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]
    written = folder(spark, "test-pipeline")

    def after(k, before):
        out = corpus_pipeline.STAGES[k][1](spark, before, SF)
        out.write.parquet(f"{written}/{k}")
        return spark.read.parquet(f"{written}/{k}")

    clean = after(0, docs)
    assert clean.columns == COLUMNS and clean.schema == docs.schema
    predicted = {r.doc_id: r.predicted for r in QUERIES["op10_toxicity"](spark, SF).collect()}
    assert rows_of(clean) == sorted((tuple(r) for r in docs.collect() if not predicted[r.doc_id]), key=repr)

    single = after(1, clean)
    assert single.columns == COLUMNS
    groups = brute_groups([(r.doc_id, r.text) for r in clean.collect()], 5)
    kept = {d for d, _, _, keep in groups if keep}
    assert len(kept) < len(groups)
    assert rows_of(single) == sorted((tuple(r) for r in clean.collect() if r.doc_id in kept), key=repr)

    redacted = after(2, single)
    want = sorted(((r.doc_id, masked(r.text), r.lang, r.source, len(masked(r.text))) for r in single.collect()), key=repr)
    assert redacted.columns == COLUMNS and rows_of(redacted) == want
    assert not any(re.search("[0-9a-f]{24}", w[1]) for w in want)

    mixed = after(3, redacted)
    assert mixed.columns == COLUMNS
    there = {tuple(r) for r in redacted.collect()}
    times = Counter(tuple(r) for r in mixed.collect())
    assert set(times) <= there and max(times.values()) <= 3
    size = {r: len(r[1].encode().split()) for r in there}
    sizes, taken = Counter(), Counter()
    for r in there:
        sizes[r[3]] += size[r]
        taken[r[3]] += size[r] * times[r]
    for s, t in mixing.targets(dict(sizes), mixing.cyclic_weights(sizes)).items():
        assert abs(taken[s] - t) <= 0.02 * t

    packed = corpus_pipeline.STAGES[4][1](spark, mixed, SF).collect()
    check_packing(packed, None)
    want = Counter()
    for d, ids in expected([(r.doc_id, r.text) for r in mixed.collect()]):
        n = math.ceil(len(ids) / 2048)
        end = len(ids) - (n - 1) * 2048
        for k in range(n):
            start = max(0, end + (k - 1) * 2048) if k else 0
            want[d, k, start, crc(ids[start: end + k * 2048])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.ids_crc32) for r in packed) == want


def test_edge_rows_pass_every_stage(spark):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "null id", "en", "s", 7), (2, "", "en", "s", 0),
            (3, "token = abcdef123456", "de", None, 20), (4, "same text here again and again", "en", "s", 30),
            (4, "same text here again and again", "en", "s", 30), (5, "same text here again and again", "en", "t", 30),
            (6, "word " * 50_000, "en", "t", 250_000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        n = docs.count()
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            if k < 4:
                assert out.columns == COLUMNS
                path = folder(spark, "test-edge")
                out.write.parquet(path)
                docs = spark.read.parquet(path)
            assert (out.count() > 0) == (n > 0)
            if k == 1 and n:
                ids = sorted((r.doc_id for r in docs.collect()), key=lambda x: (x is None, x))
                assert ids == [1, 2, 3, 4, 6, None]


def test_extra_columns_do_not_clash(spark):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    from pyspark.sql import functions as F

    names = ["toxicity_score", "node", "digest", "size", "copies", "mix_row", "component_id", "piece", "length", "n", "value"]
    docs = base.select("*", *[F.lit(1).alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.count() > 0
        if "sequence_id" not in out.columns:
            assert out.columns == docs.columns


def test_run_is_registered(spark):
    import __spark_entry__ as e

    out = e.queries()["pipeline"](spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0
    assert secretscan.KINDS[0] == "assign"
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in e.queries() if n.startswith("op")) == list(range(1, 14))


def test_only_the_last_stage_stays(spark, monkeypatch):
    import os

    made = []
    monkeypatch.setattr(corpus_pipeline, "folder", lambda spark, name: made.append(folder(spark, name)) or made[-1])
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert os.listdir(made[0]) == ["4-packing"] and out.count() > 0
