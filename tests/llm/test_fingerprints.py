"""Operator 1 against a plain loop over rows."""

import hashlib

import numpy as np
import pytest

from creditspark.llm import fingerprints as fp
from creditspark.llm.catalogue import QUERIES

SCHEMA = "doc_id long, text string, id string"


def brute(rows):
    rows = sorted(((d, t or "") for d, t, *_ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for k, (d, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        m = len(t) // 2
        e = t[: len(t) - m] + nxt[:m]
        a, b, c = (fp.digest(x.encode()) for x in (t, e, nxt))
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), a.tobytes().hex(), b.tobytes().hex(),
                    round(float(fp.likeness(a, b)), 12), round(float(fp.likeness(a, c)), 12)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((*r[:5], round(r[5], 12), round(r[6], 12)) for r in map(tuple, df.collect())), key=repr)


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_edge_rows(spark, parts):
    rows = [(1, "abc", "x"), (2, None, "y"), (None, "no id", "z"), (7, "tie a", ""), (7, "tie b", None),
            (7, "tie a", ""), (3, "", "q"), (9, "é" * 3000, "r"), (-5, "x", ""), (4, "ab" * 9, "")]
    assert got(fp.against_next(spark.createDataFrame(rows, SCHEMA), parts)) == brute(rows)
    assert got(fp.against_next(spark.createDataFrame(rows[:1], SCHEMA), parts)) == brute(rows[:1])


def test_no_rows(spark):
    assert fp.against_next(spark.createDataFrame([], SCHEMA)).collect() == []


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = QUERIES["op1_document_fingerprints"](spark, sf)
    assert got(df) == brute(rows)
    near = np.array([(r.near_edited, r.near_next) for r in df.collect()])
    assert near.min() >= 0 and near.max() <= 1
    assert (near[:, 0] > near[:, 1]).mean() > 0.9


def test_likeness_bounds_and_symmetry():
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (0, 1, 2, 3, 5, 50, 500, 50_000)]
    for x in texts:
        for y in texts:
            a, b = fp.digest(x), fp.digest(y)
            assert 0 <= fp.likeness(a, b) <= 1 and fp.likeness(a, b) == fp.likeness(b, a)
            assert x != y or fp.likeness(a, b) == 1


def test_counts_do_not_depend_on_blocks(monkeypatch):
    data = np.random.default_rng(2).integers(0, 256, 10_001).astype(np.uint8)
    whole = fp.counts(data)
    monkeypatch.setattr(fp, "BLOCK", 997)
    assert np.array_equal(fp.counts(data), whole)
    assert whole.sum() == sum(10_001 - k for *_, k in fp.TRIPLETS)


def test_fingerprints_of_any_table(spark):
    rows = fp.fingerprints(spark.createDataFrame([(1, "same text", ""), (2, "same text", ""), (3, None, "")], SCHEMA)).collect()
    assert rows[0].fingerprint == rows[1].fingerprint != rows[2].fingerprint
