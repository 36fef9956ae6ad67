"""Operators 4 and 8: exact round trips and a valid, tight packing."""

import math
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from creditspark.llm import idfiles, packing
from creditspark.llm.catalogue import QUERIES
from creditspark.llm.shared import folder

PATH = public_tokenizers.path("byte_bpe_50k.json")
ROWS = [(5, "one two", "x"), (1, None, None), (3, "", "y"), (None, "no id", "z"), (5, "one two", "x"),
        (9, "word " * 5000, None), (-4, "tie", "a"), (7, "é\n\n ü <|endoftext|>", "b")]
SCHEMA = "doc_id long, text string, length string"


def expected(rows):
    t = Tokenizer.from_file(PATH)
    return [(d, [*t.encode(x or "", add_special_tokens=False).ids, 0]) for d, x, *_ in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("bits", [1, 7, 8, 11, 16, 17, 32])
def test_bit_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001).astype(np.uint32)
    data = idfiles.pack(ids, bits)
    assert len(data) == math.ceil(1001 * bits / 8)
    assert np.array_equal(idfiles.unpack(data, 1001, bits), ids)
    assert idfiles.bits_for(50257) == 16 and idfiles.bits_for(2) == 1 and idfiles.bits_for(32000) == 15


def test_file_random_access(tmp_path):
    path = str(tmp_path / "a.bits")
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 32000, n).astype(np.uint32) for n in (1, 0, 70, 3, 500, 9)]
    w = idfiles.Writer(path, 15, block_ids=64)
    for k, ids in enumerate(docs):
        w.add(k * 10, ids)
    w.close()
    r = idfiles.Reader(path)
    assert r.doc_ids.tolist() == [0, 10, 20, 30, 40, 50] and r.n_blocks == math.ceil(583 / 64)
    for k in (4, 0, 5, 1, 2, 3):
        assert np.array_equal(r.ids(k), docs[k])
    (tmp_path / "b.bits").write_bytes((tmp_path / "a.bits").read_bytes()[:-3])
    with pytest.raises(ValueError):
        idfiles.Reader(str(tmp_path / "b.bits"))


def test_files_hold_every_document_in_order(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    manifest = idfiles.write(docs, folder(spark, "test-ids"), PATH)
    got = sorted(map(tuple, idfiles.digests(idfiles.read(spark, manifest)).collect()), key=lambda r: r[1])
    want, start = [], 0
    for d, ids in sorted(expected(ROWS), key=lambda r: (r[0] is not None, r[0])):
        want.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want


def test_no_documents(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert idfiles.digests(idfiles.read(spark, idfiles.write(docs, folder(spark, "none"), PATH))).collect() == []
    assert packing.pack_documents(docs, PATH).collect() == []


def check_packing(rows, wanted, capacity=2048):
    pieces = defaultdict(list)
    filled = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in filled.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return pieces, len(filled)


def test_pieces_and_places(spark):
    rows = packing.pack_documents(spark.createDataFrame(ROWS, SCHEMA), PATH).collect()
    pieces, _ = check_packing(rows, expected(ROWS))
    for d, ids in expected(ROWS):
        if d == 5:
            assert sorted((r["piece"], r["ids_crc32"]) for r in pieces[5]) == [(0, crc(ids))] * 2
            continue
        own = sorted(pieces[d], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(math.ceil(len(ids) / 2048)))
        assert own[0]["start"] == 0 and all(r["length"] == 2048 for r in own[1:])
        for r in own:
            assert r["ids_crc32"] == crc(ids[r["start"]: r["start"] + r["length"]])
        assert sum(r["length"] for r in own) == len(ids)


def test_plan_is_tight_and_whole():
    rng = np.random.default_rng(1)
    for n in (0, 1, 30, 2000, 60_000):
        lengths = np.clip(rng.lognormal(6, 1, n).astype(int), 1, 2048)
        histogram = np.bincount(lengths, minlength=2049)
        p = packing.plan(histogram)
        used = np.zeros(p.sequences, dtype=int)
        for length in np.flatnonzero(histogram):
            sequence, _ = p.place(int(length), np.arange(histogram[length]))
            np.add.at(used, sequence, length)
        assert used.sum() == lengths.sum() and (n == 0 or used.max() <= 2048)
        large = int((lengths > 1024).sum())
        if n >= 2000:
            assert p.sequences <= 1.01 * max(math.ceil(lengths.sum() / 2048), large)


def test_fit_recovers_a_mixture():
    rows = packing.pairs(np.array([500, 1000, 1548, 1048]), 2048)
    assert sorted(map(tuple, rows.tolist())) == [(1048, 1000, 0), (1548, 500, 0)]
    histogram = np.zeros(2049, dtype=int)
    histogram[[500, 1548, 1000, 1048]] = [40, 40, 70, 70]
    plan, left = packing.rounded(rows, packing.fit(rows, histogram), histogram)
    assert left.sum() <= 2 and dict(plan)[(1048, 1000)] >= 69


def test_fills_are_priced_over_all_there_are():
    rng = np.random.default_rng(8)
    for capacity in (9, 30, 64):
        present = np.flatnonzero(rng.random(capacity + 1) < 0.7)
        present = present[present > 0]
        residual = rng.normal(0, 3, capacity + 1)
        every = [(a, b, capacity - a - b) for a in present for b in present if b <= a and 0 < capacity - a - b <= b and capacity - a - b in present]
        best = {}
        for f in every:
            worth = residual[list(f)].sum()
            if worth > packing.WORTH and worth > best.get(f[0], (-9, None))[0]:
                best[f[0]] = (worth, f)
        assert sorted(map(tuple, packing.priced(residual, present, capacity).tolist())) == sorted(f for _, f in best.values())


def test_column_generation_uses_fills_beyond_pairs():
    """Lengths that only fit in threes: the fit finds the triples among all fills."""
    histogram = np.zeros(2049, dtype=int)
    rng = np.random.default_rng(1)
    sequences = 0
    for _ in range(500):
        a = int(rng.integers(700, 1000))
        b = int(rng.integers((2048 - a) // 2 + 1, min(a, 2047 - a)))
        histogram[[a, b, 2048 - a - b]] += 40
        sequences += 40
    rows, x = packing.fitted(histogram, 2048)
    assert (rows[:, 2] > 0).sum() > 100 and (rows.sum(axis=1) == 2048).all() and len(set(map(tuple, rows.tolist()))) == len(rows)
    assert packing.plan(histogram).sequences <= 1.01 * sequences


def test_queries_cover_the_tables(spark):
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = QUERIES["op4_best_fit_packing"](spark, sf).collect()
    pieces, used = check_packing(rows, None)
    assert len(pieces) == n and used <= 1.02 * math.ceil(sum(r["length"] for r in rows) / 2048) + 2
    ids = QUERIES["op8_token_id_files"](spark, sf).collect()
    assert len(ids) == n and sum(r["n_tokens"] for r in ids) == sum(r["length"] for r in rows)
