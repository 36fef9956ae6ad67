"""Operator 1: document fingerprints as quartile bucket digests.

A text's byte triplets (six per place, within five bytes) are hashed into 256
buckets and counted. The digest holds a code for the length, the quartiles'
ratios, and for each bucket which quartile its count is in (two bits). Two
digests are compared by a bounded difference score, scaled to a likeness
between 0 and 1.

Defined cases: a null text is an empty one; texts of under three bytes have no
triplets, so their digests differ by length only; equal texts have equal
digests; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 256
# Places of a triplet within five bytes.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 2, 4), (0, 1, 4), (0, 3, 4))
_TABLES = np.random.default_rng(20240501).integers(0, BUCKETS, (len(TRIPLETS), 3, 256)).astype(np.uint8)
# Most that the lengths' and the ratios' differences may add to a score.
LENGTH_CAP, RATIO_CAP = 48, 24
# Bytes that are counted at once.
BLOCK = 1 << 20


def counts(data: np.ndarray) -> np.ndarray:
    """Triplets per bucket, by one table lookup for each byte of a triplet."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for first in range(0, len(data), BLOCK):
        block = data[first: first + BLOCK + 4]
        for tables, (_, j, k) in zip(_TABLES, TRIPLETS, strict=True):
            n = min(len(block) - k, BLOCK)
            if n > 0:
                total += np.bincount(tables[0][block[:n]] ^ tables[1][block[j: j + n]] ^ tables[2][block[k: k + n]],
                                     minlength=BUCKETS)
    return total


def digest(data: bytes) -> np.ndarray:
    """66 bytes: length code, quartile ratios, then two bits per bucket."""
    c = counts(np.frombuffer(data, dtype=np.uint8))
    q1, q2, q3 = np.partition(c, (63, 127, 191))[[63, 127, 191]]
    codes = ((c > q1).astype(np.uint8) + (c > q2) + (c > q3)).astype(np.uint8)
    length = min(255, round(8 * np.log2(len(data) + 1)))
    ratios = (int(16 * q1 / q3) % 16 << 4 | int(16 * q2 / q3) % 16) if q3 else 0
    body = codes.reshape(-1, 4) @ np.array([64, 16, 4, 1], dtype=np.uint8)
    return np.concatenate((np.array([length, ratios], dtype=np.uint8), body.astype(np.uint8)))


def codes_of(digests: np.ndarray) -> np.ndarray:
    return ((digests[..., 2:, None] >> np.array([6, 4, 2, 0], dtype=np.uint8)) & 3).reshape(*digests.shape[:-1], BUCKETS)


_FAR = np.array([0, 1, 2, 6])


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 less the difference score over its bound, for digests row by row. A
    bucket adds 0, 1, 2 or 6 by how far apart its quartiles are; its bound is the
    larger distance of either from the lowest quartile."""
    ca, cb = codes_of(a).astype(int), codes_of(b).astype(int)
    body = _FAR[np.abs(ca - cb)].sum(axis=-1)
    most = np.maximum(_FAR[ca], _FAR[cb]).sum(axis=-1)
    head = a[..., :2].astype(int), b[..., :2].astype(int)
    length = np.minimum(np.abs(head[0][..., 0] - head[1][..., 0]), LENGTH_CAP)
    far = lambda x, y: np.minimum(np.abs(x - y) % 16, 16 - np.abs(x - y) % 16)
    ratio = np.minimum(far(head[0][..., 1] >> 4, head[1][..., 1] >> 4) + far(head[0][..., 1] & 15, head[1][..., 1] & 15), RATIO_CAP)
    return 1.0 - (body + length + ratio) / (most + LENGTH_CAP + RATIO_CAP)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex) for each row."""

    @F.pandas_udf("string")
    def hexed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: digest((t or "").encode()).tobytes().hex())

    return docs.select("doc_id", hexed(F.coalesce("text", F.lit(""))).alias("fingerprint"))


EDITED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by the beginning of ``following``."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def against_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Each document beside the next one in descending doc_id (after the last:
    the first). Rows are dealt into ranges of doc_id, one shuffle of the texts;
    the first row of each range goes to the range before it as well. Rows with
    equal doc_ids follow by text; null doc_ids come last."""
    spark = docs.sparkSession
    lowest = -(1 << 63)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = keyed.select(F.coalesce("doc_id", F.lit(lowest)).alias("id"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # As many numbers as there are ranges come to the driver.
    cuts = ids.agg(F.percentile_approx("id", [k / parts for k in range(1, parts)] or [0.5], 10 * parts)).head()[0]
    bounds = np.unique(np.array(cuts or [], dtype=np.int64))
    sent = spark.sparkContext.broadcast(bounds)
    last = len(bounds)

    @F.pandas_udf("int")
    def range_of(id_: pd.Series) -> pd.Series:
        return pd.Series(last - np.searchsorted(sent.value, id_.to_numpy(), side="right"))

    heads = dict(ids.groupBy(range_of("id").alias("r")).agg(F.max("id")).collect())
    used = sorted(heads)
    goes = {heads[r]: used[k - 1] for k, r in enumerate(used)}  # the first goes to the last range
    sent_heads = spark.sparkContext.broadcast(goes)

    @F.pandas_udf("array<int>")
    def ranges_of(id_: pd.Series) -> pd.Series:
        own = last - np.searchsorted(sent.value, id_.to_numpy(), side="right")
        also = id_.map(sent_heads.value)
        return pd.Series([[int(r)] if pd.isna(x) else [int(r), -int(x) - 1] for r, x in zip(own, also, strict=True)], dtype=object)

    dealt = (keyed.withColumn("id", F.coalesce("doc_id", F.lit(lowest)))
             .withColumn("r", F.explode(ranges_of("id")))
             .withColumn("borrowed", F.col("r") < 0)
             .withColumn("r", F.when(F.col("borrowed"), -F.col("r") - 1).otherwise(F.col("r")))
             .repartitionById(last + 1, F.col("r"))
             .sortWithinPartitions("r", "borrowed", F.desc("id"), "text")
             .select("doc_id", "text", "r", "borrowed"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # (doc_id, text, digest, range) of the row before
        for batch in batches:
            out = []
            for doc_id, text, r, borrowed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = digest(text.encode())
                if waiting is not None and waiting[3] == r:
                    d, t, f, _ = waiting
                    new = edited(t, text).encode()
                    out.append((d, len(t), hashlib.sha256(new).hexdigest(), f, digest(new), own))
                waiting = None if borrowed else (doc_id, text, own, r)
            if out:
                yield _rows(out)

    return dealt.mapInArrow(compare, EDITED)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    d, n, sha, own, new, following = zip(*rows, strict=True)
    a, b, c = np.stack(own), np.stack(new), np.stack(following)
    hexed = lambda x: pa.array([r.tobytes().hex() for r in x])
    return pa.RecordBatch.from_arrays([
        pa.array(d, type=pa.int64()), pa.array(n, type=pa.int64()), pa.array(sha), hexed(a), hexed(b),
        pa.array(likeness(a, b)), pa.array(likeness(a, c))],
        names=[f.split()[0] for f in EDITED.split(", ")])
