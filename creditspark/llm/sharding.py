"""Operator 12 [native]: shards of shuffled records by a two-pass external shuffle.

First pass: each record goes to one of as many buckets as hold ``BUCKET_BYTES``
each, by a seeded hash of what it is and where it stands, so equal records
scatter as well. Second pass: each bucket is read by one task, put into a defined
order, shuffled by Fisher-Yates (``shuffle`` in the JVM, seeded) and written. A
record's place in the whole order is its bucket's first place plus its place in
the bucket, and the shards are equal ranges of that order: their row counts are
at most one apart (the law ``rows``), and a bucket's records go to one shard, or
to the few shards that its range reaches.

All of it are DataFrame functions. A task holds one bucket; what is numbered or
offset is one short row per bucket.

A record's place in its input is its file and row there, which a lost task finds
again. Only where the input is not a plain scan is it written to the shared
folder first, so that every attempt of a task sees the same rows in the same
places. The same files, seed and bucket size give the same shards.

Defined cases: a null text has no bytes and the size 1; an empty text is written
as such; rows with a null or repeated doc_id and repeated rows are records of
their own; a record larger than a bucket fills one; fewer records than shards
leave shards empty; an empty table writes no rows; all columns of ``docs`` are
kept under ``record``, so that no name clashes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditspark.llm.shared import cut, folder

SHARDS = 16
SEED = 20_240_601
# Text bytes of a bucket; one task works on one bucket in memory.
BUCKET_BYTES = 16 << 20
# Buckets whose counts are summed by one task.
BLOCK = 4096


def size(text: str | Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _is_scan(docs: DataFrame) -> bool:
    """Files, filters and row-wise columns only."""
    plan = docs._jdf.queryExecution().analyzed().toString()
    lines = [re.sub(r"^[\s:+|-]*", "", line) for line in plan.splitlines() if line.strip()]
    return lines[-1].startswith("Relation") and all(re.match("Project|Filter|SubqueryAlias", x) for x in lines[:-1])


def placed(docs: DataFrame) -> DataFrame:
    """``record`` (all columns of ``docs``), ``text`` and ``place``: a hash of the
    record's file and row, the same in every attempt."""
    if not _is_scan(docs):
        path = folder(docs.sparkSession, "records")
        docs.write.parquet(path)
        docs = docs.sparkSession.read.schema(docs.schema).parquet(path)
    here = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(here.alias("record"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))


def buckets_for(total: int, bucket_bytes: int) -> int:
    return max(1, -(-total // bucket_bytes))


def scattered(docs: DataFrame, seed: int, bucket_bytes: int) -> tuple[DataFrame, int]:
    """First pass: record, tie, bucket; and the number of buckets."""
    rows = placed(docs)
    total = rows.agg(F.sum(size("record.text"))).first()[0] or 0
    n = buckets_for(total, bucket_bytes)
    tie = F.xxhash64(F.lit(seed), F.col("record.doc_id"), "file", "row")
    return rows.select("record", tie.alias("tie"), "row", F.pmod(F.xxhash64(F.lit(seed + 1), tie), F.lit(n)).cast("int").alias("bucket")), n


def first_places(counts: DataFrame) -> DataFrame:
    """bucket, start (records in the buckets before it) and total from bucket, m:
    running sums within blocks of buckets, and over the blocks."""
    blocks = counts.withColumn("block", F.floor(F.col("bucket") / BLOCK))
    sums = blocks.groupBy("block").agg(F.sum("m").alias("block_m"))
    every = Window.partitionBy(F.lit(0))  # a row per BLOCK buckets
    before = sums.select("block", F.sum("block_m").over(every).alias("total"),
                         (F.sum("block_m").over(every.orderBy("block")) - F.col("block_m")).alias("before"))
    own = F.sum("m").over(Window.partitionBy("block").orderBy("bucket")) - F.col("m")
    return (blocks.select("block", "bucket", own.alias("own")).join(before, "block")
            .select("bucket", (F.col("before") + F.col("own")).alias("start"), "total"))


def shuffled(docs: DataFrame, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """record, place (0 to the number of records, each once) and total, in the
    order of places within each partition; one partition per bucket."""
    rows, n = scattered(docs, seed, bucket_bytes)
    counts = cut(rows.groupBy("bucket").agg(F.count("*").alias("m")))
    starts = first_places(counts)
    # A partition is a bucket, and each bucket is put into a defined order before
    # the seeded shuffle, so a task that runs again gives the same order.
    held = (rows.repartitionById(n, F.col("bucket")).groupBy("bucket")
            .agg(F.shuffle(F.array_sort(F.collect_list(F.struct("tie", "row", "record")), _by_tie), seed).alias("own")))
    return (held.join(starts, "bucket").select("start", "total", F.posexplode("own").alias("at", "x"))
            .select(F.col("x.record").alias("record"), (F.col("start") + F.col("at")).alias("place"), "total"))


def _by_tie(a: Column, b: Column) -> Column:
    """Records may hold columns that have no order; the hash and the row decide."""
    less = (a["tie"] < b["tie"]) | ((a["tie"] == b["tie"]) & (a["row"] < b["row"]))
    more = (a["tie"] > b["tie"]) | ((a["tie"] == b["tie"]) & (a["row"] > b["row"]))
    return F.when(less, -1).when(more, 1).otherwise(0)


def in_shards(places: DataFrame, shards: int) -> DataFrame:
    """record, shard, slot: shard s holds the places from floor(s N / shards) on."""
    shard = F.expr(f"cast((place * {shards} + {shards - 1}) div total as int)")
    return places.withColumn("shard", shard).select(
        "record", "shard", F.expr(f"place - (shard * total) div {shards}").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Writes folders ``shard=<k>`` of Parquet files (record, slot), in slot order
    within each file, and returns the table as read from them."""
    out = in_shards(shuffled(docs, seed, bucket_bytes), shards)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    schema = T.StructType([out.schema["record"], out.schema["slot"], T.StructField("shard", T.IntegerType())])
    return docs.sparkSession.read.schema(schema).parquet(path)


def digests(written: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of written records."""
    text = F.col("record.text")
    return written.select(
        F.col("record.doc_id").alias("doc_id"), size(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
