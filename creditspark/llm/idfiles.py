"""Operator 8: token ids in fixed-width bit-packed files, and reading them back.

Ids are stored in the fewest bits that hold the vocabulary's largest id. A file
(one per task, in ascending doc_id) is::

    magic | blocks | doc_ids i64[n] | first id of each document i64[n+1]
          | place of each block i64[blocks+1] | bits, block ids, documents, ids i64 | magic

so a reader can find any document's ids from the index at the end, read only
the blocks that hold them, and unpack those with numpy. ``manifest.json`` lists
the files in order with the ids before each. A lost or repeated task leaves an
unlisted file behind, never a wrong one: files get names of their own and only
those that successful tasks reported are listed.

Defined cases: a null text is an empty one (its end id only); null doc_ids come
first, stored as the least long; rows with equal doc_ids follow each other by
text; an empty table gives no file and no rows; other columns are not read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditspark.llm import tokens as tk

MAGIC = b"IDBITS01"
BLOCK_IDS = 1 << 16
NULL_ID = -(1 << 63)


def bits_for(vocabulary_size: int) -> int:
    """The fewest bits that hold every id below ``vocabulary_size``."""
    return max(1, (vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """The ids' lowest ``bits`` bits, one after another, least bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids[:, None].astype(np.uint64) >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=n).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (planes.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=1).astype(np.uint32)


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Writer:
    """Appends documents to one file; at most one block waits in memory."""

    def __init__(self, uri: str, bits: int, block_ids: int = BLOCK_IDS):
        system, path = _open(uri)
        self.out = system.open_output_stream(path)
        self.bits, self.block_ids = bits, block_ids
        self.waiting: list[np.ndarray] = []
        self.waits = self.n_ids = 0
        self.doc_ids: list[int] = []
        self.firsts: list[int] = []
        self.places: list[int] = []
        self.at = len(MAGIC)
        self.out.write(MAGIC)

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.firsts.append(self.n_ids)
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.waits += len(ids)
        if self.waits >= self.block_ids:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        end = len(ids) if last else len(ids) - len(ids) % self.block_ids
        for first in range(0, end, self.block_ids):
            block = pack(ids[first: min(first + self.block_ids, end)], self.bits)
            self.places.append(self.at)
            self.out.write(block)
            self.at += len(block)
        self.waiting, self.waits = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._flush(last=True)
        for values in (self.doc_ids, [*self.firsts, self.n_ids], [*self.places, self.at],
                       [self.bits, self.block_ids, len(self.doc_ids), self.n_ids]):
            self.out.write(np.array(values, dtype="<i8").tobytes())
        self.out.write(MAGIC)
        self.out.close()


class Reader:
    """Random access to the documents of one file."""

    def __init__(self, uri: str):
        system, path = _open(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(32 + len(MAGIC), size - 32 - len(MAGIC))
        if tail[32:] != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"not a whole id file: {uri}")
        self.bits, self.block_ids, self.n_docs, self.n_ids = map(int, np.frombuffer(tail[:32], dtype="<i8"))
        self.n_blocks = -(-self.n_ids // self.block_ids)
        index = 8 * (2 * self.n_docs + self.n_blocks + 2)
        values = np.frombuffer(self.file.read_at(index, size - 32 - len(MAGIC) - index), dtype="<i8")
        self.doc_ids, self.firsts, self.places = np.split(values, [self.n_docs, 2 * self.n_docs + 1])
        self._block: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint32))

    def _unpacked(self, block: int) -> np.ndarray:
        if self._block[0] != block:
            first = int(self.places[block])
            data = self.file.read_at(int(self.places[block + 1]) - first, first)
            n = min(self.block_ids, self.n_ids - block * self.block_ids)
            self._block = (block, unpack(data, n, self.bits))
        return self._block[1]

    def ids(self, row: int) -> np.ndarray:
        """The ids of the row-th document of the file."""
        first, end = int(self.firsts[row]), int(self.firsts[row + 1])
        parts = []
        while first < end:
            block, at = divmod(first, self.block_ids)
            part = self._unpacked(block)[at: at + end - first]
            parts.append(part)
            first += len(part)
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0) -> list[dict]:
    """Writes ``docs`` (doc_id, text) to ``folder`` in ascending doc_id and
    returns the manifest: one entry per file, as many as there are tasks."""
    bits = bits_for(tk.Encoder.at(tokenizer_path).vocabulary_size)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, uri = None, f"{folder}/ids-{uuid.uuid4().hex}.bits"
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for row, ids in tk.encoded(batch.column(1), tokenizer_path, end_id):
                writer = writer or Writer(uri, bits)
                writer.add(NULL_ID if doc_ids[row] is None else doc_ids[row], ids)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({
                "part": [TaskContext.get().partitionId()], "file": [uri],
                "documents": [len(writer.doc_ids)], "ids": [writer.n_ids]})

    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
               .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))
    # One row per file comes to the driver: as many as there are tasks.
    files = sorted(ordered.mapInArrow(shard, "part long, file string, documents long, ids long").collect())
    manifest, before = [], 0
    for x in files:
        manifest.append({"file": x["file"], "documents": x["documents"], "ids": x["ids"], "before": before})
        before += x["ids"]
    with system.open_output_stream(f"{path}/manifest.json") as out:
        out.write(json.dumps({"bits": bits, "end_id": end_id, "files": manifest}).encode())
    return manifest


def read(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """The documents of the files: doc_id, start (ids of all documents before
    it), ids."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = Reader(file)
                waiting, size = [], 0
                for row in range(reader.n_docs):
                    ids = reader.ids(row)
                    doc_id = int(reader.doc_ids[row])
                    waiting.append((None if doc_id == NULL_ID else doc_id, before + int(reader.firsts[row]), ids))
                    size += len(ids)
                    if size >= 1 << 20 or len(waiting) >= 5000:
                        yield _rows(waiting)
                        waiting, size = [], 0
                if waiting:
                    yield _rows(waiting)

    rows = [(x["file"], x["before"]) for x in manifest]
    files = spark.createDataFrame(rows, "file string, before long")
    if rows:
        files = files.repartition(len(rows))
    return files.mapInArrow(documents, "doc_id long, start long, ids array<long>")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    lengths = np.array([len(x[2]) for x in rows])
    flat = np.concatenate([x[2] for x in rows]).astype(np.int64)
    return pa.RecordBatch.from_arrays([
        pa.array([x[0] for x in rows], type=pa.int64()),
        pa.array([x[1] for x in rows], type=pa.int64()),
        pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), type=pa.int32()), pa.array(flat)),
    ], names=["doc_id", "start", "ids"])


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what ``read`` gives."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            flat = ids.values.to_numpy(zero_copy_only=False)
            at = ids.offsets.to_numpy()
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1),
                pa.array(np.diff(at).astype(np.int64)),
                pa.array([tk.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], type=pa.int64()),
            ], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return documents.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
