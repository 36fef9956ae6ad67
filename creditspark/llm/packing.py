"""Operator 4: packing token sequences by non-negative least squares.

Each document becomes pieces of at most ``capacity`` ids. How many pieces have
each length is a histogram of ``capacity`` numbers, whatever the corpus' size;
on it the driver plans: patterns are up to three lengths that fill a sequence exactly,
non-negative repeat counts of the patterns are fitted to the histogram by least
squares, rounded, and what is left is packed by best fit on the histogram. All
exact fills take part, by column generation: the fit starts from the pairs, each
round prices every fill by the residual it would take away and adds the best ones
of each length, until none is worth more than half a piece or the fit no longer
gains. The plan gives, for the r-th piece of a length, its sequence and
place; the executors rank the pieces of each length (counts by task and length,
then running sums over tasks) and look their places up.

Defined cases: a null text is an empty one (its end id only); each row is a
document of its own, also where doc_ids repeat or are null; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditspark.llm import textbatch as tb
from creditspark.llm import tokens as tk
from creditspark.llm.shared import cut

CAPACITY = 2048
FIT_STEPS = 300
# A fill is added if it takes away more than so many pieces of the residual, and
# rounds go on while they lessen the squared residual by this part at least.
WORTH, GAIN = 0.5, 1e-3


# ---- the plan, on the histogram of lengths -------------------------------------------------


def pairs(present: np.ndarray, capacity: int) -> np.ndarray:
    """Exact fills of two lengths that occur, as rows (a >= b, 0)."""
    here = _here(present, capacity)
    a = np.arange(-(-capacity // 2), capacity)
    a = a[here[a] & here[capacity - a]]
    return np.stack([a, capacity - a, np.zeros_like(a)], axis=1)


def _here(present: np.ndarray, capacity: int) -> np.ndarray:
    here = np.zeros(capacity + 1, dtype=bool)
    here[present[present < capacity]] = True
    here[0] = False
    return here


def priced(residual: np.ndarray, present: np.ndarray, capacity: int) -> np.ndarray:
    """For each largest length a, the exact fill of three lengths (a >= b >= c)
    that takes most of the residual away, if it is worth it."""
    here, found = _here(present, capacity), []
    for a in np.flatnonzero(here[-(-capacity // 3):]) + -(-capacity // 3):
        b = np.arange(-(-(capacity - a) // 2), min(a, capacity - a - 1) + 1)
        b = b[here[b] & here[capacity - a - b]]
        if len(b):
            worth = residual[a] + residual[b] + residual[capacity - a - b]
            k = int(np.argmax(worth))
            if worth[k] > WORTH:
                found.append((a, b[k], capacity - a - b[k]))
    return np.array(found, dtype=int).reshape(-1, 3)


def fitted(histogram: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and their fitted repeat counts, by column generation."""
    present = np.flatnonzero(histogram)
    rows = pairs(present, capacity)
    x, known, last = np.zeros(len(rows)), set(map(tuple, rows.tolist())), np.inf
    while True:
        x = fit(rows, histogram, start=x)
        used = (rows > 0) * x[:, None]
        residual = histogram - np.bincount(rows.ravel(), weights=used.ravel(), minlength=len(histogram))
        new = np.array([r for r in priced(residual, present, capacity).tolist() if tuple(r) not in known], dtype=int).reshape(-1, 3)
        now = float((residual[1:] ** 2).sum())
        if not len(new) or now > (1 - GAIN) * last:
            return rows, x
        last = now
        known.update(map(tuple, new.tolist()))
        rows, x = np.concatenate([rows, new]), np.concatenate([x, np.zeros(len(new))])


def fit(rows: np.ndarray, histogram: np.ndarray, steps: int = FIT_STEPS, start: np.ndarray | None = None) -> np.ndarray:
    """Non-negative repeat counts x that minimise ``|A x - histogram|`` (A:
    how often a pattern holds each length), by accelerated projected gradients
    from ``start`` on."""
    if not len(rows):
        return np.zeros(0)
    bins = len(histogram)
    flat, used = rows.ravel(), (rows > 0).astype(float)

    def lengths_of(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, weights=(x[:, None] * used).ravel(), minlength=bins)

    def patterns_of(y: np.ndarray) -> np.ndarray:
        return (y[rows] * used).sum(axis=1)

    v = np.ones(len(rows))
    for _ in range(20):  # largest eigenvalue of A'A
        v = patterns_of(lengths_of(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = z = np.zeros(len(rows)) if start is None else start
    t = 1.0
    for _ in range(steps):
        x_next = np.maximum(0.0, z - patterns_of(lengths_of(z) - histogram) / (1.05 * norm))
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z = x_next + (t - 1) / t_next * (x_next - x)
        x, t = x_next, t_next
    return x


def rounded(rows: np.ndarray, x: np.ndarray, histogram: np.ndarray) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Whole repeat counts whose running sums follow those of x, never more
    than the pieces there are; and the histogram that is left."""
    whole = np.diff(np.floor(np.concatenate(([0.0], np.cumsum(x))) + 0.5)).astype(int)
    left = histogram.astype(int).copy()
    plan = []
    for k in np.argsort(-x, kind="stable"):
        if whole[k] <= 0:
            continue
        pattern = tuple(int(v) for v in rows[k] if v)
        n = min(int(whole[k]), *(left[v] // pattern.count(v) for v in set(pattern)))
        if n > 0:
            for v in pattern:
                left[v] -= n
            plan.append((pattern, int(n)))
    return plan, left


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing on a histogram: equal open sequences move together,
    so the work follows the number of lengths, not of pieces."""
    open_: dict[int, list[list]] = defaultdict(list)  # room left: [pattern, how many]
    rooms: list[int] = []
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n > 0:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                group = open_[room][-1]
                moved = min(n, group[1])
                group[1] -= moved
                if not group[1]:
                    open_[room].pop()
                    if not open_[room]:
                        del open_[room], rooms[at]
                grown, n = (group[0] + (length,), moved), n - moved
            else:
                each = min(n, capacity // length)
                grown, n = ((length,) * each, n // each), n % each
            room = capacity - sum(grown[0])
            if room not in open_:
                rooms.insert(bisect_left(rooms, room), room)
            open_[room].append([*grown])
    return [(tuple(p), n) for groups in open_.values() for p, n in groups]


@dataclass
class Plan:
    """For each length, runs of ranks: the run's first rank, its sequence for
    that rank (the next rank has the next sequence), and the place in it."""

    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    sequences: int

    def place(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, sequence, offset = self.runs[length]
        run = np.searchsorted(first, rank, side="right") - 1
        return sequence[run] + rank - first[run], offset[run]


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """The plan for ``histogram[length]`` pieces of each length up to ``capacity``."""
    exact, left = rounded(*fitted(histogram, capacity), histogram)
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    ranked = np.zeros(capacity + 1, dtype=np.int64)
    sequences = 0
    for pattern, n in exact + best_fit(left, capacity):
        offset = 0
        for length in pattern:
            runs[length].append((int(ranked[length]), sequences, offset))
            ranked[length] += n
            offset += length
        sequences += n
    if not np.array_equal(ranked, histogram):
        raise AssertionError("the plan does not hold every piece once")
    return Plan({k: tuple(np.array(v, dtype=np.int64).T) for k, v in runs.items()}, sequences)


# ---- pieces and their places, on the executors ----------------------------------------------

PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long, "
          "pack_task int, pack_rank long")


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY,
           ids: bool = False) -> DataFrame:
    """Each document's ids cut into pieces of ``capacity``, of which the first
    may be shorter; ``ids`` adds the pieces' ids. pack_task and pack_rank number
    the pieces of a length within a task."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            out: list[tuple] = []
            for row, coded in tk.encoded(batch.column(1), tokenizer_path, end_id):
                count = -(-len(coded) // capacity)
                start, end = 0, len(coded) - (count - 1) * capacity
                for piece in range(count):
                    part = coded[start:end]
                    out.append((doc_ids[row], piece, start, len(part), tk.crc32(part), task, int(seen[len(part)]),
                                part.tolist() if ids else None))
                    seen[len(part)] += 1
                    start, end = end, end + capacity
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "pack_task", "pack_rank"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            columns = [pa.array([r[k] for r in out], type=kind) for k, kind in enumerate(kinds)]
            if ids:
                names, columns = [*names, "ids"], [*columns, pa.array([r[7] for r in out], type=pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = PIECES + (", ids array<long>" if ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut_up, schema)


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Gives every piece a sequence_id and an offset in it. ``cut_pieces`` is
    what ``pieces`` gives, kept (see ``shared.cut``) so that it does not change."""
    spark = cut_pieces.sparkSession
    by_task = cut_pieces.groupBy("length", "pack_task").agg(F.count("*").alias("n"))
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in by_task.groupBy("length").agg(F.sum("n")).collect():  # at most ``capacity`` rows
        histogram[length] = n
    # The plan's size is bounded by the number of lengths and their exact fills.
    planned = spark.sparkContext.broadcast(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("pack_task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("length", "pack_task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("pack_base"))
    ranked = (cut_pieces.join(bases, ["length", "pack_task"])
              .withColumn("pack_rank", F.col("pack_rank") + F.col("pack_base")).drop("pack_base", "pack_task"))
    kept = [c for c in ranked.columns if c != "pack_rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = planned.value
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("pack_rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(rows):
                    sequence[rows], offset[rows] = p.place(int(length[rows[0]]), rank[rows])
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [pa.array(sequence), pa.array(offset)],
                names=[*kept, "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name in kept)
    placed = ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")
    first = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return placed.select(*first, *[c for c in placed.columns if c not in first])


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    return pack(cut(pieces(docs, tokenizer_path, end_id, capacity)), capacity)
