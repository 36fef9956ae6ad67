"""Operator 13: periodic runs of words by recompression.

A run is a stretch of consecutive words with smallest period q (words q apart
are the same) of at least ``LEAST`` words and two periods, which no neighbouring
word extends.

Recompression turns the word sequence into a run-length grammar. Rounds
alternate: block compression replaces each maximal block of one symbol by a
symbol of its own, pair compression splits the symbols in left and right ones and
replaces each left-right pair. Whether symbols join depends on themselves alone,
so equal stretches are parsed alike but at their ends, and the longest common
extension of two places takes one step per level: up while both places begin
symbols of the next level, then down where the symbols differ. No suffix array.

Candidates lie on harmonic grids: a run of period q holds two grid points kq and
(k+1)q with equal words, so n/q pairs for each q are all there is to look at, and
equal extensions to both sides give the run exactly. A run found with a multiple
of its period has the same ends and gives way to the smallest.

Documents are independent: each is read in one task, whole, and nothing is
shuffled. Memory for a document of n words is about 150 bytes a word while its
grammar is there; shorter documents are worked on ``SLICE_BYTES`` at a time.

Defined cases: null and empty texts have no words, no runs and an empty collapsed
text; equal rows give equal results; rows with a null doc_id are judged as any
other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditspark.llm import textbatch as tb

LEAST = 12
SLICE_BYTES = 2 << 20
# Candidate pairs extended at once.
PAIRS = 1 << 18
# Grid points of documents up to so many words are looked up, of longer ones made.
GRID_WORDS = 1 << 15


# ---- the grammar --------------------------------------------------------------------------------


@dataclass
class Level:
    """A symbol sequence and how the next level joins it: ``start`` marks places
    that begin a symbol of the next level, ``rest`` counts the equal symbols from
    here on that it joins (one in a pair), ``parent`` is its place there; ``first``
    are the places where the symbols of the next level begin."""

    sym: np.ndarray
    start: np.ndarray | None = None
    rest: np.ndarray | None = None
    parent: np.ndarray | None = None
    first: np.ndarray | None = None
    blocks: bool = False

    def join(self, start: np.ndarray, blocks: bool) -> None:
        self.start, self.blocks = start, blocks
        self.first = np.flatnonzero(start)
        self.parent = np.cumsum(start, dtype=np.int32) - 1
        if blocks:
            self.rest = (np.append(self.first[1:], len(start))[self.parent] - np.arange(len(start))).astype(np.int32)
        else:
            self.rest = np.ones(len(start), dtype=np.int32)

    def mirrored(self) -> Level:
        """The same grammar for the sequence read backwards."""
        out = Level(self.sym[::-1])
        if self.start is not None:
            out.join(np.append(self.start[1:], True)[::-1].copy(), self.blocks)
        return out


def _blocks(sym: np.ndarray) -> np.ndarray:
    start = np.ones(len(sym), dtype=bool)
    start[1:] = sym[1:] != sym[:-1]
    return start


def _pairs(sym: np.ndarray, fixed: np.ndarray, turn: int) -> np.ndarray:
    """A left symbol joins the right one behind it; a hash deals the sides."""
    left = (tb.mix64(sym.astype(np.uint64) + np.uint64((turn + 1) << 40)) & np.uint64(1)).astype(bool)
    joined = left[:-1] & ~left[1:] & ~fixed[:-1] & ~fixed[1:]
    return np.concatenate(([True], ~joined))


def grammar(sym: np.ndarray, ends: np.ndarray) -> list[Level]:
    """Levels over ``sym``. The symbols at ``ends``, the first and last place among
    them, occur once each and join no other, so no symbol spans two documents."""
    n_fixed = len(ends)
    sym = sym.astype(np.int64)
    next_id = int(sym.max()) + 1
    names = np.zeros(next_id, dtype=bool)
    names[sym[ends]] = True
    levels = [Level(sym)]
    turn = 0
    while len(sym) > 2 * n_fixed - 1 and turn < 400:  # more than one symbol somewhere
        fixed = np.zeros(len(sym), dtype=bool)
        known = sym < len(names)
        fixed[known] = names[sym[known]]
        blocks = turn % 2 == 0
        start = _blocks(sym) if blocks else _pairs(sym, fixed, turn)
        turn += 1
        if start.all():
            continue
        level = levels[-1]
        level.join(start, blocks)
        length = np.diff(np.append(level.first, len(sym)))
        own = sym[level.first]
        many = np.flatnonzero(length > 1)
        # A block is told by its symbol and length, a pair by both symbols.
        second = length[many] if blocks else sym[level.first[many] + 1]
        code, seen = pd.factorize(own[many] * np.int64(max(next_id, len(sym) + 1)) + second)
        own[many] = next_id + code
        next_id += len(seen)
        sym = own
        levels.append(Level(sym))
    return levels


def extensions(levels: list[Level], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each pair of places i <> j of one document, how many symbols from there
    on are equal."""
    start_i, at, waiting = i, np.arange(len(i)), []
    for level in levels[:-1]:
        same = level.sym[i] == level.sym[j]
        held = [(at[~same], i[~same], j[~same])]
        at, i, j = at[same], i[same], j[same]
        step = np.where(level.start[i] & level.start[j], 0, np.minimum(level.rest[i], level.rest[j]))
        i, j = i + step, j + step
        # Where one place still is inside a symbol, the symbols here differ.
        up = level.start[i] & level.start[j]
        held.append((at[~up], i[~up], j[~up]))
        waiting.append(held)
        at, i, j = at[up], level.parent[i[up]], level.parent[j[up]]
    sym, held = levels[-1].sym, []
    while len(at):
        same = sym[i] == sym[j]
        held.append((at[~same], i[~same], j[~same]))
        at, i, j = at[same], i[same] + 1, j[same] + 1
    waiting.append(held)
    for k in range(len(levels) - 1, -1, -1):
        at, i, j = (np.concatenate([at_k[x] for at_k in ((at, i, j), *waiting[k])]) for x in range(3))
        if k:
            level = levels[k - 1]
            i, j = level.first[i], level.first[j]
            step = np.where(level.sym[i] == level.sym[j], np.minimum(level.rest[i], level.rest[j]), 0)
            i, j = i + step, j + step
    out = np.empty(len(start_i), dtype=np.int64)
    out[at] = i
    return out - start_i


# ---- candidates and runs ------------------------------------------------------------------------


@functools.cache
def _grid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (j, q) of the grids with j - q >= 0, by j; where each j begins."""
    q = np.arange(1, GRID_WORDS)
    counts = (GRID_WORDS - 1) // q
    every_q = np.repeat(q, counts)
    j = every_q * (np.arange(len(every_q)) - np.repeat(np.cumsum(counts) - counts, counts) + 1)
    order = np.argsort(j, kind="stable")
    j = j[order]
    return j.astype(np.int32), every_q[order].astype(np.int32), np.searchsorted(j, np.arange(GRID_WORDS + 1))


def candidates(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places j and periods q of grid pairs (j - q, j) with equal words, and equal
    words beside them as well: a run has six such pairs in a row at least."""
    n = len(seq)
    if n < LEAST:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n <= GRID_WORDS:
        j, q, first = _grid()
        j, q = j[:first[n]], q[:first[n]]
        equal = np.flatnonzero(seq[j] == seq[j - q])
        j, q = j[equal].astype(np.int64), q[equal].astype(np.int64)
    else:
        found = [(np.flatnonzero(seq[:-p:p][: (n - 1) // p] == seq[p::p]), p) for p in range(1, n // 2 + 1)]
        q = np.repeat([p for _, p in found], [len(k) for k, _ in found])
        j = np.concatenate([(k + 1) * p for k, p in found])
    right = seq[np.minimum(j + 1, n - 1)] == seq[np.minimum(j + 1 - q, n - 1)]
    left = seq[np.maximum(j - 1, 0)] == seq[np.maximum(j - 1 - q, 0)]
    beside = (2 * q <= n) & (right & (j + 1 < n) | left & (j - q > 0))
    return j[beside], q[beside]


def runs_of(sequences: list[np.ndarray]) -> list[np.ndarray]:
    """For each sequence of word ids its runs: rows of start, length, period by
    start, then period."""
    none = np.zeros((0, 3), dtype=np.int64)
    found = [none] * len(sequences)
    pairs = {d: c for d, s in enumerate(sequences) if len((c := candidates(s))[0])}
    if not pairs:
        return found
    held = list(pairs)
    # Documents one after another, an end of its own before, between and behind them.
    sizes = np.array([len(sequences[d]) for d in held])
    ends = np.concatenate(([0], np.cumsum(sizes + 1)))
    base = ends[:-1] + 1
    sym = np.empty(ends[-1] + 1, dtype=np.int64)
    code, seen = pd.factorize(np.concatenate([sequences[d] for d in held]))
    inside = np.ones(len(sym), dtype=bool)
    inside[ends] = False
    sym[inside] = code
    sym[ends] = len(seen) + np.arange(len(ends))
    levels = grammar(sym, ends)
    back = [level.mirrored() for level in levels]
    doc = np.repeat(np.arange(len(held)), [len(pairs[d][0]) for d in held])
    q = np.concatenate([pairs[d][1] for d in held])
    j = np.concatenate([pairs[d][0] for d in held]) + base[doc]
    parts = []
    for k in range(0, len(j), PAIRS):
        jk, qk, dk = j[k: k + PAIRS], q[k: k + PAIRS], doc[k: k + PAIRS]
        ahead = extensions(levels, jk - qk, jk)
        last = len(sym) - 1
        behind = extensions(back, last - (jk - qk - 1), last - (jk - 1))
        length = ahead + behind + qk
        ok = length >= np.maximum(LEAST, 2 * qk)
        parts.append(np.unique(np.column_stack((dk, jk - qk - behind - base[dk], length, qk))[ok], axis=0))
    rows = np.unique(np.concatenate(parts), axis=0)  # by document, start, length, period
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    rows = rows[first]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    for k, own in enumerate(np.split(rows[:, 1:], np.searchsorted(rows[:, 0], np.arange(1, len(held))))):
        found[held[k]] = own
    return found


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words no run holds behind its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


# ---- the operator -------------------------------------------------------------------------------

COLUMNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(docs: DataFrame, read_as: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period by start, then period) and the
    collapsed text: its words, joined by one space, without those that a run
    repeats. ``read_as`` may give for (doc_id, number of words) the numbers of the
    words to read in place of the text's own order."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, end, data, offsets in tb.slices(batch.column(1), SLICE_BYTES):
                w = tb.words(data, offsets)
                ids, distinct = tb.encode_words(data, w)
                sequences = [ids[a:b] for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]
                if read_as is not None:
                    order = [read_as(d, len(s)) for d, s in zip(doc_ids[first:end], sequences, strict=True)]
                    sequences = [s if o is None else s[o] for s, o in zip(sequences, order, strict=True)]
                yield _rows(batch.column(0).slice(first, end - first), sequences, distinct)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, COLUMNS)


def _rows(doc_ids: pa.Array, sequences: list[np.ndarray], distinct: pa.Array) -> pa.RecordBatch:
    runs = runs_of(sequences)
    names = np.array([*distinct.to_pylist(), b""], dtype=object)[:-1]
    texts = [b" ".join(names[s[kept_words(len(s), r)] if len(r) else s].tolist()) for s, r in zip(sequences, runs, strict=True)]
    rows = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
    at = np.concatenate(([0], np.cumsum([len(r) for r in runs]))).astype(np.int32)
    spans = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], names=["start", "length", "period"])
    return pa.RecordBatch.from_arrays(
        [doc_ids, pa.array([len(s) for s in sequences], type=pa.int64()), pa.ListArray.from_arrays(pa.array(at), spans),
         pa.array(texts, type=pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])


def repeated_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """The contract's rewriting of a tenth of the documents: from word a on, the
    next p words again and again. A null doc_id is left as it is."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns from ``periodic_runs``."""
    longest = F.element_at(F.sort_array(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    some = F.size("runs") > 0
    return (found.withColumn("best", F.when(some, longest))
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
                    (-F.col("best.less")).alias("length"), F.col("best.period").alias("period"),
                    F.expr("(1000 * -best.less) div best.period").alias("exponent_milli"),
                    F.sha2(F.concat_ws("", line), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))
