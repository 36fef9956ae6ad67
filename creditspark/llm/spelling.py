"""Operator 11: spelling variants by a reduced alphabet.

Two words are near if they differ by exactly one inserted, deleted or replaced
code point. Letters are hashed to ``SYMBOLS`` symbols. Near words then have
reduced words that are equal or one edit apart, so the full one-edit neighbourhood
of each reduced word (itself, deletions, replacements, insertions, each distinct
string once) is joined to the reduced vocabulary, and each pair met is verified
on the original strings. Each pair comes out once in each direction, so a word's
near words are simply what its own neighbourhood meets.

Reduced words are never built: a polynomial hash of each neighbour follows from
the hashes of the word's beginnings and ends in constant time, so a word of n
letters costs time and memory in proportion to n (a batch of neighbours at a
time). Neighbours that no reduced word can equal are dropped where they arise, by
a bitmap of the vocabulary's keys that has ``FILTER_BITS`` bits at any size; a
full bitmap would drop less and change no result.

A word's form is its near word of largest n, if that is at least ``RATIO`` times
its own; following forms leads to its root. n grows by that ratio at each step, so
chains are short, and pointers are doubled until none moves.

Defined cases: null and empty texts have no words; a null doc_id counts as the
empty text where the contract hashes it; repeated rows count as often as they are
there; a run of letters of any length is one word; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditspark.llm import textbatch as tb
from creditspark.llm.shared import compact, cut

LEAST_POINTS = 7
LEAST_N = 2
RATIO = 10
SYMBOLS = 8
FILTER_BITS = 1 << 26
SLICE_BYTES = 2 << 20
# Letters of words whose neighbourhoods are made at once.
LETTERS = 1 << 16

# ---- the vocabulary -----------------------------------------------------------------------------

Alter = Callable[[int | None, list[bytes]], dict[int, bytes]]


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tb.Words:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF (bytes C3 80 to C3 BF)."""
    inside = ((data | 32) >= 97) & ((data | 32) <= 122) | (data == 0xC3)
    inside[1:] |= data[:-1] == 0xC3
    return tb.runs(inside, offsets)


def vocabulary(docs: DataFrame, alter: Alter | None = None, least_points: int = LEAST_POINTS, least_n: int = LEAST_N) -> DataFrame:
    """word, n: lower-cased letter runs of at least ``least_points`` code points
    and their numbers, from ``least_n`` on. ``alter`` may replace some of a
    document's runs: it gets the doc_id and the runs and returns those it changes
    by their place in the list."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, end, data, offsets in tb.slices(batch.column(1), SLICE_BYTES):
                data = tb.lower_ascii(data)
                w = letter_runs(data, offsets)
                points = tb.code_points_before(data)
                long = points[w.ends] - points[w.starts] >= least_points
                starts, ends = w.starts[long], w.ends[long]
                if not len(starts):
                    continue
                edge = np.zeros(len(data) + 1, dtype=np.int8)
                np.add.at(edge, starts, 1)
                np.add.at(edge, ends, -1)
                words = tb.pieces(data, starts, ends, np.cumsum(edge[:-1], dtype=np.int8).astype(bool))
                coded = words.dictionary_encode()
                ids = coded.indices.to_numpy(zero_copy_only=False)
                as_is, changed = np.ones(len(ids), dtype=bool), Counter()
                if alter is not None:
                    runs, at = words.to_pylist(), np.searchsorted(starts, offsets).tolist()
                    for d in range(end - first):
                        for k, word in alter(doc_ids[first + d], runs[at[d]: at[d + 1]]).items():
                            as_is[at[d] + k] = False
                            if len(word.decode()) >= least_points:
                                changed[word] += 1
                n = np.bincount(ids[as_is], minlength=len(coded.dictionary))
                yield _counted(coded.dictionary.filter(pa.array(n > 0)), n[n > 0])
                yield _counted(pa.array(list(changed), type=pa.large_binary()), list(changed.values()))

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def _counted(words: pa.Array, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([words.cast(pa.large_string()).cast(pa.string()), pa.array(n, type=pa.int64())], names=["word", "n"])


def one_letter_lost(doc_id: int | None, runs: list[bytes]) -> dict[int, bytes]:
    """The contract's slips: where 31 divides the checksum of doc_id and run, the
    run's code point checksum mod length goes."""
    before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out = {}
    for k, run in enumerate(runs):
        h = zlib.crc32(run, before)
        if h % 31 == 0:
            word = run.decode()
            at = h % len(word)
            out[k] = (word[:at] + word[at + 1:]).encode()
    return out


# ---- reduced words and their neighbourhoods -----------------------------------------------------

_BASE = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))


def _by_length(words: list[str], symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of words of one length, and their symbols (1 to ``symbols``), about
    ``LETTERS`` letters at a time."""
    length = np.array([len(w) for w in words], dtype=np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    first = np.cumsum(length) - length
    order = np.argsort(length, kind="stable")
    for n in np.unique(length).tolist():
        rows = order[np.searchsorted(length[order], n): np.searchsorted(length[order], n, side="right")]
        step = max(1, LETTERS // max(1, n))
        for k in range(0, len(rows), step):
            own = rows[k: k + step]
            letters = points[first[own][:, None] + np.arange(n)]
            yield own, tb.mix64(letters.astype(np.uint64)) % np.uint64(symbols) + np.uint64(1)


def _prefixes(sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and the polynomial hashes of all beginnings."""
    n = sym.shape[1]
    power = np.full(n + 1, _BASE, dtype=np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    before = np.zeros((len(sym), n + 1), dtype=np.uint64)
    np.cumsum(sym * power[:n], axis=1, out=before[:, 1:])
    return power, before


def keys(words: list[str], symbols: int = SYMBOLS) -> np.ndarray:
    """The key of each word's reduced word."""
    out = np.zeros(len(words), dtype=np.int64)
    for rows, sym in _by_length(words, symbols):
        out[rows] = tb.mix64(_prefixes(sym)[1][:, -1]).view(np.int64)
    return out


def neighbours(words: list[str], symbols: int = SYMBOLS, may_be: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``words`` and keys of their reduced words' one-edit neighbourhoods,
    each pair once, as far as ``may_be`` lets keys through."""
    for rows, sym in _by_length(words, symbols):
        n = sym.shape[1]
        power, before = _prefixes(sym)
        whole = before[:, -1:]
        found = []

        def keep(hashes: np.ndarray, distinct: np.ndarray | None = None, found=found) -> None:
            key = tb.mix64(hashes)
            ok = np.ones(key.shape, dtype=bool) if may_be is None else may_be(key)
            if distinct is not None:
                ok &= distinct
            at = np.nonzero(ok)
            found.append((at[0], key[at]))

        keep(whole)
        # A letter behind an equal one is not deleted, nor inserted behind one: the string is there already.
        width = max(1, LETTERS // len(rows))
        for a in range(0, n + 1, width):
            b = min(a + width, n + 1)
            c = min(b, n)
            own, head, rest = sym[:, a:c], before[:, a:b], whole - before[:, a:b]
            ahead = np.concatenate((np.zeros((len(sym), 1), np.uint64), sym), axis=1)[:, a:b]  # the letter before each place
            keep(head[:, : c - a] + (whole - before[:, a + 1: c + 1]) * _BACK, own != ahead[:, : c - a])
            for s in range(1, symbols + 1):
                s = np.uint64(s)
                keep(whole + (s - own) * power[a:c], own != s)
                keep(head + s * power[a:b] + rest * np.uint64(_BASE), ahead != s)
        at, key = (np.concatenate([x[k] for x in found]) for k in range(2))
        order = np.lexsort((key, at))
        at, key = at[order], key[order]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | (key[1:] != key[:-1])
        yield rows[at[new]], key[new].view(np.int64)


def _key_bits(vocab: DataFrame) -> np.ndarray:
    """A bit for each key's remainder; ``FILTER_BITS`` bits in all."""
    slot = F.pmod("key", F.lit(FILTER_BITS)) + 1
    rows = (vocab.groupBy(F.bitmap_bucket_number(slot).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect())  # 4 KB each
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in rows:
        at = (r.bucket - 1) * len(r.bits)
        out[at: at + len(r.bits)] = np.frombuffer(r.bits, dtype=np.uint8)
    return out


# ---- pairs, forms and roots ---------------------------------------------------------------------


def _with_keys(vocab: DataFrame, symbols: int) -> DataFrame:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = keys(batch.column(0).to_pylist(), symbols)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key)], names=["word", "n", "key"])

    numbered = vocab.select("word", "n").mapInArrow(add, "word string, n long, key long")
    return cut(numbered.withColumn("id", F.monotonically_increasing_id()))


def near_pairs(vocab: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """a, n_a, b, word_b, n_b for each word a of ``vocab`` (word, n, key, id) and
    each near word b."""
    bits = vocab.sparkSession.sparkContext.broadcast(_key_bits(vocab))

    def may_be(key: np.ndarray) -> np.ndarray:
        slot = key & np.uint64(FILTER_BITS - 1)
        return (bits.value[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for rows, key in neighbours(batch.column(1).to_pylist(), symbols, may_be):
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(key)], names=["a", "key"])

    met = (vocab.select("id", "word").mapInArrow(near, "a long, key long")
           .join(vocab.select("key", F.col("id").alias("b"), F.col("word").alias("word_b"), F.col("n").alias("n_b")), "key")
           .where("a <> b").select("a", "b", "word_b", "n_b"))
    own = vocab.select(F.col("id").alias("a"), F.col("word").alias("word_a"), F.col("n").alias("n_a"))
    return met.join(own, "a").where(F.levenshtein("word_a", "word_b", 1) == 1).select("a", "n_a", "b", "word_b", "n_b")


def _roots(forms: DataFrame) -> DataFrame:
    """id, root, root_word where forms (id, form_id, form) lead at last."""
    now = compact(forms.select("id", F.col("form_id").alias("root"), F.col("form").alias("root_word")))
    while True:
        on = now.select(F.col("id").alias("root"), F.col("root").alias("to"), F.col("root_word").alias("to_word"))
        far = now.join(on, "root", "left")
        if far.where("to is not null").isEmpty():
            return now
        now = compact(far.select("id", F.coalesce("to", "root").alias("root"), F.coalesce("to_word", "root_word").alias("root_word")))


def spelling_variants(vocab: DataFrame, symbols: int = SYMBOLS, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of ``vocab`` (word, n;
    each word once)."""
    vocab = _with_keys(vocab, symbols)
    near = cut(near_pairs(vocab, symbols).groupBy(F.col("a").alias("id"))
               .agg(F.count("*").alias("n_near"), F.first("n_a").alias("n_a"),
                    F.min(F.struct((-F.col("n_b")).alias("less"), F.col("word_b").alias("word"), F.col("b").alias("id"))).alias("best"))
               .withColumn("formed", -F.col("best.less") >= ratio * F.col("n_a"))
               .select("id", "n_near", *[F.when(F.col("formed"), x).alias(name) for x, name in
                                         ((F.col("best.id"), "form_id"), (F.col("best.word"), "form"), (-F.col("best.less"), "form_n"))]))
    roots = _roots(near.where("form is not null"))
    return (vocab.join(near, "id", "left").join(roots, "id", "left")
            .select("word", "form", F.coalesce("root_word", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"))
