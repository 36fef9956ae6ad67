"""Operator 9: near duplicates by bottom-k sketches from one hash function.

A document is the set of hashes of its word shingles; its sketch holds the
``SKETCH`` smallest. Documents with equal sets form a class, worked on as one
under a number of its own (doc_ids may repeat with other texts).
Inverted lists of the retained values generate candidates: two sets with a
similarity of at least s share all but a few of their retained values, so each
class lists only its rarest values, as many as any such pair must meet in
(``MEET`` times, not just once). The sketch of the union estimates the
similarity and drops clear misses; the exact similarity of the full sets then
confirms each link, and stars of links are contracted to components.

Pairs that meet in short lists are formed at once, and confirmed in two steps:
each class with its first partner, then, components contracted, only pairs that
are still apart. Long lists belong to large families of near copies or to texts
made of one common passage; their pairs are never all formed. Each member is held
against its list's most typical member (whose values most others retain as well:
the text that copies were made from), in its two commonest lists. What is still
apart then is found by an exact prefix filter on the full sets, ordered by
frequency: a similar pair shares one of the rarest shingles of both, at places
that leave enough shingles behind them, and few parities of their sets differ.
Only shingles that several components hold go on from there, in narrow rows: what
tells pairs apart (parities) goes along with the often held ones alone.

A sketch misses a link only if, by chance, more than 5.5 standard deviations
too few of the union's smallest values are shared (under one in a million for a
pair exactly at the threshold, far less above it); sets of up to 0.8 SKETCH
shingles are compared whole.

Defined cases: a null text is an empty one; empty sets link with nothing; rows
with equal texts, also of equal doc_id, are in one component; rows with a null
doc_id belong to a component through equal sets only and are not kept where it
has a doc_id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditspark.llm import textbatch as tb
from creditspark.llm.shared import compact, cut, free_names, release, row_hash

SKETCH = 64
MEET = 8
# Lists up to this length are joined as they are.
LONG_LIST = 128
# Parity bits that tell how much two sets differ at least.
PARITY = 512
# Groups by hash whose numbers of shingles order them by frequency.
FREQUENCY_GROUPS = 1 << 16
# Pairs that meet in a shingle of up to so many sets are formed from bare
# numbers; in one of more sets, parities are held against each other first.
RARE_SHINGLE = 16
# Of the often held shingles before one, those that go along with it.
EARLIER = 4
# Classes whose numbers (40 bytes each) are broadcast to pick out their texts;
# beyond that a bitmap of ``WANTED_BITS`` bits, at any size, drops most others.
MOST_BROADCAST = 1 << 19
WANTED_BITS = 1 << 26


# ---- shingle sets and sketches, in tasks ------------------------------------------------------


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text. A-Z count as a-z; a text
    of fewer words is one shingle."""
    for first, end, data, offsets in tb.slices(texts):
        data = tb.lower_ascii(data)
        w = tb.words(data, offsets)
        ids, distinct = tb.encode_words(data, w)
        names = distinct.to_numpy(zero_copy_only=False)
        hashed = pd.util.hash_array(names, categorize=False) if len(names) else np.zeros(0, np.uint64)
        h = hashed[ids]
        for d in range(end - first):
            own = h[w.first[d]: w.first[d + 1]]
            if not len(own):
                yield np.zeros(0, np.int64)
                continue
            length = min(words, len(own))
            acc = np.full(len(own) - length + 1, length, dtype=np.uint64)
            for j in range(length):
                acc = tb.mix64(acc * np.uint64(0x9E3779B97F4A7C15) + own[j: j + len(acc)])
            yield np.unique(acc.view(np.int64))


def _digest(values: np.ndarray) -> bytes | None:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None


def _lists(values: list[np.ndarray]) -> pa.Array:
    at = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*values, np.zeros(0, np.int64)])))


def sketches(docs: DataFrame, words: int, k: int = SKETCH) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest of the whole set (null if empty), sketch."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, small = [], [], []
            for values in shingle_sets(batch.column(2), words):
                n.append(len(values))
                digests.append(_digest(values))
                small.append(values[:k])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, type=pa.int64()), pa.array(digests, type=pa.binary()), _lists(small)],
                names=["doc_id", "text_hash", "n_shingles", "digest", "sketch"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash(), "text")
    return narrow.mapInArrow(sketch, "doc_id long, text_hash long, n_shingles long, digest binary, sketch array<long>")


def _text_hash() -> Column:
    """Tells apart the texts under one doc_id."""
    return F.xxhash64("text").alias("text_hash")


def packed_texts(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node, packed: a compressed text for each class of ``wanted`` (node,
    doc_id, text_hash, digest). Wanted texts are picked out where they are, and
    only those are compressed and moved; of many, by a bitmap that lets a few others
    through, up to the join. Equal rows meet map-side, so no task gets them all;
    where other texts have the same doc_id and hash, the class's digest tells its own."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _parts(whole):
                packed = [zlib.compress((t or "").encode(), 1) for t in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, type=pa.binary())],
                                                 names=["doc_id", "text_hash", "packed"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            chosen = [v[0] if len(v) == 1 else next(x for x in v if _digest(_unpacked([x], words)[0]) == d) for d, v in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chosen, type=pa.binary())], names=["node", "packed"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash(), "text")
    if wanted.count() <= MOST_BROADCAST:
        texts = texts.join(F.broadcast(wanted.select("doc_id", "text_hash").distinct()), ["doc_id", "text_hash"], "left_semi")
    else:
        bits = docs.sparkSession.sparkContext.broadcast(_key_bits(wanted))

        @F.pandas_udf("boolean")
        def may_be(slot: pd.Series) -> pd.Series:
            at = slot.to_numpy()
            return pd.Series((bits.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0)

        keys = texts.where("doc_id is not null").withColumn("wanted", may_be(_slot()))
        texts = keys.where("wanted").select("doc_id", "text_hash", "text")
    versions = (texts.mapInArrow(pack, "doc_id long, text_hash long, packed binary")
                .groupBy("doc_id", "text_hash").agg(F.collect_set("packed").alias("versions")))
    return (versions.join(wanted.select("node", "doc_id", "text_hash", "digest"), ["doc_id", "text_hash"])
            .select("node", "digest", "versions").mapInArrow(own, "node long, packed binary"))


def _slot() -> Column:
    return F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(WANTED_BITS))


def _key_bits(wanted: DataFrame) -> np.ndarray:
    """A bit for each doc_id and text_hash; ``WANTED_BITS`` bits in all."""
    place = _slot() + 1
    rows = (wanted.groupBy(F.bitmap_bucket_number(place).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect())  # 4 KB each
    out = np.zeros(WANTED_BITS // 8, dtype=np.uint8)
    for r in rows:
        at = (r.bucket - 1) * len(r.bits)
        out[at: at + len(r.bits)] = np.frombuffer(r.bits, dtype=np.uint8)
    return out


def _parts(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """A batch a few rows at a time: texts are held unpacked for those only."""
    return (batch.slice(k, rows) for k in range(0, batch.num_rows, rows))


def _unpacked(packed: list[bytes], words: int) -> list[np.ndarray]:
    """The shingle sets of compressed texts."""
    texts = pa.array([zlib.decompress(t) for t in packed], type=pa.large_binary()).cast(pa.large_string())
    return list(shingle_sets(texts, words))


# ---- bounds on what two sketches share ----------------------------------------------------------


def shared_at_least(n: Column, s: float, k: int = SKETCH) -> Column:
    """Retained values that a set of n shingles surely (whole sets) or almost
    surely shares with any set of similarity s."""
    least = max(1, math.floor(k * s - 5.5 * math.sqrt(k * s * (1 - s))))
    return F.when(n <= math.floor(k * s), F.ceil(n * s)).otherwise(least).cast("int")


def _meets(n: Column, s: float) -> Column:
    return F.least(F.lit(MEET), shared_at_least(n, s))


def _sizes_fit(a: str, b: str, s: float) -> Column:
    return (F.least(F.col(a), F.col(b)) + 1e-9 >= s * F.greatest(F.col(a), F.col(b)))


def _union_estimate(pairs: DataFrame, classes: DataFrame, s: float, k: int = SKETCH) -> DataFrame:
    """Pairs (a, b) whose union sketch leaves the similarity possible."""
    least = max(1, math.floor(k * s - 5.5 * math.sqrt(k * s * (1 - s)))) / k
    side = classes.select("node", "sketch")
    both = (pairs.join(side.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a")
            .join(side.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b"))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    shared = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    return both.where(shared >= least * F.size(union)).select("a", "b")


def _confirmer(texts: DataFrame, words: int, s: float) -> Callable[[DataFrame], DataFrame]:
    """What keeps the pairs (a, b) whose full sets have a similarity of at least s."""
    hundred = round(100 * s)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _parts(whole)):
            keep = []
            sides = (_unpacked(batch.column(k).to_pylist(), words) for k in (2, 3))
            for xa, xb in zip(*sides, strict=True):
                shared = len(np.intersect1d(xa, xb, assume_unique=True))
                keep.append(shared * 100 >= hundred * (len(xa) + len(xb) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    def confirm(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs)
        nodes = cut(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
        own = texts.join(F.broadcast(nodes), "node", "left_semi") if nodes.count() <= MOST_BROADCAST else texts
        both = (pairs.join(own.select(F.col("node").alias("a"), F.col("packed").alias("pa")), "a")
                .join(own.select(F.col("node").alias("b"), F.col("packed").alias("pb")), "b"))
        return both.select("a", "b", "pa", "pb").mapInArrow(exact, "a long, b long")

    confirm.texts = texts
    return confirm


# ---- components ---------------------------------------------------------------------------------


def contract(edges: DataFrame) -> DataFrame:
    """Edges (a, b) as stars: a, each node that is not a root, and b, the smallest
    node of its component; by large-star and small-star steps. Contracting stars
    with some new edges takes few steps. Few edges stay in few partitions
    (``shared.compact``), in which steps need no exchange."""
    e = compact(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while not _are_stars(e):
        both = _together(e, e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = compact(_together(small, least.select("u", F.col("m").alias("v")), e).distinct())
    return e.select(F.col("u").alias("a"), F.col("v").alias("b"))


def _together(a: DataFrame, b: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """The rows of both in as many partitions as ``like`` (``a`` if not given) has."""
    return a.unionByName(b).coalesce(max(1, (a if like is None else like).rdd.getNumPartitions()))


def labels(stars: DataFrame) -> DataFrame:
    """node, component (its smallest node) for all nodes of ``contract``'s stars."""
    return _together(stars.select(F.col("a").alias("node"), F.col("b").alias("component")),
                     stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct(), stars)


def components(edges: DataFrame) -> DataFrame:
    """node, component for all nodes of ``edges`` (a, b)."""
    return labels(contract(edges))


def _are_stars(e: DataFrame) -> bool:
    """No node has two smaller neighbours, or a smaller and a larger one."""
    ends = _together(e.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")),
                     e.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")), e)
    return (ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
            .where("down > 1 or (down = 1 and up = 1)").isEmpty())


# ---- links ----------------------------------------------------------------------------------------


def _listed(classes: DataFrame, s: float) -> DataFrame:
    """node, n, values (cnt: classes that retain it, value), long, typical for
    each class: its rarest retained values, as far as a similar pair must meet in
    them; long counts those in long lists, typical tells how many other classes
    retain its values (mean logarithm)."""
    entries = classes.select("node", "n", F.explode("sketch").alias("value"))
    counted = entries.groupBy("value").agg(F.count("*").alias("cnt")).where("cnt > 1")
    own = (entries.join(counted, "value").groupBy("node", "n")
           .agg(F.sort_array(F.collect_list(F.struct("cnt", "value"))).alias("values")))  # SKETCH at most
    kept = F.least(F.col("n"), F.lit(SKETCH))
    alone = kept - F.size("values")  # values that nobody else retains come first
    far = F.greatest(F.lit(0), kept - shared_at_least(F.col("n"), s) + _meets(F.col("n"), s) - alone)
    shared = F.aggregate("values", F.lit(0.0), lambda total, x: total + F.log(x["cnt"].cast("double")))
    own = own.select("node", "n", (shared / kept).alias("typical"),
                     F.slice("values", F.lit(1), far.cast("int")).alias("values"))
    return own.withColumn("long", F.size(F.filter("values", lambda x: x["cnt"] > LONG_LIST)))


def _entries(listed: DataFrame) -> DataFrame:
    """A row per listed value; place numbers a class's values from the commonest on."""
    rows = listed.select("node", "n", "typical", "long", F.size("values").alias("last"), F.posexplode("values").alias("at", "x"))
    return rows.select("node", "n", "typical", "long", (F.col("last") - F.col("at")).alias("place"),
                       F.col("x.value").alias("value"), F.col("x.cnt").alias("cnt"))


def _short_pairs(listed: DataFrame, s: float) -> DataFrame:
    """Pairs that meet often enough, as far as short lists show it."""
    short = (_entries(listed).where(F.col("cnt") <= LONG_LIST)
             .select("value", "node", "n", _meets(F.col("n"), s).alias("meet"), "long"))
    a, b = (short.select("value", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "meet", "long")]) for x in "ab")
    met = (a.join(b, "value").where((F.col("node_a") < F.col("node_b")) & _sizes_fit("n_a", "n_b", s))
           .groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
           .agg(F.count("*").alias("times"),
                F.first(F.least("meet_a", "meet_b") - F.least("long_a", "long_b")).alias("least")))
    return met.where(F.col("times") >= F.col("least")).select("a", "b")


def _with_components(rows: DataFrame, stars: DataFrame, *names: str) -> DataFrame:
    """``rows`` with the component of each node column (the node itself if it is alone)."""
    for name in names:
        own = labels(stars).select(F.col("node").alias(name), F.col("component").alias(f"component_{name}"))
        rows = rows.join(own, name, "left").withColumn(f"component_{name}", F.coalesce(f"component_{name}", name))
    return rows


def _apart(entries: DataFrame, stars: DataFrame) -> DataFrame:
    """The lists that still hold several components, with each member's."""
    now = _with_components(entries, stars, "node").withColumnRenamed("component_node", "component")
    several = (now.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
               .where("lo < hi").select("value"))
    return compact(now.join(several, "value", "left_semi"))


def _stars(lists: DataFrame, s: float) -> DataFrame:
    """Pairs of each member and its list's pivot, the most typical member, where
    that is of another component."""
    pivot = (lists.groupBy("value").agg(F.max(F.struct("typical", "node", "n", "component")).alias("p"))
             .select("value", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n"),
                     F.col("p.component").alias("pivot_component")))
    met = (lists.join(pivot, "value").where(F.col("component") != F.col("pivot_component"))
           .where(_sizes_fit("n", "pivot_n", s)))
    return met.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()


def _prefixes(members: DataFrame, texts: DataFrame, words: int, s: float) -> DataFrame:
    """node, component, n, typical, parity, x for each of ``members`` (node,
    component): how frequent its shingles are (mean logarithm), a parity bit for
    each of ``PARITY`` groups of its shingles, and the rarest ones, its first
    (1 - s) n, in order. Any order
    that is the same for all sets is right; here shingles are in the order of how
    many the members hold of their group by hash, so common passages come last.
    The counts have a fixed size; no shingle is moved."""
    own = cut(texts.join(members, "node").select("node", "packed", "component"))
    groups = FREQUENCY_GROUPS

    def group_of(shingles: np.ndarray) -> np.ndarray:
        return (tb.mix64(shingles.view(np.uint64)) % np.uint64(groups)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(groups, dtype=np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                for x in _unpacked(batch.column(1).slice(k, 256).to_pylist(), words):
                    np.add.at(total, group_of(x), 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["group", "times"])

    counted = own.mapInArrow(count, "group long, times long").groupBy("group").agg(F.sum("times").alias("times")).toArrow()
    times = np.zeros(groups, dtype=np.int64)  # FREQUENCY_GROUPS rows at most
    times[counted.column("group").to_numpy()] = counted.column("times").to_numpy()
    sent = members.sparkSession.sparkContext.broadcast(times)

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                node = batch.column(0).slice(k, 256)
                typical, bits, prefix, n = [], [], [], []
                for x in _unpacked(batch.column(1).slice(k, 256).to_pylist(), words):
                    g = group_of(x)
                    often = sent.value[g]
                    order = np.lexsort((x, often))
                    n.append(len(x))
                    typical.append(float(np.log(np.maximum(often, 1)).mean()) if len(x) else 0.0)
                    bits.append(np.packbits((np.bincount(g % PARITY, minlength=PARITY) & 1).astype(bool)).view(np.int64))
                    prefix.append(x[order[: len(x) - math.ceil(len(x) * s - 1e-9) + 1]])
                yield pa.RecordBatch.from_arrays(
                    [node, batch.column(2).slice(k, 256), pa.array(n, type=pa.int64()), pa.array(typical), _lists(bits), _lists(prefix)],
                    names=["node", "component", "n", "typical", "parity", "x"])

    return own.mapInArrow(shorten, "node long, component long, n long, typical double, parity array<long>, x array<long>")


def _long_pairs(prefixes: DataFrame, s: float) -> DataFrame:
    """Pairs a, b of ``_prefixes`` of other components by the prefix filter, and
    how typical each is. A similar pair shares a shingle among the rarest (1 - s) n of the
    larger set and, as its partner is no smaller, among the rarest
    (1 - 2s / (1 + s)) n of the smaller one; behind that place both must hold the
    rest of what they share. Each parity that differs stands for a shingle that
    only one of them holds, and a similar pair has few of those. A shingle within
    one component makes no pair and is dropped first; whole prefixes and parities
    would be many times the texts if they went along with each shingle."""
    small = F.col("at") < F.col("n") - F.ceil(F.col("n") * (2 * s / (1 + s)) - 1e-9) + 1
    rows = prefixes.select("node", "component", "n", F.posexplode("x").alias("at", "shingle"))
    held = (rows.groupBy("shingle").agg(F.count("*").alias("sets"), F.min("component").alias("lo"), F.max("component").alias("hi"),
                                        F.max(small).alias("small"))
            .where("lo < hi and small").select("shingle", "sets"))
    held = cut(rows.join(held, "shingle"))

    def few(a: str, b: str) -> Column:
        differ = F.lit(0)
        for k in range(PARITY // 64):
            differ = differ + F.bit_count(F.col(f"parity_{a}")[k].bitwiseXOR(F.col(f"parity_{b}")[k]))
        return differ <= (F.col(f"n_{a}") + F.col(f"n_{b}")) * ((1 - s) / (1 + s)) + 1e-9

    def met(rows: DataFrame, more: Column, *names: str) -> DataFrame:
        names = ("node", "n", "component", "at", *names)
        a, b = (side.select("shingle", *[F.col(c).alias(f"{c}_{x}") for c in names]) for x, side in (("a", rows), ("b", rows.where(small))))
        larger = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("node_a") < F.col("node_b")))
        left = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
        enough = left + 1e-9 >= (F.col("n_a") + F.col("n_b")) * (s / (1 + s))
        both = a.join(b, "shingle").where(
            larger & (F.col("component_a") != F.col("component_b")) & _sizes_fit("n_a", "n_b", s) & enough & more)
        return both.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))

    rare = met(held.where(F.col("sets") <= RARE_SHINGLE), F.lit(True))
    # A set's often held shingles in order, as many as its prefix at most.
    lists = (held.where(F.col("sets") > RARE_SHINGLE).groupBy("node")
             .agg(F.sort_array(F.collect_list(F.struct("at", "shingle"))).alias("often")))
    lists = prefixes.join(lists, "node").select("node", "component", "n", "parity", "often", F.posexplode("often").alias("k", "e"))
    before = F.slice(F.col("often.shingle"), F.greatest(F.lit(1), F.col("k") + (1 - EARLIER)), F.least(F.col("k"), F.lit(EARLIER)))
    often = cut(lists.select("node", "component", "n", "parity", F.col("e.at").alias("at"), F.col("e.shingle").alias("shingle"),
                             before.alias("before")))
    # A pair that has met in a shingle shortly before need not meet again.
    often = met(often, few("a", "b") & ~F.arrays_overlap("before_a", "before_b"), "parity", "before")
    pairs = cut(rare.unionByName(often).distinct())
    sides = [prefixes.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "typical", "parity")]) for x in "ab"]
    return (pairs.join(sides[0], "a").join(sides[1], "b").where(few("a", "b"))
            .select("a", "b", "typical_a", "typical_b"))


def links(docs: DataFrame, classes: DataFrame, words: int, s: float) -> DataFrame:
    """Pairs a, b of classes that links connect: enough of them to connect all
    that are connected."""
    spark = docs.sparkSession
    listed = cut(_listed(classes, s))
    release(spark)
    pairs = compact(_union_estimate(_short_pairs(listed, s), classes, s))
    release(spark)
    # Only pairs of sets that both reach into long lists often enough can have been missed.
    hot = compact(_entries(listed).where((F.col("cnt") > LONG_LIST) & (F.col("long") >= _meets(F.ceil(F.col("n") * s), s)))
                  .select("value", "node", "n", "typical", "place"))
    nodes = (pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
             .unionByName(hot.select("node")).distinct())
    wanted = cut(classes.join(nodes, "node", "left_semi"))
    del listed, nodes
    confirm = _confirmer(cut(packed_texts(docs, wanted, words)), words, s)
    release(spark)

    def apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
        return compact(_with_components(pairs, found, "a", "b").where("component_a <> component_b").select("a", "b"))

    # Each class with one partner, and each member of a long list with its pivot.
    some = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    long = not hot.isEmpty()
    if long:
        lists = hot.where("place = 1").withColumn("component", F.col("node"))
        some = some.unionByName(_union_estimate(_stars(lists, s), wanted, s)).distinct()
    found = contract(confirm(some))
    del some
    release(spark)
    # Then only pairs that are still apart, and the pivots of the second lists.
    left = apart(pairs, found)
    if long:
        lists = _apart(hot.where("place = 2"), found)
        left = left.unionByName(_union_estimate(_stars(lists, s), wanted, s)).distinct()
    if not left.isEmpty():
        found = contract(found.unionByName(confirm(left)))
    del pairs, left, wanted
    release(spark)
    if not long:
        return found
    members = _apart(hot, found).select("node", "component").distinct()
    pairs = compact(_long_pairs(cut(_prefixes(members, confirm.texts, words, s)), s))
    release(spark)
    # The full sets tell better than sketches which partner is closest to the family's origin.
    both = pairs.select(F.col("a").alias("node"), F.struct(F.col("typical_b").alias("typical"), F.col("b").alias("other")).alias("p")).unionByName(
        pairs.select(F.col("b").alias("node"), F.struct(F.col("typical_a").alias("typical"), F.col("a").alias("other")).alias("p")))
    best = both.groupBy("node").agg(F.max("p").alias("p"))
    found = contract(found.unionByName(confirm(
        best.select(F.least("node", "p.other").alias("a"), F.greatest("node", "p.other").alias("b")).distinct())))
    left = apart(pairs.select("a", "b"), found)
    return found if left.isEmpty() else found.unionByName(confirm(left))


# ---- the operator ---------------------------------------------------------------------------------


# Shares in which a component's members meet its smallest doc_id.
SHARES = 32


def _judged(docs: DataFrame, words: int, s: float) -> DataFrame:
    """doc_id, text_hash, n_shingles, group (the component's number; null without
    shingles or a doc_id in the class), component_id for each row of ``docs``."""
    rows = cut(sketches(docs, words))
    sets = (rows.where("digest is not null and doc_id is not null").groupBy("digest")
            .agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n")))
    sets = cut(sets.withColumn("node", F.monotonically_increasing_id()))
    # One row per class with its sketch; equal rows meet map-side, so no class is too large.
    first = rows.groupBy("digest", "doc_id").agg(F.first("text_hash").alias("text_hash"), F.first("sketch").alias("sketch"))
    classes = cut(first.join(sets, ["digest", "doc_id"]))
    rows = cut(rows.select("doc_id", "text_hash", "n_shingles", "digest"))  # the sketches are with the classes
    del first
    release(docs.sparkSession)
    linked = cut(components(links(docs, classes, words, s)).join(sets.select("node", "digest", "doc_id"), "node"))
    least = (linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
             .withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))))
    linked = (linked.withColumn("share", F.pmod(F.xxhash64("node"), F.lit(SHARES)).cast("int")).join(least, ["component", "share"])
              .select("node", "component", "component_id"))
    named = (sets.join(linked, "node", "left")
             .select("digest", F.coalesce("component", "node").alias("group"), F.coalesce("component_id", "doc_id").alias("component_id")))
    # Empty sets have no class; they stay out of the join, where they would be one key.
    empty = (rows.where("digest is null")
             .select("doc_id", "text_hash", "n_shingles", F.lit(None).cast("long").alias("group"), F.lit(None).cast("long").alias("component_id")))
    with_class = (rows.where("digest is not null").join(named, "digest", "left")
                  .select("doc_id", "text_hash", "n_shingles", "group", "component_id"))
    return with_class.unionByName(empty).withColumn("component_id", F.coalesce("component_id", "doc_id"))


def near_duplicates(docs: DataFrame, words: int = 5, s: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links lead
    to), kept (it is the document's own) for each row of ``docs``."""
    component = F.col("component_id")
    return _judged(docs, words, s).select("doc_id", "n_shingles", component,
                                          F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def without_copies(docs: DataFrame, words: int = 5, s: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, the one with
    the smallest doc_id (of several texts under it, the one of smallest hash).
    Texts of equal doc_id in other groups are documents of their own. Rows of
    equal doc_id and text are copies, whatever their other columns hold: the row
    whose columns have the smallest hash stays. Rows without a doc_id stay."""
    own = _judged(docs, words, s).where("doc_id = component_id").select("doc_id", "text_hash", "group")
    kept = (own.where("group is not null").groupBy("doc_id", "group").agg(F.min("text_hash").alias("text_hash"))
            .select("doc_id", "text_hash").unionByName(own.where("group is null").select("doc_id", "text_hash")).distinct())
    keys = free_names(docs.columns, "doc_key", "text_key", "row_key")
    doc, text, row = keys
    texts = docs.where("doc_id is not null").withColumns(
        {doc: F.col("doc_id").cast("long"), text: F.xxhash64("text"), row: row_hash(docs)})
    one = (texts.select(*keys).groupBy(doc, text).agg(F.min(row).alias(row))
           .join(kept.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text)), [doc, text], "left_semi"))
    chosen = texts.join(one, keys, "left_semi").dropDuplicates(keys)
    return chosen.select(*docs.columns).unionByName(docs.where("doc_id is null"))
