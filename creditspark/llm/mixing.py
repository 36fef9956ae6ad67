"""Operator 7: mixing sources to target weights by min-cost flow.

Documents may belong to several sources. They are aggregated by membership
pattern; the words of each pattern flow to its sources' quotas, where the first
pass over a pattern is free and each repetition costs more than the one before
(convex costs). The flow gives the words to take of each pattern: some whole
passes, and a rest that is taken as documents in a seeded order, up to the last
one that fits, filled up with a few documents of fitting size.

The driver holds a row per membership pattern and per source, never per document.
Patterns that share no source with others need no search: the flow of one source
fed by one pattern is the smaller of quota and capacity. What is decided per
pattern goes to the documents by broadcast up to ``MOST_BROADCAST`` patterns, so
a pattern that holds a third of all documents is spread over tasks as they are;
beyond that by a join, whose hot partitions Spark splits.

Defined cases: a null text has size 0; the null source is a source of its own
(last in order); rows with equal doc_ids are documents of their own; documents
of size 0 take nothing; an empty table gives no rows; other columns are not read
by ``mix_documents`` and are kept, row by row, by ``mixed_documents``.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditspark.llm import textbatch as tb
from creditspark.llm.shared import cut, free_names, located

MOST_PASSES = 3
SEED = 7
# The seeded order is first summed over so many ranges of it.
RANGES = 1 << 12
FILL_ROUNDS = 3
# Rows per pattern that are broadcast at once (under 100 bytes each).
MOST_BROADCAST = 1 << 17


def sizes(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, ``keep`` columns and size: the words of the whole text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: list[int] = []
            for _, _, data, offsets in tb.slices(batch.column(0)):
                n.extend(tb.words(data, offsets).counts.tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n, type=pa.int64())],
                                             names=[*batch.schema.names[1:], "size"])

    narrow = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), *keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema[1:])
    return narrow.mapInArrow(count, f"{fields}, size long")


# ---- targets and flow, on the driver ---------------------------------------------------------


def in_order(sources) -> list[str | None]:
    """By code point, null last."""
    return sorted(sources, key=lambda s: (s is None, s or ""))


def cyclic_weights(sources) -> dict[str | None, float]:
    return {s: 1.0 + k % 3 for k, s in enumerate(in_order(sources))}


def targets(source_sizes: dict, weights: dict, most: float = MOST_PASSES) -> dict:
    """Each source's share by weight of all words; targets stop at ``most``
    times their source's size and the excess is shared anew by weight."""
    left = float(sum(source_sizes.values()))
    out: dict = {}
    open_ = list(source_sizes)
    while open_:
        whole = sum(weights[s] for s in open_)
        share = {s: left * weights[s] / whole for s in open_}
        above = [s for s in open_ if share[s] > most * source_sizes[s]]
        if not above:
            return out | share
        for s in above:
            out[s] = float(most * source_sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def flow(patterns: dict[tuple, int], quotas: dict, passes: int = MOST_PASSES) -> dict[tuple[tuple, str | None], int]:
    """Words of each pattern that go to each of its sources: a cheapest flow
    among the largest ones, by successive shortest paths. Taking a pattern's
    k-th pass costs k - 1 a word."""
    out: dict = {}
    for own in _components(patterns):
        if len(own) == 1 and len(set(own[0])) == 1:
            (p,), s = own, own[0][0]
            n = min(round(quotas[s]), passes * patterns[p])
            out |= {(p, s): n} if n else {}
        else:
            out |= _flow_of({p: patterns[p] for p in own}, quotas, passes)
    return out


def _components(patterns: dict) -> list[list[tuple]]:
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for p in patterns:
        for s in p:
            root[find(("p", p))] = find(("s", s))
    groups: dict = {}
    for p in patterns:
        groups.setdefault(find(("p", p)), []).append(p)
    return list(groups.values())


def _flow_of(patterns: dict, quotas: dict, passes: int) -> dict:
    arcs: dict = {}  # node: list of arcs [to, capacity, cost, the arc back]

    def arc(a, b, capacity, cost):
        there, back = [b, capacity, cost, None], [a, 0, -cost, None]
        there[3], back[3] = back, there
        arcs.setdefault(a, []).append(there)
        arcs.setdefault(b, []).append(back)
        return there

    between = {}
    for p, size in patterns.items():
        for k in range(passes):
            arc("from", ("p", p), size, k)
        for s in dict.fromkeys(p):
            between[p, s] = arc(("p", p), ("s", s), passes * size, 0)
    for s in dict.fromkeys(s for p in patterns for s in p):
        arc(("s", s), "to", round(quotas[s]), 0)
    level = dict.fromkeys(arcs, 0)  # potentials: reduced costs stay >= 0
    while True:
        far, by, heap = {"from": 0}, {}, [(0, 0, "from")]
        tie = 0
        while heap:
            d, _, node = heapq.heappop(heap)
            if d > far[node]:
                continue
            for x in arcs.get(node, ()):
                if x[1] > 0 and (new := d + x[2] + level[node] - level[x[0]]) < far.get(x[0], float("inf")):
                    far[x[0]], by[x[0]], tie = new, x, tie + 1
                    heapq.heappush(heap, (new, tie, x[0]))
        if "to" not in far:
            return {k: x[3][1] for k, x in between.items() if x[3][1]}
        for node in arcs:
            level[node] += far.get(node, far["to"])
        node, most = "to", float("inf")
        while node != "from":
            most, node = min(most, by[node][1]), by[node][3][0]
        node = "to"
        while node != "from":
            by[node][1] -= most
            by[node][3][1] += most
            node = by[node][3][0]


# ---- the mix --------------------------------------------------------------------------------


def mix(items: DataFrame, weights=cyclic_weights, seed: int = SEED, passes: int = MOST_PASSES) -> DataFrame:
    """``items`` (doc_id, size, sources: array of strings, any others) with
    copies, how often the mix takes the document, and taken, size times copies;
    for documents of one source also source_size and target. ``items`` is kept
    (``shared.cut``) by the caller, so that it does not change between uses."""
    spark = items.sparkSession
    keyed = items.withColumn("mix_pattern", F.to_json("sources"))
    counted = keyed.groupBy("mix_pattern").agg(F.sum("size").alias("n")).collect()  # a row per pattern
    words = {r["mix_pattern"]: int(r["n"]) for r in counted}
    pattern = {k: tuple(json.loads(k)) for k in words}
    source_sizes: dict = {}
    for k, n in words.items():
        for s in dict.fromkeys(pattern[k]):
            source_sizes[s] = source_sizes.get(s, 0) + n
    quota = targets(source_sizes, weights(source_sizes), passes)
    merged: dict[tuple, int] = {}
    for k, n in words.items():
        merged[pattern[k]] = merged.get(pattern[k], 0) + n
    taken: dict[tuple, int] = {}
    for (p, _), n in flow(merged, quota, passes).items():
        taken[p] = taken.get(p, 0) + n
    rows = []
    for k, n in words.items():
        whole, rest = divmod(taken.get(pattern[k], 0), n) if n else (0, 0)
        one = pattern[k][0] if len(pattern[k]) == 1 else None
        rows.append((k, int(whole), int(rest), source_sizes.get(one) if len(pattern[k]) == 1 else None,
                     quota.get(one) if len(pattern[k]) == 1 else None))
    plan = spark.createDataFrame(rows, "mix_pattern string, mix_whole long, mix_rest long, source_size long, target double")
    few = len(rows) <= MOST_BROADCAST
    with_plan = keyed.join(F.broadcast(plan) if few else plan, "mix_pattern")
    chosen = _choose(cut(with_plan.withColumn("mix_row", F.monotonically_increasing_id())), seed, few)
    copies = F.col("mix_whole") + F.col("mix_extra")
    return chosen.select(*items.columns, "source_size", "target", copies.alias("copies"),
                         (F.col("size") * copies).alias("taken"))


def _choose(rows: DataFrame, seed: int, few: bool) -> DataFrame:
    """Adds mix_extra: 1 for documents of the last, partial pass. In the seeded
    order those are the ones up to the rest; sums over ranges of that order find
    the range where it is reached, and only that range is summed one by one.
    ``few`` says that a row per pattern can be broadcast."""
    order = F.xxhash64(F.col("doc_id"), F.lit(seed))
    rows = (rows.withColumn("mix_order", order)
            .withColumn("mix_range", F.shiftrightunsigned(order, 64 - RANGES.bit_length() + 1)))
    sums = rows.where("mix_rest > 0").groupBy("mix_pattern", "mix_rest", "mix_range").agg(F.sum("size").alias("n"))
    upto = Window.partitionBy("mix_pattern").orderBy("mix_range")
    sums = sums.withColumn("end", F.sum("n").over(upto)).where("end > mix_rest")
    edge = sums.groupBy("mix_pattern").agg(F.min(F.struct("mix_range", (F.col("end") - F.col("n")).alias("before"))).alias("e"))
    edge = edge.select("mix_pattern", F.col("e.mix_range").alias("mix_edge"), F.col("e.before").alias("mix_before"))
    rows = rows.join(F.broadcast(edge) if few else edge, "mix_pattern", "left")
    rows = rows.withColumn("mix_extra", F.when(F.col("mix_range") < F.col("mix_edge"), 1).otherwise(0))
    one_by_one = Window.partitionBy("mix_pattern").orderBy("mix_order", "doc_id", "size", "mix_row")
    last = (rows.where("mix_range = mix_edge")
            .withColumn("mix_end", F.col("mix_before") + F.sum("size").over(one_by_one))
            .where("mix_end <= mix_rest"))
    picked = last.select("mix_row", F.lit(1).alias("mix_now"))
    rows = cut(rows.join(picked, "mix_row", "left")
               .withColumn("mix_extra", F.greatest("mix_extra", F.coalesce("mix_now", F.lit(0)))).drop("mix_now"))
    return _fill(rows, few)


def _fill(rows: DataFrame, few: bool) -> DataFrame:
    """Takes a few more documents of each pattern: the largest that fits what is
    still missing, some rounds long, and at last the one that comes nearest. A
    row per pattern and round comes to the driver."""
    spark = rows.sparkSession
    small = F.broadcast if few else (lambda df: df)  # a row per pattern and round at most
    missing = {r[0]: r[1] for r in rows.where("mix_rest > 0").groupBy("mix_pattern", "mix_rest")
               .agg(F.sum(F.col("size") * F.col("mix_extra")).alias("n"))
               .select("mix_pattern", F.col("mix_rest") - F.col("n")).collect()}
    added: list[int] = []
    for k in range(FILL_ROUNDS + 1):
        fits_below = F.col("size") <= F.col("mix_missing") if k < FILL_ROUNDS else F.col("size") < 2 * F.col("mix_missing")
        wanted = spark.createDataFrame([(k, n) for k, n in missing.items() if n > 0], "mix_pattern string, mix_missing long")
        had = spark.createDataFrame([(x,) for x in added], "mix_row long")
        fits = (rows.where("mix_extra = 0 and size > 0").join(small(wanted), "mix_pattern").where(fits_below)
                .join(small(had), "mix_row", "left_anti")
                .groupBy("mix_pattern").agg(F.min(F.struct(F.abs(F.col("size") - F.col("mix_missing")).alias("off"),
                                                           "size", "mix_order", "mix_row")).alias("best"))).collect()
        for r in fits:
            missing[r["mix_pattern"]] -= r["best"]["size"]
            added.append(r["best"]["mix_row"])
    marks = spark.createDataFrame([(x, 1) for x in added], "mix_row long, mix_now int")
    return (rows.join(small(marks), "mix_row", "left")
            .withColumn("mix_extra", F.greatest("mix_extra", F.coalesce("mix_now", F.lit(0)))).drop("mix_now"))


def mix_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``mix`` for documents that each have one source."""
    items = cut(sizes(docs, "source").withColumn("sources", F.array(F.col("source").cast("string"))))
    return mix(items, seed=seed)


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them (left out if never;
    at most ``MOST_PASSES`` times). Each row counts by itself and is told by its
    place in its file, so rows that are equal, or differ in some columns only,
    neither meet in one task nor stand for each other."""
    at, file, row = located(docs)
    narrow = at.select("doc_id", "source", "text", F.col(file).alias("mix_file"), F.col(row).alias("mix_line"))
    items = cut(sizes(narrow, "source", "mix_file", "mix_line").withColumn("sources", F.array(F.col("source").cast("string"))))
    (times,) = free_names(at.columns, "times")
    copies = mix(items, seed=seed).where("copies > 0").select(
        F.col("mix_file").alias(file), F.col("mix_line").alias(row), F.col("copies").alias(times))
    taken = at.join(copies, [file, row])
    (copy,) = free_names(taken.columns, "copy")
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*docs.columns)
