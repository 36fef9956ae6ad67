"""Operator 6: quality rules with risk-controlled thresholds.

Each rule is a measure of a text (a share, in hundredths). Half of the labelled
documents say how much each range of a measure speaks for a bad text (smoothed
log odds); a document's evidence is their sum over the rules. The other half, the
holdout, decides per stratum (language) from which evidence on documents are
rejected: going down from the strongest evidence, each cutoff must show, by the
exact binomial (Clopper-Pearson) upper bound on the holdout's good documents,
that at most ``FALSE_REJECTIONS`` of them would go. The first that does not ends
the walk: a fixed-sequence test, which spends a stratum's whole error once for
all rules together, and the error is divided by the number of strata
(Bonferroni). So with confidence ``1 - ERROR`` no stratum loses more than that
share of its good documents. The walk also ends where, in the first half, most of
the rejected are no longer bad.

Languages with fewer than ``LEAST_LABELLED`` labelled documents are one stratum
together, so a column of stray languages adds nothing to the plan. Histograms
over strata, rules, ranges and evidence are all that comes to the driver; a
stratum's cutoff and its tables go to the documents as a small table.
Defined cases: a null text has no words (base_failed); a null language is a
language of its own; a doc_id with several labels is good if all are; rows with
equal doc_ids are judged each; without labels no document is rejected but by the
base rules; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditspark.llm import textbatch as tb
from creditspark.llm.shared import cut

# The base measures and limits.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30

FALSE_REJECTIONS = 0.05
ERROR = 0.05
# The rejected documents of the first half must be bad to this share at least.
PROPOSED_BAD = 0.5
LEAST_LABELLED = 200
# A measure's ranges begin at these hundredths.
RANGES = (0, 1, 2, 3, 5, 8, 13, 20, 30, 45, 65, 100)
# Log odds of a range are smoothed by so many documents of the usual share.
PRIOR = 8.0
# Evidence is counted in tenths from -10 to 10.
EVIDENCE = 201
OTHERS = "(others)"
RULES = ("symbols", "dup_lines", "repeats", "capitals", "marks", "few_distinct", "digits")


def _marks(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOL, _CAPITAL = _marks(SYMBOLS), _marks("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER, _MARK, _DIGIT = _CAPITAL | _marks("abcdefghijklmnopqrstuvwxyz"), _marks("!?;:=~^+_\\/@"), _marks("0123456789")


def repeated(ids: np.ndarray, first: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Per row, the words in windows that the row holds twice or more. Windows
    are named exactly, by naming pairs of names (lengths 1, 2, 4, ...)."""
    rows = len(first) - 1
    n = len(ids)
    if n < window:
        return np.zeros(rows, dtype=np.int64)
    names, length = ids, 1
    while length < window:
        assert window % (2 * length) == 0
        pairs = names[: len(names) - length].astype(np.int64) * (int(names.max()) + 1) + names[length:]
        names, length = pd.factorize(pairs)[0].astype(np.int64), 2 * length
    row = np.repeat(np.arange(rows), np.diff(first))
    at = np.flatnonzero(row[: n - window + 1] == row[window - 1:])  # windows within a row
    key = row[at] * (int(names.max()) + 1) + names[at]
    twice = at[pd.Series(key).duplicated(keep=False).to_numpy()]
    change = np.zeros(n + 1, dtype=np.int64)
    change[twice] += 1
    np.add.at(change, twice + window, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(change[:-1]) > 0)))
    return covered[first[1:]] - covered[first[:-1]]


def _per_row(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))
    return np.diff(total[offsets])


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    w = tb.words(data, offsets)
    ids, _ = tb.encode_words(data, w)
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows), w.counts)
    n_words = w.counts.astype(np.int64)
    lines = tb.runs(data != 0x0A, offsets)
    has_word = np.concatenate(([0], np.cumsum(w.inside, dtype=np.int64)))
    used = has_word[lines.ends] > has_word[lines.starts]
    line_ids = tb.pieces(data, lines.starts, lines.ends, data != 0x0A).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    line_row = np.repeat(np.arange(rows), lines.counts)[used]
    key = line_row * (int(line_ids.max(initial=0)) + 1) + line_ids[used]
    again = pd.Series(key).duplicated().to_numpy()
    n_lines = np.bincount(line_row, minlength=rows)
    word_key = row * (int(ids.max(initial=0)) + 1) + ids
    distinct = np.bincount(row[~pd.Series(word_key).duplicated().to_numpy()], minlength=rows)
    out = {
        "n_words": n_words,
        "word_chars": _per_row(w.inside & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _per_row(_SYMBOL[data], offsets),
        "n_dup_lines": np.bincount(line_row[again], minlength=rows).astype(np.int64),
        "n_repeat_words": repeated(ids, w.first),
    }
    share = lambda a, b: np.where(b > 0, np.minimum(100, 100 * a // np.maximum(b, 1)), 0)
    shares = {
        "symbols": share(out["n_symbols"], n_words), "dup_lines": share(out["n_dup_lines"], n_lines),
        "repeats": share(out["n_repeat_words"], n_words),
        "capitals": share(_per_row(_CAPITAL[data], offsets), _per_row(_LETTER[data], offsets)),
        "marks": share(_per_row(_MARK[data], offsets), n_words), "few_distinct": share(n_words - distinct, n_words),
        "digits": share(_per_row(_DIGIT[data], offsets), out["word_chars"]),
    }
    return out | {f"share_{k}": shares[k].astype(np.int64) for k in RULES}


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = BASE + tuple(f"share_{k}" for k in RULES)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and all measures of each whole text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [measure(data, offsets) for _, _, data, offsets in tb.slices(batch.column(0))]
            if parts:
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[1:], *[pa.array(np.concatenate([p[k] for p in parts]).astype(np.int64)) for k in MEASURES]],
                    names=["doc_id", "stratum", *MEASURES])

    narrow = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("stratum"))
    return narrow.mapInArrow(count, "doc_id long, stratum string, " + ", ".join(f"{k} long" for k in MEASURES))


# ---- risk control, on histograms --------------------------------------------------------------


def binomial_tail(x: int, n: int, p: float) -> float:
    """The probability of x or fewer among n at share p, as an incomplete beta
    function by its continued fraction: the cost does not grow with n."""
    a, b, z = n - x, x + 1, 1.0 - p
    if z <= 0.0:
        return 0.0
    if z > (a + 1) / (a + b + 2):  # the fraction converges fast on one side
        return 1.0 - _beta_fraction(b, a, p)
    return _beta_fraction(a, b, z)


def _beta_fraction(a: float, b: float, z: float) -> float:
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(z) + b * math.log1p(-z)) / a
    tiny, c = 1e-300, 1.0
    d = 1.0 / (1.0 - (a + b) * z / (a + 1.0) or tiny)
    value = d
    for m in range(1, 10_000):
        for k in (m * (b - m) * z / ((a + 2 * m - 1) * (a + 2 * m)),
                  -(a + m) * (a + b + m) * z / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1.0 + k * d or tiny)
            c = 1.0 + k / c or tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * value


def upper_bound(x: int, n: int, error: float) -> float:
    """The exact (Clopper-Pearson) upper confidence bound for a share of which
    x of n were seen: the p at which x or fewer have probability ``error``."""
    if n == 0 or x >= n:
        return 1.0
    low, high = x / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mid < 1 and binomial_tail(x, n, mid) > error else (low, mid)
    return high


def range_of(hundredths: Column) -> Column:
    """The number of the measure's range."""
    return F.aggregate(F.array(*[F.lit(x) for x in RANGES[1:]]), F.lit(0), lambda n, x: n + (hundredths >= x).cast("int"))


def log_odds(table: np.ndarray) -> np.ndarray:
    """How much each range speaks for a bad text, from counts [quality, range]
    of good (1) and bad (0) ones."""
    bad, n = table[0].astype(float), table.sum(axis=0)
    share = (bad.sum() + 0.5) / (n.sum() + 1.0)
    smooth = (bad + PRIOR * share) / (n + PRIOR)
    return np.log(smooth / (1 - smooth)) - math.log(share / (1 - share))


def select_cutoff(tune: np.ndarray, hold: np.ndarray, limit: float, error: float) -> int | None:
    """The evidence above which documents are rejected, from counts [quality,
    evidence] of the two halves; None: none is."""
    above = lambda h: np.concatenate((np.cumsum(h[:, ::-1], axis=1)[:, ::-1][:, 1:], np.zeros((2, 1), int)), axis=1)
    bad, good = above(tune)
    rejected, n = above(hold)[1], int(hold[1].sum())
    best = None
    for c in range(tune.shape[1] - 2, -1, -1):
        if upper_bound(int(rejected[c]), n, error) > limit:
            break
        if bad[c] > 0 and bad[c] >= PROPOSED_BAD * (bad[c] + good[c]):
            best = c
    return best


def _labelled(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled documents that pass the base rules: quality (1: good), hold."""
    known = (labels.where("quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.min(F.col("quality").cast("int")).alias("quality")))
    return (measured.where(~_base_failed()).join(known, "doc_id")
            .withColumn("hold", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(2)).cast("int")))


@dataclass
class Fitted:
    """Per stratum the log odds [rule, range] and the evidence above which
    documents go (``EVIDENCE``: never)."""

    odds: dict[str | None, np.ndarray]
    cutoffs: dict[str | None, int]


def evidence(ranges: list[Column], odds: Column) -> Column:
    """The sum of a document's log odds, in tenths from -10 on."""
    total = F.lit(0.0)
    for k, x in enumerate(ranges):
        total = total + odds[F.lit(k * len(RANGES)) + x]
    return F.floor(F.greatest(F.lit(-10.0), F.least(F.lit(10.0), total)) * 10 + 100).cast("int")


def _table(spark: SparkSession, values: dict, kind: str) -> DataFrame:
    """stratum and a value for each: a few rows, by ``LEAST_LABELLED``."""
    return spark.createDataFrame([(s, v) for s, v in values.items()], f"at string, value {kind}")


def _with(df: DataFrame, values: dict, kind: str, name: str) -> DataFrame:
    """``df`` with the stratum's value, that of the others where it has none of its own."""
    rest = F.lit(values.get(OTHERS)).cast(kind) if kind == "int" else F.lit(values.get(OTHERS) or []).cast(kind)
    own = _table(df.sparkSession, {s: v for s, v in values.items() if s != OTHERS}, kind)
    joined = df.join(F.broadcast(own), F.col("stratum").eqNullSafe(F.col("at")), "left")
    return joined.withColumn(name, F.coalesce("value", rest)).drop("at", "value")


def fit(measured: DataFrame, labels: DataFrame) -> Fitted:
    spark = measured.sparkSession
    rows = cut(_labelled(measured, labels))
    strata = {r["stratum"] for r in rows.groupBy("stratum").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_LABELLED).collect()}
    named = spark.createDataFrame([(s, s if s is not None else "") for s in strata], "at string, name string")
    rows = rows.join(F.broadcast(named), F.col("stratum").eqNullSafe(F.col("at")), "left").withColumn("own", F.col("name").isNotNull()).drop("at", "name")
    ranges = [range_of(F.col(f"share_{k}")) for k in RULES]
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), x.alias("range")) for k, x in enumerate(ranges)])).alias("r")
    counted = (rows.where("hold = 0").select("own", "stratum", "quality", pairs)
               .groupBy("own", F.when(F.col("own"), F.col("stratum")).alias("stratum"), "quality", "r.rule", "r.range")
               .agg(F.count("*").alias("n")).collect())  # strata times rules times ranges
    key = lambda r: r["stratum"] if r["own"] else OTHERS
    tables: dict = {}
    for r in counted:
        tables.setdefault(key(r), np.zeros((len(RULES), 2, len(RANGES)), dtype=np.int64))[r["rule"], r["quality"], r["range"]] += r["n"]
    odds = {s: np.array([log_odds(t) for t in table]) for s, table in tables.items()}
    rows = _with(rows, {s: o.ravel().tolist() for s, o in odds.items()}, "array<double>", "odds").where(F.size("odds") > 0)
    scored = rows.select("own", "stratum", "quality", "hold", evidence(ranges, F.col("odds")).alias("evidence"))
    counted = (scored.groupBy("own", F.when(F.col("own"), F.col("stratum")).alias("stratum"), "quality", "hold", "evidence")
               .agg(F.count("*").alias("n")).collect())
    halves: dict = {}
    for r in counted:
        halves.setdefault(key(r), np.zeros((2, 2, EVIDENCE), dtype=np.int64))[r["hold"], r["quality"], r["evidence"]] += r["n"]
    cutoffs = {}
    for s, (tune, hold) in halves.items():
        found = select_cutoff(tune, hold, FALSE_REJECTIONS, ERROR / len(halves))
        cutoffs[s] = EVIDENCE if found is None else found
    return Fitted(odds, cutoffs)


def _base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base measures, base_failed, kept, evidence, and the rules that
    spoke most against a rejected document."""
    measured = cut(measures(docs))
    fitted = fit(measured, labels)
    rows = _with(measured, {s: o.ravel().tolist() for s, o in fitted.odds.items()}, "array<double>", "odds")
    rows = _with(rows, fitted.cutoffs, "int", "cutoff")
    ranges = [range_of(F.col(f"share_{k}")) for k in RULES]
    speaks = F.array_compact(F.array(*[F.when(F.col("odds")[F.lit(k * len(RANGES)) + x] >= 0.5, F.lit(rule))
                                       for k, (rule, x) in enumerate(zip(RULES, ranges, strict=True))]))
    has = F.size("odds") > 0
    judged = (rows.withColumn("base_failed", _base_failed())
              .withColumn("evidence", F.when(has, evidence(ranges, F.col("odds"))))
              .withColumn("rejected", F.coalesce(F.col("evidence") > F.col("cutoff"), F.lit(False))))
    return judged.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & ~F.col("rejected")).alias("kept"),
                         "evidence", F.when(F.col("rejected"), F.array_join(speaks, ",")).otherwise("").alias("failed_rules"))
