"""Operator 10: toxicity behind a noisy channel.

Writers hide words by look-alike signs (1d10t), separators (s.t.u.p.i.d,
s t u p i d) and repeated letters (stuuupid). Each suspicious form is read as a
lattice: every sign may stand for some letters or for nothing, at a cost, and a
Viterbi search finds the likeliest letters under a character trigram model
counted over the whole corpus. The restored words of a text are then scored,
beside its plain ones, by a logistic regression on the words that labelled texts
show to matter.

The model's counts are a table of trigrams of code points that grows with the
corpus and stays distributed. The distinct suspicious forms of all texts are one
too: they are dealt into parts of about ``PART_FORMS``, each part gets the costs
of the trigrams that its lattices pass through, and each form is read once,
however many texts have it. Texts and restored words meet by a join on the form.

The training sample (``TRAIN_ROWS`` labelled rows by hash, a bound that does not
depend on the corpus) and the words chosen from it are all that comes to the
driver. Texts are worked on ``SLICE_BYTES`` at a time in a task, a longer one
alone, with about 40 bytes of arrays per byte of text.

Defined cases: null and empty texts get the score of a text without any chosen
word; rows whose doc_id is null are not held out and not used for training; a
doc_id with several labels counts as toxic if one says so; without labels of
both kinds every score is the share of toxic labels (0 without any); a character
repeated more than three times in a form counts as three; a form longer than
``LONGEST`` code points is no single hidden word, and a longer run of spaced
letters is read in overlapping windows; an empty table gives no rows; other
columns are not read, and kept by ``accept``.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditspark.llm import textbatch as tb
from creditspark.llm.shared import cut, fewer_tasks, located

FOLDS = 5
TRAIN_ROWS = 30_000
# A chosen word is in at least so many training texts, and its toxic share
# differs from the rest by so many standard errors.
LEAST_TEXTS, LEAST_Z = 4, 4.0
RIDGE = 0.1
SLICE_BYTES = 1 << 20
PART_FORMS = 20_000
LONGEST = 256
# Rejected rows (under 200 bytes each) that are broadcast to leave them out.
MOST_BROADCAST = 1 << 17

# What a sign may stand for, and its cost in nats; "" is nothing.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c",
}
SEPARATORS = ".-_*~·,:;/\\'`^ "
SIGN_COST, SEPARATOR_COST, SIGN_AS_NOTHING, REPEAT_COST, BREAK_COST = 1.0, 0.3, 8.0, 0.5, 2.0


# ---- the character model ----------------------------------------------------------------------

# A symbol is a lower-case letter's code point; 0 stands before and after words.
_BITS = 21


@functools.cache
def _is_letter() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def gram(a: int, b: int, c: int) -> int:
    return (a << 2 * _BITS) | (b << _BITS) | c


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of the letter runs of ``text`` and their numbers: each run by
    itself, behind two word marks and before one."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    s = np.concatenate(([0, 0], np.where(_is_letter()[points], points, 0), [0]))
    before = np.where(s[1:-1] > 0, s[:-2], 0)  # nothing before a word's first letter
    here = (s[2:] > 0) | (s[1:-1] > 0)  # a letter, or the mark behind one
    before, last, now = before[here], s[1:-1][here], s[2:][here]
    letters = np.flatnonzero(np.bincount(s))  # the word mark among them
    k = len(letters)
    if k**3 > 1 << 22:
        code, seen = pd.factorize((before << 2 * _BITS) | (last << _BITS) | now)
        return seen, np.bincount(code, minlength=len(seen))
    dense = np.zeros(int(letters[-1]) + 1, dtype=np.int64)
    dense[letters] = np.arange(k)
    n = np.bincount((dense[before] * k + dense[last]) * k + dense[now], minlength=k**3)
    seen = np.flatnonzero(n)
    a, b, c = letters[seen // (k * k)], letters[seen // k % k], letters[seen % k]
    return (a << 2 * _BITS) | (b << _BITS) | c, n[seen]


def gram_costs(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """gram, cost for the trigrams of ``wanted`` (gram, each once): negative log
    probabilities from ``counts`` (gram, n), shorter contexts mixed in."""
    bits = (1 << _BITS) - 1
    part = lambda k: F.shiftright("gram", k * _BITS).bitwiseAND(bits)
    parts = counts.select("n", part(2).alias("a"), part(1).alias("b"), part(0).alias("c"))
    three = counts.select("gram", F.col("n").alias("n3"))
    context3 = parts.groupBy("a", "b").agg(F.sum("n").alias("m3"))
    two = parts.groupBy("b", "c").agg(F.sum("n").alias("n2"))
    context2 = parts.groupBy("b").agg(F.sum("n").alias("m2"))
    one = parts.groupBy("c").agg(F.sum("n").alias("n1"))
    whole = one.agg(F.coalesce(F.sum("n1"), F.lit(0)).alias("n"), F.count("*").alias("symbols")).first()
    rows = wanted.select("gram", part(2).alias("a"), part(1).alias("b"), part(0).alias("c"))
    rows = (rows.join(three, "gram", "left").join(context3, ["a", "b"], "left").join(two, ["b", "c"], "left")
            .join(context2, "b", "left").join(one, "c", "left"))
    n = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("double")
    p1 = (n("n1") + 1.0) / (float(whole["n"]) + whole["symbols"] + 1.0)
    p2 = (n("n2") + 5.0 * p1) / (n("m2") + 5.0)
    p3 = (n("n3") + 5.0 * p2) / (n("m3") + 5.0)
    return rows.select("gram", (-F.log(p3)).alias("cost"))


# ---- decoding -----------------------------------------------------------------------------------

_RUN = re.compile(r"([a-z])\1\1")
_SPACED = re.compile(r"(?:[^\W_][.\-_*~·,:;/\\'`^ ]+){2,}[^\W_]")
_EDGE = re.compile(r"^[^\w@$!|+€(]+|[^\w]+$")
# The same, but look-alike signs at the end stay.
_OUTER = re.compile(r"^[^\w@$!|+€(]+|[^\w@$!|+€(]+$")
_TOKEN = re.compile(r"[^\W\d_]+")
_SIGN = re.compile("[" + re.escape("".join(SIGNS)) + "]")
# Two signs at least and nothing else, but for separators.
_ALL_SIGNS = re.compile("(?:[{0}][{1}]*)+[{0}]".format(re.escape("".join(SIGNS)), re.escape(SEPARATORS)))


def suspicious(word: str) -> bool:
    """``word`` (lower case, edges stripped) may hide letters."""
    return bool(_SIGN.search(word) and _TOKEN.search(word) or _RUN.search(word) or _SPACED.search(word)
                or _ALL_SIGNS.fullmatch(word))


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each sign its readings and their costs."""
    out = []
    for k, c in enumerate(word):
        if c in SIGNS:
            readings = [(x, SIGN_COST) for x in SIGNS[c]] + [("", SIGN_AS_NOTHING)]
        elif c == " ":  # between spaced letters: within a word, or between two
            readings = [("", SEPARATOR_COST), (" ", BREAK_COST)]
        elif c in SEPARATORS:
            readings = [("", SEPARATOR_COST)]
        elif c.isalpha():
            readings = [(c, 0.0)]
            if k and word[k - 1] == c:
                readings.append(("", REPEAT_COST))
        else:
            readings = [("", SIGN_AS_NOTHING)]
        out.append(readings)
    return out


def _symbol(c: str) -> int:
    return 0 if c == " " else ord(c)


def _behind(b: int, c: int) -> tuple[int, int]:
    """The state after symbol c: the last two symbols of the word."""
    return (b, c) if c else (0, 0)


def needed(word: str) -> set[int]:
    """The trigrams that readings of ``word`` pass through."""
    out, states = set(), {(0, 0)}
    for readings in lattice(word):
        symbols = [_symbol(x) for x, _ in readings if x]
        out.update(gram(a, b, c) for a, b in states for c in symbols)
        new = {_behind(b, c) for _, b in states for c in symbols}
        states = new | states if len(symbols) < len(readings) else new
    return out | {gram(a, b, 0) for a, b in states}


def decode(word: str, costs: dict[int, float]) -> str:
    """The likeliest letters of ``word``: Viterbi over the last two symbols."""
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for readings in lattice(word):
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, path) in best.items():
            for letter, own in readings:
                if letter:
                    c = _symbol(letter)
                    state, total, way = _behind(b, c), cost + own + costs[gram(a, b, c)], (letter, path)
                else:
                    state, total, way = (a, b), cost + own, path
                if state not in new or total < new[state][0]:
                    new[state] = (total, way)
        best = new
    _, path = min(((cost + costs[gram(a, b, 0)], path) for (a, b), (cost, path) in best.items()), key=lambda x: x[0])
    letters = []
    while path:
        letters.append(path[0])
        path = path[1]
    return "".join(reversed(letters))


def windows(form: str) -> list[tuple[str, bool, bool]]:
    """``form`` as it is read: whole, or a long run of spaced letters in windows
    of ``LONGEST`` that overlap by half; whether words at the left and the right
    end of a window are whole."""
    if len(form) <= LONGEST:
        return [(form, True, True)]
    if " " not in form:
        return []
    half = LONGEST // 2
    starts = range(0, len(form) - half, half)
    return [(form[k: k + LONGEST], k == 0, k + LONGEST >= len(form)) for k in starts]


def restored(form: str, costs: dict[int, float]) -> list[str]:
    """The words that ``form`` is likeliest to stand for."""
    out = []
    for part, left, right in windows(form):
        words = decode(part, costs).split()
        out.extend(words[not left: len(words) - (not right)])
    return list(dict.fromkeys(out))


_MANY = re.compile(r"(.)\1{3,}", re.DOTALL)


def _form(word: str) -> str:
    return _MANY.sub(r"\1\1\1", word)


def tokens_and_forms(word: str) -> tuple[list[str], list[str]]:
    """The plain words inside a word, and its suspicious forms. Signs at the end
    may be letters (a$$) or marks (idiot!): both forms count."""
    word = word.lower()
    forms = dict.fromkeys((_EDGE.sub("", word), _OUTER.sub("", word)))
    return list(dict.fromkeys(_TOKEN.findall(next(iter(forms))))), [_form(x) for x in forms if suspicious(x)]


# Words of letters and usual marks at the ends, the bulk of any text: they are
# what they look like, unless a letter comes three times in a row.
_MARKS = "\"'.,;:?)]"
_PLAIN = "^[\"']*[a-z\u00df-\u00f6\u00f8-\u00ff]+[.,;:?\"')\\]]*$"
_THREE = "|".join(c * 3 for c in "abcdefghijklmnopqrstuvwxyz")


@dataclass
class Read:
    """What a slice's rows hold: ``(row, place in tokens)`` and ``(row, place in
    forms)`` pairs, each once."""

    tokens: pa.Array
    token_row: np.ndarray
    token: np.ndarray
    forms: list[str]
    form_row: np.ndarray
    form: np.ndarray


def _pairs(row: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(row.astype(np.int64) * max(1, n) + place)
    return both // max(1, n), both % max(1, n)


def read(data: np.ndarray, offsets: np.ndarray) -> Read:
    w = tb.words(data, offsets)
    ids, distinct = tb.encode_words(data, w)
    row = np.repeat(np.arange(len(offsets) - 1), w.counts)
    lower = pc.utf8_lower(distinct.cast(pa.large_string()))
    plain = pc.and_(pc.match_substring_regex(lower, _PLAIN), pc.invert(pc.match_substring_regex(lower, _THREE)))
    plain = plain.to_numpy(zero_copy_only=False).astype(bool)
    at_row, at_id = _pairs(row, ids, len(distinct))
    simple = plain[at_id]
    tokens = [pc.utf8_trim(lower, _MARKS)]
    token_row, token = [at_row[simple]], [at_id[simple]]
    form_at: dict[str, int] = {}
    form_row, form = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    odd = np.flatnonzero(~plain)
    if len(odd):
        found = [tokens_and_forms(x.decode()) for x in distinct.take(pa.array(odd)).to_pylist()]
        place = np.zeros(len(distinct), dtype=np.int64)
        place[odd] = np.arange(len(odd))
        rows, which = at_row[~simple], place[at_id[~simple]]
        for k, (rs, xs) in enumerate(((token_row, token), (form_row, form))):
            lists = [f[k] for f in found]
            if k == 0:
                flat = [x for xs_ in lists for x in xs_]
                base = len(distinct)
                codes = np.arange(len(flat)) + base
                tokens.append(pa.array(flat, type=pa.large_string()))
            else:
                codes = np.array([form_at.setdefault(x, len(form_at)) for xs_ in lists for x in xs_], dtype=np.int64)
            n = np.array([len(x) for x in lists], dtype=np.int64)
            first = np.cumsum(n) - n
            times = n[which]
            inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            rs.append(np.repeat(rows, times))
            xs.append(codes[np.repeat(first[which], times) + inner] if len(codes) else np.zeros(0, np.int64))
    points = tb.code_points_before(data)
    runs = tb.runs((points[w.ends] - points[w.starts]) == 1, w.first)
    for a, b in zip(runs.starts.tolist(), runs.ends.tolist(), strict=True):
        if b - a >= 3:  # spaced letters or signs
            text = _form(" ".join(x.decode() for x in distinct.take(pa.array(ids[a:b])).to_pylist()).lower())
            form_row.append(row[a: a + 1])
            form.append(np.array([form_at.setdefault(text, len(form_at))]))
    forms = list(form_at)
    every = pa.concat_arrays(tokens)
    r, t = _pairs(np.concatenate(token_row), np.concatenate(token), len(every))
    fr, f = _pairs(np.concatenate(form_row), np.concatenate(form), len(forms))
    return Read(every, r, t, forms, fr, f)


def _lists(values: pa.Array, row: np.ndarray, rows: int) -> pa.Array:
    """One list per row of the values, which are in the order of rows."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)), values)


def _strings(values: pa.Array | list[str]) -> pa.Array:
    return (pa.array(values, type=pa.string()) if isinstance(values, list) else values.cast(pa.string()))


# ---- what the corpus holds ------------------------------------------------------------------------


def evidence(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trigrams of all texts (gram, n) and their distinct suspicious forms
    (form), from one pass."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "n", "form"]
        for batch in batches:
            for _, _, data, offsets in tb.slices(batch.column(0), SLICE_BYTES):
                # Rows end words: a space between them.
                seen, n = trigrams(np.insert(data, offsets[1:-1], 32).tobytes().decode())
                yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n), pa.nulls(len(seen), pa.string())], names=names)
                forms = read(data, offsets).forms
                none = pa.nulls(len(forms), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, _strings(forms)], names=names)

    # What a task has counted is moved once per task, so tasks are not too small.
    both = cut(fewer_tasks(docs.select("text")).mapInArrow(gather, "gram long, n long, form string")
               .groupBy("gram", "form").agg(F.sum("n").alias("n")))
    return both.where("gram is not null").select("gram", "n"), both.where("form is not null").select("form")


def restore(grams: DataFrame, forms: DataFrame) -> DataFrame:
    """form, tokens: the words that each form is likeliest to stand for."""
    parts = 1 + forms.count() // PART_FORMS
    dealt = forms.withColumn("part", F.pmod(F.xxhash64("form"), F.lit(parts)).cast("int"))

    def wants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {(p, g) for x, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                     for w, _, _ in windows(x) for g in needed(w)}
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], type=pa.int32()), pa.array([g for _, g in found], type=pa.int64())],
                                             names=["part", "gram"])

    def decoded(own: pd.DataFrame, costs: pd.DataFrame) -> pd.DataFrame:
        table = dict(zip(costs["gram"].tolist(), costs["cost"].tolist(), strict=True))
        return pd.DataFrame({"form": own["form"], "tokens": [restored(x, table) for x in own["form"]]})

    wanted = cut(dealt.mapInArrow(wants, "part int, gram long").distinct())
    costs = wanted.join(gram_costs(grams, wanted.select("gram").distinct()), "gram")
    return cut(dealt.groupBy("part").cogroup(costs.groupBy("part")).applyInPandas(decoded, "form string, tokens array<string>"))


# ---- the classifier -------------------------------------------------------------------------------


@dataclass
class Model:
    words: list[str]
    weights: np.ndarray
    bias: float


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and toxic of at most ``TRAIN_ROWS`` labelled documents that are not
    held out. The sample's ids are bounded by that, so they are broadcast."""
    known = (labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(~held_out(F.col("doc_id"))))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("text", "toxic")


def words_of(rows: DataFrame, known: DataFrame) -> DataFrame:
    """toxic, tokens (plain and restored, each once) of each row's text."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in tb.slices(batch.column(0), SLICE_BYTES):
                x, n = read(data, offsets), end - first
                tokens = _lists(x.tokens.take(pa.array(x.token)).cast(pa.string()), x.token_row, n)
                forms = _lists(_strings(x.forms).take(pa.array(x.form)), x.form_row, n)
                yield pa.RecordBatch.from_arrays([*[c.slice(first, n) for c in batch.columns[1:]], tokens, forms],
                                                 names=["toxic", "tokens", "forms"])

    split_rows = cut(rows.select("text", "toxic").mapInArrow(split, "toxic int, tokens array<string>, forms array<string>")
                     .withColumn("id", F.monotonically_increasing_id()))
    found = (split_rows.select("id", F.explode("forms").alias("form")).join(known, "form")
             .groupBy("id").agg(F.flatten(F.collect_list("tokens")).alias("more")))
    return (split_rows.join(found, "id", "left")
            .select("toxic", F.array_distinct(F.concat("tokens", F.coalesce("more", F.array().cast("array<string>")))).alias("tokens")))


def chosen_words(rows: DataFrame) -> tuple[list[str], int, int]:
    """Words of ``rows`` (toxic, tokens) whose presence tells toxic texts from
    others, by a two-proportion z-test, strongest first; and the numbers of toxic
    and other texts."""
    whole = rows.agg(F.count("*"), F.sum("toxic")).head()
    n, bad = int(whole[0]), int(whole[1] or 0)
    if not 0 < bad < n:
        return [], bad, n - bad
    share = bad / n
    z = (F.col("bad") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    counted = (rows.select("toxic", F.explode("tokens").alias("token")).groupBy("token")
               .agg(F.count("*").alias("n"), F.sum("toxic").alias("bad"))
               .where((F.col("n") >= LEAST_TEXTS) & (F.abs(z) >= LEAST_Z)).orderBy(F.desc(F.abs(z)), "token"))
    return [r["token"] for r in counted.select("token").collect()], bad, n - bad  # words of the bounded sample


def regression(row: np.ndarray, feature: np.ndarray, y: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """Ridge-penalised logistic regression on 0/1 features, by Newton steps
    whose linear systems are solved by conjugate gradients."""
    w, bias = np.zeros(size), math.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9))

    def times(v: np.ndarray, b: float) -> np.ndarray:
        return b + np.bincount(row, weights=v[feature], minlength=len(y))

    def back(r: np.ndarray) -> np.ndarray:
        return np.bincount(feature, weights=r[row], minlength=size)

    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(times(w, bias), -30, 30)))
        h = np.maximum(p * (1 - p), 1e-6)
        grad = np.append(back(p - y) + RIDGE * w, (p - y).sum())
        step, r = np.zeros(size + 1), -grad
        d, old = r.copy(), r @ r
        for _ in range(50):
            if old < 1e-12:
                break
            hd = h * times(d[:-1], d[-1])
            ad = np.append(back(hd) + RIDGE * d[:-1], hd.sum())
            alpha = old / (d @ ad)
            step += alpha * d
            r -= alpha * ad
            new = r @ r
            d, old = r + new / old * d, new
        w, bias = w + step[:-1], bias + step[-1]
        if np.abs(step).max() < 1e-6:
            break
    return w, bias


def train(docs: DataFrame, labels: DataFrame, known: DataFrame) -> Model:
    """``known`` (form, tokens) has the restored forms of ``docs``."""
    rows = words_of(training_rows(docs, labels), known)
    words, bad, good = chosen_words(rows)
    if not words:
        share = bad / (bad + good) if bad + good else 0.0
        share = min(max(share, 1e-9), 1 - 1e-9)
        return Model([], np.zeros(0), math.log(share / (1 - share)))
    index = {t: k for k, t in enumerate(words)}

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [[index[t] for t in ts if t in index] for ts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, type=pa.list_(pa.int32()))], names=["toxic", "f"])

    sample = rows.mapInArrow(present, "toxic int, f array<int>").collect()  # TRAIN_ROWS at most, chosen words only
    row = np.repeat(np.arange(len(sample)), [len(r["f"]) for r in sample])
    feature = np.array([f for r in sample for f in r["f"]], dtype=np.int64)
    y = np.array([r["toxic"] for r in sample], dtype=float)
    weights, bias = regression(row, feature, y, len(words))
    return Model(words, weights, bias)


def scores(docs: DataFrame, model: Model, known: DataFrame, file: str, row: str) -> DataFrame:
    """``docs`` (``file``, ``row``, text, any others) with the score in place of
    the text. Only rows with suspicious forms are moved, without their texts."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # words of the bounded sample
    others = [c for c in docs.columns if c != "text"]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(sent.value.words, type=pa.large_string())
        for batch in batches:
            for first, end, data, offsets in tb.slices(batch.column(0), SLICE_BYTES):
                x, n = read(data, offsets), end - first
                of = pc.index_in(x.tokens, value_set=words)
                at = of.take(pa.array(x.token)).fill_null(-1).to_numpy(zero_copy_only=False)
                r, f = _pairs(x.token_row[at >= 0], at[at >= 0], len(words))
                features = _lists(pa.array(f.astype(np.int32)), r, n)
                forms = _lists(_strings(x.forms).take(pa.array(x.form)), x.form_row, n)
                yield pa.RecordBatch.from_arrays([*[c.slice(first, n) for c in batch.columns[1:]], features, forms],
                                                 names=[*others, "features", "forms"])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            lists = batch.column(len(others))
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            weight = m.weights[lists.flatten().to_numpy(zero_copy_only=False)]
            z = m.bias + np.bincount(np.repeat(np.arange(len(size)), size), weights=weight, minlength=len(size))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))],
                                             names=[*others, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*others).schema)
    marked = cut(docs.select("text", *others).mapInArrow(mark, f"{fields}, features array<int>, forms array<string>"))
    words = spark.createDataFrame([(w, k) for k, w in enumerate(model.words)], "token string, feature int")
    hits = (known.select("form", F.explode("tokens").alias("token")).join(F.broadcast(words), "token")
            .groupBy("form").agg(F.collect_set("feature").alias("hit")))
    found = (marked.select(file, row, F.explode("forms").alias("form")).join(hits, "form")
             .groupBy(file, row).agg(F.flatten(F.collect_list("hit")).alias("more")))
    hidden = (marked.where(F.size("forms") > 0).join(found, [file, row], "left")
              .select(*others, F.array_distinct(F.concat("features", F.coalesce("more", F.array().cast("array<int>")))).alias("features")))
    open_ = marked.where(F.size("forms") == 0).select(*others, "features")
    return open_.unionByName(hidden).mapInArrow(judged, f"{fields}, score double")


def _scored(docs: DataFrame, labels: DataFrame, at: DataFrame, file: str, row: str) -> DataFrame:
    known = restore(*evidence(docs))
    return scores(at, train(docs, labels, known), known, file, row)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    at, file, row = located(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    rows = _scored(at, labels, at, file, row)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                       F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, as they are. Rejected
    rows are told by their place in their file; few are left out by broadcast."""
    at, file, row = located(docs)
    narrow = at.select("doc_id", "text", at[file].alias("at_file"), at[row].alias("at_row"))
    bad = cut(_scored(narrow, labels, narrow.drop("doc_id"), "at_file", "at_row").where("score >= 0.5")
              .select(F.col("at_file").alias(file), F.col("at_row").alias(row)))
    few = bad.count() <= MOST_BROADCAST
    return at.join(F.broadcast(bad) if few else bad, [file, row], "left_anti").select(*docs.columns)
