"""Null-aware scalar helpers. Each takes and returns a Column.

Conventions: NaN never appears in a cleaned table (it becomes NULL at
ingestion), NULL propagates like pandas NaN, and division by zero yields NULL
instead of an ANSI error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def clip(c, lo=None, hi=None) -> Column:
    """pandas ``clip``: bounds apply to non-null values, NULL stays NULL.

    ``greatest``/``least`` skip NULLs, so the NULL test has to come first.
    """
    c = col(c)
    out = c
    if lo is not None:
        out = F.greatest(out, lit(lo))
    if hi is not None:
        out = F.least(out, lit(hi))
    return F.when(c.isNotNull(), out)


def nan_to_null(c) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)


def safe_div(n, d) -> Column:
    """``n / d`` with a zero denominator giving NULL (pandas ``replace({0: nan})``)."""
    d = col(d)
    return col(n) / F.when(d != 0, d)


def np_round(c, digits: int) -> Column:
    """NumPy ``round``: scale, round half to even, unscale (``rint(x*10^d)/10^d``)."""
    c = col(c)
    if digits == 0:
        return F.rint(c)
    scale = float(10**digits)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


# Characters Python's ``str.strip()`` removes (``str.isspace``).
PY_WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip_ws(c) -> Column:
    """Python ``str.strip()``: trims that character set from both ends (no regex)."""
    return F.btrim(col(c), F.lit(PY_WHITESPACE))


# Python's ``\s`` (str.isspace) as an explicit Java character class: Java's
# Unicode ``\s`` leaves out the separators U+001C..U+001F that Python counts.
_PY_WS_CLASS = "[" + "".join(f"\\u{ord(ch):04x}" for ch in PY_WHITESPACE) + "]+"


def collapse_ws(c) -> Column:
    """pandas ``str.replace(r"\\s+", " ", regex=True)``: whitespace runs become one space."""
    return F.regexp_replace(col(c), _PY_WS_CLASS, " ")


def key_of(c) -> Column:
    """Lookup key for the sector / collateral tables: ``(x or "").strip().lower()``."""
    return F.lower(strip_ws(F.coalesce(col(c), F.lit(""))))


# A plain decimal or scientific number, or inf / infinity, with optional sign and
# surrounding blanks: the strings ``pandas.to_numeric`` turns into a number.
# Java-style suffixes ("1d", "1f") that Spark's cast would take are rejected, and
# "nan" is left out because it is missing data (NaN becomes NULL here).
_NUMBER_RE = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"


def to_number(c) -> Column:
    """``pd.to_numeric(errors='coerce')`` on a string column; NaN never results.

    An overflowing literal such as ``1e400`` is unparseable for pandas (missing),
    while the cast would give infinity; infinity is kept only when spelled out.
    """
    c = col(c)
    parsed = F.when(c.rlike(_NUMBER_RE), F.trim(c).try_cast("double"))
    finite_or_spelled = (F.abs(parsed) != F.lit(float("inf"))) | F.lower(c).contains("inf")
    return F.when(finite_or_spelled, parsed)


def lookup(c, table: dict, default) -> Column:
    """Small literal map lookup with a default; the map is folded into codegen."""
    pairs = []
    for k, v in table.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.coalesce(F.create_map(*pairs)[col(c)], F.lit(default))


def apply_layers(df, layers) -> "DataFrame":  # noqa: F821
    """Add each layer of ``(name, Column)`` pairs as one projection on top of
    the previous, so later layers refer to earlier values by name."""
    for layer in layers:
        df = df.select("*", *[c.alias(name) for name, c in layer])
    return df


def drop_helpers(df):
    """Drop underscore-prefixed helper columns."""
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def keep_where(df, cond: Column):
    """Keep the rows where ``cond`` is true, evaluated on the already computed
    columns of ``df``.

    A plain ``where`` on a derived column is pushed by the optimizer below the
    projections that compute it (into the scenario join, even), so the whole
    scoring chain would be evaluated twice per row: once inlined into the
    predicate, once for the output. A generator cannot be pushed below its
    child, so exploding a one-element array for kept rows (NULL, hence no row,
    otherwise) filters in place without that duplication.
    """
    return df.select("*", F.explode(F.when(cond, F.array(F.lit(True)))).alias("_keep")).drop("_keep")
