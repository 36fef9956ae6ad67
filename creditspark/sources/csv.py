"""Portfolio readers (S1, S2): delimited text and Parquet.

CSV is read with every column as a string; cleaning does the typed coercion.
Each file's encoding is decided from all of its bytes: one aggregate over the
raw lines tells which files are valid UTF-8, the others are ISO-8859-1. Rows
that do not fit the header are errors with counts, never shifted or cut. Both
passes can be left out (``encoding=``, ``validate=False``) for input that is
known to be sound; ``layer.ingest`` does both in the pass that reads the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import with_generated_ids
from ..schema import MalformedRowsError, check_required

# Separators looked for in the header, in preference order for ties; any other
# one is given as ``sep``.
SEPARATORS = (",", ";", "\t", "|")
# pandas' default missing-value strings (``read_csv`` without ``na_values``).
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
_CORRUPT = "_corrupt_record"


def sniff_separator(spark: SparkSession, path: str) -> str:
    """The candidate that occurs most often in the header line."""
    head = [r.value for r in spark.read.text(path).limit(1).collect()]
    counts = [(head[0].count(s), -i, s) for i, s in enumerate(SEPARATORS)] if head else []
    best = max(counts, default=(0, 0, ","))
    return best[2] if best[0] > 0 else ","


def encodings(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Encoding -> files of ``path``, from every byte of every file. The text
    source hands on lines as they are, so their bytes can be tested. A file name
    each comes to the driver, only where the encodings differ."""
    lines = spark.read.text(path)
    by_file = lines.groupBy(F.input_file_name().alias("file")).agg(F.min(F.is_valid_utf8("value")).alias("utf8"))
    found = {r["utf8"] for r in by_file.select("utf8").distinct().collect()}
    if len(found) < 2:
        return {"ISO-8859-1" if found == {False} else "UTF-8": [path]}
    out: dict[str, list[str]] = {"UTF-8": [], "ISO-8859-1": []}
    for r in by_file.orderBy("file").collect():
        out["UTF-8" if r["utf8"] else "ISO-8859-1"].append(r["file"])
    return out


def csv_reader(spark: SparkSession, sep: str, encoding: str, multi_line: bool):
    """A reader for delimited text with a header, quoted as pandas does it."""
    return (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("encoding", encoding)
        # pandas' default quoting: "" inside a quoted field is one quote.
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("multiLine", multi_line)
        # Every file's header is held against the columns.
        .option("enforceSchema", False)
    )


def _check_rows(spark: SparkSession, paths: list[str], columns: list[str], sep: str, encoding: str, multi_line: bool) -> None:
    """Raise if rows have more fields than the header or unbalanced quotes.
    Rows with fewer fields are filled with NULL, as pandas does."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, _CORRUPT]])
    # Without pruning: a field count needs every field parsed.
    rows = (csv_reader(spark, sep, encoding, multi_line).option("columnPruning", False)
            .option("columnNameOfCorruptRecord", _CORRUPT).schema(schema).csv(paths))
    rest = F.regexp_replace(_CORRUPT, '"([^"]|"")*"', "")
    fields = F.length(rest) - F.length(F.replace(rest, F.lit(sep))) + 1
    quotes = F.length(_CORRUPT) - F.length(F.replace(F.col(_CORRUPT), F.lit('"')))
    surplus, unbalanced = rows.agg(
        F.count(F.when((quotes % 2 == 0) & (fields > len(columns)), F.lit(1))),
        F.count(F.when(quotes % 2 == 1, F.lit(1))),
        F.count(F.col(f"`{columns[0]}`")),
    ).head()[:2]
    if surplus or unbalanced:
        raise MalformedRowsError(surplus, unbalanced)


def read_csv_portfolio(
    spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None,
    multi_line: bool = False, validate: bool = True,
) -> DataFrame:
    """Read a loan CSV (header row, any column order; all files of a folder with
    the same header) as strings; pandas' NA tokens become NULL. A missing
    required column, a file with another header (when its rows are read),
    surplus fields and unbalanced quotes are errors. ``multi_line`` allows line
    breaks inside quotes, at the cost of one task per file."""
    sep = sep or sniff_separator(spark, path)
    groups = {encoding: [path]} if encoding else encodings(spark, path)
    parts = []
    for enc, paths in groups.items():
        if not paths:
            continue
        df = csv_reader(spark, sep, enc, multi_line).csv(paths)
        # A byte-order mark may survive in the first header name under latin-1.
        names = [c.lstrip("\ufeff").replace("\u00ef\u00bb\u00bf", "", 1) for c in df.columns]
        check_required(names)
        if validate:
            _check_rows(spark, paths, df.columns, sep, enc, multi_line)
        parts.append(df.select(*[F.col(f"`{old}`").alias(new) for old, new in zip(df.columns, names, strict=True)]))
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    df = df.select(*[F.when(~F.col(f"`{c}`").isin(*NA_TOKENS), F.col(f"`{c}`")).alias(c) for c in df.columns])
    return _with_ids(df)


def _with_ids(df: DataFrame) -> DataFrame:
    """Position-based ids follow file order, so they are made on the scan itself."""
    return df if "LoanID" in df.columns else with_generated_ids(df)


def read_parquet_portfolio(spark: SparkSession, path: str) -> DataFrame:
    """Read a loan table stored as Parquet (typed or string columns)."""
    df = spark.read.parquet(path)
    check_required(df.columns)
    return _with_ids(df)


def read_portfolio(spark: SparkSession, path: str, fmt: str | None = None, **kw) -> DataFrame:
    fmt = fmt or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    if fmt == "parquet":
        return read_parquet_portfolio(spark, path)
    return read_csv_portfolio(spark, path, **kw)
