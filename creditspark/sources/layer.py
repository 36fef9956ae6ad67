"""A cleaned portfolio layer: validated input, stored by column, read by partition.

``ingest`` reads delimited text once. The same pass parses, cleans, writes and
observes: how many rows have surplus fields or unbalanced quotes, and which files
hold bytes that are not UTF-8. Sound input is published (``sources.publish``);
rows that do not fit the header are errors that name files and counts, found by
a second pass that only then runs, and nothing is published. Bytes are read as
ISO-8859-1, which keeps them, and each row is decoded as UTF-8 where it is valid;
a file that mixes both is ISO-8859-1 as a whole, and its rows are written again.

The layer is partitioned by a hash of the sector, a bounded number of folders
whatever labels there are, and sorted by geography within. Filters read the
folder of their sector only. Whether a filter leaves any loans is told by the
table of labels, which is written beside the loans.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import clean
from ..operators.filters import ALL, EffectiveFilters
from ..schema import MalformedRowsError, check_required
from .csv import NA_TOKENS, csv_reader, encodings, sniff_separator
from .publish import Published, Publisher, read_published

PARTS = 64
_CORRUPT, _FILE, _PART = "_corrupt_record", "_file", "_part"


def sector_part(sector: Column) -> Column:
    return F.pmod(F.xxhash64(sector), F.lit(PARTS)).cast("int")


def _named(raw: str) -> str:
    """A header name as read byte by byte."""
    data = raw.encode("latin-1", "replace")
    try:
        return data.decode("utf-8").lstrip("\ufeff")
    except UnicodeDecodeError:
        return raw


def _rows_as_read(spark: SparkSession, paths: Sequence[str], sep: str, encoding: str, multi_line: bool) -> tuple[DataFrame, list[str]]:
    """All columns as strings with the record of rows that do not fit, and the file."""
    raw = csv_reader(spark, sep, encoding, multi_line).csv(list(paths)).columns
    names = [_named(c) if encoding == "ISO-8859-1" else c.lstrip("\ufeff") for c in raw]
    check_required(names)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*raw, _CORRUPT]])
    # Without pruning: a field count needs every field parsed.
    rows = (csv_reader(spark, sep, encoding, multi_line).option("columnPruning", False)
            .option("columnNameOfCorruptRecord", _CORRUPT).schema(schema).csv(list(paths)))
    rows = rows.select(*[F.col(f"`{a}`").alias(b) for a, b in zip(raw, names, strict=True)], _CORRUPT, F.input_file_name().alias(_FILE))
    return rows, names


def _faults(sep: str, fields: int) -> tuple[Column, Column]:
    """Whether a row has more fields than the header, or an open quote."""
    rest = F.regexp_replace(_CORRUPT, '"([^"]|"")*"', "")
    found = F.length(rest) - F.length(F.replace(rest, F.lit(sep))) + 1
    quotes = F.length(_CORRUPT) - F.length(F.replace(F.col(_CORRUPT), F.lit('"')))
    broken = F.coalesce(quotes % 2 == 1, F.lit(False))
    return F.coalesce((quotes % 2 == 0) & (found > fields), F.lit(False)), broken


def _decoded(rows: DataFrame, names: Sequence[str]) -> tuple[DataFrame, Column, Column]:
    """Rows read as ISO-8859-1 with their text decoded; whether a row has bytes
    beyond ASCII that are UTF-8, and whether it has others."""
    whole = F.concat_ws(",", *[F.col(f"`{c}`") for c in names])
    utf8 = F.is_valid_utf8(F.encode(whole, "ISO-8859-1").cast("string"))
    high = whole.rlike("[\\x80-\\xff]")
    rows = rows.select("*", utf8.alias("_utf8"), high.alias("_high"))
    text = lambda c: F.when(F.col("_high") & F.col("_utf8"), F.decode(F.encode(c, "ISO-8859-1"), "UTF-8")).otherwise(c)
    return rows.select(*[text(F.col(f"`{c}`")).alias(c) for c in names], _CORRUPT, _FILE, "_utf8", "_high"), \
        F.col("_high") & F.col("_utf8"), ~F.col("_utf8")


def _no_na(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    return rows.select(*[F.when(~F.col(f"`{c}`").isin(*NA_TOKENS), F.col(f"`{c}`")).alias(c) for c in names])


def _laid_out(cleaned: DataFrame) -> DataFrame:
    dealt = cleaned.withColumn(_PART, sector_part(F.col("Sector"))).hint("rebalance", _PART)
    return dealt.sortWithinPartitions(_PART, "Sector", "Geography")


def _write(publisher: Publisher, cleaned: DataFrame) -> PortfolioLayer:
    # Labels come from the written table: two narrow columns.
    loans = publisher.stage_table("loans", _laid_out(cleaned), partition_by=[_PART])
    labels = loans.groupBy("Sector", "Geography").agg(F.count(F.lit(1)).alias("n_loans"))
    publisher.stage_table("labels", labels.coalesce(1))
    return PortfolioLayer(publisher.publish())


def _malformed(rows: DataFrame, surplus: Column, broken: Column) -> MalformedRowsError:
    """The error for rows that do not fit, with counts per file."""
    # Spark asks for a column of the data beside the record.
    by_file = (rows.groupBy(_FILE).agg(F.sum(surplus.cast("long")).alias("surplus"), F.sum(broken.cast("long")).alias("broken"),
                                       F.count(rows[0]).alias("n"))
               .where("surplus + broken > 0").orderBy(_FILE).collect())
    return MalformedRowsError(sum(r.surplus for r in by_file), sum(r.broken for r in by_file),
                              {r[_FILE]: (r.surplus, r.broken) for r in by_file})


def ingest(spark: SparkSession, path: str, root: str, layer_id: str, sep: str | None = None, multi_line: bool = False,
           lenient_rates: bool = False) -> PortfolioLayer:
    """Reads the delimited text at ``path``, writes and publishes the cleaned
    layer ``layer_id`` under ``root``. Files without LoanIDs are read by
    ``sources.csv`` instead, as ids by position need the files' order."""
    publisher = Publisher(spark, root, layer_id)
    sep = sep or sniff_separator(spark, path)
    rows, names = _rows_as_read(spark, [path], sep, "ISO-8859-1", multi_line)
    if "LoanID" not in names:
        raise ValueError("ingest needs a LoanID column; read_csv_portfolio makes ids by position")
    surplus, broken = _faults(sep, len(names))
    decoded, as_utf8, other = _decoded(rows, names)
    # Observed below the cleaning, in the pass that writes. A task that runs again
    # may count its rows again, so only none or some is read from the counts.
    watch = Observation()
    decoded = decoded.observe(
        watch, F.sum(surplus.cast("long")).alias("surplus"), F.sum(broken.cast("long")).alias("broken"),
        F.collect_set(F.when(as_utf8, F.col(_FILE))).alias("utf8_files"),
        F.collect_set(F.when(other, F.col(_FILE))).alias("other_files"))
    loans = publisher.stage_table("loans", _laid_out(clean(_no_na(decoded, names), lenient_rates=lenient_rates)), partition_by=[_PART])
    found = watch.get
    if found["surplus"] or found["broken"]:
        raise _malformed(rows, surplus, broken)
    if set(found["utf8_files"] or ()) & set(found["other_files"] or ()):
        # Rare: some file mixes both encodings; every file's bytes decide, as the reader has it.
        publisher = Publisher(spark, root, layer_id)
        parts = [_no_na(*_rows_as_read(spark, files, sep, enc, multi_line)) for enc, files in encodings(spark, path).items() if files]
        whole = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
        return _write(publisher, clean(whole, lenient_rates=lenient_rates))
    labels = loans.groupBy("Sector", "Geography").agg(F.count(F.lit(1)).alias("n_loans"))
    publisher.stage_table("labels", labels.coalesce(1))
    return PortfolioLayer(publisher.publish())


def write_layer(spark: SparkSession, raw: DataFrame, root: str, layer_id: str, lenient_rates: bool = False) -> PortfolioLayer:
    """Cleans a portfolio that is a DataFrame already, writes and publishes it."""
    return _write(Publisher(spark, root, layer_id), clean(raw, lenient_rates=lenient_rates))


def read_layer(spark: SparkSession, root: str, layer_id: str) -> PortfolioLayer:
    return PortfolioLayer(read_published(spark, root, layer_id))


@dataclass(frozen=True)
class PortfolioLayer:
    published: Published

    @property
    def loans(self) -> DataFrame:
        """All cleaned loans, as ``clean`` gives them."""
        return self.published.table("loans").drop(_PART)

    @property
    def labels(self) -> DataFrame:
        """Sector, Geography, n_loans."""
        return self.published.table("labels")

    def domains(self) -> DataFrame:
        """F6 from the labels alone."""
        pairs = F.stack(F.lit(2), F.lit("Sector"), F.col("Sector"), F.lit("Geography"), F.col("Geography")).alias("dimension", "value")
        return self.labels.select(pairs).distinct().orderBy("dimension", "value")

    def filtered(self, sector: str = ALL, geography: str = ALL) -> tuple[DataFrame, EffectiveFilters]:
        """The loans that the filters leave, relaxed as ``filter_portfolio``
        does it. The labels, read first, settle what the filters come to, so the
        loans are read from the folder of their sector only."""
        if sector == ALL and geography == ALL:
            return self.loans, EffectiveFilters(ALL, ALL)
        in_sector = F.lit(True) if sector == ALL else F.col("Sector") == sector
        in_geography = F.lit(True) if geography == ALL else F.col("Geography") == geography
        presence = self.labels.agg(F.coalesce(F.max(in_sector & in_geography), F.lit(False)).alias("has_both"),
                                   F.coalesce(F.max(in_sector), F.lit(False)).alias("has_sector"))
        asked = EffectiveFilters(sector, geography, presence)
        in_effect = asked.resolve()
        df = self.published.table("loans")
        if in_effect[0] != ALL:
            df = df.where((F.col(_PART) == sector_part(F.lit(in_effect[0]))) & (F.col("Sector") == in_effect[0]))
        if in_effect[1] != ALL:
            df = df.where(F.col("Geography") == in_effect[1])
        return df.drop(_PART), asked
