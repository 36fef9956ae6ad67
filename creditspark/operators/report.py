"""Masking, display projections and sinks (P7, P8, S5, S6); the snapshot is in ``snapshot``."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.core import np_round

# --- Fixed values that must equal the reference's for identical results -----
MASK_PREFIX, MASK_KEEP, MASK_SUFFIX = "****", 4, "***"
# ---------------------------------------------------------------------------


def mask_pii(df: DataFrame) -> DataFrame:
    """LoanID -> ``****`` + last 4 characters; Borrower -> first character + ``***``.

    A NULL Borrower stays NULL (the reference prints it as ``n***``).
    """
    out = df
    if "LoanID" in df.columns:
        out = out.withColumn("LoanID", F.concat(F.lit(MASK_PREFIX), F.right(F.col("LoanID"), F.lit(MASK_KEEP))))
    if "Borrower" in df.columns:
        # (?d): only "\n" ends a line, as for Python's "." (Java also stops at "\r").
        out = out.withColumn("Borrower", F.regexp_replace(F.col("Borrower"), "(?d)(.)(.*)", "$1" + MASK_SUFFIX))
    return out


# --- Display tables. Their columns, order and digits are fixed values: they ---
# --- must equal the reference's tables for identical results -----------------

def _pct(name: str, digits: int = 2):
    return np_round(F.col(name) * F.lit(100.0), digits).alias(name)


def _num(name: str, digits: int):
    return np_round(F.col(name), digits).alias(name)


def display_pricing(df: DataFrame, extra=()) -> DataFrame:
    """The pricing table as displayed: percentages x100 rounded to 2,
    money to 2, spread in whole bps, all-in rate to 2."""
    return df.select(
        "Scenario", *extra, "LoanID",
        _pct("PD_12m_st"), _pct("LGD_st"), _num("EAD_12m_st", 2), _num("EL_12m_st", 2), _pct("EL_rate_st"),
        _num("SuggestedSpread_bps", 0), _num("SuggestedAllInRate_pct", 2),
    )


def display_derived_base(df: DataFrame) -> DataFrame:
    """Derived metrics as displayed on the data tab."""
    money = ("LoanAmount", "MonthlyPayment", "AnnualDebtService", "Balance_12m", "Interest_Y1")
    return df.select(
        "LoanID", "Borrower", "Sector", "Geography", _num("LoanAmount", 2),
        (F.col("InterestRate_clean") * F.lit(100.0)).alias("InterestRate_%"), "TermMonths",
        *[_num(c, 2) for c in money[1:]], *[_num(c, 4) for c in ("LTV", "DTI", "DSCR", "ICR")],
    )


def display_base_risk(df: DataFrame) -> DataFrame:
    return df.select("LoanID", _pct("PD_12m"), _pct("LGD"), _num("EAD_12m", 2), _num("EL_12m", 2), "RiskTier")


def display_stressed_risk(df: DataFrame) -> DataFrame:
    return df.select("Scenario", "LoanID", _pct("PD_12m_st"), _pct("LGD_st"), _num("EAD_12m_st", 2),
                     _num("EL_12m_st", 2), "RiskTier_st")


def display_covenants(df: DataFrame) -> DataFrame:
    cols = ("DSCR_st", "ICR_st", "LTV_st", "DTI_st", "HR_DSCR_st", "HR_ICR_st", "HR_LTV_st", "HR_DTI_st", "WorstHeadroom_st")
    return df.select("Scenario", "LoanID", "Badge_st", *[_num(c, 4) for c in cols])


def display_lifetime(df: DataFrame) -> DataFrame:
    return df.select("Scenario", "LoanID", _num("EL_life_base", 2), _num("EL_life_st", 2))


def display_watchlist_tab(ranked: DataFrame) -> DataFrame:
    """The watchlist as the covenant tab shows it."""
    return ranked.select("Scenario", "rank", "LoanID", "Badge_st", _pct("PD_12m_st"), _pct("LGD_st"),
                         *[_num(c, 4) for c in ("WorstHeadroom_st", "DSCR_st", "LTV_st", "DTI_st", "EL_12m_st")])


def display_watchlist_report(ranked: DataFrame) -> DataFrame:
    """The watchlist of the report: everything rounded to 4 digits."""
    return ranked.select("Scenario", "rank", "LoanID", "Badge_st", "Tightest",
                         *[_num(c, 4) for c in ("WorstHeadroom_st", "DSCR_st", "LTV_st", "DTI_st", "PD_12m_st", "LGD_st")])


def display_top(ranked: DataFrame) -> DataFrame:
    """A top-10 table of the report."""
    return ranked.select("Scenario", "rank", "LoanID", "Borrower", "Sector", "Geography", _num("EAD_12m_st", 2),
                         _num("EL_12m_st", 2), _pct("PD_12m_st"), _pct("LGD_st"), "RiskTier_st")


# --- sinks ---------------------------------------------------------------------------

# Rows of one written file at most; Spark deals the rows of a large scenario to
# as many tasks as its size asks for.
ROWS_PER_FILE = 5_000_000


def _write_by_scenario(df: DataFrame, path: str, fmt: str, scenarios: Sequence[str], rows_per_file: int) -> None:
    """Writes ``df`` in one folder per scenario, and replaces the folders of the
    scenarios it has; other scenarios' folders stay. A rerun gives the same
    table. ``scenarios`` are those that were run: one of them without rows is
    replaced by a folder without rows."""
    seen = Observation()
    # Rows meet by scenario so that each task writes few files; AQE splits large ones.
    dealt = df.hint("rebalance", "Scenario").observe(seen, F.collect_set("Scenario").alias("names"))
    how = {"header": True, "maxRecordsPerFile": rows_per_file}
    (dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**how)
     .partitionBy("Scenario").format(fmt).save(path))
    as_folder = df.sparkSession._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for name in sorted(set(scenarios) - set(seen.get["names"] or ())):
        # Static overwrite of that folder alone: it has no rows to name it.
        none = df.drop("Scenario").where(F.lit(False)).coalesce(1)
        none.write.mode("overwrite").options(**how).format(fmt).save(f"{path.rstrip('/')}/Scenario={as_folder(name)}")


def write_exceptions_csv(exceptions_df: DataFrame, path: str, scenarios: Sequence[str] = (),
                         rows_per_file: int = ROWS_PER_FILE) -> None:
    """Every Red / Amber loan, unrounded, CSV with header, one folder per
    scenario. A rerun replaces the scenarios it ran and leaves the others."""
    _write_by_scenario(exceptions_df, path, "csv", scenarios, rows_per_file)


def write_pricing_table(pricing_display: DataFrame, path: str, fmt: str = "parquet", scenarios: Sequence[str] = (),
                        rows_per_file: int = ROWS_PER_FILE) -> None:
    """The rounded pricing table, partitioned by scenario. A rerun replaces
    the scenarios it ran and leaves the others."""
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"fmt must be 'parquet' or 'csv', got {fmt!r}")
    _write_by_scenario(pricing_display, path, fmt, scenarios, rows_per_file)


def pricing_export_name(preset: str, now: _dt.datetime | None = None) -> str:
    """The name of one pricing export: preset and time, as the reference names it."""
    return f"pricing_table_{preset}_{now or _dt.datetime.now():%Y%m%d_%H%M%S}"
