"""A loan portfolio projected from the driver's TPC-H-style tables.

One loan per order: ``orders JOIN customer JOIN nation``. The expressions
deliberately plant the dirty values the engine must survive: missing and zero
amounts, percent and decimal rates, zero rates, out-of-range scores, zero and
missing incomes, negative market values, dirty sector labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- Fixed values of the derived test portfolio (shared with the oracle SQL) ---
SEGMENT_SECTOR = {"BUILDING": "Construction", "FURNITURE": "Retail", "MACHINERY": "Manufacturing",
                  "AUTOMOBILE": "Transport"}
PRIORITY_COLLATERAL = {"1-URGENT": "Equipment", "2-HIGH": "RealEstate", "3-MEDIUM": "Inventory", "5-LOW": "AR"}
TERMS = (6, 12, 24, 36, 48, 60, 84, 120, 180, 360)
# ---------------------------------------------------------------------------


def _null(t: str) -> Column:
    return F.lit(None).cast(t)


def _d(v: float) -> Column:
    return F.lit(float(v))


def _case(c: Column, table: dict, default: Column) -> Column:
    out = None
    for key, val in table.items():
        out = F.when(c == key, F.lit(val)) if out is None else out.when(c == key, F.lit(val))
    return out.otherwise(default)


def loans_from_tables(orders: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    o = orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    c = customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    # nation is a fixed 25-row dimension: the planner's size estimate broadcasts it.
    n = nation.select("n_nationkey", "n_name")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))

    k = F.col("o_orderkey")
    price = F.col("o_totalprice")
    k17 = (k % 17).cast("double")
    x = _d(3.5) + _d(0.25) * (k % 37).cast("double")
    term = F.element_at(F.array(*[F.lit(t) for t in TERMS]), (k % 10 + 1).cast("int"))

    return j.select(
        F.concat(F.lit("L-"), F.lpad(k.cast("string"), 8, "0")).alias("LoanID"),
        F.col("c_name").alias("Borrower"),
        F.when(k % 29 == 0, _null("string"))
        .when(k % 31 == 0, F.lit("  Real   Estate "))
        .when(k % 37 == 0, F.lit("none"))
        .otherwise(_case(F.col("c_mktsegment"), SEGMENT_SECTOR, F.lit("Technology")))
        .alias("Sector"),
        F.col("n_name").alias("Geography"),
        F.when(k % 499 == 7, _null("double")).when(k % 499 == 8, _d(0)).otherwise(price).alias("LoanAmount"),
        F.when(k % 4999 == 21, _d(7500))  # with the long terms: growth factors overflow
        .when(k % 9973 == 5, _d(6))
        .when(k % 401 == 9, _null("double"))
        .when(k % 401 == 10, _d(0))
        .when(k % 5 == 0, x / _d(100))
        .otherwise(x)
        .alias("InterestRate"),
        F.when(k % 4999 == 21, 360).when(k % 9973 == 5, 200_000).otherwise(term).alias("TermMonths"),
        F.when(k % 23 == 0, _null("double"))
        .when(k % 307 == 11, _d(900))
        .otherwise((F.lit(520) + (k * 7919) % 331).cast("double"))
        .alias("CreditScore"),
        F.when(k % 211 == 12, _d(0))
        .when(k % 211 == 13, _null("double"))
        .otherwise((F.col("c_acctbal") + _d(1000)) * _d(4))
        .alias("MonthlyIncome"),
        _case(
            F.col("o_orderpriority"),
            PRIORITY_COLLATERAL,
            F.when(k % 2 == 0, F.lit("Securities")).otherwise(_null("string")),
        ).alias("CollateralType"),
        F.when(k % 101 == 14, _null("double")).otherwise(price * (_d(0.6) + _d(0.06) * k17)).alias("CollateralValue"),
        F.when((k % 101 == 14) | (k % 4 == 0), _null("double"))
        .when(k % 41 == 0, _d(-1))
        .otherwise(price * (_d(0.55) + _d(0.06) * k17))
        .alias("CurrentMarketValue"),
        F.when(k % 3 == 0, _null("double")).otherwise(price * (_d(0.05) + _d(0.02) * (k % 20).cast("double"))).alias("EBITDA"),
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw (uncleaned) loan table over ``sf_dir``; one row per order."""
    return loans_from_tables(
        read_table(spark, sf_dir, "orders"),
        read_table(spark, sf_dir, "customer"),
        read_table(spark, sf_dir, "nation"),
    )


# The same projection as SQL text, for DuckDB oracles over the same parquet views.
LOANS_SQL = """
SELECT
  concat('L-', lpad(CAST(o_orderkey AS VARCHAR), 8, '0')) AS LoanID,
  c_name AS Borrower,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL
       WHEN o_orderkey % 31 = 0 THEN '  Real   Estate '
       WHEN o_orderkey % 37 = 0 THEN 'none'
       WHEN c_mktsegment = 'BUILDING' THEN 'Construction'
       WHEN c_mktsegment = 'FURNITURE' THEN 'Retail'
       WHEN c_mktsegment = 'MACHINERY' THEN 'Manufacturing'
       WHEN c_mktsegment = 'AUTOMOBILE' THEN 'Transport'
       ELSE 'Technology' END AS Sector,
  n_name AS Geography,
  CASE WHEN o_orderkey % 499 = 7 THEN NULL
       WHEN o_orderkey % 499 = 8 THEN CAST(0 AS DOUBLE)
       ELSE o_totalprice END AS LoanAmount,
  CASE WHEN o_orderkey % 4999 = 21 THEN CAST(7500 AS DOUBLE)
       WHEN o_orderkey % 9973 = 5 THEN CAST(6 AS DOUBLE)
       WHEN o_orderkey % 401 = 9 THEN NULL
       WHEN o_orderkey % 401 = 10 THEN CAST(0 AS DOUBLE)
       WHEN o_orderkey % 5 = 0 THEN (CAST(3.5 AS DOUBLE) + CAST(0.25 AS DOUBLE) * CAST(o_orderkey % 37 AS DOUBLE)) / CAST(100 AS DOUBLE)
       ELSE CAST(3.5 AS DOUBLE) + CAST(0.25 AS DOUBLE) * CAST(o_orderkey % 37 AS DOUBLE) END AS InterestRate,
  CAST(CASE WHEN o_orderkey % 4999 = 21 THEN 360 WHEN o_orderkey % 9973 = 5 THEN 200000 ELSE
       CASE o_orderkey % 10 WHEN 0 THEN 6 WHEN 1 THEN 12 WHEN 2 THEN 24 WHEN 3 THEN 36 WHEN 4 THEN 48
       WHEN 5 THEN 60 WHEN 6 THEN 84 WHEN 7 THEN 120 WHEN 8 THEN 180 ELSE 360 END END AS INTEGER) AS TermMonths,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL
       WHEN o_orderkey % 307 = 11 THEN CAST(900 AS DOUBLE)
       ELSE CAST(520 + (o_orderkey * 7919) % 331 AS DOUBLE) END AS CreditScore,
  CASE WHEN o_orderkey % 211 = 12 THEN CAST(0 AS DOUBLE)
       WHEN o_orderkey % 211 = 13 THEN NULL
       ELSE (c_acctbal + CAST(1000 AS DOUBLE)) * CAST(4 AS DOUBLE) END AS MonthlyIncome,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Equipment' WHEN '2-HIGH' THEN 'RealEstate'
       WHEN '3-MEDIUM' THEN 'Inventory' WHEN '5-LOW' THEN 'AR'
       ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'Securities' ELSE NULL END END AS CollateralType,
  CASE WHEN o_orderkey % 101 = 14 THEN NULL
       ELSE o_totalprice * (CAST(0.6 AS DOUBLE) + CAST(0.06 AS DOUBLE) * CAST(o_orderkey % 17 AS DOUBLE)) END AS CollateralValue,
  CASE WHEN o_orderkey % 101 = 14 OR o_orderkey % 4 = 0 THEN NULL
       WHEN o_orderkey % 41 = 0 THEN CAST(-1 AS DOUBLE)
       ELSE o_totalprice * (CAST(0.55 AS DOUBLE) + CAST(0.06 AS DOUBLE) * CAST(o_orderkey % 17 AS DOUBLE)) END AS CurrentMarketValue,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL
       ELSE o_totalprice * (CAST(0.05 AS DOUBLE) + CAST(0.02 AS DOUBLE) * CAST(o_orderkey % 20 AS DOUBLE)) END AS EBITDA
FROM orders
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
"""
