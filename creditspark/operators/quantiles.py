"""Exact quantiles of any number of distinct values, by range refinement.

The values are non-negative integer keys with counts. A first histogram over the
keys' high bits is small at any input, and tells in which of its ranges each
wanted rank lies; only those ranges are counted again, by their next bits, until
single keys are left. Each step is a distributed count followed by running sums
over at most 2^(difference of two shifts) rows of a group and rank, whatever the
number of keys. The frequency table is shuffled once; later steps read that
shuffle again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Keys below 2^40: histograms of 2^14, 2^13 and 2^13 ranges.
SHIFTS = (26, 13, 0)


def _before(by: Sequence[str], order: str, n: str) -> tuple[Column, Column]:
    """Running sum of ``n`` up to a row, and over the whole group."""
    group = Window.partitionBy(*by)
    return F.sum(n).over(group.orderBy(order)), F.sum(n).over(group)


def exact_percentiles(freq: DataFrame, by: Sequence[str], key: str, n: str, percentiles: Sequence[float],
                      shifts: Sequence[int] = SHIFTS) -> DataFrame:
    """``by``, total (long) and q (array of doubles, linear between neighbours) of
    the keys in ``freq`` (``by``, key, n: its count; each key may come more than
    once). Groups without keys are missing; NULL keys count for nothing."""
    by = list(by)
    keyed = freq.select(*by, F.col(key).cast("long").alias("_key"), F.col(n).cast("long").alias("_n"))
    ranges = keyed.groupBy(*by, F.shiftright("_key", shifts[0]).alias("_range")).agg(F.sum("_n").alias("_m"))
    # Not a plain filter on the key: that would be pushed below what computes it.
    ranges = ranges.withColumn("_m", F.when(F.col("_range").isNotNull(), F.col("_m")).otherwise(0))
    end, total = _before([*by, "_all"], "_range", "_m")
    ranges = ranges.withColumn("_all", F.lit(0)).withColumns({"_end": end, "_total": total})
    place = [(i, p * (F.col("_total") - 1)) for i, p in enumerate(percentiles)]
    wanted = F.array(*[F.struct(F.lit(2 * i + up).alias("_at"), (F.ceil(h) if up else F.floor(h)).cast("long").alias("_rank"))
                       for i, h in place for up in (0, 1)])
    here = F.filter(wanted, lambda w: (w["_rank"] >= F.col("_end") - F.col("_m")) & (w["_rank"] < F.col("_end")))
    found = ranges.select(*by, "_range", (F.col("_end") - F.col("_m")).alias("_before"), "_total", F.inline(here))
    for coarse, fine in zip(shifts, shifts[1:]):
        # A row per rank and group: a bounded broadcast.
        inside = keyed.withColumn("_range", F.shiftright("_key", coarse)).join(F.broadcast(found), [*by, "_range"])
        ranges = (inside.groupBy(*by, "_at", "_rank", "_before", "_total", F.shiftright("_key", fine).alias("_fine"))
                  .agg(F.sum("_n").alias("_m")))
        end, _ = _before([*by, "_at"], "_fine", "_m")
        ranges = ranges.withColumn("_end", F.col("_before") + end)
        found = (ranges.where((F.col("_rank") >= F.col("_end") - F.col("_m")) & (F.col("_rank") < F.col("_end")))
                 .select(*by, F.col("_fine").alias("_range"), (F.col("_end") - F.col("_m")).alias("_before"), "_total", "_at", "_rank"))
    value = lambda at: F.max(F.when(F.col("_at") == at, F.col("_range").cast("double")))
    rows = found.groupBy(*by).agg(F.coalesce(F.max("_total"), F.lit(0)).cast("long").alias("total"),
                                  *[value(k).alias(f"_v{k}") for k in range(2 * len(percentiles))])
    between = []
    for i, p in enumerate(percentiles):
        h, lo, hi = p * (F.col("total") - 1), F.col(f"_v{2 * i}"), F.col(f"_v{2 * i + 1}")
        between.append(F.when(lo == hi, lo).otherwise((F.ceil(h) - h) * lo + (h - F.floor(h)) * hi))
    return rows.select(*by, "total", F.array(*between).alias("q"))
