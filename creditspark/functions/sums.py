"""Sums of doubles that are the same at any partitioning.

Floating-point addition depends on its order, so sums over other partitions, or
after a lost task ran again, differ in their last bits. Here each value is first
rounded to a multiple of 2^-30 (about 1e-9) and the multiples are summed as whole
numbers, which no order changes. A multiple may need 90 bits, so it is split in
three parts that are summed as longs: partial sums stay plain long additions in
generated code, up to 2^37 rows of a group. The few sums per group are put
together as one decimal at the end.

Values of 2^60 (1e18) and more would overflow the high part; they are added as
doubles, so that nothing is lost, and only sums that hold such values depend on
their order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import col

UNIT_BITS, PART_BITS = 30, 26
LARGE = float(1 << 60)


def exact_units(c) -> Column:
    """An aggregate: the sum of ``c`` in units of 2^-30 as decimal(38, 0), exact
    but for each value's rounding to a unit; 0 without values. NULLs and values
    from ``LARGE`` on count for nothing."""
    c = col(c)
    whole = F.rint(F.when(F.abs(c) < F.lit(LARGE), c) * F.lit(float(1 << UNIT_BITS)))
    high = F.floor(whole * F.lit(2.0 ** -(2 * PART_BITS)))
    rest = whole - high.cast("double") * F.lit(float(1 << 2 * PART_BITS))  # exact: a multiple of whole's last bit
    mid = F.floor(rest * F.lit(2.0**-PART_BITS))
    low = (rest - mid.cast("double") * F.lit(float(1 << PART_BITS))).cast("long")
    as_decimal = lambda x, bits: F.coalesce(F.sum(x), F.lit(0)).cast("decimal(20,0)") * F.lit(1 << bits).cast("decimal(17,0)")
    return (as_decimal(high, 2 * PART_BITS) + as_decimal(mid, PART_BITS) + as_decimal(low, 0)).cast("decimal(38,0)")


def large_sum(c) -> Column:
    """An aggregate: the plain sum of the values that ``exact_units`` leaves out."""
    c = col(c)
    return F.coalesce(F.sum(F.when(F.abs(c) >= F.lit(LARGE), c)), F.lit(0.0))


def units_to_double(units: Column) -> Column:
    return units.cast("double") * F.lit(2.0**-UNIT_BITS)


def exact_sum(c) -> Column:
    """An aggregate: the sum of ``c`` as a double, NULLs skipped, 0 without
    values (pandas ``sum``)."""
    return units_to_double(exact_units(c)) + large_sum(c)
