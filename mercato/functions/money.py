"""Money and ratio helpers.

Money stays DECIMAL through sums so totals do not depend on summation order;
it becomes DOUBLE only after the final rounding, as the reports show it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_money(c: Column, digits: int = 2) -> Column:
    """Round half away from zero, then show as double."""
    return F.round(c, digits).cast("double")


def as_double(c: Column) -> Column:
    return c.cast("double")


def exact_mean(total: Column, n: Column) -> Column:
    """Sum / count of a decimal total, exact to 12 places before rounding.

    The total is brought to DECIMAL(25,2) first: a sum of sums is typed
    DECIMAL(38,2), whose quotient would keep 6 places only."""
    return F.try_divide(total.cast("decimal(25,2)"), n.cast("decimal(12,0)"))


def rate_percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """``round(part * 100.0 / whole, digits)`` in double, null if whole is 0."""
    return F.round(F.try_divide(part.cast("double") * F.lit(100.0), whole.cast("double")), digits)


RATIO_PLACES = 10


def ratio_units(num: Column, den: Column, places: int = RATIO_PLACES) -> Column:
    """``num / den`` of two decimals rounded half up to ``places`` decimals,
    as an exact integer count of 10^-places units (DECIMAL(38,0)).

    Means of such ratios are summed exactly, so they do not depend on how
    rows are partitioned or in which order partial sums are merged.
    """
    return (F.round(num / den, places) * F.lit(10 ** places)).cast("decimal(38,0)")


def units_mean(unit_sum: Column, n: Column, places: int = RATIO_PLACES) -> Column:
    """Mean of ratios from a sum of :func:`ratio_units` and their count."""
    return unit_sum.cast("double") / n / F.lit(float(10 ** places))
