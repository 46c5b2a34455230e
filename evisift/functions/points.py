"""Exact point arithmetic: whole hundredths inside the plan, DOUBLE only at the edge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(numerator: Column, denominator: int) -> Column:
    """``numerator / denominator`` as a whole number, halves away from zero."""
    return div(numerator.cast("long") * 2 + F.signum(numerator).cast("long") * denominator, 2 * denominator)


def div(numerator: Column, denominator: int) -> Column:
    """Whole-number division that truncates towards zero."""
    return F.call_function("div", numerator, F.lit(denominator).cast("long"))


def clamp(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def as_points(hundredths: Column) -> Column:
    """Hundredths to points, the last step before output."""
    return hundredths.cast("double") / F.lit(100.0)


def tenths_text(tenths: Column) -> Column:
    """A whole number of tenths written with one decimal place."""
    sign = F.when(tenths < 0, "-").otherwise("")
    size = F.abs(tenths).cast("long")
    return F.concat(sign, div(size, 10).cast("string"), F.lit("."), (size % 10).cast("string"))


def one_decimal(hundredths: Column) -> Column:
    return tenths_text(half_up(hundredths, 10))
