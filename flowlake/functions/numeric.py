"""Numeric column helpers with the data model's NULL rules: NULL means undefined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_double(col: Column | str) -> Column:
    """Numeric coercion of a text cell: anything unparseable becomes NULL."""
    c = F.col(col) if isinstance(col, str) else col
    return c.try_cast("double")


def is_inf(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.abs(c) == F.lit(float("inf")), F.lit(False))


def is_missing(col: Column | str) -> Column:
    """NULL or NaN."""
    c = F.col(col) if isinstance(col, str) else col
    return c.isNull() | F.isnan(c)


def is_finite(col: Column | str) -> Column:
    return ~(is_missing(col) | is_inf(col))


def clip(col: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(col, F.lit(float(high))), F.lit(float(low)))


def ratio(num: Column, den: Column) -> Column:
    """Quotient, NULL where the denominator is zero or missing."""
    return F.try_divide(num.cast("double"), F.nullif(den.cast("double"), F.lit(0.0)))


def ratio_or_zero(num: Column, den: Column) -> Column:
    return F.coalesce(ratio(num, den), F.lit(0.0))


def over_one(num: Column, den: Column) -> Column:
    """Quotient with the denominator floored at one."""
    return num.cast("double") / F.greatest(den.cast("double"), F.lit(1.0))


def rate(x: Column, seconds: Column) -> Column:
    """x per second; zero for an empty record of no duration, NULL for a non-empty one."""
    return F.when(seconds > 0, x.cast("double") / seconds).when(x == 0, F.lit(0.0))


def all_of(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def any_of(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out
