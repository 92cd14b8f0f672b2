"""Rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def even(c: Column | str, digits: int) -> Column:
    """Half-even rounding of the decimal value; noise of sums beyond nine digits does not decide a tie."""
    return F.bround(F.round(c, 9), digits)


def signed_round(c: Column, digits: int) -> Column:
    """Half-up rounding of doubles as SQL engines do it, by scaling; unlike ``round``, what is rounded to zero keeps its sign."""
    return F.abs(F.round(c * 10.0**digits, 0) / 10.0**digits) * F.signum(c)
