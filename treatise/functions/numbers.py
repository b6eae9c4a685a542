"""Sums that don't depend on the order of their rows, and rounding as the SQL's engine has it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sums of multiples of 1 / GRID are exact in doubles below 2**33.
GRID = 2.0**20


def rounded(value: Column, digits: int) -> Column:
    """A double rounded to so many digits, halves away from zero, as value * 10**digits is a half in doubles.

    F.round() takes halves from the shortest decimal form instead: 16.4690405 becomes 16.469041 there, and 16.46904
    here and in DuckDB, since 16.4690405 * 10**6 is a little less than a half.
    """
    return F.round(value * 10.0**digits) / 10.0**digits


def steady_sum(value: Column) -> Column:
    """A sum of doubles, as an aggregate: multiples of a grid, which add up exactly, and what is left of them.

    The rests are below 2**-20, so what their order changes is far below the last bit of the sum.
    """
    coarse = F.rint(value * GRID) / GRID
    return F.sum(coarse) + F.sum(value - coarse)
