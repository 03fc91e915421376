"""Numeric column expressions with the semantics that the analyses need.

Spark's ANSI division raises on 0/0 and its comparisons hold NaN for the largest value; the
helpers below give IEEE results instead and leave the session's settings alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def ieee_div(a: Column, b: Column) -> Column:
    """a / b in doubles: NaN for 0/0, infinities for other divisions by zero, null for null."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when(a > 0, F.lit(math.inf)).otherwise(F.lit(-math.inf))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def above(value: Column, threshold: float) -> Column:
    """value > threshold, false for NaN and null."""
    return F.coalesce((value > F.lit(float(threshold))) & ~F.isnan(value), F.lit(False))


def angle_between(a: Column, b: Column) -> Column:
    """(a - b) modulo 2 pi, in [0, 2 pi)."""
    return F.pmod(a - b, F.lit(2 * math.pi))


def first_peak(values: Column, start: int) -> Column:
    """Place (from 0) of the largest element from `start` on: the first of equal ones; NaN counts as the largest."""
    tail = F.slice(values, start + 1, F.greatest(F.size(values) - start, F.lit(0)))
    return -F.array_max(F.transform(tail, lambda v, i: F.struct(v.alias("v"), (-(i + start)).alias("k"))))["k"]


def group_mean(value: Column, integer: bool = False) -> Column:
    """Mean over a group; with integer, the floor of it (as integer division gives)."""
    return F.floor(F.sum(value) / F.count(value)).cast("double") if integer else F.avg(value)


def group_sd(value: Column) -> Column:
    """Standard deviation of a group: sqrt(sum of squares / (max(n - 1, 1) + 1e-6)); 0 for one row."""
    n = F.count(value)
    squares = F.var_pop(value) * n
    return F.sqrt(squares / (F.greatest(n - 1, F.lit(1)) + F.lit(1e-6)))


def centred(values: Column) -> Column:
    """An array minus its mean."""
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.greatest(F.size(values), F.lit(1))
    return F.transform(values, lambda v: v - mean)
