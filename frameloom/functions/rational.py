"""Exact arithmetic on longs: media time, and floor, ceiling and half-even rounding of quotients."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ticks(pts: Column, origin: Column) -> Column:
    """Media time in ticks of the source's time base; the origin is the source's first time stamp."""
    return (pts - origin).cast("long")


def seconds(tick: Column, num: Column, den: Column) -> Column:
    """Seconds for display: one correctly rounded double division."""
    return (tick * num).cast("double") / den.cast("double")


def _quotient(a: Column, b: Column) -> Column:
    """Truncating integer division of longs (b > 0), without a detour over doubles."""
    return F.call_function("div", a.cast("long"), b.cast("long"))


def div_floor(a: Column, b: Column) -> Column:
    a, b = a.cast("long"), b.cast("long")
    return _quotient(a - F.pmod(a, b), b)


def div_ceil(a: Column, b: Column) -> Column:
    return -div_floor(-a, b)


def div_half_even(a: Column, b: Column) -> Column:
    """a / b to the nearest whole number, ties to the even one (b > 0)."""
    a, b = a.cast("long"), b.cast("long")
    low, twice = div_floor(a, b), 2 * F.pmod(a, b)
    return F.when(twice < b, low).when(twice > b, low + 1).otherwise(low + F.pmod(low, F.lit(2)))
