"""Numeric and time helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, places: int) -> Column:
    """Decimal rounding with a fixed intermediate scale, so engines agree."""
    return F.round(value.cast("decimal(28,6)"), places).cast("double")


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from start to end with fractions; NULL when either is missing."""
    micros = F.timestamp_diff("MICROSECOND", start, end)
    return micros.cast("double") / F.lit(1_000_000.0)


def pct_change(before: Column, after: Column) -> Column:
    """Percent change, one decimal; NULL when either side is zero or missing."""
    pre, post = F.nullif(before, F.lit(0.0)), F.nullif(after, F.lit(0.0))
    return rounded((post - pre) / F.greatest(pre, F.lit(1.0)) * 100.0, 1)


def half_even_pct(part: Column, total: Column) -> Column:
    """Whole percent rounded half to even; an empty total counts as 100."""
    exact = (part * 100).cast("decimal(28,6)") / total.cast("decimal(28,6)")
    return F.when(total == 0, F.lit(100)).otherwise(F.bround(exact, 0).cast("int"))
