"""Null-safe arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio_or(numerator: Column, denominator: Column, default: float | None = 0.0) -> Column:
    """``numerator / denominator``; ``default`` when the denominator is null or zero."""
    quotient = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return quotient if default is None else F.coalesce(quotient, F.lit(default))


def growth(current: Column, previous: Column) -> Column:
    """``current / previous - 1``; a missing or zero previous value reads as no growth."""
    return F.when(F.coalesce(previous, F.lit(0)) == 0, F.lit(0.0)).otherwise(
        F.try_divide(current.cast("double"), previous.cast("double")) - 1.0
    )


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def min_max(c: Column, low: Column, high: Column) -> Column:
    """Scaled to [0, 1]; 0.5 when the range is empty."""
    span = high - low
    return F.when(F.coalesce(span, F.lit(0.0)) == 0.0, F.lit(0.5)).otherwise(
        F.try_divide(c.cast("double") - low, span)
    )


def bool_flag(c: Column) -> Column:
    """1.0 / 0.0 from a boolean, a number, or the texts true, false, 1, 0; else null."""
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text.isin("true", "1", "1.0"), 1.0).when(text.isin("false", "0", "0.0"), 0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Set similarity of two arrays, 0 when both are empty."""
    return F.coalesce(
        F.try_divide(
            F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")
        ),
        F.lit(0.0),
    )
