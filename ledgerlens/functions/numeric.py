"""Ratios, integer division, sentinels and banding."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(numerator: Column, denominator: Column) -> Column:
    """Integer division that truncates toward zero; NULL on a zero denominator."""
    return F.call_function("div", numerator, F.nullif(denominator, F.lit(0)))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double quotient; NULL (not an error) when the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient only for a positive denominator, else NULL."""
    return F.when(denominator > 0, F.try_divide(numerator, denominator))


def floor_to(value: Column, places: int) -> Column:
    """Round down to a number of decimals."""
    scale = 10**places
    return F.floor(value * scale) / scale


def clean_numeric(text: Column, sentinels: Iterable[str], precision: int = 12, scale: int = 2) -> Column:
    """Numeric text to decimal, with sentinel strings and bad text as NULL."""
    return F.when(~text.isin(*sentinels), text).try_cast(f"decimal({precision},{scale})")


def nullif_fallback(value: Column, fallback: Column) -> Column:
    """``value`` unless it is NULL or zero, else ``fallback``."""
    return F.coalesce(F.nullif(value, F.lit(0)), fallback)


def lookup(key: Column, mapping: Sequence[tuple[Iterable, object]], default=None) -> Column:
    """First entry whose value list contains ``key``; ``default`` otherwise."""
    out = None
    for members, value in mapping:
        hit = key.isin(*members)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out if default is None else out.otherwise(F.lit(default))


def bands(value: Column, edges: Sequence[tuple[object, object, object]]) -> Column:
    """Label of the first half-open band ``[low, high)`` holding ``value``; None is unbounded."""
    out = None
    for low, high, label in edges:
        hit = F.lit(True)
        if low is not None:
            hit = value >= F.lit(low)
        if high is not None:
            hit = (value < F.lit(high)) if low is None else hit & (value < F.lit(high))
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out
