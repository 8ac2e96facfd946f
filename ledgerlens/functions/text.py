"""Pulling values out of free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import parse_date


def amount_between(text: Column, opening: str, closing: str) -> Column:
    """Number between the first ``opening`` and the first ``closing`` mark.

    NULL when the opening mark is missing or stands at position 1, when the closing
    mark does not follow it, or when the text in between is not a number.
    """
    start, stop = F.instr(text, opening), F.instr(text, closing)
    width = stop - start - F.lit(len(opening))
    inner = text.substr(start + F.lit(len(opening)), width)
    return F.when((start > 1) & (width > 0), inner).try_cast("decimal(18,2)")


def date_after(text: Column, marker: str, guard: str, guard_after: int) -> Column:
    """ISO date that follows ``marker``, trusted only if ``guard`` stands late enough."""
    start = F.instr(text, marker)
    inner = text.substr(start + F.lit(len(marker)), F.lit(10))
    return parse_date(F.when((start > 1) & (F.instr(text, guard) > guard_after), inner))
