"""Conditional aggregates.

Two families that must not be mixed: ``*_if`` is NULL when nothing matches,
``*_if0`` is 0 when rows exist but nothing matches.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sum_if(cond: Column, value: Column) -> Column:
    return F.sum(F.when(cond, value))


def sum_if0(cond: Column, value: Column) -> Column:
    return F.sum(F.when(cond, value).otherwise(F.lit(0)))


def tally(cond: Column) -> Column:
    """Matching rows, NULL when there are none."""
    return F.sum(F.when(cond, F.lit(1)))


def tally0(cond: Column) -> Column:
    """Matching rows, 0 when there are none."""
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0)))


def placeholder() -> Column:
    """A metric that is reported but not defined yet: always NULL."""
    return F.lit(None).cast("bigint")
