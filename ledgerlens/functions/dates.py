"""Date arithmetic."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import int_div

EPOCH = dt.date(1970, 1, 1)
MILLIS_PER_DAY = 86_400_000


def _month_index(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def months_diff(start: Column, end: Column) -> Column:
    """Calendar month boundaries crossed from ``start`` to ``end``.

    31 Jan -> 1 Feb is one month. ``months_between`` and SQL ``datediff(MONTH, ..)``
    count completed months instead and must not be used here.
    """
    return _month_index(end) - _month_index(start)


def whole_years(start: Column, end: Column) -> Column:
    """Days between the dates divided by 365, truncated."""
    return int_div(F.datediff(end, start), F.lit(365))


def epoch_ms_to_date(millis: Column) -> Column:
    """Epoch milliseconds to a UTC date, whatever the session time zone is."""
    return F.date_add(F.lit(EPOCH), F.floor(millis / MILLIS_PER_DAY).cast("int"))


def parse_date(text: Column) -> Column:
    """ISO text ``yyyy-MM-dd`` to a date; any other text becomes NULL."""
    return F.when(F.length(text) == 10, text).try_cast("date")


def vintage_label(day: Column) -> Column:
    """Origination quarter such as ``2020 Q2``."""
    return F.concat(F.year(day).cast("string"), F.lit(" Q"), F.quarter(day).cast("string"))


def age_from_birth_year(birth_year: Column, reference_year: int) -> Column:
    """Age in a reference year; the birth year may be text."""
    return F.lit(reference_year) - birth_year.try_cast("int")


def age_from_dob(born: Column, on: dt.date) -> Column:
    """Age in years of 365 days at ``on``, rounded to two decimals."""
    days = F.datediff(F.lit(on), born)
    return F.round(days.cast("decimal(10,5)") / F.lit(365), 2)


def month_end(year: int, month: int) -> dt.date:
    """Last day of a calendar month (plain Python, for parameters)."""
    first_of_next = dt.date(year + month // 12, month % 12 + 1, 1)
    return first_of_next - dt.timedelta(days=1)


def month_ends(start: dt.date, end: dt.date) -> list[dt.date]:
    """Month ends of the months touched by ``[start, end]``, in order."""
    out, year, month = [], start.year, start.month
    while (year, month) <= (end.year, end.month):
        out.append(month_end(year, month))
        year, month = (year, month + 1) if month < 12 else (year + 1, 1)
    return out
