"""Reporting calendar."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.dates import month_end

ONE_DAY = dt.timedelta(days=1)


@dataclass(frozen=True)
class ReportCalendar:
    """Dates of one monthly report run.

    Plain Python dates: they reach Spark as literals, so date filters prune files.
    """

    prev_month_start: dt.date
    prev_month_end: dt.date
    rep_month_start: dt.date
    rep_month_end: dt.date
    snapshot_start: dt.date
    snapshot_end: dt.date
    as_of: dt.date

    def frame(self, spark: SparkSession) -> DataFrame:
        """The calendar as a one-row DataFrame."""
        days = asdict(self)
        return spark.createDataFrame([tuple(days.values())], ", ".join(f"{c} date" for c in days))


def _end_of_month_back(day: dt.date, months: int) -> dt.date:
    index = day.year * 12 + day.month - 1 - months
    return month_end(index // 12, index % 12 + 1)


def report_calendar(as_of: dt.date, offset: int = 1,
                    bad_dates: Iterable[dt.date] = ()) -> ReportCalendar:
    """Months and snapshot dates of the report run at ``as_of``, ``offset`` months back.

    Snapshots are taken the day after the month boundary dates; one that is known to be
    bad is replaced by the next day's.
    """
    bad = set(bad_dates)

    def snapshot_after(day: dt.date) -> dt.date:
        following = day + ONE_DAY
        return following + ONE_DAY if following in bad else following

    before_previous = _end_of_month_back(as_of, 2 + offset)
    previous = _end_of_month_back(as_of, 1 + offset)
    reported = _end_of_month_back(as_of, offset)
    return ReportCalendar(
        prev_month_start=before_previous + ONE_DAY,
        prev_month_end=previous,
        rep_month_start=previous + ONE_DAY,
        rep_month_end=reported,
        snapshot_start=snapshot_after(previous + ONE_DAY),
        snapshot_end=snapshot_after(reported),
        as_of=as_of,
    )
