"""Mergeable summaries of status histories.

A summary stands for a stretch of an agreement's history: its first and last snapshots, and what
changed inside it. Two summaries of neighbouring stretches make one: their sums add up, and the
change from the last snapshot of the earlier to the first of the later one is added. So a history is
sorted once, within stretches of bounded length, nothing is joined back to its rows, and a new month
is merged into what is known of all earlier ones.

Snapshots are one a day at most; where a day has several, they are taken in the order of their
values.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import values as V
from ..functions.aggregates import sum_if, tally
from ..functions.dates import parse_date
from ..operators.history import entered_state

TRANSITION_EPOCH = dt.date(2000, 1, 1)
#: Years of a stretch: at most so many times 366 snapshots of one agreement are sorted together.
STRETCH_YEARS = 5
#: Statuses of which the first snapshot counts.
VISITED = {"shortfall_visit": V.REPO_SHORTFALL, "vt_visit": V.VT_CRYSTALISED}
SUMS = ("dups_check", "crystalised_date", "crystalised_from", "crystalised_to", "crystalised_date2",
        "crystalised_from2", "crystalised_to2", "crystalised_from3")
NEWEST = ("dateat", "status", "arrears_value", "payment", "capital_outstanding", "contract_date_ms")


def _change_sums(kept: Column, now: Column, before: Column, balance: Column, arrears: Column,
                 day: Column) -> dict[str, tuple[Column, Column]]:
    """Condition and value of every sum over status changes."""
    number = F.datediff(day, F.lit(TRANSITION_EPOCH)).cast("bigint")
    crystalised = kept & now.isin(*V.CRYSTALISED) & ~before.isin(*V.CRYSTALISED)
    after_repo = kept & (now == V.REPO_SHORTFALL) & (before == V.REPO)
    written_off = kept & entered_state(V.WRITTEN_OFF, now, before)
    return {
        "dups_check": (crystalised, F.lit(1).cast("bigint")),
        "crystalised_date": (crystalised, number),
        "crystalised_from": (crystalised, balance),
        "crystalised_to": (crystalised, arrears),
        "crystalised_date2": (after_repo, number),
        "crystalised_from2": (after_repo, balance),
        "crystalised_to2": (after_repo, arrears),
        "crystalised_from3": (written_off, balance),
    }


def _insured(kept: Column, now: Column, any_before: Column, day: Column,
             since: dt.date | None) -> Column:
    entered = kept & entered_state(V.INSURANCE_SHORTFALL, now, any_before)
    if since is not None:
        entered = entered & (day >= F.lit(since))
    return entered


def _fields(*columns: str) -> list[Column]:
    """Columns for a struct that sorts with NULLs last."""
    return [x for c in columns for x in (F.col(c).isNull().alias(f"{c}_null"), F.col(c))]


def stretches(history: DataFrame, bad_dates: Iterable[dt.date] = (),
              insurance_since: dt.date | None = None) -> DataFrame:
    """One summary per agreement and ``STRETCH_YEARS`` years of its history.

    Bad snapshots count for ``insurance_dates`` as the status before, and for nothing else.
    """
    bad = [F.lit(day) for day in bad_dates]
    day = F.col("day")
    rows = history.select("agreement_code", parse_date(F.col("dateat")).alias("day"), "status",
                          "arrears_value", "capital_outstanding").withColumns({
        "stretch": F.floor(F.year("day") / STRETCH_YEARS),
        "kept": F.coalesce(~day.isin(*bad), F.lit(True)) if bad else F.lit(True)})
    ordered = ["day", "arrears_value", "capital_outstanding", "status"]
    inside = Window.partitionBy("agreement_code", "stretch").orderBy(
        *[F.col(c).asc_nulls_last() for c in ordered])
    row = F.struct("status", "capital_outstanding")
    if bad:
        known = F.last(F.when(F.col("kept"), row), ignorenulls=True).over(
            inside.rowsBetween(Window.unboundedPreceding, -1))
    else:
        known = F.lag(row).over(inside)
    rows = rows.withColumns({"any_before": F.lag("status").over(inside), "before": known,
                             "at": F.row_number().over(inside)})
    kept, now, before = F.col("kept"), F.col("status"), F.col("before")
    sums = _change_sums(kept, now, before["status"], before["capital_outstanding"],
                        F.col("arrears_value"), day)
    insured = _insured(kept, now, F.col("any_before"), day, insurance_since)
    snapshot = F.struct("at", "day", "status", "arrears_value", "capital_outstanding", "kept")
    kept_snapshot = F.when(kept, snapshot)
    out = rows.groupBy("agreement_code", "stretch").agg(
        F.min(snapshot).alias("first"), F.max(snapshot).alias("last"),
        F.min(kept_snapshot).alias("first_kept"), F.max(kept_snapshot).alias("last_kept"),
        *[sum_if(condition, value).alias(name) for name, (condition, value) in sums.items()],
        *[F.min(F.when(kept & (now == status), F.struct(
            "at", "day", "arrears_value", before.isNotNull().alias("has_previous")))).alias(name)
          for name, status in VISITED.items()],
        F.max(kept & before.isNotNull()).alias("has_previous"),
        F.collect_set(F.when(insured, day)).alias("insurance_dates"))
    return out.drop("stretch").withColumn("since", F.lit(insurance_since).cast("date"))


def merged(summaries: DataFrame) -> DataFrame:
    """One summary per agreement from those of its stretches, which must not overlap in time.

    Associative: any grouping of neighbouring stretches gives the same.
    """
    across = Window.partitionBy("agreement_code").orderBy(
        F.col("first.day").asc_nulls_last(), F.col("last.day").asc_nulls_last())
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    rows = summaries.withColumns({
        "last_before": F.lag("last").over(across),
        "kept_before": F.last("last_kept", ignorenulls=True).over(earlier)})
    first, entry, before = F.col("first"), F.col("first_kept"), F.col("kept_before")
    # the changes from one stretch to the next
    border = _change_sums(entry.isNotNull() & before.isNotNull(), entry["status"], before["status"],
                          before["capital_outstanding"], entry["arrears_value"], entry["day"])
    met = entry.isNotNull() & before.isNotNull()
    since = (F.col("since").isNull() | (first["day"] >= F.col("since")))
    insured = _insured(first["kept"], first["status"], F.col("last_before")["status"],
                       first["day"], None) & since

    def with_border(name: str) -> Column:
        condition, value = border[name]
        added = F.when(condition, value)
        return F.coalesce(F.col(name) + added, F.col(name), added)

    def visit(name: str) -> Column:
        seen = F.col(name)
        return F.when(seen.isNotNull(), F.struct(
            F.col("stretch_at"), seen["at"].alias("at"), seen["day"].alias("day"),
            seen["arrears_value"].alias("arrears_value"),
            (seen["has_previous"] | before.isNotNull()).alias("has_previous")))

    def placed(column: str) -> Column:
        return F.when(F.col(column).isNotNull(), F.struct(F.col("stretch_at"), F.col(column)))

    rows = rows.withColumn("stretch_at", F.row_number().over(across))
    out = rows.groupBy("agreement_code").agg(
        F.min(placed("first"))["first"].alias("first"), F.max(placed("last"))["last"].alias("last"),
        F.min(placed("first_kept"))["first_kept"].alias("first_kept"),
        F.max(placed("last_kept"))["last_kept"].alias("last_kept"),
        *[F.sum(with_border(name)).alias(name) for name in SUMS],
        *[F.min(visit(name)).alias(name) for name in VISITED],
        F.max(F.col("has_previous") | met).alias("has_previous"),
        # distinct days: no more than the calendar has
        F.array_distinct(F.flatten(F.collect_list(F.concat(
            "insurance_dates", F.when(insured, F.array(first["day"])).otherwise(
                F.array().cast("array<date>")))))).alias("insurance_dates"),
        F.max("since").alias("since"))
    # sums keep the type of one stretch, so that a state can be merged month after month
    kinds = {c: summaries.schema[c].dataType for c in SUMS}
    return out.select(*[F.col(c).dropFields("stretch_at").alias(c) if c in VISITED
                        else F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c)
                        for c in summaries.columns])


def changes_of(summary: DataFrame) -> DataFrame:
    """The status changes that a whole history's summary tells of (see ``stock.status_changes``)."""
    visits = [F.when(F.col(name)["has_previous"], F.col(name)) for name in VISITED]
    counted = [F.when(v.isNotNull(), F.lit(1)) for v in visits]

    def total(values: list[Column]) -> Column:
        a, b = values
        return F.coalesce(a + b, a, b)

    return summary.select(
        "agreement_code", *SUMS,
        total([v["arrears_value"] for v in visits]).alias("shortfall_balance"),
        total(counted).cast("bigint").alias("dups_check2"),
        F.coalesce("has_previous", F.lit(False)).alias("has_previous"), "insurance_dates")


def newest_two(history: DataFrame) -> DataFrame:
    """The newest two snapshots of every agreement, as ``newest`` and ``older``."""
    order = Window.partitionBy("agreement_code").orderBy(F.col("dateat").desc_nulls_last())
    ranked = (history.select("agreement_code", *NEWEST)
              .withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= 2))
    snapshot = F.struct(*NEWEST)
    return ranked.groupBy("agreement_code").agg(
        F.max(F.when(F.col("_rank") == 1, snapshot)).alias("newest"),
        F.max(F.when(F.col("_rank") == 2, snapshot)).alias("older"))
