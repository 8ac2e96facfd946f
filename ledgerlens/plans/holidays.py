"""Payment-holiday outcomes: windows, arrears and balances by month, exits, monthly summary."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import values as V
from ..functions.aggregates import sum_if0, tally0
from ..functions.dates import month_ends
from ..functions.numeric import lookup
from ..operators.joins import at_own_date
from ..operators.reshape import month_pivot

Tables = Mapping[str, DataFrame]

EXIT_TYPES = (V.VT_DEFAULT, V.DEFAULT, V.VT, V.SETTLEMENT)
DEFAULT_TYPES = (V.DEFAULT, V.VT_DEFAULT, V.VT)
ARREARS_NUMBER = [((band,), number) for number, band in enumerate(V.ARREARS_BANDS, start=-1)]


def month_column(kind: str, day: dt.date) -> str:
    """``arr_2020_06``: no two months of any range share a name."""
    return f"{kind}_{day:%Y_%m}"


def ph_windows(forbearance: DataFrame) -> DataFrame:
    """First and last dates per agreement of holidays, reductions and extensions."""
    approved = F.col("status").isin(*V.APPROVED_STATUSES) & F.col("booking_status").isin(
        *V.BOOKED_STATUSES)

    def of(kinds: tuple[str, ...], column: str) -> Column:
        return F.when(approved & F.col("type").isin(*kinds), F.col(column))

    holiday, reduction, extension = V.HOLIDAY_TYPES, V.REDUCTION_TYPES, V.EXTENSION_TYPES
    dates = forbearance.groupBy("agreement_code").agg(
        F.min(of(holiday, "created_date")).alias("ph_created_date"),
        F.min(of(holiday, "start_date")).alias("ph_start_date"),
        F.max(of(holiday, "end_date")).alias("ph_end_date"),
        F.min(of(reduction, "created_date")).alias("rmp_created_date"),
        F.min(of(reduction, "start_date")).alias("rmp_start_date"),
        F.max(of(reduction, "end_date")).alias("rmp_end_date"),
        F.min(of(extension, "start_date")).alias("add_ph_start_date"),
        F.max(of(extension, "end_date")).alias("add_ph_end_date"),
    )
    return dates.withColumns({
        "first_fb_start_date": F.least(F.greatest("ph_start_date", "ph_created_date"),
                                       F.greatest("rmp_start_date", "rmp_created_date")),
        "first_fb_end_date": F.least("ph_end_date", "rmp_end_date"),
    })


def arrears_number(band: Column) -> Column:
    """-1 for up to date, then 0 to 5 payments down."""
    return lookup(band, ARREARS_NUMBER)


def _month_columns(start: dt.date, end: dt.date, kind: str) -> dict[str, dt.date]:
    return {month_column(kind, day): day for day in month_ends(start, end)}


def ph_arrears(windows: DataFrame, timeline: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Arrears when forbearance began, and at each month end from ``start`` to ``end``."""
    band = "payment_reduction_adjusted_arrears_status"
    status = timeline.select("agreement_code", "date", arrears_number(F.col(band)).alias("arr"))
    loans = windows.select("agreement_code", "first_fb_start_date")
    before = at_own_date(loans, status, "agreement_code", "first_fb_start_date").select(
        "agreement_code", F.col("arr").alias("pre_arr"))
    months = _month_columns(start, end, "arr")
    monthly = (
        status.filter(F.col("date").isin(*[F.lit(d) for d in months.values()]))
        .join(loans.select("agreement_code"), "agreement_code", "left_semi")
        .distinct()
    )
    after = month_pivot(monthly, "agreement_code", "arr", months)
    return before.join(after, "agreement_code", "left")


def ph_exits(windows: DataFrame, exits: DataFrame, timeline: DataFrame) -> DataFrame:
    """First exit per agreement and type, with the balance of the day before."""
    cases = (
        exits.filter(F.col("type").isin(*EXIT_TYPES))
        .join(windows.select("agreement_code"), "agreement_code", "left_semi")
        .groupBy("agreement_code", "type").agg(F.min("date").alias("sd_date"))
    )
    balances = timeline.select("agreement_code", "date", F.col("capital_balance").alias("sd_balance"))
    return at_own_date(cases, balances, "agreement_code", F.date_sub("sd_date", 1))


def ph_balances(windows: DataFrame, timeline: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Balance at each month end of agreements that ever asked for forbearance."""
    months = _month_columns(start, end, "bal")
    forborne = timeline.select("agreement_code", "date", "capital_balance").join(
        windows.select("agreement_code"), "agreement_code", "left_semi")
    return month_pivot(forborne, "agreement_code", "capital_balance", months)


def ph_loan_table(t: Tables, start: dt.date, end: dt.date) -> DataFrame:
    """One row per forborne agreement and exit type, everything side by side.

    What is wanted of the timeline (arrears when forbearance began, arrears and balance at month
    ends, the balance before each exit) are days per agreement. They are looked up together, in one
    join to the timeline, which holds one row per agreement and day.
    """
    windows = ph_windows(t["forbearance"])
    exits = (
        t["settlements_and_defaults"].filter(F.col("type").isin(*EXIT_TYPES))
        .groupBy("agreement_code", "type").agg(F.min("date").alias("sd_date"))
        .groupBy("agreement_code").agg(F.collect_list(F.struct("type", "sd_date")).alias("exits"))
    )
    loans = windows.join(exits, "agreement_code", "left")
    arrears, balances = _month_columns(start, end, "arr"), _month_columns(start, end, "bal")

    def day_before(exit_row: Column) -> Column:
        return F.date_sub(exit_row["sd_date"], 1)

    days = F.concat(
        F.array(*[F.lit(day) for day in arrears.values()], F.col("first_fb_start_date")),
        F.coalesce(F.transform("exits", day_before), F.array().cast("array<date>")))
    wanted = loans.select("agreement_code", F.explode(F.array_distinct(days)).alias("date"))
    found = (
        t["loan_timeline"].select(
            "agreement_code", "date", "capital_balance",
            arrears_number(F.col("payment_reduction_adjusted_arrears_status")).alias("arr"))
        .join(wanted.filter("date is not null"), ["agreement_code", "date"])
        .groupBy("agreement_code", "date").agg(
            F.max("arr").alias("arr"), F.max("capital_balance").alias("bal"))
        .groupBy("agreement_code").agg(F.map_from_entries(F.collect_list(
            F.struct("date", F.struct("arr", "bal")))).alias("at"))
    )
    at = F.col("at")
    return (
        loans.join(found, "agreement_code", "left")
        .select("*", F.explode_outer("exits").alias("exit"))
        .select("agreement_code", "first_fb_start_date", "first_fb_end_date", "rmp_start_date",
                "rmp_end_date", "add_ph_end_date", "add_ph_start_date",
                at[F.col("first_fb_start_date")]["arr"].alias("pre_arr"),
                *[at[F.lit(day)]["arr"].alias(name) for name, day in arrears.items()],
                "exit.type", "exit.sd_date", at[day_before(F.col("exit"))]["bal"].alias("sd_balance"),
                *[at[F.lit(day)]["bal"].alias(name) for name, day in balances.items()])
    )


def ph_monthly(loan_table: DataFrame, cutoff: dt.date) -> DataFrame:
    """Seven outcomes of forbearance at a month-end ``cutoff``: volumes and values."""
    on = F.lit(cutoff)
    balance, arrears = (F.col(month_column(kind, cutoff)) for kind in ("bal", "arr"))
    first_start, first_end = F.col("first_fb_start_date"), F.col("first_fb_end_date")
    reduced, extended = F.col("rmp_start_date"), F.col("add_ph_start_date")
    exit_day, exit_balance = F.col("sd_date"), F.col("sd_balance")

    started = first_start <= on
    still_open = (exit_day > on) | exit_day.isNull()
    in_first = started & (first_end > on) & still_open
    in_extension = (
        (first_end <= on)
        & (extended.isNotNull() | ((reduced != first_start) & reduced.isNotNull()))
        & ((extended <= on) | (reduced <= on))
        & ((F.col("add_ph_end_date") > on) | (F.col("rmp_end_date") > on))
        & still_open
    )
    last_end = F.greatest("first_fb_end_date", "add_ph_end_date", "rmp_end_date")
    finished = (last_end <= on) & still_open
    performing = finished & (F.col("pre_arr") >= arrears)
    worse = finished & (F.col("pre_arr") < arrears)
    left = exit_day <= on
    defaulted = F.col("type").isin(*DEFAULT_TYPES) & left
    settled = (F.col("type") == V.SETTLEMENT) & left
    outcomes = {
        "ph": (started, F.greatest(balance, exit_balance)),
        "first_ph": (in_first, balance),
        "ext_ph": (in_extension, balance),
        "perf": (performing, balance),
        "notperf": (worse, balance),
        "def": (defaulted, exit_balance),
        "set": (settled, exit_balance),
    }
    return loan_table.agg(*[
        column for name, (cond, value) in outcomes.items()
        for column in (tally0(cond).alias(f"vol_{name}"), sum_if0(cond, value).alias(f"val_{name}"))
    ])
