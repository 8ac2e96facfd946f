"""Weekly regulatory report."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import values as V
from ..functions.aggregates import sum_if
from ..operators.history import top_per_key
from ..operators.joins import on_date
from ..operators.newest import advanced_newest, newest_rows
from ..operators.reshape import side_by_side

Tables = Mapping[str, DataFrame]

# Days in arrears: a month and a quarter are 365/12 and 365/4 in whole days
MONTH_DAYS, QUARTER_DAYS, YEAR_DAYS = 365 // 12, 365 // 4, 365
WEEK = 7


def facility_rows(t: Tables, report_date: dt.date, committed: Sequence[str],
                  lookback_days: int = WEEK) -> DataFrame:
    """Live loans of committed facilities at the date, flagged if newly in a payment holiday."""
    since = report_date - dt.timedelta(days=lookback_days)
    entering = (
        t["forbearance"].filter(
            F.col("status").isin(*V.APPROVED_STATUSES)
            & F.col("booking_status").isin(*V.BOOKED_STATUSES)
            # "_" stands for any one character, so a space matches too
            & F.col("type").like("%Payment_Holiday%")
            & F.col("created_date").between(F.lit(since), F.lit(report_date)))
        .select("agreement_code", F.lit(True).alias("newly_in_holiday")).distinct()
    )
    funding = on_date(t["funding_entity"], report_date).filter(
        F.col("current_funding_entity").isin(*committed)).select("agreement_code")
    live = on_date(t["loan_timeline"], report_date).filter("is_live").select(
        "agreement_code", "capital_balance", "payment_holiday",
        F.col("holiday_adjusted_days_in_arrears").alias("days"))
    return live.join(funding, "agreement_code").join(entering, "agreement_code", "left")


def _arrears_bands() -> dict[str, Column]:
    days = F.col("days")
    return {
        "less_than_1m": (days > 0) & (days <= MONTH_DAYS),
        "1m_3m": (days > MONTH_DAYS) & (days <= QUARTER_DAYS),
        "3m_1y": (days > QUARTER_DAYS) & (days <= YEAR_DAYS),
        "more_than_1y": days > YEAR_DAYS,
    }


def facility_totals(rows: DataFrame) -> DataFrame:
    """Balances and loan counts of the facilities by impairment, one row.

    Most counts are of distinct agreements and come from one row per agreement, so no
    distinct aggregate is needed. Two "numbers" count distinct balances and three count
    rows, as reported.
    """
    impaired, unimpaired = F.col("days") > 0, F.col("days") == 0
    holiday, entering = F.col("payment_holiday"), F.col("newly_in_holiday")
    bands = _arrears_bands()
    balance = F.col("capital_balance")

    values = {
        "total_drawn_from_committed_facilities": F.lit(True),
        "impaired_loans": impaired,
        **{f"impaired_loans_{b}": cond for b, cond in bands.items()},
        "total_unimpaired_loans_ph": unimpaired & holiday,
        "impaired_loans_ph": impaired & holiday,
        **{f"impaired_loans_{b}_ph": cond & holiday for b, cond in bands.items()},
        "sum_unimpaired_cb_newly_entering_ph": unimpaired & entering,
        "sum_impaired_cb_newly_entering_ph": impaired & entering,
    }
    agreements = {
        "number_of_loans_committed_facility": F.lit(True),
        # the name says a day, the band is the first month
        "number_impaired_loans_less_than_1d": bands["less_than_1m"],
        "number_impaired_loans_1m_3m": bands["1m_3m"],
        "number_impaired_loans_3m_1y": bands["3m_1y"],
        "number_total_unimpaired_loans_ph": unimpaired & holiday,
        "number_impaired_loans_less_than_1m_ph": bands["less_than_1m"] & holiday,
        "number_impaired_loans_1m_3m_ph": bands["1m_3m"] & holiday,
        "number_unimpaired_newly_entering_ph": unimpaired & entering,
        "number_impaired_newly_entering_ph": impaired & entering,
    }
    row_counts = {
        "number_impaired_loans_ph": (impaired & holiday, balance),
        "number_impaired_loans_3m_1y_ph": (bands["3m_1y"] & holiday, F.col("agreement_code")),
        "number_impaired_loans_more_than_1y_ph": (bands["more_than_1y"] & holiday, balance),
    }
    per_agreement = rows.groupBy("agreement_code").agg(
        *[sum_if(cond, balance).alias(name) for name, cond in values.items()],
        *[F.max(F.when(cond, F.lit(1)).otherwise(F.lit(0))).alias(name)
          for name, cond in agreements.items()],
        *[F.count(F.when(cond, counted)).alias(name)
          for name, (cond, counted) in row_counts.items()],
    )
    summed = per_agreement.agg(
        *[F.sum(name).alias(name) for name in values],
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in (*agreements, *row_counts)],
    )
    over_year = F.max(F.when(bands["more_than_1y"], F.lit(1)).otherwise(F.lit(0)))
    distinct_balances = (
        rows.filter(impaired & balance.isNotNull())
        .groupBy("capital_balance").agg(over_year.alias("over_year"))
        .agg(F.count(F.lit(1)).alias("number_impaired_loans"),
             F.coalesce(F.sum("over_year"), F.lit(0)).alias("number_impaired_loans_more_than_1y"))
    )
    return side_by_side(summed, distinct_balances)


def missed_not_cured(timeline: DataFrame, report_date: dt.date, days: int = WEEK) -> DataFrame:
    """Loans that missed a payment due in the last days and have not caught up, one row.

    A loan's arrears are compared with the arrears held as many rows earlier as days have
    passed since its payment date. That offset is at most ``days`` here, so the newest
    ``days + 1`` rows per agreement decide. Only loans with a row on the report date and a recent
    payment date are ranked: their keys come from one day of the timeline.
    """
    candidates = timeline.filter(
        (F.col("date") == F.lit(report_date)) & (F.col("days_since_last_payment_date") <= days)
    ).select("agreement_code").distinct()
    seen = timeline.filter(F.col("date") <= F.lit(report_date)).join(
        candidates, "agreement_code", "left_semi")
    recent = top_per_key(
        seen.select("agreement_code", "date", "capital_balance", "arrears", "arrears_yesterday",
                    "days_since_last_payment_date"),
        ["agreement_code"], [F.col("date").desc()], k=days + 1, rank="back")
    newest = F.col("back") == 1

    def current(column: str) -> Column:
        return F.max(F.when(newest, F.col(column))).alias(column)

    earlier = F.array(*[F.max(F.when(F.col("back") == n + 1, F.col("arrears_yesterday")))
                        for n in range(days + 1)])
    loans = recent.groupBy("agreement_code").agg(
        *[current(c) for c in ("date", "capital_balance", "arrears",
                               "days_since_last_payment_date")],
        earlier.alias("earlier"))
    since = F.col("days_since_last_payment_date")
    before = F.get("earlier", since.cast("int"))
    missed = (F.col("date") == F.lit(report_date)) & (since <= days) & (F.col("arrears") > before)
    return loans.filter(missed).agg(
        F.sum("capital_balance").alias("value_of_loans_missing"),
        F.count("agreement_code").alias("number_of_loans_missing"))


MISSED_COLUMNS = ("capital_balance", "arrears", "arrears_yesterday", "days_since_last_payment_date")


def arrears_state(timeline: DataFrame, until: dt.date, days: int = WEEK) -> DataFrame:
    """Newest rows of every loan up to a date, as many as ``missed_not_cured`` looks at."""
    return newest_rows(timeline.filter(F.col("date") <= F.lit(until)), "agreement_code", "date",
                       MISSED_COLUMNS, days + 1)


def advanced_arrears_state(state: DataFrame, timeline: DataFrame, until: dt.date,
                           days: int = WEEK) -> DataFrame:
    """The state of a later date from the last one and the days of the timeline since."""
    return advanced_newest(state, timeline, "agreement_code", "date", MISSED_COLUMNS, days + 1, until)


def missed_from_state(state: DataFrame, report_date: dt.date, days: int = WEEK) -> DataFrame:
    """``missed_not_cured`` from the arrears state of the report date, without the timeline."""
    now = F.element_at("newest", 1)
    since = now["days_since_last_payment_date"]
    earlier = F.get(F.transform("newest", lambda row: row["arrears_yesterday"]), since.cast("int"))
    missed = (now["date"] == F.lit(report_date)) & (since <= days) & (now["arrears"] > earlier)
    return state.filter(missed).agg(
        F.sum(now["capital_balance"]).alias("value_of_loans_missing"),
        F.count("agreement_code").alias("number_of_loans_missing"))


def declined_applications(applications: DataFrame, report_date: dt.date,
                          lookback_days: int = WEEK) -> DataFrame:
    """Applications declined after the start of the window, up to the date; one row."""
    since = report_date - dt.timedelta(days=lookback_days)
    amount = F.when(F.col("stage_name") == "Closed - Declined", F.col("total_finance_amount"))
    return (
        applications
        .filter((F.col("closed_date") > F.lit(since)) & (F.col("closed_date") <= F.lit(report_date)))
        .agg(F.sum(amount).alias("sum_finance_declined"), F.count(amount).alias("number_declined"))
    )


def fca_weekly(t: Tables, report_date: dt.date, committed: Sequence[str],
               lookback_days: int = WEEK, state: DataFrame | None = None) -> DataFrame:
    """The 32 metrics of the weekly report, side by side in report order.

    With the arrears ``state`` of the report date, the timeline is read for that date only.
    """
    facility = facility_totals(facility_rows(t, report_date, committed, lookback_days))
    missed = (missed_not_cured(t["loan_timeline"], report_date) if state is None
              else missed_from_state(state, report_date))
    declined = declined_applications(t["applications"], report_date, lookback_days)
    return side_by_side(facility, missed, declined).select(*V.WEEKLY_METRICS)
