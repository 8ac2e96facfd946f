"""Forbearance book: position at a month end and its outcomes."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import values as V
from ..functions.aggregates import sum_if0, tally0
from ..functions.numeric import lookup, nullif_fallback
from ..operators.joins import at_own_date, left_join_many, on_date

Tables = Mapping[str, DataFrame]

# Arrears band -> payments down
PAYMENTS_DOWN = tuple(zip(V.ARREARS_BANDS, map(Decimal, ("0", "0.5", "1", "2", "3", "4", "5"))))


def _payments_down(band: Column) -> Column:
    return lookup(band, [((name,), number) for name, number in PAYMENTS_DOWN]).cast("decimal(3,1)")


def _ended(prefix: str = "") -> Column:
    return F.col(f"{prefix}is_vt") | F.col(f"{prefix}is_defaulted") | F.col(f"{prefix}is_settled")


def forbearance_position(t: Tables, day: dt.date) -> DataFrame:
    """Loans on the forbearance timeline at ``day``.

    Adds the first date a forborne loan ended with the amount it ended on, and the arrears
    now and when the first forbearance began. Several exits of a loan give several rows.
    """
    book = t["forbearance_timeline"]
    first_end = (
        book.filter(F.col("has_initial_forbearance") & _ended())
        .groupBy("agreement_code").agg(F.min("date").alias("def_date"))
    )
    exits = t["settlements_and_defaults"].select(
        F.col("agreement_code").alias("_ended_loan"), F.col("amount").alias("def_bal"))
    rows = (
        on_date(book, day).join(first_end, "agreement_code", "left")
        .withColumn("_ended_loan", F.when(F.col("def_date").isNotNull(), F.col("agreement_code")))
    )
    rows = left_join_many(rows, exits, "_ended_loan").drop("_ended_loan")
    at_start = t["loan_timeline"].select(
        "agreement_code", "date", F.col("date").alias("loan_timeline_join_date"),
        F.col("arrears_status").alias("start_arrears_status"),
        *[F.col(c).alias(f"start_{c}") for c in ("is_vt", "is_defaulted", "is_settled")])
    joined = at_own_date(rows, at_start, "agreement_code", "initial_forbearance_start_date")
    return joined.withColumns({
        "cur_arrs_num": F.when(~_ended(), _payments_down(F.col("arrears_status"))),
        "pre_ph_arrs_num": F.when(~_ended("start_"), _payments_down(F.col("start_arrears_status"))),
    }).drop("start_arrears_status", "start_is_vt", "start_is_defaulted", "start_is_settled")


def forbearance_summary(position: DataFrame) -> DataFrame:
    """Loans granted forbearance and where they stand: seven volumes and seven values."""
    vt, defaulted, settled = F.col("is_vt"), F.col("is_defaulted"), F.col("is_settled")
    inside, initial = F.col("in_forbearance"), F.col("in_initial_forbearance")
    granted = F.col("has_initial_forbearance")
    now, before = F.col("cur_arrs_num"), F.col("pre_ph_arrs_num")
    worse = ~inside & ~(settled | vt) & (now > before)
    extended = ~initial & inside & ~_ended()
    improved = ~inside & ~_ended() & (now <= before)
    left_by_vt = ~inside & vt & ~(defaulted | settled)
    left_by_settling = settled & ~(defaulted | vt)
    balance, ended_on = F.col("capital_balance"), F.col("def_bal")
    last_balance = nullif_fallback(balance, ended_on)
    return (
        position.filter(granted)
        .groupBy(F.last_day("date").alias("month_end"))
        .agg(
            F.count_distinct("agreement_code").alias("vol_fb_granted"),
            tally0(initial).alias("vol_in_initial_fb"),
            tally0(extended).alias("vol_in_ph_ext"),
            tally0(improved).alias("vol_exited_static_imp"),
            tally0(worse | (granted & defaulted)).alias("vol_exited_deteriorate"),
            tally0(granted & left_by_vt).alias("vol_exited_vt"),
            tally0(granted & left_by_settling).alias("vol_settled"),
            F.sum(last_balance).alias("val_fb_granted"),
            sum_if0(initial, balance).alias("val_in_initial_fb"),
            sum_if0(extended, balance).alias("val_in_ph_ext"),
            sum_if0(improved, balance).alias("val_exited_static_imp"),
            sum_if0(worse | defaulted, last_balance).alias("val_exited_deteriorate"),
            sum_if0(left_by_vt, ended_on).alias("val_exited_vt"),
            sum_if0(~inside & left_by_settling, ended_on).alias("val_settled"),
        )
        .orderBy("month_end")
    )
