"""Warehouse semantics of the scalar helpers, on hand-made rows."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import dates, numeric, text
from ledgerlens.functions.aggregates import placeholder, sum_if, sum_if0, tally, tally0
from ledgerlens.plans.forbearance import _payments_down
from ledgerlens.plans.origination import car_age, ltv_buckets
from ledgerlens.plans.stock import arrears_ladder, sale_amount, sale_date

D = dt.date


def one(spark, schema, row, column):
    return spark.createDataFrame([row], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("start, end, months", [
    (D(2020, 1, 31), D(2020, 2, 1), 1),
    (D(2020, 1, 1), D(2020, 1, 31), 0),
    (D(2020, 3, 1), D(2019, 12, 31), -3),
    (None, D(2020, 1, 1), None),
])
def test_months_are_counted_by_calendar_boundary(spark, start, end, months):
    got = one(spark, "a date, b date", (start, end), dates.months_diff(F.col("a"), F.col("b")))
    assert got == months


@pytest.mark.parametrize("a, b, quotient", [(7, 2, 3), (-7, 2, -3), (365, 12, 30), (1, 0, None)])
def test_integer_division_truncates(spark, a, b, quotient):
    assert one(spark, "a int, b int", (a, b), numeric.int_div(F.col("a"), F.col("b"))) == quotient


def test_whole_years_truncate_toward_zero(spark):
    years = dates.whole_years(F.col("a"), F.col("b"))
    assert one(spark, "a date, b date", (D(2019, 1, 1), D(2020, 12, 30)), years) == 1
    assert one(spark, "a date, b date", (D(2020, 1, 1), D(2019, 6, 1)), years) == 0


def test_car_age_marks_new_cars(spark):
    age = car_age(F.col("a"), F.col("b"))
    assert one(spark, "a date, b date", (D(2020, 5, 1), D(2020, 5, 30)), age) == -1
    assert one(spark, "a date, b date", (D(2020, 4, 30), D(2020, 5, 1)), age) == 0
    assert one(spark, "a date, b date", (None, D(2020, 5, 1)), age) is None


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_epoch_dates_do_not_depend_on_the_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        day = dates.epoch_ms_to_date(F.col("ms"))
        assert one(spark, "ms bigint", (788918400000,), day) == D(1995, 1, 1)
        assert one(spark, "ms bigint", (788918399999,), day) == D(1994, 12, 31)
        assert one(spark, "ms bigint", (-1,), day) == D(1969, 12, 31)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("raw, day", [
    ("2020-02-29", D(2020, 2, 29)), ("2021-02-29", None), ("2020", None), ("nonsense!!", None),
    (None, None)])
def test_bad_dates_become_null(spark, raw, day):
    assert one(spark, "t string", (raw,), dates.parse_date(F.col("t"))) == day


def test_labels_and_ages(spark):
    assert one(spark, "a date", (D(2020, 6, 30),), dates.vintage_label(F.col("a"))) == "2020 Q2"
    assert one(spark, "y string", ("1990",), dates.age_from_birth_year(F.col("y"), 2020)) == 30
    assert one(spark, "y string", ("?",), dates.age_from_birth_year(F.col("y"), 2020)) is None
    born = dates.age_from_dob(F.col("a"), D(2020, 1, 1))
    assert one(spark, "a date", (D(2019, 1, 1),), born) == Decimal("1.00")


@pytest.mark.parametrize("arrears, payment, status, code", [
    ("0", "100", "AG_LIVE_PRIMARY", "0"),
    ("50", "100", "AG_LIVE_PRIMARY", "0.1"),
    ("100", "100", "AG_LIVE_PRIMARY", "1"),
    ("599", "100", "AG_LIVE_PRIMARY", "5"),
    ("600", "100", "AG_LIVE_PRIMARY", "6"),
    ("900", "100", "AG_LIVE_PRIMARY", "6"),
    ("-5", "100", "AG_LIVE_PRIMARY", "0"),
    ("50", "0", "AG_LIVE_PRIMARY", "0"),
    ("50", None, "AG_LIVE_PRIMARY", "0"),
    ("50", "100", "AG_REPO", "-1"),
    (None, "100", None, "-1"),
])
def test_arrears_ladder(spark, arrears, payment, status, code):
    number = [None if v is None else Decimal(v) for v in (arrears, payment)]
    ladder = arrears_ladder(F.col("a"), F.col("p"), F.col("s"))
    got = one(spark, "a decimal(14,2), p decimal(14,2), s string", (*number, status), ladder)
    assert got == Decimal(code)


@pytest.mark.parametrize("ratio, label", [
    ("69", "1. 0.7"), ("70", "2. 0.7-0.79"), ("100", "5. 1-1.09"), ("108", "5. 1-1.09"),
    ("109", None), ("109.5", None), ("110", "6. 1.1"), (None, "7. Unknown")])
def test_ltv_labels_keep_their_gap(spark, ratio, label):
    rows = spark.createDataFrame(
        [(None if ratio is None else Decimal(ratio), Decimal(100))],
        "total_finance_amount decimal(14,2), current_retail_value decimal(14,2)")
    assert ltv_buckets(rows).first()["ltv_bucket"] == label


@pytest.mark.parametrize("note, amount", [
    ("sold for £1234.56 today", Decimal("1234.00")),
    ("£99.00 at the start", None),
    ("no sign 12.50", None),
    ("v. good, £12 received", None),
    ("got £12a.3", None),
    (None, None),
])
def test_sale_amount(spark, note, amount):
    assert one(spark, "t string", (note,), sale_amount(F.col("t"))) == amount


@pytest.mark.parametrize("note, day", [
    ("The vehicle have been sold on 2020-03-04 and paid", D(2020, 3, 4)),
    ("The vehicle have been sold on 2020-13-04 and paid", None),
    ("Was sold on 2020-03-04 and paid", None),
    ("The vehicle have been sold, no detail", None),
])
def test_sale_date_needs_a_late_guard(spark, note, day):
    assert one(spark, "t string", (note,), sale_date(F.col("t"))) == day


def test_sentinels_and_ratios(spark):
    clean = numeric.clean_numeric(F.col("t"), ("{ND}", "{OB}"))
    for raw, number in (("{ND}", None), ("12.345", Decimal("12.35")), ("x", None), (None, None)):
        assert one(spark, "t string", (raw,), clean) == number
    safe = numeric.safe_ratio(F.col("a"), F.col("b"))
    assert one(spark, "a double, b double", (1.0, 0.0), safe) is None
    assert one(spark, "a double, b double", (1.0, -2.0), safe) is None
    assert one(spark, "a double, b double", (1.0, 2.0), safe) == 0.5
    plain = numeric.ratio(F.col("a"), F.col("b"))
    assert one(spark, "a double, b double", (1.0, 0.0), plain) is None
    fallback = numeric.nullif_fallback(F.col("a"), F.lit(9))
    assert [one(spark, "a int", (v,), fallback) for v in (0, None, 4)] == [9, 9, 4]


def test_lookup_keeps_three_valued_logic(spark):
    column = numeric.lookup(F.col("t"), [(("a", "b"), 1)], 0)
    assert [one(spark, "t string", (v,), column) for v in ("b", "c", None)] == [1, 0, 0]
    assert one(spark, "t string", ("0-Down",), _payments_down(F.col("t"))) == Decimal("0.5")
    assert one(spark, "t string", ("other",), _payments_down(F.col("t"))) is None


def test_sums_without_a_match(spark):
    rows = spark.createDataFrame([(1, 5)], "k int, v int")
    hit, value = F.col("k") == 2, F.col("v")
    got = rows.agg(sum_if(hit, value), sum_if0(hit, value), tally(hit), tally0(hit)).first()
    assert tuple(got) == (None, 0, None, 0)
    empty = rows.filter("k > 9").agg(sum_if(hit, value), sum_if0(hit, value), tally0(hit)).first()
    assert tuple(empty) == (None, None, None)
    assert rows.select(placeholder()).first()[0] is None


def test_text_between_other_marks(spark):
    got = text.amount_between(F.col("t"), "<", ">")
    assert one(spark, "t string", ("a<7>",), got) == Decimal("7.00")
    assert dates.month_ends(D(2019, 11, 30), D(2020, 2, 1)) == [
        D(2019, 11, 30), D(2019, 12, 31), D(2020, 1, 31), D(2020, 2, 29)]
