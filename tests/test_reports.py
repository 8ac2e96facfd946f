"""Report rules on hand-made rows, and identities that hold on the test tables."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import values
from ledgerlens import registry
from ledgerlens.operators.history import lag_by_column
from ledgerlens.plans import (
    checks, forbearance, holidays, matching, provision, regulatory, segments, stock)
from ledgerlens.plans.calendar import report_calendar
from ledgerlens.plans.origination import introducer_channel, profile_groups
from ledgerlens.registry import reports as R
from ledgerlens.sources import tables as S
from ledgerlens.sources.driver_tables import DERIVED, RAW, DriverTables

D = dt.date
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return DriverTables(spark, SF)


def test_calendar_offsets_and_bad_snapshots():
    run = report_calendar(D(2020, 4, 17), bad_dates=[D(2020, 3, 2), D(2020, 4, 1)])
    assert (run.prev_month_start, run.prev_month_end) == (D(2020, 2, 1), D(2020, 2, 29))
    assert (run.rep_month_start, run.rep_month_end) == (D(2020, 3, 1), D(2020, 3, 31))
    assert (run.snapshot_start, run.snapshot_end) == (D(2020, 3, 3), D(2020, 4, 2))
    january = report_calendar(D(2021, 1, 31), offset=0)
    assert january.rep_month_end == D(2021, 1, 31) and january.prev_month_end == D(2020, 12, 31)


def test_calendar_as_a_frame(spark):
    run = report_calendar(D(2020, 4, 17))
    assert run.frame(spark).first()["rep_month_end"] == run.rep_month_end


@pytest.mark.parametrize("platform, category, channel", [
    ("POS", None, "3. Dealer"), ("POS", "Franchise Dealer", "3. Dealer"),
    ("POS", "Lead Generator", "4. Non-Internet Broker"), ("POS", "Online Broker", "1. Aggregator"),
    ("POS", "DTC", "2. DTC"), ("DTC", None, "2. DTC"), ("DTC", "Broker", "2. DTC"),
    (None, "DTC", "2. DTC"), (None, None, "5. Other"), ("POS", "strange", "5. Other")])
def test_channels(spark, platform, category, channel):
    apps = spark.createDataFrame([(1, platform, 5)], "application_id long, platform string, introducer_id long")
    dealers = spark.createDataFrame([(5, category)], "dealer_id long, introducer_category string")
    assert introducer_channel(apps, dealers).first()["introducer_channel"] == channel


def test_profile_has_every_breakdown(spark):
    assert len(profile_groups()) == 46


HISTORY = "agreement_code long, dateat string, status string, arrears_value decimal(14,2), " \
          "capital_outstanding decimal(14,2)"


def history(spark, *rows):
    return spark.createDataFrame(
        [(a, day, status, Decimal(arrears), Decimal(balance)) for a, day, status, arrears, balance in rows],
        HISTORY)


def test_bad_snapshot_counts_as_previous_for_insurance_but_not_for_balances(spark):
    rows = history(
        spark,
        (1, "2020-01-01", "AG_LIVE_PRIMARY", 1, 100),
        (1, "2020-02-01", "AG_INSURANCE SHORTFALL", 2, 90),   # bad snapshot
        (1, "2020-03-01", "AG_INSURANCE SHORTFALL", 3, 80),
        (1, "2020-04-01", "AG_REPO_CRYSTALISED", 4, 70),
    )
    bad = [D(2020, 2, 1)]
    # the entry itself is on the bad day; the next snapshot did not change
    assert values(stock.insurance_writeoffs(rows, D(2019, 1, 1), bad)) == []
    assert values(stock.insurance_writeoffs(rows, D(2019, 1, 1))) == [(1, D(2020, 2, 1))]
    assert values(stock.insurance_writeoffs(rows, D(2020, 2, 2))) == []
    changed = stock.crystallisation(rows, bad).first()
    assert changed["crystalised_from"] == 80 and changed["crystalised_to"] == 4
    assert changed["dups_check"] == 1 and changed["crystalised_date"] == (D(2020, 4, 1) - D(2000, 1, 1)).days


def test_first_in_state_needs_a_previous_snapshot(spark):
    rows = history(
        spark,
        (1, "2020-01-01", "AG_REPO_SHORTFALL", 10, 100),      # first of the loan: not counted
        (1, "2020-02-01", "AG_REPO", 20, 90),
        (1, "2020-03-01", "AG_REPO_SHORTFALL", 30, 80),       # second time in the status
        (2, "2020-01-01", "AG_REPO", 1, 50),
        (2, "2020-02-01", "AG_REPO_SHORTFALL", 2, 40),
        (3, "2020-02-01", "AG_REPO_SHORTFALL", 2, 40),        # no previous snapshot at all
    )
    got = {r["agreement_code"]: r for r in stock.crystallisation(rows).collect()}
    assert set(got) == {1, 2}
    assert got[1]["shortfall_balance"] is None and got[1]["crystalised_from2"] == 90
    assert got[2]["shortfall_balance"] == 2 and got[2]["dups_check2"] == 1


def test_repeated_transitions_are_reported(spark):
    rows = history(
        spark, (1, "2020-01-01", "AG_REPO", 1, 9), (1, "2020-02-01", "AG_VT_CRYSTALISED", 1, 8),
        (1, "2020-03-01", "AG_REPO", 1, 7), (1, "2020-04-01", "AG_REPO_CRYSTALISED", 1, 6))
    found = checks.repeated_transitions(stock.crystallisation(rows))
    assert values(found, "agreement_code", "dups_check") == [(1, 2)]


def test_snapshots_of_one_day_give_one_answer(spark):
    rows = [(1, "2020-01-01", "AG_REPO", 1, 9), (1, "2020-02-01", "AG_REPO_SHORTFALL", 7, 8),
            (1, "2020-02-01", "AG_REPO_SHORTFALL", 5, 6)]
    for order in (rows, rows[::-1]):
        got = stock.crystallisation(history(spark, *order)).first()
        assert got["shortfall_balance"] == 5 and got["crystalised_from2"] == 9


def test_life_events_in_one_pass_equal_the_single_ones(t):
    events = stock.life_events(t)
    for kind, single, day in ((stock.TERMINATION, stock.terminations(t), "termination_date"),
                              (stock.REPOSSESSION, stock.repossessions(t), "repo_date"),
                              (stock.SALE, stock.vehicle_sales(t), "vehicle_sale_date")):
        texts = ["actual_sale_date", "gross_sale_amount"] if kind == stock.SALE else []
        known = single.filter("agreement_code is not null").select("agreement_code", day, *texts)
        got = events.filter(F.col("kind") == kind).select("agreement_code", "day", *texts)
        assert values(known) and values(got) == values(known.toDF(*got.columns))


def test_reports_on_the_stored_position_read_nothing_else(t):
    stored = stock.stored_position(t, R.CALENDAR, R.INSURANCE_SINCE, R.BAD_SNAPSHOTS)
    fresh = stock.stock_position(t, R.CALENDAR, R.INSURANCE_SINCE, R.BAD_SNAPSHOTS)
    report = stock.roll_rates(stored, R.MONTH)
    assert values(report) == values(stock.roll_rates(fresh, R.MONTH))
    plan = report._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 1 and "PartitionFilters: [isnotnull(report_month" in plan


def test_checks_of_keys_and_date_texts(spark):
    df = spark.createDataFrame([(1, "2020-01-01"), (1, "1.2.2020"), (None, None), (2, "2020-02-30")],
                               "k int, d string")
    assert values(checks.key_counts({"a": (df, "k"), "b": (df, "d")})) == [("a", 4, 2, 1), ("b", 4, 3, 1)]
    assert values(checks.unread_dates(df, "d")) == [(4, 1, 2)]


def test_status_ladder_with_one_snapshot_has_no_previous(spark):
    rows = spark.createDataFrame(
        [(1, "2020-03-01", "AG_LIVE_PRIMARY", Decimal(250), Decimal(100), Decimal(9), 0),
         (1, "2020-04-01", "AG_LIVE_PRIMARY", Decimal(50), Decimal(100), Decimal(9), 0),
         (2, "2020-04-01", "AG_REPO", Decimal(50), Decimal(100), Decimal(9), 0),
         (3, "2020-05-01", "AG_REPO", Decimal(50), Decimal(100), Decimal(9), 0)],
        "agreement_code long, dateat string, status string, arrears_value decimal(14,2), "
        "payment decimal(14,2), capital_outstanding decimal(14,2), contract_date_ms long")
    got = stock.status_ladder(rows, (D(2020, 3, 1), D(2020, 4, 1)))
    assert values(got, "agreement_code", "current_arrears", "previous_arrears", "report_month") == [
        (1, Decimal("0.1"), Decimal(2), D(2020, 3, 31)), (2, Decimal(-1), Decimal(-1), D(2020, 3, 31))]


def test_roll_outcomes_partition_every_opening_state(t):
    matrix = R.roll_rate_matrix(t).fillna(0).collect()
    outcomes = [c for c in R.OUTCOMES_SQL if c != "vol"]
    assert matrix and all(r["vol"] == sum(r[c] for c in outcomes) for r in matrix)
    wide = R.roll_rate_wide(t).first().asDict()
    assert all(wide[f"{r['opening']}_vol"] == r["vol"] for r in matrix)


def test_total_row_equals_the_channels(t):
    funnel = R.application_funnel(t).fillna(0).collect()
    split = [r for r in funnel if r["introducer_channel"] != "TOTAL"]
    (total,) = [r for r in funnel if r["introducer_channel"] == "TOTAL"]
    assert total["app_vol"] == sum(r["app_vol"] for r in split)
    assert total["app_val"] == sum(r["app_val"] for r in split)


def test_moves_never_exceed_the_segment(t):
    for row in R.migration_by_region(t).collect():
        assert row["det_vol"] + row["hold_vol"] + row["imp_vol"] <= row["cust"]
        assert row["cv_exp"] is None or 0 <= row["cv_exp"] <= 1


def test_an_unrelated_loan_changes_no_other_segment(spark, t):
    portfolio = segments.exposure_portfolio(t, R.DAY, R.BASELINE, R.CONTRACTS_BEFORE, 2020)
    extra = portfolio.limit(1).withColumn("region", F.lit("NOWHERE")).withColumn(
        "agreement_code", F.lit(-1).cast("bigint"))
    before = values(segments.segment_migration(portfolio, "region"), "region", "cust", "det_bal")
    after = values(segments.segment_migration(portfolio.unionByName(extra), "region")
                   .filter("region <> 'NOWHERE' or region is null"), "region", "cust", "det_bal")
    assert before == after


def test_three_valued_holiday_flag(spark):
    rows = spark.createDataFrame([("n", None, 1), ("n", True, 2), ("n", False, 4)],
                                 "region string, had_covid_ph boolean, capital_balance int").withColumn(
        "arr_num", F.lit(1))
    assert values(segments.segment_band_balance(rows, "region")) == [("n", 1, 7, 4, 2)]


@pytest.mark.parametrize("age, group", [(15, "Unknown"), (16, "16-24"), (24, "16-24"), (25, "25-34"),
                                        (49, "35-49"), (50, "50+"), (None, "Unknown")])
def test_age_groups(spark, age, group):
    got = spark.createDataFrame([(age,)], "a int").select(segments.age_group(F.col("a"))).first()[0]
    assert got == group


FORBEARANCE = "agreement_code long, type string, status string, booking_status string, " \
              "created_date date, start_date date, end_date date"


def test_windows_ignore_missing_kinds(spark):
    a, b, c, d = (D(2020, m, 1) for m in (3, 4, 5, 6))
    rows = [(1, "Payment Holiday", "Agreed", "Completed", b, a, c),
            (2, "Payment Reduction", "Expired", "Reviewed", a, b, d),
            (3, "Payment Holiday", "Agreed", "Completed", a, b, d),
            (3, "Payment Reduction", "Agreed", "Completed", a, a, c),
            (4, "Payment Holiday", "Declined", "Completed", a, a, c)]
    got = holidays.ph_windows(spark.createDataFrame(rows, FORBEARANCE))
    assert values(got, "agreement_code", "first_fb_start_date", "first_fb_end_date") == [
        (1, b, c), (2, b, d), (3, a, c), (4, None, None)]


def test_month_columns_of_any_range_have_names_of_their_own():
    months = holidays._month_columns(D(2020, 1, 31), D(2021, 6, 30), "bal")
    assert len(months) == 18 and months["bal_2021_01"] == D(2021, 1, 31)


def test_missed_not_cured_equals_the_general_lag(spark, t):
    timeline = t["loan_timeline"]
    got = regulatory.missed_not_cured(timeline, R.MONTH).first()
    lagged = lag_by_column(
        timeline.select("agreement_code", "date", "capital_balance", "arrears", "arrears_yesterday",
                        "days_since_last_payment_date"),
        "arrears_yesterday", "days_since_last_payment_date", ["agreement_code"], ["date"],
        "earlier")
    missed = lagged.filter((F.col("date") == F.lit(R.MONTH)) & (F.col("arrears") > F.col("earlier"))
                           & (F.col("days_since_last_payment_date") <= 7))
    want = missed.agg(F.sum("capital_balance"), F.count_distinct("agreement_code")).first()
    assert tuple(got) == tuple(want) and got[1] > 0


def test_weekly_buckets_add_up(t):
    row = R.fca_weekly(t).first().asDict()
    bands = ("less_than_1m", "1m_3m", "3m_1y", "more_than_1y")
    assert row["impaired_loans"] == sum(row[f"impaired_loans_{b}"] or 0 for b in bands)
    assert list(row) == list(R.V.WEEKLY_METRICS) and len(row) == 32


def test_bridge_equals_the_single_movements(t):
    bridge = R.provision_bridge(t)
    cube = provision.movement_cube(t["provision_timeline"], R.MONTH)
    static = values(provision.static_rolls(cube))
    assert values(bridge.filter("movement = 'static'"), "state", "amount") == static
    released = provision.left_live(cube, provision.COVID).first()[0]
    assert bridge.filter("movement = 'live_to_covid'").first()["amount"] == released


PROVISION = "agreement_code long, date date, scenario string, state long, provision_held decimal(14,2), " \
            "previous_scenario string, previous_state long, previous_provision_held decimal(14,2)"


def test_deteriorated_contains_every_step(spark):
    on = D(2021, 3, 31)
    rows = [(1, on, "live", 2, Decimal(5), "live", 1, Decimal(3)),
            (2, on, "live", 4, Decimal(9), "live", 1, Decimal(3)),
            (3, on, "live", 0, Decimal(1), "live", 3, Decimal(3)),
            (4, on, "live", 1, Decimal(7), None, None, None)]
    cube = provision.movement_cube(spark.createDataFrame(rows, PROVISION), on)
    assert values(provision.deteriorated_rolls(cube)) == [(1, 2, Decimal(2)), (1, 4, Decimal(6))]
    assert values(provision.deteriorated_rolls(cube, skip_one_step=True)) == [(1, 4, Decimal(6))]
    assert values(provision.improved_rolls(cube, one_step=False)) == [(3, 0, Decimal(-2))]
    assert values(provision.improved_rolls(cube, one_step=True)) == []
    assert values(provision.new_business(spark.createDataFrame(rows, PROVISION), on)) == [(Decimal(7), 1)]


def test_forbearance_numbers_come_from_each_timeline(t):
    position = forbearance.forbearance_position(t, R.MONTH)
    ended = position.filter("is_vt or is_defaulted or is_settled")
    assert ended.filter("cur_arrs_num is not null").count() == 0
    assert position.filter("pre_ph_arrs_num is not null").count() > 0


def test_keeper_match_keeps_every_listed_row(spark, t):
    listed = t["vehicle_list"]
    matched = matching.keeper_match_by_vin(listed, t, R.MONTH)
    assert matched.count() == listed.count()
    assert matched.filter("VIN is null and agreement_code is not null").count() == 0
    assert matching.keeper_match_by_vin(listed, t, R.MONTH, dedupe=True).count() == \
        listed.select("VIN").distinct().count()


def test_row_order_does_not_matter(t):
    timeline = t["loan_timeline"]
    shuffled = timeline.repartition(7, F.rand(seed=4))
    assert values(regulatory.missed_not_cured(timeline, R.MONTH)) == values(
        regulatory.missed_not_cured(shuffled, R.MONTH))


def test_derived_tables_have_the_declared_schemas(spark, t):
    from pyspark.sql.types import _parse_datatype_string
    for name, ddl in S.SCHEMAS.items():
        declared = {f.name: f.dataType for f in _parse_datatype_string(ddl)}
        derived = {f.name: f.dataType for f in t[name].schema}
        assert declared == derived, name
    assert set(t) == set(RAW) | set(DERIVED)


def test_stored_tables_give_the_same_report(spark, t, tmp_path):
    for name in ("applications", "dealer_dim", "funnel_summary", "loan_agreements", "opportunity"):
        t[name].write.parquet(f"{tmp_path}/{name}")
    stored = S.ParquetTables(spark, str(tmp_path))
    assert values(R.application_funnel(stored)) == values(R.application_funnel(t))
    with pytest.raises(KeyError):
        stored["nothing"]


def test_scratch_tables_live_in_the_shared_folder(spark):
    df = S.materialize(spark.range(5).toDF("n"), "five")
    assert values(df) == [(n,) for n in range(5)]
    assert spark.conf.get("spark.checkpoint.dir") in df.inputFiles()[0]
    S.save_table(df, "five_saved")
    catalog = S.CatalogTables(spark, "default")
    assert len(catalog) == len(S.SCHEMAS)
    assert spark.table("five_saved").count() == 5
    S.drop_table(spark, "five_saved")
    S.drop_table(spark, "five_saved")
    assert not spark.catalog.tableExists("five_saved")


def test_every_query_has_sql_and_one_name():
    queries = registry.load()
    assert len(queries) > 140 and all(q.sql for q in queries.values())
