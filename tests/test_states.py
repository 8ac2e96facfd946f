"""Summaries of histories that are merged, the monthly pack, and scratch tables."""

from __future__ import annotations

import datetime as dt
import os
from decimal import Decimal
from functools import reduce

import pytest
from conftest import values
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens import values as V
from ledgerlens.plans import holidays, stock
from ledgerlens.plans.summaries import changes_of, merged, stretches
from ledgerlens.registry import reports as R
from ledgerlens.sources import tables as T
from ledgerlens.sources.driver_tables import DriverTables

STATUSES = [V.LIVE, V.REPO, V.REPO_SHORTFALL, V.VT_CRYSTALISED, "AG_REPO_CRYSTALISED",
            V.INSURANCE_SHORTFALL, V.WRITTEN_OFF, "AG_CLOSED"]
SCHEMA = ("agreement_code bigint, dateat string, status string, arrears_value decimal(14,2), "
          "capital_outstanding decimal(14,2), payment decimal(14,2), contract_date_ms bigint")
START = dt.date(2003, 11, 1)
BAD = [START + dt.timedelta(days=31 * 4)]


@pytest.fixture(scope="module")
def t(spark):
    return DriverTables(spark, "/root/testdata/sf0.001")


def plain_changes(rows, bad, since):
    """The same from the rows of one agreement, in order."""
    kept = [r for r in rows if r[1] not in {d.isoformat() for d in bad}]
    sums, visits, seen = {}, {}, set()

    def add(name, value):
        if value is not None:
            sums[name] = sums.get(name, 0) + value

    for before, now in zip([None, *kept], kept):
        status, was = now[2], before and before[2]
        if before and status in V.CRYSTALISED and was not in V.CRYSTALISED:
            add("dups_check", 1)
            add("crystalised_date", (dt.date.fromisoformat(now[1]) - dt.date(2000, 1, 1)).days)
            add("crystalised_from", before[4])
            add("crystalised_to", now[3])
        if before and status == V.REPO_SHORTFALL and was == V.REPO:
            add("crystalised_date2", (dt.date.fromisoformat(now[1]) - dt.date(2000, 1, 1)).days)
            add("crystalised_from2", before[4])
            add("crystalised_to2", now[3])
        if before and status == V.WRITTEN_OFF != was:
            add("crystalised_from3", before[4])
        if status not in seen and status in (V.REPO_SHORTFALL, V.VT_CRYSTALISED) and before:
            add("shortfall_balance", now[3])
            add("dups_check2", 1)
        seen.add(status)
    for before, now in zip(rows, rows[1:]):
        if (now in kept and now[2] == V.INSURANCE_SHORTFALL != before[2]
                and dt.date.fromisoformat(now[1]) >= since):
            visits[now[1]] = True
    return sums, len(kept) > 1, sorted(visits)


NAMES = ("dups_check", "crystalised_date", "crystalised_from", "crystalised_to", "crystalised_date2",
         "crystalised_from2", "crystalised_to2", "crystalised_from3", "shortfall_balance", "dups_check2")


def as_plain(df):
    out = {}
    for r in df.collect():
        sums = {c: int(r[c]) for c in NAMES if r[c] is not None}
        out[r.agreement_code] = (sums, r.has_previous, sorted(d.isoformat() for d in r.insurance_dates))
    return out


def months(raw):
    """Rows from (agreement, month, status) with values that tell them apart."""
    return [(k, (START + dt.timedelta(days=31 * m)).isoformat(), STATUSES[s], Decimal(10 * m + s),
             Decimal(1000 - m), Decimal(5), m)
            for k, m, s in sorted(raw)]


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.tuples(st.integers(1, 4), st.integers(0, 30)), st.integers(0, 7), min_size=1,
                       max_size=70),
       st.sets(st.integers(1, 30), max_size=4))
def test_summaries_of_any_cut_merge_to_the_whole(spark, raw, cuts):
    rows = months([(*k, s) for k, s in raw.items()])
    since = START + dt.timedelta(days=200)
    expected = {k: plain_changes([r for r in rows if r[0] == k], BAD, since) for k in {r[0] for r in rows}}
    whole = spark.createDataFrame(rows, SCHEMA)
    edges = [(START + dt.timedelta(days=31 * m - 1)).isoformat() for m in (0, *sorted(cuts), 99)]
    parts = [merged(stretches(whole.filter(F.col("dateat").between(a, b)), BAD, since))
             for a, b in zip(edges, edges[1:])]
    assert as_plain(stock.status_changes(whole, BAD, since)) == expected
    # neighbours first, then the rest: the grouping makes no difference
    pairs = [merged(parts[k].unionByName(parts[k + 1])) if k + 1 < len(parts) else parts[k]
             for k in range(0, len(parts), 2)]
    assert as_plain(changes_of(merged(reduce(lambda a, b: a.unionByName(b), pairs)))) == expected


def test_twelve_months_from_states_equal_full_runs(spark, t):
    """Each month's position comes from the state before and one snapshot."""
    history = t["status_history"].filter(F.col("agreement_code") % 12 == 0).coalesce(1)
    history = T.materialize(history, "history", ("dateat",)).withColumn("dateat", F.col("dateat").cast("string"))
    days = [d for (d,) in history.select("dateat").distinct().orderBy("dateat").collect()][20:33]
    state = T.materialize(stock.position_state(history.filter(F.col("dateat") <= days[0]), R.BAD_SNAPSHOTS,
                                               R.INSURANCE_SINCE), "state")
    for day in days[1:]:
        snapshot = history.filter(F.col("dateat") == day)
        state = T.materialize(stock.advanced_state(state, snapshot, R.BAD_SNAPSHOTS, R.INSURANCE_SINCE), "state")
    known = history.filter(F.col("dateat") <= days[-1])
    full = stock.position_state(known, R.BAD_SNAPSHOTS, R.INSURANCE_SINCE)
    columns = ["agreement_code", *NAMES]
    for a, b in ((changes_of(state), changes_of(full)),):
        assert values(a, *columns) == values(b, *columns)
        assert values(a.select("agreement_code", F.explode("insurance_dates"))) == values(
            b.select("agreement_code", F.explode("insurance_dates")))
    pair = tuple(dt.date.fromisoformat(d) for d in days[-2:])
    assert values(stock.ladder_of_state(state, pair)) == values(stock.status_ladder(known, pair))
    assert values(stock.ladder_of_state(full, pair)) == values(stock.status_ladder(known, pair))
    # one date of the history is read
    plan = stock.advanced_state(state, snapshot)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "PartitionFilters" in line
             and "dateat" in line.split("PartitionFilters")[1].split("]")[0]]
    assert scans and all(days[-1] in line for line in scans)


def test_pack_equals_the_six_reports(spark, t):
    sp = R.stock_rows(t)
    loans, timeline = t["loan_agreements"], t["loan_timeline"]
    pack = stock.monthly_pack(sp, loans, timeline, R.MONTH)
    single = {
        "portfolio_volumes": stock.portfolio_volumes(sp, R.MONTH), "roll_rates": stock.roll_rates(sp, R.MONTH),
        "sales_performance": stock.sales_performance(sp, R.MONTH),
        "months_on_book": stock.months_on_book(sp, timeline, R.MONTH),
        "portfolio_values": stock.portfolio_values(sp, loans, R.MONTH),
        "cohort_performance": stock.cohort_performance(sp, loans, R.MONTH)}
    assert set(pack) == set(single)
    for name, df in single.items():
        assert pack[name].columns == df.columns
        assert values(pack[name]) == values(df), name
    assert R.stock_rows(DriverTables(spark, t.folder)) is sp


def test_holiday_table_equals_its_parts(spark, t):
    """One look-up against separate joins for arrears, exits and balances."""
    start, end = R.HOLIDAY_MONTHS
    windows, timeline = holidays.ph_windows(t["forbearance"]), t["loan_timeline"]
    got = holidays.ph_loan_table(t, start, end)
    parts = (
        windows.select("agreement_code", "first_fb_start_date", "first_fb_end_date", "rmp_start_date",
                       "rmp_end_date", "add_ph_end_date", "add_ph_start_date")
        .join(holidays.ph_arrears(windows, timeline, start, end), "agreement_code", "left")
        .join(holidays.ph_exits(windows, t["settlements_and_defaults"], timeline), "agreement_code", "left")
        .join(holidays.ph_balances(windows, timeline, start, end), "agreement_code", "left"))
    assert sorted(got.columns) == sorted(parts.columns)
    assert values(got, *sorted(got.columns)) == values(parts, *sorted(got.columns))


def test_scratch_tables_go_with_their_run(spark):
    root = T.scratch_root(spark)
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    tables = spark.catalog.listTables()
    with pytest.raises(ZeroDivisionError):
        with T.scratch_run(spark):
            T.materialize(spark.range(5).toDF("k"), "plain")
            kept = T.materialize_by_key(spark.range(5).toDF("k"), "dealt", "k", 2)
            assert kept.count() == 5 and len(os.listdir(root)) == len(before) + 2
            1 / 0
    assert set(os.listdir(root)) == before and spark.catalog.listTables() == tables


def test_bucketed_scratch_tables_join_without_an_exchange(spark):
    with T.scratch_run(spark):
        left, right = (T.materialize_by_key(spark.range(200).select(F.col("id").alias("k"), (F.col("id") * n).alias(f"v{n}")),
                                            f"side{n}", "k", 3) for n in (2, 3))
        joined = left.hint("merge").join(right, "k").groupBy("k").agg(F.sum("v2"), F.sum("v3"))
        assert joined.count() == 200
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
