"""Timelines of many loans: how their rows are dealt, and what is not moved again."""

from __future__ import annotations

import datetime as dt
import re
from collections import Counter
from decimal import Decimal

import pytest
from conftest import values

from ledgerlens.plans import checks, stock
from ledgerlens.session import tune
from ledgerlens.sources import driver_tables

ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderdate date, o_totalprice double"
DAY = dt.date(1998, 3, 31)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def folder(spark, tmp_path):
    """Loans of one to five years, one key twice and one loan without a date."""
    rows = [(k, k % 7, dt.date(1995, 1, 5) + dt.timedelta(days=29 * (k % 40)), 1000.0 + k)
            for k in [*range(1, 121), 120]] + [(500, 1, None, 5.0)]
    spark.createDataFrame(rows, ORDERS).write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def test_tasks_of_a_timeline_grow_in_number_and_not_in_rows(spark, folder, monkeypatch):
    whole = driver_tables.DriverTables(spark, folder)["provision_timeline"]
    monkeypatch.setattr(driver_tables, "PART_ROWS", 100, raising=False)
    dealt = driver_tables.DriverTables(spark, folder)["provision_timeline"]
    assert values(dealt) == values(whole)
    sizes = [n for n in dealt.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(sizes) > 2 * spark.sparkContext.defaultParallelism
    assert max(sizes) < 5 * 100


def test_no_loans_no_rows(spark, tmp_path):
    spark.createDataFrame([], ORDERS).write.parquet(f"{tmp_path}/orders.parquet")
    assert driver_tables.DriverTables(spark, str(tmp_path))["provision_timeline"].count() == 0


ACTIONS = "action_id bigint, contact_id bigint, created_at timestamp, description string, name string"


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    tune(spark)


def test_life_events_leave_the_history_where_it_is(spark, folder, no_broadcast):
    t = driver_tables.DriverTables(spark, folder)
    log = spark.createDataFrame(
        [(1, 3, dt.datetime(1998, 2, 1, 12), "call", "Loan Terminated")], ACTIONS)
    found = stock.life_events({
        "action_log": log, "contact": spark.createDataFrame([(3, "A3")], "id bigint, account_id string"),
        "loan_link": spark.createDataFrame([("A3", 7)], "main_borrower string, agreement_code bigint"),
        "status_history": t["status_history"]})
    assert not re.search(r"hashpartitioning\(agreement_code#\w+, _snapshot", plan(found))
    assert values(found, "agreement_code", "kind", "day") == [(7, "termination", dt.date(1998, 2, 1))]


def test_exits_meet_all_events_of_a_loan_from_one_read(spark, tmp_path):
    exits = [(1, "VT", DAY, Decimal(5), DAY), (1, "Default", DAY, Decimal(6), DAY),
             (2, "VT", DAY, Decimal(7), DAY), (None, "VT", DAY, Decimal(8), DAY),
             (3, "VT", None, None, None)]
    events = [(1, stock.TERMINATION, 1), (1, stock.TERMINATION, 1), (1, stock.TERMINATION, 2),
              (1, stock.SALE, 3), (1, stock.SALE, 4), (2, stock.REPOSSESSION, 5),
              (None, stock.SALE, 6), (9, stock.SALE, 7)]
    rows = [(k, kind, DAY + dt.timedelta(days=n), DAY if kind == stock.SALE and n == 3 else None,
             Decimal(n) if kind == stock.SALE else None) for k, kind, n in events]
    spark.createDataFrame(rows, "agreement_code bigint, kind string, day date, actual_sale_date date, "
                          "gross_sale_amount decimal(18,2)").write.parquet(f"{tmp_path}/life_events")
    t = {"settlements_and_defaults": spark.createDataFrame(
        exits, "agreement_code bigint, type string, processed_date date, amount decimal(18,2), date date")}
    found = stock.exit_events(t, spark.read.parquet(f"{tmp_path}/life_events"))
    none = {stock.TERMINATION: (None,), stock.REPOSSESSION: (None,), stock.SALE: (None, None, None)}

    def of(loan, kind):
        return [row[2:] if kind == stock.SALE else row[2:3]
                for row in rows if loan is not None and row[:2] == (loan, kind)] or [none[kind]]

    wanted = [(*e, *a, *b, *c) for e in exits for a in of(e[0], stock.TERMINATION)
              for b in of(e[0], stock.REPOSSESSION) for c in of(e[0], stock.SALE)]
    assert found.columns == [
        "agreement_code", "type", "processed_date", "settlement_amount", "exit_date", "termination_date",
        "repo_date", "vehicle_sale_date", "actual_sale_date", "gross_sale_amount"]
    assert Counter(map(tuple, found.collect())) == Counter(wanted)
    assert len(re.findall(r"FileScan parquet|Scan parquet", plan(found).split("== Initial Plan ==")[-1])) == 1


def test_watched_reports_are_sorted_in_the_stated_number_of_parts(spark):
    rows = [(k % 40, "a" if k % 3 else None) for k in range(200)] + [(None, "b")] * 5
    report, watch = checks.watched(spark.createDataFrame(rows, "k int, v string"), ["k"],
                                   nulls_of=["v"], parts=13)
    assert report.rdd.getNumPartitions() == 13
    assert values(report) == values(spark.createDataFrame(rows, "k int, v string"))
    assert watch.counts() == {"rows": 205, "keys": 40, "null_keys": 5, "null_v": 67}


def test_an_advanced_state_is_merged_in_the_stated_number_of_parts(spark, folder):
    history = driver_tables.DriverTables(spark, folder)["status_history"]
    bad, last = [dt.date(1996, 6, 1)], "1997-01-01"
    state = stock.position_state(history.filter(history["dateat"] < last), bad, DAY)
    later = history.filter(history["dateat"] == last)
    dealt = stock.advanced_state(state, later, bad, DAY, parts=13)
    assert len(re.findall(r"hashpartitioning\(agreement_code#\w+, 13\), REPARTITION", plan(dealt))) == 2
    assert not re.search(r"hashpartitioning\(agreement_code#\w+, \d+\), ENSURE", plan(dealt))
    plain = stock.advanced_state(state, later, bad, DAY)
    assert sorted(map(repr, dealt.collect())) == sorted(map(repr, plain.select(dealt.columns).collect()))
