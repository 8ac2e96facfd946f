"""Newest rows kept as a state, counts that arrive with a report, broadcasts by measured size."""

from __future__ import annotations

import datetime as dt

import pytest
from conftest import values
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.operators.joins import at_own_date
from ledgerlens.operators.newest import advanced_newest, known_until, merged_newest, newest_rows
from ledgerlens.plans import bureau, checks, origination, regulatory
from ledgerlens.registry import reports as R
from ledgerlens.sources import tables as S
from ledgerlens.sources.driver_tables import DriverTables

START = dt.date(2020, 1, 1)
SCHEMA = "k bigint, d date, v bigint"


@pytest.fixture(scope="module")
def t(spark):
    return DriverTables(spark, "/root/testdata/sf0.001")


def plan_of(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def state_values(state):
    return sorted(((r.k, [(x.d, x.v) for x in r.newest]) for r in state.collect()), key=str)


def plain_newest(rows, k):
    found = {}
    for key, d, v in rows:
        if d is not None:
            found.setdefault(key, []).append((d, v))
    order = lambda x: (x[0], x[1] is not None, x[1] or 0)
    return sorted(((key, sorted(x, key=order, reverse=True)[:k]) for key, x in found.items()), key=str)


histories = st.lists(st.tuples(
    st.sampled_from([None, 1, 1, 1, 2, 3]),
    st.one_of(st.none(), st.integers(0, 12).map(lambda n: START + dt.timedelta(days=n))),
    st.one_of(st.none(), st.integers(0, 3))), max_size=30)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(histories, st.integers(1, 4), st.lists(st.integers(0, 12), min_size=2, max_size=2))
def test_any_cut_gives_the_same_newest_rows(spark, rows, k, cuts):
    df = spark.createDataFrame(rows, SCHEMA)
    low, high = (START + dt.timedelta(days=n) for n in sorted(cuts))
    parts = [df.filter(F.col("d") <= F.lit(low)), df.filter((F.col("d") > F.lit(low)) & (F.col("d") <= F.lit(high))),
             df.filter(F.col("d") > F.lit(high))]
    merged = merged_newest([newest_rows(p, "k", "d", ["v"], k) for p in parts], "k", k)
    assert state_values(merged) == plain_newest(rows, k)
    state = newest_rows(parts[0], "k", "d", ["v"], k)
    for until in (high, high, START + dt.timedelta(days=12)):
        state = advanced_newest(state, df, "k", "d", ["v"], k, until)
    # of the days that the first state knows nothing is read again
    assert state_values(state) == plain_newest(rows, k)


def test_an_empty_state_reads_everything(spark):
    df = spark.createDataFrame([(1, START, 5), (1, None, 6)], SCHEMA)
    empty = newest_rows(df.limit(0), "k", "d", ["v"], 2)
    assert known_until(empty, "d") is None
    assert state_values(advanced_newest(empty, df, "k", "d", ["v"], 2, START)) == [(1, [(START, 5)])]


def test_six_weeks_from_the_state_equal_six_reads_of_the_history(t):
    timeline, day = t["loan_timeline"], R.MONTH - dt.timedelta(days=35)
    state = S.materialize(regulatory.arrears_state(timeline, day), "arrears")
    found = []
    for n in range(6):
        if n:
            day += dt.timedelta(days=7)
            state = S.materialize(regulatory.advanced_arrears_state(state, timeline, day), "arrears")
        got = values(regulatory.missed_from_state(state, day))
        assert got == values(regulatory.missed_not_cured(timeline, day))
        found += got
    assert day == R.MONTH and any(count for _, count in found)
    week = regulatory.fca_weekly(t, day, R.COMMITTED, state=state)
    assert values(week) == values(regulatory.fca_weekly(t, day, R.COMMITTED))


def test_the_lower_bound_of_dates_comes_from_the_state(spark, t, tmp_path):
    stored = str(tmp_path / "timeline")
    t["loan_timeline"].write.parquet(stored)
    timeline = spark.read.parquet(stored)
    last = R.MONTH - dt.timedelta(days=7)
    state = S.materialize(regulatory.arrears_state(timeline, last), "arrears")
    known = known_until(state, "date")
    plan = plan_of(regulatory.advanced_arrears_state(state, timeline, R.MONTH))
    assert f"GreaterThan(date,{known})" in plan and f"LessThanOrEqual(date,{R.MONTH})" in plan
    assert "loan_timeline" not in plan_of(regulatory.missed_from_state(state, last))


ODD_ROWS = [(1, START, 5), (1, START, None), (2, START, 7), (None, START, 1), (None, None, 2), (3, None, 1)]


@pytest.mark.parametrize("rows", [ODD_ROWS, []])
@pytest.mark.parametrize("key", [["k"], ["k", "d"]])
def test_counts_arrive_with_the_report(spark, rows, key):
    df = spark.createDataFrame(rows, SCHEMA)
    place = [["k", "d", "v"].index(c) for c in key]
    whole = [tuple(r[p] for p in place) for r in rows]
    expected = {"rows": len(rows), "keys": len({w for w in whole if None not in w}),
                "null_keys": sum(None in w for w in whole),
                "total": float(sum(r[2] or 0 for r in rows)) if rows else None,
                "null_v": sum(r[2] is None for r in rows)}
    for exact in (True, False):
        report, watch = checks.watched(df, key, amount="v", nulls_of=["v"], exact_keys=exact)
        assert report.columns == df.columns
        assert values(report) == values(df)             # the report's own job
        assert watch.counts() == expected
        assert watch.frame(spark).first().asDict() == expected


def test_watching_reads_no_table_again(spark, t):
    report = bureau.bureau_back(t)
    seen, _ = checks.watched(report, ["agreement_code"])

    def scans(df):
        return plan_of(df).count("Scan parquet")
    assert scans(seen) == scans(report)
    by_key = t["loan_agreements"].groupBy("agreement_code").count()
    seen, _ = checks.watched(by_key, ["agreement_code"])
    assert plan_of(seen).count("Exchange\n") == plan_of(by_key).count("Exchange\n")   # no further one


@pytest.fixture(scope="module")
def stored(spark, t, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    for name in ("loan_agreements", "loan_timeline", "credit_score_summary", "funnel_summary",
                 "opportunity_link", "global_search", "retro_public", "retro_partial", "retro_score",
                 "applications", "dealer_dim", "opportunity"):
        ddl = S.SCHEMAS[name]
        kinds = spark.createDataFrame([], ddl).schema
        t[name].select([F.col(f.name).cast(f.dataType) for f in kinds]).write.parquet(f"{root}/{name}")
    return root


def joins_of(df):
    tree = plan_of(df).split("\n\n")[0]
    return {kind: tree.count(f"{kind} ") for kind in ("BroadcastHashJoin", "SortMergeJoin")}


def test_facts_are_not_shuffled_for_small_dimensions(spark, stored, monkeypatch):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")       # measured hints alone decide
    try:
        small = S.ParquetTables(spark, stored)
        funnel = (dt.date(1995, 1, 1), dt.date(1996, 12, 31))
        assert small.small("dealer_dim") and small.small("loan_agreements")
        channels = origination.introducer_channel(small["applications"], S.dimension(small, "dealer_dim"))
        assert joins_of(channels)["SortMergeJoin"] == 0 and "hashpartitioning" not in plan_of(channels)
        kinds = joins_of(bureau.bureau_back(small))
        # sides that are joined themselves have no measured size, adaptive execution decides on them
        assert kinds == {"BroadcastHashJoin": 6, "SortMergeJoin": 2}
        # the timeline meets the loans where it is read
        terms = at_own_date(S.dimension(small, "loan_agreements").select("agreement_code", "contract_date"),
                            small["loan_timeline"].select("agreement_code", "date", "payment"),
                            "agreement_code", "contract_date", "inner")
        assert joins_of(terms) == {"BroadcastHashJoin": 1, "SortMergeJoin": 0}
        assert "hashpartitioning" not in plan_of(terms)

        monkeypatch.setattr(S, "stored_bytes", lambda spark, path: 1 << 40)
        large = S.ParquetTables(spark, stored)
        assert not large.small("dealer_dim")
        assert joins_of(bureau.bureau_back(large)) == {"BroadcastHashJoin": 0, "SortMergeJoin": 8}
        assert values(bureau.bureau_back(small)) == values(bureau.bureau_back(large))
        assert values(origination.application_funnel(small, *funnel)) == values(
            origination.application_funnel(large, *funnel))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_small_files_that_hold_much_are_not_small(spark, tmp_path):
    spark.range(1_000_000).select(
        F.lit(1).cast("bigint").alias("dealer_id"), F.lit("x" * 40).alias("introducer_category")
    ).write.parquet(str(tmp_path / "dealer_dim"))
    t = S.ParquetTables(spark, str(tmp_path))
    assert t.file_bytes("dealer_dim") < 8 << 20 and not t.small("dealer_dim")
    assert S.row_bytes(spark.createDataFrame([], "a int, b string")) == 1
    assert S.row_bytes(spark.createDataFrame([], "a array<int>")) is None


def test_sizes_of_catalog_tables(spark, t):
    spark.sql("CREATE DATABASE IF NOT EXISTS sizes")
    t["dealer_dim"].select(F.col("dealer_id").cast("bigint"), "introducer_category").write.mode(
        "overwrite").saveAsTable("sizes.dealer_dim")
    c = S.CatalogTables(spark, "sizes")
    assert 0 < c.file_bytes("dealer_dim") < 1 << 20 and c.small("dealer_dim")
    assert DriverTables(spark, "/root/testdata/sf0.001").file_bytes("dealer_dim") is None
    S.drop_table(spark, "sizes.dealer_dim")
