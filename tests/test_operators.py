"""Histories, joins and reshaping on hand-made rows, hot keys included."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import values
from ledgerlens.operators import history as H
from ledgerlens.operators import joins as J
from ledgerlens.operators import reshape as R
from ledgerlens.sources.tables import read_delimited

DAY0 = dt.date(2018, 11, 20)
SCHEMA = "k int, day date, s string"


def history_rows(seed=1, hot=400, others=60):
    """One key with most of the rows over several years, others with few, and a NULL key."""
    rng, rows = random.Random(seed), []
    for key, size in [(1, hot), (None, 40)] + [(k, rng.randint(1, 4)) for k in range(2, others)]:
        days = sorted(rng.sample(range(1500), size))
        rows += [(key, DAY0 + dt.timedelta(days=d), rng.choice("ABC")) for d in days]
    rng.shuffle(rows)
    return rows


def by_key(rows):
    out = {}
    for row in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        out.setdefault(row[0], []).append(row)
    return out


def test_previous_equals_brute_force_across_chunks(spark):
    rows = history_rows()
    got = H.previous(spark.createDataFrame(rows, SCHEMA), {"s": "before"}, ["k"], ["day"])
    want = []
    for group in by_key(rows).values():
        want += [(*row, None if i == 0 else group[i - 1][2]) for i, row in enumerate(group)]
    assert values(got) == values(spark.createDataFrame(want, SCHEMA + ", before string"))


def test_kept_previous_skips_rows_but_plain_does_not(spark):
    rows = history_rows(seed=2)
    got = H.previous(spark.createDataFrame(rows, SCHEMA), {"s": "before"}, ["k"], ["day"],
                     kept=F.col("s") != "B", kept_columns={"s": "kept_before"})
    want = []
    for group in by_key(rows).values():
        kept = None
        for i, row in enumerate(group):
            want.append((*row, None if i == 0 else group[i - 1][2], kept))
            kept = kept if row[2] == "B" else row[2]
    assert values(got) == values(
        spark.createDataFrame(want, SCHEMA + ", before string, kept_before string"))


def test_previous_keeps_null_values_of_the_preceding_row(spark):
    rows = [(1, DAY0, None), (1, DAY0 + dt.timedelta(days=1), "A"),
            (1, DAY0 + dt.timedelta(days=400), "B"), (1, DAY0 + dt.timedelta(days=800), None),
            (1, DAY0 + dt.timedelta(days=1200), "C")]
    got = H.previous(spark.createDataFrame(rows, SCHEMA), {"s": "before"}, ["k"], ["day"])
    assert [r["before"] for r in got.orderBy("day").collect()] == [None, None, "A", "B", None]


def test_numbering_and_dynamic_lag_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(*row, rng.choice([None, 0, 1, 2, 5])) for row in history_rows(seed=3)]
    df = spark.createDataFrame(rows, SCHEMA + ", back int")
    want_number, want_lag = [], []
    for group in by_key(rows).values():
        for i, row in enumerate(group):
            want_number.append((*row, i + 1))
            at = i - (row[3] or 0)
            want_lag.append((*row, group[at][2] if at >= 0 else None))
    numbered = H.numbered(df, ["k"], ["day"], "n")
    assert values(numbered) == values(spark.createDataFrame(want_number, SCHEMA + ", back int, n long"))
    lagged = H.lag_by_column(df, "s", "back", ["k"], ["day"], "then")
    assert values(lagged) == values(spark.createDataFrame(want_lag, SCHEMA + ", back int, then string"))


@settings(max_examples=6, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 2)), st.integers(0, 30),
                          st.sampled_from("AB")), min_size=1, max_size=40),
       st.integers(1, 9))
def test_histories_do_not_depend_on_where_they_are_cut(spark, raw, hot_rows):
    rows = [(k, DAY0 + dt.timedelta(days=d), s, n, n % 5) for n, (k, d, s) in enumerate(raw)]
    df = spark.createDataFrame(rows, SCHEMA + ", n int, back int")
    found = []
    for hot in (hot_rows, None):
        lagged = H.previous(df, {"s": "before", "n": "n_before"}, ["k"], ["day"], kept=F.col("s") == "A",
                            kept_columns={"n": "a_before"}, hot_rows=hot)
        count = H.numbered(df, ["k"], ["day"], "at", from_end="left", hot_rows=hot)
        back = H.lag_by_column(df, "n", "back", ["k"], ["day"], "then", hot_rows=hot)
        found.append([values(x) for x in (lagged, count, back)])
    assert found[0] == found[1]


def test_ranges_of_a_hot_key_are_even(spark):
    """Half of all rows belong to one key and one day; no range is above twice the median."""
    df = spark.range(40_000).select(
        F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id") % 500).alias("k"),
        F.lit(DAY0).alias("day"), F.col("id").alias("n"))
    ranged = H._ranges(df, ["k"], ["day"], ["n"], 2_000)
    sizes = [r["count"] for r in ranged.rows.filter("_hot").groupBy("k", "_range").count().collect()]
    assert len(sizes) >= 3 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]
    assert {r.k for r in ranged.rows.filter("_hot").select("k").distinct().collect()} == {-1}


def _exchanges(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.count("Exchange hashpartitioning"), text.count("Join")


def test_histories_without_hot_keys_are_dealt_once(spark):
    df = spark.createDataFrame(history_rows(), SCHEMA).withColumn("back", F.lit(2))
    assert _exchanges(H.previous(df, {"s": "before"}, ["k"], ["day"])) == (1, 0)
    assert _exchanges(H.lag_by_column(df, "s", "back", ["k"], ["day"], "then")) == (1, 0)


def test_first_latest_and_entered(spark):
    rows = [(1, DAY0, "A"), (1, DAY0 + dt.timedelta(1), "A"), (1, DAY0 + dt.timedelta(2), "B"),
            (1, DAY0 + dt.timedelta(3), "A"), (1, DAY0 + dt.timedelta(4), "B"), (2, DAY0, "B")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert values(H.first_per_key(df, ["k"], "day", ["s"])) == [(1, DAY0, "A"), (2, DAY0, "B")]
    assert values(H.latest_per_key(df, ["k"], "day")) == [
        (1, DAY0 + dt.timedelta(4), "B"), (2, DAY0, "B")]
    lagged = H.previous(df, {"s": "previous_status"}, ["k"], ["day"])
    entered = lagged.filter(H.entered_state("B", "s"))
    assert values(entered, "k", "day") == [(1, DAY0 + dt.timedelta(2)), (1, DAY0 + dt.timedelta(4))]


def test_top_per_key_limits_before_the_shuffle(spark):
    plan = H.first_per_key(spark.createDataFrame(history_rows(), SCHEMA), ["k"], "day")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") >= 2


def test_left_join_many_equals_a_left_join(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d")], "k int, l string")
    right = spark.createDataFrame([(1, 10)] * 50 + [(1, None), (3, 30), (None, 40)], "k int, r int")
    assert values(J.left_join_many(left, right, "k")) == values(left.join(right, "k", "left"))
    keys = spark.createDataFrame([(1,), (3,), (1,)], "k int")
    assert values(J.left_join_many(left, right, "k", keys)) == values(left.join(right, "k", "left"))


def test_pandas_style_merge(spark):
    left = spark.createDataFrame([("v1", "x"), ("v1", "y"), (None, "z"), ("v3", "w")], "VIN string, VRM string")
    right = spark.createDataFrame([("v1", "p", 1), ("v1", "q", 2), (None, "r", 3)],
                                  "VIN string, VRM string, n int")
    got = J.enrich_left(left, right, ["VIN"], ("_a", "_b"))
    pandas = left.toPandas().merge(right.toPandas(), how="left", on="VIN", suffixes=("_a", "_b"))
    assert got.columns == list(pandas.columns)
    want = [(r.VRM_a, r.VRM_b, None if r.n != r.n else int(r.n)) for r in pandas.itertuples()]
    plain = [(a, b if isinstance(b, str) else None, n) for a, b, n in want]
    assert sorted(map(str, plain)) == sorted(map(str, values(got, "VRM_a", "VRM_b", "n")))


def test_snapshots_and_own_dates(spark):
    later = DAY0 + dt.timedelta(31)
    line = spark.createDataFrame([(1, DAY0, "x"), (1, later, "y"), (2, later, "z")],
                                 "k int, date date, s string")
    compared = J.snapshot_compare(line, "k", later, DAY0, {"s": "base"})
    assert values(compared, "k", "s", "base") == [(1, "y", "x"), (2, "z", None)]
    asked = spark.createDataFrame([(1, DAY0), (2, DAY0), (3, None)], "k int, d date")
    assert values(J.at_own_date(asked, line, "k", "d")) == [(1, DAY0, "x"), (2, DAY0, None), (3, None, None)]


def test_date_filters_reach_the_files(spark, tmp_path):
    df = spark.createDataFrame([(1, DAY0, 5), (2, DAY0 + dt.timedelta(1), 6)], "k int, date date, v int")
    df.write.partitionBy("date").parquet(str(tmp_path / "line"))
    plan = J.on_date(spark.read.parquet(str(tmp_path / "line")), DAY0).select("k")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in text and "ReadSchema: struct<k:int>" in text


def test_pivot_total_and_transpose(spark):
    rows = spark.createDataFrame([(1, DAY0, 2), (1, DAY0, 3), (2, DAY0 + dt.timedelta(1), 4)],
                                 "k int, date date, v int")
    wide = R.month_pivot(rows, "k", "v", {"a": DAY0, "b": DAY0 + dt.timedelta(1)})
    assert values(wide) == [(1, 5, None), (2, None, 4)]
    sums = spark.createDataFrame([("m", "x", 1, None), ("m", None, 2, None), ("n", "x", 4, 8)],
                                 "month string, split string, a int, b int")
    total = R.with_total(sums, "month", "split", "TOTAL")
    assert values(total) == [("m", "TOTAL", 3, None), ("m", "x", 1, None), ("m", None, 2, None),
                             ("n", "TOTAL", 4, 8), ("n", "x", 4, 8)]
    side = R.side_by_side(spark.range(1).selectExpr("7 as a"), spark.range(1).selectExpr("cast(null as int) as b"))
    assert values(side) == [(7, None)]
    long = R.transpose_metrics(side, ["a", "b"], "int")
    assert values(long) == [("a", 7), ("b", None)]


def test_no_crossing_of_one_row_frames(spark):
    side = R.side_by_side(spark.range(1).selectExpr("7 as a"), spark.range(1).selectExpr("8 as b"))
    text = side._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text


@pytest.mark.parametrize("k", [1, 2])
def test_top_per_key_keeps_k(spark, k):
    df = spark.createDataFrame(history_rows(), SCHEMA)
    sizes = H.top_per_key(df, ["k"], [F.col("day").desc()], k).groupBy("k").count()
    assert max(n for _, n in values(sizes)) == k


def test_previous_over_a_year_border_with_weeks(spark):
    rows = [("a", "2024-01-03", "A"), ("a", "2024-02-07", "B"), ("a", "2025-01-02", "C")]
    history = spark.createDataFrame(rows, "key string, dateat string, status string")
    got = H.previous(history, {"status": "before"}, ["key"], ["dateat"])
    assert values(got, "status", "before") == [("A", None), ("B", "A"), ("C", "B")]


def test_tied_days_follow_the_other_columns_and_numbers_run_both_ways(spark):
    day = dt.date(2024, 12, 31)
    rows = [(1, day, "B"), (1, day, "A"), (1, day + dt.timedelta(1), None), (1, day + dt.timedelta(1), "C")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, SCHEMA)
        got = H.previous(df, {"s": "before"}, ["k"], ["day"])
        assert values(got) == values(spark.createDataFrame(
            [(1, day, "A", None), (1, day, "B", "A"), (1, day + dt.timedelta(1), "C", "B"),
             (1, day + dt.timedelta(1), None, "C")], SCHEMA + ", before string"))
        both = H.numbered(df, ["k"], ["day"], "n", from_end="m")
        assert sorted((r["n"], r["m"], r["s"]) for r in both.collect()) == [
            (1, 4, "A"), (2, 3, "B"), (3, 2, "C"), (4, 1, None)]


def test_side_by_side_rejects_a_second_row(spark):
    with pytest.raises(Exception, match="one row"):
        R.side_by_side(spark.range(2).selectExpr("id as a"), spark.range(1).selectExpr("8 as b")).collect()


def test_delimited_input_fails_on_a_bad_value(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("a,b\n1,x\nbad,y\n")
    with pytest.raises(Exception):
        read_delimited(spark, str(tmp_path / "bad.csv"), "a int, b string").collect()
