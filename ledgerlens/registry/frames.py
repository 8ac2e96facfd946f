"""Joins, aggregates, windows and set operators, each on whole tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from .. import values as V
from ..functions.aggregates import sum_if, sum_if0, tally
from ..functions.numeric import ratio
from ..operators.history import (
    entered_state, first_per_key, lag_by_column, latest_per_key, numbered, previous)
from ..operators.joins import (
    at_own_date, enrich_left, first_match, left_join_many, on_date, snapshot_compare)
from ..operators.reshape import month_pivot, side_by_side, with_total
from ..plans.checks import (
    control_totals, duplicate_keys, key_counts, repeated_transitions, unread_dates)
from ..plans.stock import crystallisation
from . import query
from .sql import columns, d, n, tally as sql_tally, total, total0, x

MARCH = dt.date(1998, 3, 31)
MARCH_SQL = "DATE '1998-03-31'"
OCTOBER = dt.date(1998, 10, 31)

# ---------------------------------------------------------------- joins


@query("inner_join", """
    SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def inner_join(t):
    return t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", "n_name")


@query("left_join", """
    SELECT o_orderkey, l_linenumber, l_quantity FROM orders
    LEFT JOIN lineitem ON l_orderkey = o_orderkey""")
def left_join(t):
    return t["orders"].join(t["lineitem"], F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        "o_orderkey", "l_linenumber", "l_quantity")


@query("left_join_hot_key", """
    SELECT agreement_code, contract_end_date, type, round(CAST(amount AS DOUBLE), 6) AS amount
    FROM (SELECT agreement_code, CAST(contract_end_date AS VARCHAR) AS contract_end_date
          FROM loan_agreements) LEFT JOIN settlements_and_defaults USING (agreement_code)""")
def left_join_hot_key(t):
    return left_join_many(t["loan_agreements"].select("agreement_code", "contract_end_date"),
                          t["settlements_and_defaults"].select("agreement_code", "type", "amount"),
                          "agreement_code")


@query("snapshot_at_own_date", "SELECT f.agreement_code, f.type, " + columns(
    d("f.start_date", "start_date"), x("lt.capital_balance", "capital_balance")) + """
    FROM forbearance f LEFT JOIN loan_timeline lt
      ON lt.agreement_code = f.agreement_code AND lt.date = f.start_date""")
def snapshot_at_own_date(t):
    balances = t["loan_timeline"].select("agreement_code", "date", "capital_balance")
    return at_own_date(t["forbearance"].select("agreement_code", "type", "start_date"), balances,
                       "agreement_code", "start_date")


@query("left_join_const_date", f"""
    SELECT la.agreement_code, lt.status_code FROM loan_agreements la
    LEFT JOIN loan_timeline lt ON lt.agreement_code = la.agreement_code AND lt.date = {MARCH_SQL}""")
def left_join_const_date(t):
    state = on_date(t["loan_timeline"], MARCH).select("agreement_code", "status_code")
    return t["loan_agreements"].select("agreement_code").join(state, "agreement_code", "left")


@query("join_computed_key", """
    SELECT e.event_id, h.status FROM events e JOIN event_history h
      ON h.agreement_code = e.user_id AND CAST(h.dateat AS DATE) = CAST(e.ts AS DATE)""")
def join_computed_key(t):
    history = t["event_history"].select(F.col("agreement_code").alias("user_id"),
                                        F.to_date("dateat").alias("day"), "status")
    return t["events"].withColumn("day", F.to_date("ts")).join(history, ["user_id", "day"]).select(
        "event_id", "status")


@query("semi_in_subquery", """
    SELECT agreement_code FROM loan_agreements
    WHERE agreement_code IN (SELECT agreement_code FROM forbearance WHERE status = 'Agreed')""")
def semi_in_subquery(t):
    agreed = t["forbearance"].filter(F.col("status") == "Agreed").select("agreement_code")
    return t["loan_agreements"].join(agreed, "agreement_code", "left_semi").select("agreement_code")


@query("anti_join", """
    SELECT o_orderkey FROM orders
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def anti_join(t):
    return t["orders"].join(t["lineitem"], F.col("o_orderkey") == F.col("l_orderkey"),
                            "left_anti").select("o_orderkey")


@query("outer_to_inner", """
    SELECT la.agreement_code, sd.type FROM loan_agreements la
    JOIN settlements_and_defaults sd USING (agreement_code) WHERE sd.type IN ('VT', 'Default')""")
def outer_to_inner(t):
    exits = t["settlements_and_defaults"].select("agreement_code", "type")
    return t["loan_agreements"].select("agreement_code").join(exits, "agreement_code", "left").filter(
        F.col("type").isin(V.VT, V.DEFAULT))


@query("snapshot_compare", """
    SELECT lt.agreement_code, lt.arrears_status, b.arrears_status AS base_status
    FROM loan_timeline lt LEFT JOIN loan_timeline b
      ON b.agreement_code = lt.agreement_code AND b.date = DATE '1998-03-31'
    WHERE lt.date = DATE '1998-10-31'""")
def compare_snapshots(t):
    return snapshot_compare(t["loan_timeline"], "agreement_code", OCTOBER, MARCH,
                            {"arrears_status": "base_status"}).select(
        "agreement_code", "arrears_status", "base_status")


@query("merge_suffix", """
    WITH p AS (SELECT vin, registration, agreement_code FROM loan_agreements)
    SELECT v.VIN, v.VRM AS VRM_list, p.registration AS VRM_portfolio, p.agreement_code
    FROM vehicle_list v LEFT JOIN p ON v.VIN IS NOT DISTINCT FROM p.vin""")
def merge_suffix(t):
    portfolio = t["loan_agreements"].select(
        F.col("vin").alias("VIN"), F.col("registration").alias("VRM"), "agreement_code")
    return enrich_left(t["vehicle_list"], portfolio, ["VIN"], ("_list", "_portfolio"))


@query("join_distinct_dim", """
    SELECT la.agreement_code, a.employment_status FROM loan_agreements la
    LEFT JOIN (SELECT DISTINCT id, employment_status FROM account WHERE is_person) a
      ON a.id = la.main_borrower_account_id""")
def join_distinct_dim(t):
    people = t["account"].filter("is_person").select(
        F.col("id").alias("main_borrower_account_id"), "employment_status")
    return first_match(t["loan_agreements"].select("agreement_code", "main_borrower_account_id"),
                       people, "main_borrower_account_id").drop("main_borrower_account_id")


@query("unused_join_dup_guard", """
    SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS rows FROM lineitem
    GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def unused_join_dup_guard(t):
    return duplicate_keys(t["lineitem"], ["l_orderkey", "l_linenumber"])


@query("side_by_side", "SELECT * FROM (SELECT " + n("count(*)", "orders") + " FROM orders), (SELECT "
       + n("count(*)", "lines") + ", " + x("max(l_quantity)", "most") + " FROM lineitem)")
def side_by_side_totals(t):
    return side_by_side(t["orders"].agg(F.count(F.lit(1)).alias("orders")),
                        t["lineitem"].agg(F.count(F.lit(1)).alias("lines"),
                                          F.max("l_quantity").alias("most")))


# ---------------------------------------------------------------- aggregates


def _price():
    return F.col("o_totalprice").cast("decimal(14,2)")


PRICE = "CAST(o_totalprice AS DECIMAL(14,2))"


@query("global_agg", "SELECT " + columns(n("count(*)", "orders"), x(f"sum({PRICE})", "amount"),
                                         d("min(CAST(o_orderdate AS DATE))", "first_day"))
       + " FROM orders")
def global_agg(t):
    return t["orders"].agg(F.count(F.lit(1)).alias("orders"), F.sum(_price()).alias("amount"),
                           F.min(F.to_date("o_orderdate")).alias("first_day"))


@query("group_one_key", f"SELECT o_custkey, {n('count(*)', 'orders')}, {x(f'sum({PRICE})', 'amount')}"
       " FROM orders GROUP BY o_custkey")
def group_one_key(t):
    return t["orders"].groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"),
                                                F.sum(_price()).alias("amount"))


@query("group_two_keys", "SELECT l_returnflag, l_linestatus, " + x(
    "sum(CAST(l_extendedprice AS DECIMAL(14,2)))", "amount") + " FROM lineitem GROUP BY ALL")
def group_two_keys(t):
    return t["lineitem"].groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(F.col("l_extendedprice").cast("decimal(14,2)")).alias("amount"))


@query("group_distinct", """
    SELECT agreement_code, CAST(month(date) AS BIGINT) AS month, arrears_status
    FROM loan_timeline GROUP BY ALL""")
def group_distinct(t):
    return t["loan_timeline"].select("agreement_code", F.month("date").alias("month"),
                                     "arrears_status").distinct()


@query("count_star", "SELECT o_orderstatus, " + n("count(*)", "orders") + " FROM orders GROUP BY 1")
def count_star(t):
    return t["orders"].groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"))


@query("count_distinct", "SELECT l_returnflag, " + n("count(DISTINCT l_orderkey)", "orders")
       + " FROM lineitem GROUP BY 1")
def count_distinct(t):
    return t["lineitem"].groupBy("l_returnflag").agg(F.count_distinct("l_orderkey").alias("orders"))


QUANTITY_CONDITIONS = {
    "small": ("l_quantity < 10", lambda q: q < 10),
    "medium": ("l_quantity BETWEEN 10 AND 30", lambda q: q.between(10, 30)),
    "large": ("l_quantity > 30", lambda q: q > 30),
}


@query("cond_count_distinct", "SELECT l_linestatus, " + columns(*[
    n(f"count(DISTINCT l_orderkey) FILTER (WHERE {sql})", name)
    for name, (sql, _) in QUANTITY_CONDITIONS.items()]) + " FROM lineitem GROUP BY 1")
def cond_count_distinct(t):
    flags = {name: F.max(F.when(cond(F.col("l_quantity")), F.lit(1)).otherwise(F.lit(0)))
             for name, (_, cond) in QUANTITY_CONDITIONS.items()}
    per_order = t["lineitem"].groupBy("l_linestatus", "l_orderkey").agg(
        *[flag.alias(name) for name, flag in flags.items()])
    return per_order.groupBy("l_linestatus").agg(*[F.sum(name).alias(name) for name in flags])


@query("cond_count", "SELECT l_linestatus, " + columns(*[
    n(f"count(*) FILTER (WHERE {sql})", name) for name, (sql, _) in QUANTITY_CONDITIONS.items()])
       + " FROM lineitem GROUP BY 1")
def cond_count(t):
    return t["lineitem"].groupBy("l_linestatus").agg(*[
        F.count(F.when(cond(F.col("l_quantity")), F.lit(1))).alias(name)
        for name, (_, cond) in QUANTITY_CONDITIONS.items()])


@query("cond_sum_null", "SELECT o_custkey, " + columns(
    x(total("o_orderstatus = 'F'", PRICE), "finished"), n(sql_tally("o_orderstatus = 'P'"), "partial"))
       + " FROM orders GROUP BY 1")
def cond_sum_null(t):
    status = F.col("o_orderstatus")
    return t["orders"].groupBy("o_custkey").agg(sum_if(status == "F", _price()).alias("finished"),
                                                tally(status == "P").alias("partial"))


@query("cond_sum_zero", "SELECT o_custkey, " + x(total0("o_orderstatus = 'F'", PRICE), "finished")
       + " FROM orders GROUP BY 1")
def cond_sum_zero(t):
    return t["orders"].groupBy("o_custkey").agg(
        sum_if0(F.col("o_orderstatus") == "F", _price()).alias("finished"))


CHANGE = "provision_held - previous_provision_held"


@query("sum_difference", f"SELECT scenario, {x(f'sum({CHANGE})', 'change')}"
       " FROM provision_timeline GROUP BY 1")
def sum_difference(t):
    change = F.col("provision_held") - F.col("previous_provision_held")
    return t["provision_timeline"].groupBy("scenario").agg(F.sum(change).alias("change"))


@query("sum_negated", "SELECT scenario, " + x("sum(-previous_provision_held)", "released")
       + " FROM provision_timeline GROUP BY 1")
def sum_negated(t):
    return t["provision_timeline"].groupBy("scenario").agg(
        F.sum(-F.col("previous_provision_held")).alias("released"))


@query("cond_avg", "SELECT platform, " + columns(
    x("avg(mileage)", "mileage"), x("avg(term) FILTER (WHERE mileage < 50000)", "short_term"))
       + " FROM loan_agreements GROUP BY 1")
def cond_avg(t):
    return t["loan_agreements"].groupBy("platform").agg(
        F.avg("mileage").alias("mileage"),
        F.avg(F.when(F.col("mileage") < 50_000, F.col("term"))).alias("short_term"))


@query("cond_min_max", "SELECT agreement_code, " + columns(
    d("min(start_date) FILTER (WHERE type = 'Payment Reduction')", "first_reduction"),
    d("max(end_date) FILTER (WHERE status <> 'Declined')", "last_end")) + " FROM forbearance GROUP BY 1")
def cond_min_max(t):
    reduction = F.col("type") == "Payment Reduction"
    return t["forbearance"].groupBy("agreement_code").agg(
        F.min(F.when(reduction, F.col("start_date"))).alias("first_reduction"),
        F.max(F.when(F.col("status") != "Declined", F.col("end_date"))).alias("last_end"))


ARREARS_SHARE = ("CAST(coalesce(sum(arrears), 0) AS DOUBLE)"
                 " / nullif(CAST(sum(capital_balance) AS DOUBLE), 0)")


@query("agg_ratio", "SELECT arrears_status, " + x(ARREARS_SHARE, "share") + " FROM loan_timeline GROUP BY 1")
def agg_ratio(t):
    return t["loan_timeline"].groupBy("arrears_status").agg(
        F.sum("arrears").alias("arrears"), F.sum("capital_balance").alias("balance")).select(
        "arrears_status", ratio(F.col("arrears"), F.col("balance")).alias("share"))


@query("month_pivot", "SELECT agreement_code, " + columns(*[
    x(total(f"date = DATE '1998-0{m}-{day}'", "capital_balance"), f"m{m}")
    for m, day in ((1, 31), (2, 28), (3, 31))]) + """
    FROM loan_timeline WHERE date BETWEEN DATE '1998-01-31' AND DATE '1998-03-31' GROUP BY 1""")
def pivot_months(t):
    days = {"m1": dt.date(1998, 1, 31), "m2": dt.date(1998, 2, 28), "m3": MARCH}
    return month_pivot(t["loan_timeline"], "agreement_code", "capital_balance", days)


@query("funnel_total", """
    WITH s AS (SELECT CAST(year(contract_date) AS BIGINT) AS year, coalesce(platform, 'none') AS platform,
                      count(*) AS loans, sum(total_finance_amount) AS amount
               FROM loan_agreements GROUP BY ALL)
    SELECT year, platform, CAST(loans AS BIGINT) AS loans, round(CAST(amount AS DOUBLE), 6) AS amount FROM s
    UNION ALL SELECT year, 'TOTAL', CAST(sum(loans) AS BIGINT), round(CAST(sum(amount) AS DOUBLE), 6)
    FROM s GROUP BY year""")
def funnel_total(t):
    sums = t["loan_agreements"].groupBy(
        F.year("contract_date").alias("year"), F.coalesce("platform", F.lit("none")).alias("platform")
    ).agg(F.count(F.lit(1)).alias("loans"), F.sum("total_finance_amount").alias("amount"))
    return with_total(sums, "year", "platform", "TOTAL")


@query("select_distinct", "SELECT DISTINCT VIN, VRM FROM vehicle_list")
def select_distinct(t):
    return t["vehicle_list"].distinct()


@query("drop_duplicates", "SELECT VIN, max(VRM) AS VRM FROM vehicle_list WHERE VIN IS NOT NULL GROUP BY VIN")
def drop_duplicates(t):
    return latest_per_key(t["vehicle_list"].filter(F.col("VIN").isNotNull()), ["VIN"], "VRM")


TRANSITIONS_SQL = """
    WITH h AS (SELECT *, lag(status) OVER (PARTITION BY agreement_code ORDER BY dateat) AS before,
                      row_number() OVER (PARTITION BY agreement_code, status ORDER BY dateat) AS visit
               FROM status_history),
    c AS (SELECT agreement_code,
                 sum(CASE WHEN status IN ('AG_REPO_CRYSTALISED', 'AG_VT_CRYSTALISED')
                           AND before NOT IN ('AG_REPO_CRYSTALISED', 'AG_VT_CRYSTALISED')
                          THEN 1 END) AS a,
                 sum(CASE WHEN status IN ('AG_REPO_SHORTFALL', 'AG_VT_CRYSTALISED') AND visit = 1
                          THEN 1 END) AS b
          FROM h WHERE before IS NOT NULL GROUP BY agreement_code)
    SELECT agreement_code, CAST(a AS BIGINT) AS dups_check, CAST(b AS BIGINT) AS dups_check2
    FROM c WHERE a > 1 OR b > 1"""


@query("dup_transition_check", TRANSITIONS_SQL)
def dup_transition_check(t):
    return repeated_transitions(crystallisation(t["status_history"]))


@query("control_totals", "SELECT " + columns(
    n("count(*)", "rows"), n("count(DISTINCT agreement_code)", "keys"), x("sum(capital_balance)", "total"))
       + " FROM loan_timeline")
def totals(t):
    return control_totals(t["loan_timeline"], "agreement_code", "capital_balance")


#: Tables that reports join, or leave out, trusting that their key is unique.
LOOKUPS = {"opportunity": "id", "opportunity_history": "id", "funnel_summary": "loan_application_id",
           "applicant": "id", "contact": "id", "dealer_dim": "dealer_id", "global_search": "id",
           "retro_public": "global_search_id", "vehicle_list": "VIN"}


@query("key_counts", " UNION ALL ".join(
    f"SELECT '{name}' AS name, " + columns(
        n("count(*)", "rows"), n(f"count(DISTINCT {key})", "keys"),
        n(f"count(*) - count({key})", "null_keys")) + f" FROM {name}"
    for name, key in LOOKUPS.items()))
def lookup_keys(t):
    return key_counts({name: (t[name], key) for name, key in LOOKUPS.items()})


@query("unread_dates", "SELECT " + columns(
    n("count(*)", "rows"), n("count(*) - count(dateat)", "missing"),
    n("count(dateat) - count(try_cast(dateat AS DATE))", "unread")) + " FROM status_history")
def unread_snapshots(t):
    return unread_dates(t["status_history"], "dateat")


# ---------------------------------------------------------------- ordered histories


@query("first_event_per_key", """
    SELECT contact_id, first(action_id ORDER BY created_at, action_id) AS action_id
    FROM action_log GROUP BY contact_id""")
def first_event_per_key(t):
    return first_per_key(t["action_log"], ["contact_id"], "created_at", ["action_id"]).select(
        "contact_id", "action_id")


@query("latest_per_key", """
    SELECT agreement_code, max(dateat) AS dateat, arg_max(status, dateat) AS status
    FROM event_history GROUP BY agreement_code""")
def latest_status(t):
    return latest_per_key(t["event_history"], ["agreement_code"], "dateat").select(
        "agreement_code", "dateat", "status")


@query("first_in_state", """
    SELECT agreement_code, dateat, status,
           CAST(row_number() OVER (PARTITION BY agreement_code, status ORDER BY dateat) AS BIGINT)
             AS first_in_state,
           CAST(row_number() OVER (PARTITION BY agreement_code, status ORDER BY dateat DESC) AS BIGINT)
             AS last_in_state
    FROM status_history""")
def first_in_state(t):
    history = t["status_history"].select("agreement_code", "dateat", "status")
    return numbered(history, ["agreement_code", "status"], ["dateat"], "first_in_state",
                    from_end="last_in_state")


@query("lag_previous", """
    SELECT agreement_code, dateat, status,
           lag(status) OVER w AS previous_status,
           round(CAST(lag(arrears_value) OVER w AS DOUBLE), 6) AS previous_arrears
    FROM status_history WINDOW w AS (PARTITION BY agreement_code ORDER BY dateat)""")
def lag_previous(t):
    history = t["status_history"].select("agreement_code", "dateat", "status", "arrears_value")
    return previous(history, {"status": "previous_status", "arrears_value": "previous_arrears"},
                    ["agreement_code"], ["dateat"], tie=["status"]).drop("arrears_value")


@query("lag_dynamic", """
    SELECT agreement_code, CAST(date AS VARCHAR) AS date,
           round(CAST(lag(arrears_yesterday, CAST(coalesce(days_since_last_payment_date, 0) AS INT))
                   OVER (PARTITION BY agreement_code ORDER BY date) AS DOUBLE), 6) AS lagged
    FROM loan_timeline""")
def lag_dynamic(t):
    rows = t["loan_timeline"].select("agreement_code", "date", "arrears_yesterday",
                                     "days_since_last_payment_date")
    return lag_by_column(rows, "arrears_yesterday", "days_since_last_payment_date",
                         ["agreement_code"], ["date"], "lagged", tie=["arrears_yesterday"]).select(
        "agreement_code", "date", "lagged")


@query("entered_state", """
    WITH h AS (SELECT agreement_code, dateat, status,
                      lag(status) OVER (PARTITION BY agreement_code ORDER BY dateat) AS before
               FROM event_history)
    SELECT agreement_code, dateat FROM h WHERE status = 'AG_REPO' AND before <> 'AG_REPO'""")
def entered(t):
    history = t["event_history"].select("agreement_code", "dateat", "status")
    lagged = previous(history, {"status": "previous_status"}, ["agreement_code"], ["dateat"])
    return lagged.filter(entered_state(V.REPO)).select("agreement_code", "dateat")


# ---------------------------------------------------------------- set operators


@query("union_all", """
    SELECT 'customer' AS kind, c_custkey AS id, round(CAST(c_acctbal AS DOUBLE), 6) AS amount FROM customer
    UNION ALL SELECT 'part', p_partkey, round(CAST(p_size AS DOUBLE), 6) FROM part""")
def union_all(t):
    return t["customer"].select(F.lit("customer").alias("kind"), "c_custkey", "c_acctbal").union(
        t["part"].select(F.lit("part"), "p_partkey", F.col("p_size").cast("double"))
    ).toDF("kind", "id", "amount")


@query("order_nulls", """
    SELECT platform, introducer_id, CAST(count(*) AS BIGINT) AS loans FROM loan_agreements
    GROUP BY ALL ORDER BY platform NULLS LAST, introducer_id DESC""")
def order_nulls(t):
    return t["loan_agreements"].groupBy("platform", "introducer_id").agg(
        F.count(F.lit(1)).alias("loans")).orderBy(F.col("platform").asc_nulls_last(),
                                                  F.col("introducer_id").desc())


@query("limit_rows", """
    SELECT agreement_code, round(CAST(total_finance_amount AS DOUBLE), 6) AS total_finance_amount
    FROM loan_agreements ORDER BY total_finance_amount DESC, agreement_code LIMIT 100""")
def limit_rows(t):
    return t["loan_agreements"].select("agreement_code", "total_finance_amount").orderBy(
        F.col("total_finance_amount").desc(), "agreement_code").limit(100)
