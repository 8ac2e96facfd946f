"""Projection, predicates and scalar functions, each on a whole table."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import values as V
from ..functions.aggregates import placeholder
from ..functions.dates import (
    age_from_birth_year, age_from_dob, epoch_ms_to_date, months_diff, parse_date, vintage_label,
    whole_years)
from ..functions.numeric import (
    clean_numeric, floor_to, int_div, lookup, nullif_fallback, ratio, safe_ratio)
from ..functions.text import amount_between, date_after
from ..operators.joins import between_dates
from ..plans.calendar import report_calendar
from ..plans.origination import car_age
from ..plans.segments import age_group
from . import query
from .sql import columns, d, n, quoted, tally, x

# ---------------------------------------------------------------- projection


@query("project_rename", """
    SELECT c_custkey AS account, c_name AS borrower, c_mktsegment AS segment FROM customer""")
def project_rename(t):
    return t["customer"].select(F.col("c_custkey").alias("account"),
                                F.col("c_name").alias("borrower"), "c_mktsegment"
                                ).withColumnRenamed("c_mktsegment", "segment")


@query("literal_column", """
    SELECT o_orderkey, 'TOTAL' AS label, CAST(1 AS BIGINT) AS months_back, true AS flagged
    FROM orders""")
def literal_column(t):
    return t["orders"].select("o_orderkey", F.lit("TOTAL").alias("label"),
                              F.lit(1).alias("months_back"), F.lit(True).alias("flagged"))


@query("lateral_alias_ratio", "SELECT o_custkey, " + columns(
    x("sum(CAST(o_totalprice AS DECIMAL(14,2)))", "spent"),
    x("sum(CAST(o_totalprice AS DECIMAL(14,2))) FILTER (WHERE o_orderstatus = 'F')", "finished"),
    x("CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE)"
      " / CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE)", "share"),
) + " FROM orders GROUP BY o_custkey")
def lateral_alias_ratio(t):
    price = F.col("o_totalprice").cast("decimal(14,2)")
    sums = t["orders"].groupBy("o_custkey").agg(
        F.sum(price).alias("spent"),
        F.sum(F.when(F.col("o_orderstatus") == "F", price)).alias("finished"))
    return sums.withColumn("share", ratio(F.col("finished"), F.col("spent")))


@query("placeholder_cols", """
    SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS orders, CAST(NULL AS BIGINT) AS fraud
    FROM orders GROUP BY o_orderstatus""")
def placeholder_cols(t):
    return t["orders"].groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders")).withColumn(
        "fraud", placeholder())


# ---------------------------------------------------------------- predicates


@query("filter_compare", """
    SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_quantity < 10 AND NOT l_returnflag = 'N'
      AND l_discount <> 0""")
def filter_compare(t):
    return t["lineitem"].filter(
        (F.col("l_shipdate") >= F.lit(dt.date(1998, 1, 1)).cast("timestamp_ntz"))
        & (F.col("l_quantity") < 10) & ~(F.col("l_returnflag") == "N")
        & (F.col("l_discount") != 0)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("filter_in_list", """
    SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
      AND o_orderstatus NOT IN ('F', 'P')""")
def filter_in_list(t):
    return t["orders"].filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
                              & ~F.col("o_orderstatus").isin("F", "P")).select("o_orderkey")


@query("age_bands", """
    WITH a AS (SELECT account_id, 2020 - CAST(birth_year AS INT) AS age FROM customer_dim)
    SELECT account_id, CAST(age AS BIGINT) AS age,
           CASE WHEN age >= 50 THEN '50+' WHEN age >= 35 THEN '35-49' WHEN age >= 25 THEN '25-34'
                WHEN age >= 16 THEN '16-24' ELSE 'Unknown' END AS age_group FROM a""")
def age_bands(t):
    age = age_from_birth_year(F.col("birth_year"), 2020)
    return t["customer_dim"].select("account_id", age.alias("age"), age_group(age).alias("age_group"))


@query("null_predicates", "SELECT " + columns(
    n("count(*) FILTER (WHERE mileage IS NULL)", "no_mileage"),
    n("count(*) FILTER (WHERE mileage IS NOT NULL AND registration_date IS NULL)", "no_registration"),
    n("count(platform)", "with_platform")) + " FROM loan_agreements")
def null_predicates(t):
    mileage, registered = F.col("mileage"), F.col("registration_date")
    return t["loan_agreements"].agg(
        F.count_if(mileage.isNull()).alias("no_mileage"),
        F.count_if(mileage.isNotNull() & registered.isNull()).alias("no_registration"),
        F.count("platform").alias("with_platform"))


@query("ilike_filter", """
    SELECT action_id FROM action_log WHERE lower(description) LIKE '%vehicle have been sold%'""")
def ilike_filter(t):
    return t["action_log"].filter(F.col("description").ilike(V.SALE_PHRASE)).select("action_id")


@query("like_wildcard", """
    SELECT agreement_code, type FROM forbearance WHERE type LIKE '%Payment_Holiday%'""")
def like_wildcard(t):
    return t["forbearance"].filter(F.col("type").like("%Payment_Holiday%")).select(
        "agreement_code", "type")


@query("searched_case", """
    SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium'
                           ELSE 'large' END AS size_label,
           CASE p_type WHEN 'PROMO' THEN 'offer' END AS offer FROM part""")
def searched_case(t):
    size = F.col("p_size")
    return t["part"].select(
        "p_partkey",
        F.when(size < 10, "small").when(size < 30, "medium").otherwise("large").alias("size_label"),
        F.when(F.col("p_type") == "PROMO", "offer").alias("offer"))


@query("boolean_flags", "SELECT region, " + columns(
    n("count(*) FILTER (WHERE had_covid_ph)", "had"),
    n("count(*) FILTER (WHERE NOT had_covid_ph)", "had_not"),
    n("count(*) FILTER (WHERE had_covid_ph IS NULL)", "unknown"),
) + " FROM customer_dim GROUP BY region")
def boolean_flags(t):
    flag = F.col("had_covid_ph")
    return t["customer_dim"].groupBy("region").agg(
        F.count_if(flag).alias("had"), F.count_if(~flag).alias("had_not"),
        F.count_if(flag.isNull()).alias("unknown"))


@query("report_window_filter", """
    SELECT loan_application_id, CAST(created_date AS VARCHAR) AS created_date FROM funnel_summary
    WHERE created_date BETWEEN DATE '1998-02-01' AND DATE '1998-02-28'""")
def report_window_filter(t):
    run = report_calendar(dt.date(1998, 5, 1), offset=2)
    return between_dates(t["funnel_summary"], "created_date", run.prev_month_start,
                         run.prev_month_end).select("loan_application_id", "created_date")


# ---------------------------------------------------------------- dates


@query("last_day", "SELECT o_orderkey, " + d("last_day(CAST(o_orderdate AS DATE))", "month_end")
       + " FROM orders")
def last_day(t):
    return t["orders"].select("o_orderkey", F.last_day("o_orderdate").alias("month_end"))


CALENDAR_DAYS = (dt.date(1997, 12, 1), *(dt.date(1998, month, 1) for month in range(1, 6)))
BAD_SNAPSHOTS = (dt.date(1998, 2, 2), dt.date(1998, 3, 1))


@query("report_calendar", """
    WITH c AS (SELECT m, o, last_day(m - to_months(o)) AS rep_end, last_day(m - to_months(o + 1)) AS prev_end,
                      last_day(m - to_months(o + 2)) AS before
               FROM (SELECT DISTINCT month_end + 1 AS m FROM month_ends
                     WHERE month_end BETWEEN DATE '1997-11-30' AND DATE '1998-04-30') d,
                    (VALUES (1), (2)) AS s(o)),
    bad AS (SELECT list(CAST(b AS DATE)) AS days FROM (VALUES ('1998-02-02'), ('1998-03-01')) AS v(b))
    SELECT CAST(m AS VARCHAR) AS as_of, CAST(o AS BIGINT) AS months_back,
           CAST(before + 1 AS VARCHAR) AS prev_month_start, CAST(prev_end AS VARCHAR) AS prev_month_end,
           CAST(prev_end + 1 AS VARCHAR) AS rep_month_start, CAST(rep_end AS VARCHAR) AS rep_month_end,
           CAST(prev_end + 2 + CASE WHEN list_contains(days, prev_end + 2) THEN 1 ELSE 0 END AS VARCHAR)
             AS snapshot_start,
           CAST(rep_end + 1 + CASE WHEN list_contains(days, rep_end + 1) THEN 1 ELSE 0 END AS VARCHAR)
             AS snapshot_end
    FROM c, bad""")
def report_calendar_dates(t):
    """The library's calendar for the first of six months, one and two months back, two bad dates."""
    frames = [
        report_calendar(day, back, BAD_SNAPSHOTS).frame(t.spark).withColumn("months_back", F.lit(back))
        for day in CALENDAR_DAYS for back in (1, 2)]
    months = t["month_ends"].select(F.date_add("month_end", 1).alias("as_of"))
    return months.join(reduce(DataFrame.unionByName, frames), "as_of").select(
        "as_of", "months_back", "prev_month_start", "prev_month_end", "rep_month_start",
        "rep_month_end", "snapshot_start", "snapshot_end")


@query("shift_days", "SELECT o_orderkey, " + columns(
    d("CAST(o_orderdate AS DATE) + 1", "next_day"), d("CAST(o_orderdate AS DATE) - 10", "ten_before"),
    d("CAST(CAST(o_orderdate AS DATE) + INTERVAL 2 MONTH AS DATE)", "two_months_later")) + " FROM orders")
def shift_days(t):
    day = F.to_date("o_orderdate")
    return t["orders"].select("o_orderkey", F.date_add(day, 1).alias("next_day"),
                              F.date_sub(day, 10).alias("ten_before"),
                              F.add_months(day, 2).alias("two_months_later"))


@query("months_diff", "SELECT agreement_code, " + columns(
    n("date_diff('month', registration_date, contract_date)", "age_months"),
    n("date_diff('month', contract_end_date, contract_date)", "backward")) + " FROM loan_agreements")
def months_between_dates(t):
    return t["loan_agreements"].select(
        "agreement_code",
        months_diff(F.col("registration_date"), F.col("contract_date")).alias("age_months"),
        months_diff(F.col("contract_end_date"), F.col("contract_date")).alias("backward"))


@query("day_diff", "SELECT agreement_code, "
       + n("contract_end_date - contract_date", "days") + ", "
       + n("contract_date - DATE '2000-01-01'", "since_2000") + " FROM loan_agreements")
def day_diff(t):
    contract = F.col("contract_date")
    return t["loan_agreements"].select(
        "agreement_code", F.datediff("contract_end_date", contract).alias("days"),
        F.datediff(contract, F.lit(dt.date(2000, 1, 1))).alias("since_2000"))


@query("car_age_years", """
    SELECT agreement_code,
           CAST(CASE WHEN date_diff('month', registration_date, contract_date) = 0 THEN -1
                     ELSE (contract_date - registration_date) // 365 END AS BIGINT) AS car_age
    FROM loan_agreements""")
def car_age_years(t):
    return t["loan_agreements"].select(
        "agreement_code", car_age(F.col("registration_date"), F.col("contract_date")).alias("car_age"))


@query("truncate_day", "SELECT event_id, " + d("CAST(ts AS DATE)", "day") + " FROM events")
def truncate_day(t):
    return t["events"].select("event_id", F.to_date("ts").alias("day"))


@query("parse_date", "SELECT agreement_code, " + columns(
    d("CAST(dateat AS DATE)", "day"), d("try_cast(status AS DATE)", "not_a_day")) + " FROM event_history")
def parse_date_text(t):
    return t["event_history"].select("agreement_code", parse_date(F.col("dateat")).alias("day"),
                                     parse_date(F.col("status")).alias("not_a_day"))


@query("epoch_ms_to_date", "SELECT agreement_code, dateat, "
       + d("CAST(epoch_ms(contract_date_ms) AS DATE)", "contract_date") + " FROM status_history")
def epoch_to_date(t):
    return t["status_history"].select(
        "agreement_code", "dateat", epoch_ms_to_date(F.col("contract_date_ms")).alias("contract_date"))


@query("vintage_label", """
    SELECT agreement_code, strftime(contract_date, '%Y') || ' Q' ||
           CAST((month(contract_date) + 2) // 3 AS VARCHAR) AS vintage FROM loan_agreements""")
def vintage(t):
    return t["loan_agreements"].select("agreement_code", vintage_label(F.col("contract_date")).alias("vintage"))


@query("age_from_dob", "SELECT id, " + x(
    "CAST((DATE '1998-03-31' - date_of_birth) * 200 + 365 AS BIGINT) // 730 / 100.0", "age")
       + " FROM applicant")
def age_dob(t):
    return t["applicant"].select("id", age_from_dob(F.col("date_of_birth"), dt.date(1998, 3, 31)).alias("age"))


# ---------------------------------------------------------------- text


@query("locate_substring", "SELECT action_id, " + columns(
    n("strpos(description, '£')", "pound"), n("strpos(description, 'sold on ')", "sold"))
       + " FROM action_log")
def locate_substring(t):
    text = F.col("description")
    return t["action_log"].select("action_id", F.instr(text, "£").alias("pound"),
                                  F.instr(text, "sold on ").alias("sold"))


@query("extract_amount", "SELECT action_id, "
       + x("try_cast(nullif(regexp_extract(description, '.£([0-9]+)[.]', 1), '') AS DECIMAL(18,2))",
           "amount") + " FROM action_log")
def extract_amount(t):
    return t["action_log"].select("action_id", amount_between(F.col("description"), "£", ".").alias("amount"))


@query("extract_date", "SELECT action_id, "
       + d("try_cast(nullif(regexp_extract(description, '.sold on (.{10}) and ', 1), '') AS DATE)",
           "sold_on") + " FROM action_log")
def extract_date(t):
    return t["action_log"].select(
        "action_id", date_after(F.col("description"), "sold on ", " and ", 35).alias("sold_on"))


# ---------------------------------------------------------------- numbers


@query("arith", "SELECT l_orderkey, l_linenumber, " + columns(
    x("l_extendedprice * (1 - l_discount) + l_tax", "net"), x("l_extendedprice / 3", "unit"),
    x("-l_quantity", "negated")) + " FROM lineitem")
def arith(t):
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
    return t["lineitem"].select(
        "l_orderkey", "l_linenumber", (price * (1 - F.col("l_discount")) + F.col("l_tax")).alias("net"),
        (price / 3).alias("unit"), (-quantity).alias("negated"))


@query("int_div_buckets", "SELECT agreement_code, " + columns(
    d("date", "date"), n("days_in_arrears // (365 // 12)", "months_behind"),
    n("-days_in_arrears // 91", "quarters_negative")) + " FROM loan_timeline")
def int_div_buckets(t):
    days = F.col("days_in_arrears")
    return t["loan_timeline"].select(
        "agreement_code", "date", int_div(days, F.lit(365 // 12)).alias("months_behind"),
        int_div(-days, F.lit(91)).alias("quarters_negative"))


@query("round_avg", "SELECT p_brand, "
       + x("CAST((sum(p_size) * 200 + count(*)) AS BIGINT) // (2 * count(*)) / 100.0", "avg_size")
       + " FROM part GROUP BY p_brand")
def round_avg(t):
    return t["part"].groupBy("p_brand").agg(F.round(F.avg("p_size"), 2).alias("avg_size"))


@query("floor_two_dp", "SELECT introducer_id, "
       + x("floor(100 * avg(mileage)) / 100", "avg_mileage") + " FROM loan_agreements GROUP BY introducer_id")
def floor_two_dp(t):
    return t["loan_agreements"].groupBy("introducer_id").agg(
        floor_to(F.avg("mileage"), 2).alias("avg_mileage"))


@query("abs_months", "SELECT agreement_code, "
       + n("date_diff('month', registration_date, contract_date)", "age_months") + " FROM loan_agreements")
def abs_months(t):
    backward = months_diff(F.col("contract_date"), F.col("registration_date"))
    return t["loan_agreements"].select("agreement_code", F.abs(backward).alias("age_months"))


@query("coalesce_chain", "SELECT agreement_code, " + columns(
    n("CASE WHEN mileage IS NOT NULL THEN mileage WHEN introducer_id > 60 THEN introducer_id ELSE -1 END",
      "first_known")) + " FROM loan_agreements")
def coalesce_chain(t):
    introducer = F.col("introducer_id")
    return t["loan_agreements"].select("agreement_code", F.coalesce(
        "mileage", F.when(introducer > 60, introducer), F.lit(-1)).alias("first_known"))


@query("nullif_fallback", "SELECT agreement_code, " + columns(d("date", "date"), x(
    "CASE WHEN capital_balance <> 0 THEN capital_balance ELSE 1 END", "balance"))
       + " FROM forbearance_timeline")
def nullif_or(t):
    return t["forbearance_timeline"].select(
        "agreement_code", "date", nullif_fallback(F.col("capital_balance"), F.lit(1)).alias("balance"))


@query("greatest_least", "SELECT agreement_code, " + columns(
    d("greatest(contract_date, registration_date)", "later"),
    n("least(mileage, term, introducer_id)", "smallest")) + " FROM loan_agreements")
def greatest_least(t):
    return t["loan_agreements"].select(
        "agreement_code", F.greatest("contract_date", "registration_date").alias("later"),
        F.least("mileage", "term", "introducer_id").alias("smallest"))


@query("cast_types", "SELECT l_orderkey, l_linenumber, " + columns(
    n("CAST(floor(l_extendedprice) AS INTEGER) // 1000", "thousands"),
    x("CAST(l_extendedprice AS DECIMAL(14,2))", "money"),
    "CAST(l_linenumber AS VARCHAR) AS line_text", n("try_cast(l_returnflag AS BIGINT)", "not_a_number"))
       + " FROM lineitem")
def cast_types(t):
    price = F.col("l_extendedprice")
    return t["lineitem"].select(
        "l_orderkey", "l_linenumber",
        int_div(F.floor(price).cast("int"), F.lit(1000)).alias("thousands"),
        price.cast("decimal(14,2)").alias("money"),
        F.col("l_linenumber").cast("string").alias("line_text"),
        F.col("l_returnflag").try_cast("bigint").alias("not_a_number"))


@query("sentinel_null", "SELECT credit_search_id, "
       + x("CASE WHEN full_debt_tm NOT LIKE '{%' THEN CAST(full_debt_tm AS DECIMAL(12,2)) END", "debt")
       + " FROM bureau_response")
def sentinel_null(t):
    return t["bureau_response"].select(
        "credit_search_id", clean_numeric(F.col("full_debt_tm"), V.BUREAU_SENTINELS).alias("debt"))


@query("safe_ratio", "SELECT agreement_code, " + x(
    "CASE WHEN mileage > 0 THEN CAST(introducer_id AS DOUBLE) / CAST(mileage AS DOUBLE) END", "per_mile")
       + " FROM loan_agreements")
def guarded_ratio(t):
    return t["loan_agreements"].select(
        "agreement_code", safe_ratio(F.col("introducer_id").cast("double"),
                                     F.col("mileage").cast("double")).alias("per_mile"))


@query("value_lookup", f"""
    SELECT id, CASE WHEN fuel_type IN ({quoted(V.PETROL)}) THEN 'petrol'
                    WHEN fuel_type IN ({quoted(V.DIESEL)}) THEN 'diesel' ELSE 'neither' END AS fuel
    FROM opportunity""")
def value_lookup(t):
    return t["opportunity"].select("id", lookup(F.col("fuel_type"), [
        (V.PETROL, "petrol"), (V.DIESEL, "diesel")], "neither").alias("fuel"))
