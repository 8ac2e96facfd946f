"""Domain tables derived from the order-and-lineitem test tables.

Each entry is one SELECT over the test tables or over earlier entries, in SQL that Spark
and ANSI engines read alike, so the same inputs can be rebuilt elsewhere for checking.
Only ``timeline_base`` differs per engine (see there). All arithmetic that decides a
value is integer or decimal arithmetic, so engines agree to the last digit.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Tables

#: Timeline rows that one task makes, and later sorts in memory.
PART_ROWS = 1_000_000

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _bands(column: str, edges: str = "60 63 66 69 72 75") -> str:
    labels = ("Up-to-Date", "0-Down", "1-Down", "2-Down", "3-Down", "4-Down")
    whens = " ".join(f"WHEN {column} < {e} THEN '{lab}'" for e, lab in zip(edges.split(), labels))
    return f"CASE {whens} ELSE '5+ Down' END"


def _pick(index: str, values: list[str | None]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1]) if v is not None)
    nulls = " ".join(f"WHEN {i} THEN NULL" for i, v in enumerate(values[:-1]) if v is None)
    last = "NULL" if values[-1] is None else f"'{values[-1]}'"
    return f"CASE {index} {whens} {nulls} ELSE {last} END"


def _money(expression: str) -> str:
    return f"CAST({expression} AS DECIMAL(14,2))"


# Spark generates the month ends of each agreement's life instead of a range join.
TIMELINE_BASE_SPARK = """
    SELECT agreement_code, contract_date, date, total_finance_amount, m, mob,
           ((agreement_code % 1009 + 1) * (m % 1013) * ((m + agreement_code) % 97 + 1))
             % 10007 % 100 AS h
    FROM (SELECT agreement_code, contract_date, contract_end_date, total_finance_amount, mob,
                 first_month + mob AS m, last_day(add_months(contract_date, mob)) AS date
          FROM (SELECT agreement_code, contract_date, contract_end_date, total_finance_amount,
                       year(contract_date) * 12 + month(contract_date) AS first_month,
                       year(contract_end_date) * 12 + month(contract_end_date) AS final_month
                FROM loan_agreements) la
          LATERAL VIEW explode(sequence(0, final_month - first_month)) AS mob) b
    JOIN month_ends ON month_end = date
    WHERE date <= contract_end_date
"""

TIMELINE_BASE_ANSI = """
    SELECT b.agreement_code, b.contract_date, b.date, b.total_finance_amount, b.m,
           b.m - (year(b.contract_date) * 12 + month(b.contract_date)) AS mob,
           ((b.agreement_code % 1009 + 1) * (b.m % 1013) * ((b.m + b.agreement_code) % 97 + 1))
             % 10007 % 100 AS h
    FROM (SELECT agreement_code, contract_date, total_finance_amount, month_end AS date,
                 year(month_end) * 12 + month(month_end) AS m
          FROM loan_agreements
          JOIN month_ends ON month_end BETWEEN contract_date AND contract_end_date) b
"""

DERIVED: dict[str, tuple[tuple[str, ...], str]] = {
    "month_ends": (("orders",), """
        SELECT DISTINCT last_day(CAST(o_orderdate AS DATE)) AS month_end FROM orders"""),
    "loan_agreements": (("orders",), f"""
        SELECT o_orderkey AS agreement_code, o_orderkey AS opportunity_id,
               o_custkey AS main_borrower_account_id, o_orderkey % 120 AS introducer_id,
               CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 6 = 1 THEN 'DTC'
                    ELSE 'POS' END AS platform,
               CAST(o_orderdate AS DATE) AS contract_date,
               CAST(o_orderdate AS DATE) + CAST(365 * (1 + o_orderkey % 5) AS INT)
                 AS contract_end_date,
               CASE WHEN o_orderkey % 40 <> 0
                    THEN CAST(o_orderdate AS DATE) - CAST((o_orderkey * 37) % 5000 AS INT)
               END AS registration_date,
               CAST(12 * (1 + o_orderkey % 5) AS INT) AS term,
               {_money("o_totalprice")} AS total_finance_amount,
               {_money(_money("o_totalprice") + " + o_orderkey % 5000")} AS total_payable,
               CASE WHEN o_orderkey % 50 <> 0
                    THEN {_money("floor(o_totalprice * 100 / (60 + o_orderkey % 60))")} END
                 AS current_retail_value,
               CASE WHEN o_orderkey % 25 <> 0 THEN (o_orderkey * 7919) % 130000 END AS mileage,
               'REG' || CAST(o_orderkey AS STRING) AS registration,
               'VIN' || CAST(o_orderkey AS STRING) AS vin
        FROM orders"""),
    "dealer_dim": (("supplier",), """
        SELECT s_suppkey AS dealer_id, """ + _pick("s_suppkey % 7", [
            "Car Supermarket", "Franchise Dealer", "Independent Dealer", "Broker",
            "Lead Generator", "Online Broker", "DTC"]) + """ AS introducer_category
        FROM supplier"""),
    "customer_dim": (("customer", "nation", "region"), """
        SELECT c_custkey AS account_id, 'Given' || CAST(c_custkey AS STRING) AS first_name,
               c_name AS last_name,
               CASE WHEN n_nationkey <> 0 THEN r_name END AS region,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'SELF EMPLOYED'
                    WHEN 'FURNITURE' THEN 'Retired' WHEN 'HOUSEHOLD' THEN NULL
                    ELSE 'EMPLOYED' END AS employment_status,
               CAST(1940 + c_custkey % 66 AS STRING) AS birth_year,
               CASE WHEN c_custkey % 11 <> 0 THEN c_custkey % 3 = 0 END AS had_covid_ph,
               c_custkey % 13 = 0 AS is_vulnerable, c_custkey % 29 = 0 AS is_with_solicitors,
               CAST(c_custkey % 7 AS INT) AS total_months_of_forbearance
        FROM customer JOIN nation ON n_nationkey = c_nationkey
                      JOIN region ON r_regionkey = n_regionkey"""),
    "timeline_base": (("loan_agreements", "month_ends"), TIMELINE_BASE_SPARK),
    "loan_timeline": (("timeline_base",), f"""
        SELECT agreement_code, date, contract_date,
               CASE WHEN h < 85 THEN 'AG_LIVE_PRIMARY' WHEN h < 96 THEN 'AG_REPO'
                    ELSE 'AG_CLOSED' END AS status_code,
               {_money("total_finance_amount - 10 * mob")} AS capital_balance,
               {_money("CASE WHEN h < 60 THEN 0 ELSE (h - 59) * 25 END")} AS arrears,
               {_money("CASE WHEN h < 62 THEN 0 ELSE (h - 61) * 20 END")} AS arrears_yesterday,
               CAST(CASE WHEN h < 60 THEN 0 ELSE (h - 59) * 10 END AS INT) AS days_in_arrears,
               CAST(CASE WHEN h < 70 THEN 0 ELSE (h - 69) * 14 END AS INT)
                 AS holiday_adjusted_days_in_arrears,
               {_bands("h")} AS arrears_status,
               {_bands("(h + 7) % 100")} AS arrears_status_last_payment_date,
               {_bands("(h * 7 + 3) % 100")} AS payment_reduction_adjusted_arrears_status,
               CASE WHEN (agreement_code + m) % 17 <> 0
                    THEN CAST((agreement_code + m) % 11 AS INT) END
                 AS days_since_last_payment_date,
               (agreement_code + m) % 9 = 0 AS payment_holiday,
               h < 96 AS is_live, h = 96 AS is_vt, h > 96 AND h < 99 AS is_defaulted,
               h = 99 AS is_settled,
               CAST(mob - (CASE WHEN h < 60 THEN 0 ELSE 1 END) AS INT) AS instalments_satisfied,
               {_money("mob * 100")} AS cash_transactions_cumulative,
               {_money("100 + agreement_code % 50")} AS payment,
               {_money("(agreement_code % 997) * 3")} AS interest_payable
        FROM timeline_base"""),
    "provision_timeline": (("timeline_base",), f"""
        SELECT agreement_code, date, scenario, state, provision_held,
               lag(scenario) OVER (PARTITION BY agreement_code ORDER BY date)
                 AS previous_scenario,
               lag(state) OVER (PARTITION BY agreement_code ORDER BY date) AS previous_state,
               lag(provision_held) OVER (PARTITION BY agreement_code ORDER BY date)
                 AS previous_provision_held
        FROM (SELECT agreement_code, date,
                     CASE WHEN h < 80 THEN 'live' WHEN h < 90 THEN 'covid'
                          ELSE 'terminated' END AS scenario,
                     CAST(CASE WHEN h % 10 < 5 THEN h % 10 WHEN h % 10 = 9 THEN 9999
                               WHEN h % 10 = 8 THEN 9001 ELSE 5 END AS BIGINT) AS state,
                     {_money("(agreement_code % 997 + 1) * h")} AS provision_held
              FROM timeline_base) p"""),
    "status_history": (("timeline_base",), f"""
        SELECT agreement_code, CAST(date + 1 AS STRING) AS dateat,
               CASE WHEN h < 85 THEN 'AG_LIVE_PRIMARY' WHEN h < 88 THEN 'AG_REPO'
                    WHEN h < 91 THEN 'AG_REPO_SHORTFALL' WHEN h < 93 THEN 'AG_VT_CRYSTALISED'
                    WHEN h < 95 THEN 'AG_REPO_CRYSTALISED'
                    WHEN h < 97 THEN 'AG_INSURANCE SHORTFALL' WHEN h < 98 THEN 'AG_WRITTEN_OFF'
                    ELSE 'AG_CLOSED' END AS status,
               {_money("CASE WHEN h < 60 THEN 0 ELSE (h - 59) * 25 END")} AS arrears_value,
               {_money("total_finance_amount - 10 * mob")} AS capital_outstanding,
               {_money("100")} AS payment,
               788918400000 + (agreement_code % 2400) * 86400000 AS contract_date_ms
        FROM timeline_base"""),
    "event_history": (("events",), f"""
        SELECT user_id AS agreement_code, CAST(day AS STRING) AS dateat,
               CASE event_type WHEN 'purchase' THEN 'AG_REPO' WHEN 'error' THEN 'AG_REPO_SHORTFALL'
                    WHEN 'signup' THEN 'AG_INSURANCE SHORTFALL' ELSE 'AG_LIVE_PRIMARY' END
                 AS status,
               {_money("CASE WHEN event_id % 3 = 0 THEN 0 ELSE value * 5 END")} AS arrears_value,
               {_money("5000 - user_id * 10")} AS capital_outstanding,
               {_money("50 + user_id % 50")} AS payment
        FROM (SELECT *, CAST(ts AS DATE) AS day,
                     row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE)
                                        ORDER BY ts DESC, event_id DESC) AS newest
              FROM events) e
        WHERE newest = 1"""),
    "settlements_and_defaults": (("lineitem",), f"""
        SELECT agreement_code, """ + _pick("(agreement_code + shift) % 5", [
            "Settlement", "Unwind", "VT", "VT - Default", "Default"]) + """ AS type,
               last_day(first_ship) + 1 AS date, last_day(first_ship) + 6 AS processed_date,
               last_day(first_ship) + 2 AS crm_date, last_day(first_ship) + 3 AS ledger_date,
               amount
        FROM (SELECT l_orderkey AS agreement_code,
                     CASE WHEN l_linestatus = 'F' THEN 0 ELSE 2 END AS shift,
                     min(CAST(l_shipdate AS DATE)) AS first_ship,
                     CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DECIMAL(18,2)) AS amount
              FROM lineitem WHERE l_returnflag = 'R'
              GROUP BY l_orderkey, l_linestatus) s"""),
    "forbearance": (("lineitem",), """
        SELECT l_orderkey AS agreement_code, """ + _pick("l_linenumber % 4", [
            "Payment Holiday", "Retrospective Payment Holiday", "Payment Reduction",
            "Additional Payment Holiday"]) + """ AS type,
               CASE WHEN l_linestatus = 'F' THEN 'Agreed' WHEN l_quantity < 25 THEN 'Expired'
                    ELSE 'Declined' END AS status, """ + _pick("l_suppkey % 3", [
            "Completed", "Reviewed", "Open"]) + """ AS booking_status,
               last_day(CAST(l_shipdate AS DATE)) - (l_linenumber % 5) AS created_date,
               last_day(CAST(l_shipdate AS DATE)) AS start_date,
               last_day(CAST(l_shipdate AS DATE) + 62) AS end_date
        FROM lineitem WHERE l_returnflag = 'A'"""),
    "funding_entity": (("timeline_base",), """
        SELECT agreement_code, date,
               CASE WHEN agreement_code % 4 = 3 THEN 'OTHER'
                    ELSE 'COMMITTED_' || CAST(agreement_code % 4 AS STRING) END
                 AS current_funding_entity
        FROM timeline_base"""),
    "forbearance_timeline": (("timeline_base",), f"""
        SELECT agreement_code, agreement_code AS loan_id, date,
               {_money("CASE WHEN h < 94 THEN total_finance_amount - 10 * mob ELSE 0 END")}
                 AS capital_balance,
               h < 94 AS is_live, h >= 94 AND h < 96 AS is_settled,
               h >= 96 AND h < 98 AS is_defaulted, h >= 98 AS is_vt,
               CAST(CASE WHEN h < 60 THEN 0 ELSE (h - 55) % 8 END AS INT) AS payments_down,
               agreement_code % 3 = 0 AS has_application,
               agreement_code % 2 = 0 AND h < 20 AS in_initial_forbearance,
               agreement_code % 2 = 0 AS has_initial_forbearance,
               agreement_code % 2 = 0 AND h < 40 AS in_forbearance,
               last_day(contract_date + 31) AS initial_forbearance_start_date,
               last_day(contract_date + 31) + 90 AS initial_forbearance_end_date,
               date = last_day(contract_date + 31) AS initial_forbearance_start,
               date = last_day(last_day(contract_date + 31) + 90) AS initial_forbearance_end,
               h % 5 = 0 AS payment_since_forbearance,
               CAST(h % 4 AS INT) AS payments_down_end_of_initial_forbearance,
               CASE WHEN h < 94 THEN 'open' ELSE 'closed' END AS status,
               {_bands("h", "60 70 80 85 90 90")} AS arrears_status
        FROM timeline_base"""),
    "case_notes": (("lineitem",), """
        SELECT l_orderkey AS agreement_code, """ + _pick("l_suppkey % 4", [
            "Retail", "Hospitality", "Transport", None]) + """ AS employment_industry, """
        + _pick("l_partkey % 3", ["Furloughed", "Redundant", "None"]) + """ AS employment_impact
        FROM lineitem WHERE l_returnflag = 'N'"""),
    "applications": (("orders",), f"""
        SELECT o_orderkey AS application_id,
               CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 6 = 1 THEN 'DTC'
                    ELSE 'POS' END AS platform,
               o_orderkey % 120 AS introducer_id,
               CASE o_orderstatus WHEN 'O' THEN 'Closed - Declined' WHEN 'F' THEN 'Funded'
                    ELSE 'In Progress' END AS stage_name,
               CASE WHEN o_orderkey % 13 <> 0 THEN {_money("o_totalprice")} END
                 AS total_finance_amount,
               CAST(o_orderdate AS DATE) + 5 AS closed_date
        FROM orders"""),
    "funnel_summary": (("orders",), """
        SELECT o_orderkey AS loan_application_id, CAST(o_orderdate AS DATE) AS created_date,
               CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS auto_accept,
               CASE WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 1 ELSE 0 END
                 AS auto_decline,
               CASE WHEN o_orderkey % 20 = 0 THEN NULL WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END
                 AS auto_refer,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END
                 AS underwriter_accept,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 'EX' ELSE 'TU' END
                 AS credit_search_provider,
               o_orderkey % 97 = 0 AS test_application_flag,
               CAST((o_orderkey * 13) % 60000 AS DECIMAL(12,2)) AS affordability_gross_salary,
               CAST((o_orderkey * 7) % 900 AS DECIMAL(12,2)) AS max_monthly_allowance,
               CAST(o_orderkey % 2 AS INT) AS score_decline,
               CAST(o_orderkey % 3 % 2 AS INT) AS policy_decline,
               CAST(o_orderkey % 5 % 2 AS INT) AS affordability_fail,
               CAST(o_orderkey % 7 % 2 AS INT) AS manual_override
        FROM orders"""),
    "opportunity": (("orders",), f"""
        SELECT o_orderkey AS id, {_money(_money("o_totalprice") + " + 100")} AS finance_amount,
               CASE WHEN o_orderkey % 30 = 0 THEN NULL
                    WHEN o_orderkey % 8 = 0 THEN 'Light Commercial Vehicle' ELSE 'Hatchback' END
                 AS vehicle_name,
               """ + _pick("o_orderkey % 16", [
            "PETROL", "Petrol", "DIESEL", "Diesel", "Petrol/Electric", "Diesel/Electric",
            "HYB-PETROL", "PETROL/ELE", "HYB-DIESEL", "ELECTRIC", "Electric (Battery)",
            "PETROL/GAS", "GAS PETROL", "UNKNOWN", None, "HYDROGEN"]) + """ AS fuel_type,
               CASE WHEN o_orderkey % 25 <> 0 THEN (o_orderkey * 7919) % 130000 END AS mileage
        FROM orders"""),
    "opportunity_history": (("orders",), """
        SELECT o_orderkey AS id,
               CASE WHEN o_orderkey % 8 = 0 THEN 'Light Commercial Vehicle' ELSE 'Hatchback' END
                 AS vehicle_name,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'PETROL'
                    ELSE 'STEAM' END AS fuel_type
        FROM orders"""),
    "opportunity_link": (("orders",), """
        SELECT o_orderkey AS opportunity_id, o_custkey AS account_id,
               'A' || CAST(o_orderkey AS STRING) AS applicant_id,
               CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN NULL
                    ELSE 'L' || CAST(o_orderkey AS STRING) END AS loan_id,
               CASE WHEN o_orderkey % 33 = 0 THEN 'Duplicate' END AS exclusion_reason,
               CAST(o_orderdate AS DATE) - 10 AS created_date
        FROM orders"""),
    "applicant": (("orders",), """
        SELECT 'A' || CAST(o_orderkey AS STRING) AS id,
               CASE WHEN o_orderkey % 45 <> 0 THEN CAST(18 + (o_orderkey * 37) % 62 AS INT) END
                 AS current_age,
               DATE '1925-01-01' + CAST((o_orderkey * 97) % 18000 AS INT) AS date_of_birth
        FROM orders"""),
    "residence": (("customer",), """
        SELECT c_custkey AS applicant_id, """ + _pick("c_custkey % 9", [
            "Home Owner", "Private Tenant", "Council Tenant", "Other Tenant", "Lodging",
            "Live With Parents", "HM Forces", "Not Declared", None]) + """ AS status,
               CASE WHEN c_custkey % 4 <> 0 THEN 1 ELSE 0 END AS is_current,
               DATE '1994-01-01' + CAST(c_custkey % 300 AS INT) AS created_date
        FROM customer
        UNION ALL
        SELECT c_custkey, 'Home Owner', 1, DATE '1995-01-01' FROM customer WHERE c_acctbal < 0"""),
    "income_summary": (("orders",), """
        SELECT o_orderkey AS loan_application_id,
               CASE WHEN o_orderkey % 14 <> 0 THEN (o_orderkey * 41) % 180000 END
                 AS gross_annual_income
        FROM orders"""),
    "account": (("customer",), """
        SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'Self-Employed'
                    WHEN 'FURNITURE' THEN 'Retired' WHEN 'HOUSEHOLD' THEN 'Unemployed'
                    WHEN 'MACHINERY' THEN 'Director' ELSE 'EMPLOYED' END AS employment_status,
               c_custkey % 20 <> 0 AS is_person
        FROM customer
        UNION ALL
        SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Self-Employed'
                    WHEN 'FURNITURE' THEN 'Retired' WHEN 'HOUSEHOLD' THEN 'Unemployed'
                    WHEN 'MACHINERY' THEN 'Director' ELSE 'EMPLOYED' END, true
        FROM customer WHERE c_acctbal < 0"""),
    "account_address": (("customer",), """
        SELECT c_custkey AS id, 'House ' || CAST(c_custkey AS STRING) AS current_address
        FROM customer"""),
    "action_log": (("orders",), f"""
        SELECT o_orderkey AS action_id, o_custkey AS contact_id,
               CAST(last_day(CAST(o_orderdate AS DATE)) + 1 AS TIMESTAMP) AS created_at,
               CASE o_orderkey % 4
                    WHEN 0 THEN 'Vehicle Disposal Record created'
                    WHEN 1 THEN 'The vehicle have been sold on '
                      || CAST(last_day(CAST(o_orderdate AS DATE)) + 1 AS STRING)
                      || ' and proceeds of £' || CAST({_money("o_totalprice")} AS STRING)
                      || ' received'
                    WHEN 2 THEN 'The vehicle have been sold, no detail'
                    ELSE 'call' END AS description,
               CASE WHEN o_orderkey % 9 = 0 THEN 'Loan Terminated' ELSE 'Note' END AS name
        FROM orders"""),
    "contact": (("customer",), """
        SELECT c_custkey AS id, 'ACC' || CAST(c_custkey AS STRING) AS account_id FROM customer"""),
    "loan_link": (("orders",), """
        SELECT 'ACC' || CAST(o_custkey AS STRING) AS main_borrower,
               o_orderkey AS agreement_code FROM orders"""),
    "vehicle_list": (("orders",), """
        SELECT CASE WHEN o_orderkey % 5 <> 0 THEN 'VIN' || CAST(o_orderkey AS STRING) END AS VIN,
               'REG' || CAST(o_orderkey AS STRING) AS VRM
        FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority IN ('1-URGENT', '2-HIGH')
        UNION ALL
        SELECT 'VIN' || CAST(o_orderkey AS STRING), 'REG' || CAST(o_orderkey AS STRING)
        FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '2-HIGH'"""),
    "pipeline_last": (("orders",), """
        SELECT o_orderkey AS external_ref, 'P' || CAST(o_orderkey AS STRING) AS pipeline_uuid,
               CAST(o_orderdate AS DATE) - 9 AS created_at FROM orders"""),
    "credit_search_requests": (("orders",), """
        SELECT 'P' || CAST(o_orderkey AS STRING) AS pipeline_uuid,
               'C' || CAST(o_orderkey AS STRING) AS credit_search_id FROM orders"""),
    "bureau_response": (("orders",), """
        SELECT 'C' || CAST(o_orderkey AS STRING) AS credit_search_id,
               CASE WHEN o_orderkey % 10 = 0 THEN '{ND}' WHEN o_orderkey % 10 = 1 THEN '{OB}'
                    ELSE CAST(o_orderkey % 9000 AS STRING) END AS full_debt_tm,
               o_orderkey % 4 AS public_both_gd, o_orderkey % 3 AS public_both_hd,
               o_orderkey % 2 AS public_both_kd, o_orderkey % 5 AS public_both_ld,
               CAST(o_orderdate AS DATE) - CAST(o_orderkey % 700 AS INT) AS public_both_od,
               o_orderkey % 6 AS partial_both_or, o_orderkey % 800 AS partial_both_rr,
               o_orderkey % 7 AS partial_both_vr, o_orderkey % 8 AS partial_both_tpb,
               300 + o_orderkey % 500 AS score_main_jf
        FROM orders"""),
    "credit_score_summary": (("orders",), """
        SELECT o_orderkey AS application_id, 400 + o_orderkey % 200 AS internal_score_a,
               500 + o_orderkey % 300 AS internal_score_b FROM orders"""),
    "global_search": (("orders",), """
        SELECT 'G' || CAST(o_orderkey AS STRING) AS id, o_orderkey AS opportunity_id
        FROM orders WHERE o_orderstatus <> 'P'"""),
    "retro_public": (("orders",), """
        SELECT 'G' || CAST(o_orderkey AS STRING) AS global_search_id, o_orderkey % 4 AS both_gd,
               o_orderkey % 3 AS both_hd, o_orderkey % 2 AS both_kd, o_orderkey % 5 AS both_ld,
               CAST(o_orderdate AS DATE) - CAST(o_orderkey % 700 AS INT) AS both_od
        FROM orders WHERE o_orderpriority <> '5-LOW'"""),
    "retro_partial": (("orders",), """
        SELECT 'G' || CAST(o_orderkey AS STRING) AS global_search_id, o_orderkey % 6 AS both_or,
               o_orderkey % 800 AS both_rr, o_orderkey % 7 AS both_vr, o_orderkey % 8 AS both_tpb
        FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED'"""),
    "retro_score": (("orders",), """
        SELECT 'G' || CAST(o_orderkey AS STRING) AS global_search_id,
               300 + o_orderkey % 500 AS main_jf FROM orders"""),
}


def needed(names: tuple[str, ...] | list[str]) -> list[str]:
    """The derived tables behind ``names``, each after those it reads."""
    out: list[str] = []

    def visit(name: str) -> None:
        if name in DERIVED and name not in out:
            for parent in DERIVED[name][0]:
                visit(parent)
            out.append(name)

    for name in names:
        visit(name)
    return out


class DriverTables(Tables):
    """Domain tables computed by Spark from ``<folder>/<table>.parquet``."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark)
        self.folder = folder.rstrip("/")
        self._parts: int | None = None

    #: Stored results by application, folder and name.
    _shared: dict[tuple[str, str, str], DataFrame] = {}

    def shared(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """What ``make`` returned when this session first asked for ``name`` over this folder."""
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in self._shared:
            self._shared[key] = make()
        return self._shared[key]

    def _names(self) -> list[str]:
        return [*RAW, *DERIVED]

    def _read(self, name: str) -> DataFrame:
        if name in RAW:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        sources, select = DERIVED[name]
        frames = {source: self[source] for source in sources}
        if name == "timeline_base":
            # one row per calendar month: small by nature, whatever the number of orders
            frames["month_ends"] = frames["month_ends"].hint("broadcast")
            # rows that multiply are dealt out first, to a stated number of partitions: adaptive
            # execution would join small ones before they grow
            frames["loan_agreements"] = frames["loan_agreements"].repartition(
                self.timeline_parts(), "agreement_code")
        return run_select(self.spark, select, frames)

    def timeline_parts(self) -> int:
        """Partitions of the timelines: one a core, and more where those would hold too many rows.

        The rows to be made are counted from the lengths of the agreements, by one pass over them.
        """
        if self._parts is None:
            months = F.abs(F.months_between("contract_end_date", "contract_date")) + 1
            rows = self["loan_agreements"].agg(F.sum(months)).first()[0] or 0
            self._parts = max(self.spark.sparkContext.defaultParallelism, ceil(rows / PART_ROWS))
        return self._parts


def run_select(spark: SparkSession, select: str, frames: dict[str, DataFrame]) -> DataFrame:
    """Run a SELECT whose table names stand for DataFrames."""
    for name, frame in frames.items():
        frame.createOrReplaceTempView(f"ledgerlens_{name}")
        select = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 ledgerlens_{name} AS {name}", select)
    return spark.sql(select)
