"""The reports, at dates that suit the test tables."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace
from functools import reduce

from pyspark.sql import functions as F

from .. import values as V
from ..plans import (
    bureau, checks, forbearance, holidays, matching, origination, provision, regulatory, segments, stock)
from ..plans.calendar import report_calendar
from ..sources.tables import materialize
from . import query
from .sql import columns, d, n, quoted, tally as sql_tally, tally0, total, total0, x

BAD_SNAPSHOTS = [dt.date(1997, 6, 1)]
# The derived history holds first-of-month snapshots only, so the opening one is a day earlier.
CALENDAR = replace(report_calendar(dt.date(1998, 5, 1), offset=2, bad_dates=BAD_SNAPSHOTS),
                   snapshot_start=dt.date(1998, 3, 1))
MONTH = CALENDAR.rep_month_end
INSURANCE_SINCE = dt.date(1996, 1, 1)

# ---------------------------------------------------------------- origination

CHANNEL_SQL = """
    SELECT application_id,
           CASE WHEN platform = 'POS'
                THEN CASE introducer_category
                          WHEN 'Broker' THEN '4. Non-Internet Broker'
                          WHEN 'Lead Generator' THEN '4. Non-Internet Broker'
                          WHEN 'Online Broker' THEN '1. Aggregator'
                          WHEN 'DTC' THEN '2. DTC' ELSE '3. Dealer' END
                WHEN 'DTC' IN (platform, introducer_category) THEN '2. DTC'
                ELSE '5. Other' END AS introducer_channel
    FROM applications LEFT JOIN dealer_dim ON dealer_id = introducer_id"""


@query("introducer_channel", CHANNEL_SQL)
def introducer_channel(t):
    return origination.introducer_channel(t["applications"], t["dealer_dim"])


REFERRED = "auto_refer IS DISTINCT FROM 0"
FUNNEL_METRICS = {
    "app_vol": ("n", "count(*)"),
    "app_val": ("x", "sum(finance_amount)"),
    "auto_accept": ("n", "sum(auto_accept)"),
    "auto_declines": ("n", sql_tally(
        "CASE credit_search_provider WHEN 'TU' THEN auto_decline = 1 "
        "ELSE auto_accept + auto_refer = 0 END")),
    "auto_refer": ("n", f"count(*) FILTER (WHERE {REFERRED})"),
    "manual_acc": ("n", sql_tally(f"{REFERRED} AND underwriter_accept = 1")),
    "manual_dec": ("n", sql_tally(f"{REFERRED} AND underwriter_accept = 0")),
    "manual_pend": ("n", sql_tally(f"{REFERRED} AND underwriter_accept IS NULL")),
    "final_accepts": ("n", "sum(underwriter_accept)"),
    "final_accept_amt": ("x", total("underwriter_accept = 1", "finance_amount")),
    "final_declines": ("n", "count(*) FILTER (WHERE underwriter_accept = 0)"),
    "final_pending": ("n", "count(*) - count(underwriter_accept)"),
    "new_business": ("n", sql_tally("total_finance_amount > 0")),
    "new_business_amt": ("x", "sum(total_finance_amount)"),
}


def _funnel_sql(grouping: str, label: str, where: str) -> str:
    metrics = columns(*[(n if kind == "n" else x)(sql, name)
                        for name, (kind, sql) in FUNNEL_METRICS.items()])
    return f"""
    WITH channel AS ({CHANNEL_SQL}),
    rows AS (SELECT f.*, last_day(created_date) AS month, introducer_channel, finance_amount,
                    total_finance_amount
             FROM funnel_summary f
             LEFT JOIN channel c ON c.application_id = f.loan_application_id
             LEFT JOIN loan_agreements la ON la.opportunity_id = f.loan_application_id
             LEFT JOIN opportunity o ON o.id = f.loan_application_id
             WHERE created_date BETWEEN DATE '1998-02-01' AND DATE '1998-02-28' {where})
    SELECT CAST(month AS VARCHAR) AS month_end, {label} {metrics}
    FROM rows GROUP BY {grouping}"""


@query("application_funnel", _funnel_sql(
    "GROUPING SETS ((month, introducer_channel), (month))",
    "CASE WHEN grouping(introducer_channel) = 1 THEN 'TOTAL' ELSE introducer_channel END"
    " AS introducer_channel,", "AND NOT test_application_flag"))
def application_funnel(t):
    return origination.application_funnel(t, CALENDAR.prev_month_start, CALENDAR.prev_month_end)


@query("application_funnel_unsplit", _funnel_sql("month", "", ""))
def application_funnel_unsplit(t):
    return origination.application_funnel(t, CALENDAR.prev_month_start, CALENDAR.prev_month_end,
                                          by_channel=False, drop_test=False)


IN_MONTH = "contract_date BETWEEN DATE '1998-03-01' AND DATE '1998-03-31'"


def _age_months(later: str = "contract_date") -> str:
    return f"date_diff('month', registration_date, {later})"


def _profile_rows(age: str) -> str:
    return f"""
    WITH homes AS (SELECT opportunity_id, status AS home FROM residence
                   JOIN opportunity_link k ON k.account_id = residence.applicant_id WHERE is_current = 1),
    funded AS (SELECT * FROM opportunity_link WHERE exclusion_reason IS NULL AND loan_id IS NOT NULL),
    people AS (SELECT DISTINCT id, employment_status AS job FROM account WHERE is_person),
    rows AS (
        SELECT la.*, home, job, introducer_category AS category, o.vehicle_name AS vehicle,
               o.fuel_type AS fuel, h.fuel_type AS old_fuel, gross_annual_income AS income,
               {age} AS age, {_age_months()} AS age_months,
               CASE WHEN {_age_months()} = 0 THEN -1
                    ELSE (contract_date - registration_date) // 365 END AS car_years
        FROM loan_agreements la
        LEFT JOIN homes USING (opportunity_id)
        LEFT JOIN funded f ON f.opportunity_id = la.opportunity_id
        LEFT JOIN income_summary i ON i.loan_application_id = f.opportunity_id
        LEFT JOIN applicant a ON a.id = f.applicant_id
        LEFT JOIN people ON people.id = main_borrower_account_id
        LEFT JOIN dealer_dim ON dealer_id = la.introducer_id
        LEFT JOIN opportunity o ON o.id = la.opportunity_id
        LEFT JOIN opportunity_history h ON h.id = la.opportunity_id
        WHERE {IN_MONTH})"""


FUELS = {"petrol": V.PETROL, "diesel": V.DIESEL, "hybrid": V.HYBRID, "electric": V.ELECTRIC,
         "lpg": V.LPG}


def _steps(column: str, prefix: str, edges: list[int], unit: str = "", scale: int = 1) -> dict[str, str]:
    """Half-open ranges cut at ``edges``, the last one open-ended."""
    out = {}
    for low, high in zip([None, *edges], edges):
        above = "" if low is None else f"{column} >= {low} AND "
        out[f"{prefix}lt{high // scale}{unit}"] = f"{above}{column} < {high}"
    out[f"{prefix}gt{edges[-1] // scale}{unit}"] = f"{column} >= {edges[-1]}"
    return out


CAR_STEPS = _steps("car_years", "car_age_", [1, 4, 7, 10])
CAR_STEPS["car_age_lt1"] = "car_years = 0"
PROFILE_CONDITIONS = {
    "dealer": "platform = 'POS' AND coalesce(category, 'none') IN "
              "('none', 'Car Supermarket', 'Franchise Dealer', 'Independent Dealer')",
    "non_internet_broker": "platform = 'POS' AND category IN ('Broker', 'Lead Generator')",
    "aggregator": "platform = 'POS' AND category = 'Online Broker'",
    "dtc": "'DTC' IN (platform, category)",
    "other_channel": "platform IS NULL AND category IS DISTINCT FROM 'DTC'",
    **_steps("age", "cust_age_", [21, 30, 40, 50, 60, 70]),
    "cust_age_missing": "age IS NULL",
    "employed": "job IN ('EMPLOYED', 'Director')",
    "self_employed": "job IN ('Self-Employed', 'SELF EMPLOYED')",
    "retired": "job = 'Retired'",
    "homemaker": "job IN ('Disability', 'Unemployed')",
    "employed_other": "job = 'XXXXXXX'",
    "employed_unknown": "coalesce(job, '1') = '1'",
    "homeowner": "home = 'Home Owner'",
    "tenant": "home LIKE '%Tenant' OR home = 'Lodging'",
    "living_with_parent": "home = 'Live With Parents'",
    "resident_other": "home = 'HM Forces'",
    "resident_unknown": "coalesce(home, 'Not Declared') = 'Not Declared'",
    "car_age_new": "car_years = -1",
    **CAR_STEPS,
    "car": "vehicle IS DISTINCT FROM 'Light Commercial Vehicle'",
    "lcv": "vehicle = 'Light Commercial Vehicle'",
    **_steps("mileage", "mileage_", [10_000, 25_000, 50_000, 75_000, 100_000], "k", 1000),
    "mileage_unknown": "mileage IS NULL",
    **{name: f"fuel IN ({quoted(words)})" for name, words in FUELS.items()},
    "fuel_other": "fuel = 'HYDROGEN' AND old_fuel IS NOT NULL",
    "fuel_unknown": "coalesce(fuel, 'UNKNOWN') = 'UNKNOWN'",
}


def _exact_round2(column: str) -> str:
    """Average of whole numbers, rounded half up to two decimals in whole-number arithmetic."""
    return f"CAST(sum({column}) * 200 + count({column}) AS BIGINT) // (2 * count({column})) / 100.0"


def _profile_select(measure: str, whole=n) -> str:
    by_value = measure == "value"
    weight = "total_finance_amount" if by_value else "1"
    counted = x if by_value else whole
    incomes = "income BETWEEN 0 AND 150000"
    return "SELECT CAST(last_day(contract_date) AS VARCHAR) AS month_end, " + columns(
        counted("sum(total_finance_amount)" if by_value else "count(DISTINCT agreement_code)",
                "nb_total"),
        x("sum(current_retail_value)", "retail_value"),
        whole("sum(term)", "term"),
        x(_exact_round2("age"), "cust_age_avg"),
        whole(total(incomes, "income" if by_value else "1"), "gross_income"),
        x("avg(age_months)" if by_value else "avg(nullif(age_months, 0))", "avg_car_age"),
        x("floor(100 * avg(mileage)) / 100", "avg_mileage"),
        *[counted(total(cond, weight), name) for name, cond in PROFILE_CONDITIONS.items()],
    ) + " FROM rows GROUP BY 1"


STORED_AGE = "current_age"
AGE_FROM_BIRTH = ("CAST((DATE '1998-03-31' - date_of_birth) * 200 + 365 AS BIGINT) // 730 / 100.0")


def _profile(t, measure: str, **options):
    return origination.new_business_profile(t, CALENDAR.rep_month_start, CALENDAR.rep_month_end,
                                            measure, **options)


@query("new_business_vols", _profile_rows(STORED_AGE) + _profile_select("volume"))
def new_business_vols(t):
    return _profile(t, "volume")


@query("new_business_vals", _profile_rows(STORED_AGE) + _profile_select("value"))
def new_business_vals(t):
    return _profile(t, "value")


@query("new_business_vols_age_from_dob",
       _profile_rows(AGE_FROM_BIRTH) + "SELECT CAST(last_day(contract_date) AS VARCHAR) AS month_end, "
       + columns(*[n(total(cond, "1"), name) for name, cond in PROFILE_CONDITIONS.items()
                   if name.startswith("cust_age")]) + " FROM rows GROUP BY 1")
def new_business_vols_age_from_dob(t):
    ages = [name for name in PROFILE_CONDITIONS if name.startswith("cust_age")]
    return _profile(t, "volume", age_from_birth=True).select("month_end", *ages)


OLDER_ROWS = _profile_rows(STORED_AGE).replace("o.vehicle_name", "h.vehicle_name").replace(
    "o.fuel_type", "h.fuel_type").replace("LEFT JOIN opportunity o ON o.id = la.opportunity_id", "")
KNOWN_FUELS = quoted([*sum(FUELS.values(), ()), V.FUEL_UNKNOWN])


@query("new_business_older", OLDER_ROWS + _profile_select("value").replace(
    "fuel = 'HYDROGEN' AND old_fuel IS NOT NULL", f"fuel NOT IN ({KNOWN_FUELS})"))
def new_business_older(t):
    return _profile(t, "value", opportunities=t["opportunity_history"])


@query("new_business_stack", _profile_rows(STORED_AGE)
       + f"SELECT 'volume' AS measure, * FROM ({_profile_select('volume', x)}) v "
       + f"UNION ALL SELECT 'value', * FROM ({_profile_select('value', x)}) v")
def new_business_stack(t):
    return origination.new_business_stack(t, CALENDAR.rep_month_start, CALENDAR.rep_month_end)


LTV = "CAST(total_finance_amount AS DOUBLE) / CAST(current_retail_value AS DOUBLE)"


@query("ltv_buckets", f"""
    WITH l AS (SELECT *, {LTV} AS ltv FROM loan_agreements WHERE {IN_MONTH})
    SELECT CAST(last_day(contract_date) AS VARCHAR) AS rep_month,
           CASE WHEN ltv IS NULL THEN '7. Unknown' WHEN ltv >= 1.1 THEN '6. 1.1'
                WHEN ltv >= 1.09 THEN NULL WHEN ltv >= 1.0 THEN '5. 1-1.09'
                WHEN ltv >= 0.9 THEN '4. 0.9-0.99' WHEN ltv >= 0.8 THEN '3. 0.8-0.89'
                WHEN ltv >= 0.7 THEN '2. 0.7-0.79' ELSE '1. 0.7' END AS ltv_bucket,
           {n("count(DISTINCT agreement_code)", "vol")}, {x("sum(total_finance_amount)", "val")}
    FROM l GROUP BY 1, 2""")
def ltv_buckets(t):
    return origination.ltv_breakdown(t, CALENDAR.rep_month_start, CALENDAR.rep_month_end)


@query("fuel_breakdown", f"""
    WITH f AS (SELECT id, mileage AS listed, CASE
                 {" ".join(f"WHEN fuel_type IN ({quoted(FUELS[k])}) THEN '{label}'"
                           for k, label in (("diesel", "1. Diesel"), ("electric", "2. Electric"),
                                            ("hybrid", "3. Hybrid"), ("petrol", "4. Petrol"),
                                            ("lpg", "6. LPG")))}
                 WHEN fuel_type <> 'UNKNOWN' THEN '5. Other' ELSE 'Unknown' END AS fuel
               FROM opportunity)
    SELECT CAST(last_day(contract_date) AS VARCHAR) AS month_end, fuel AS fuel_type,
           {n("count(*)", "vol")}, {x(_exact_round2("term"), "avg_term")},
           {x("sum(current_retail_value)", "avg_retail_val")},
           {x(_exact_round2("current_age"), "avg_age")},
           {x(_exact_round2(_age_months()), "car_age")}, {x(_exact_round2("listed"), "avg_mileage")}
    FROM loan_agreements la
    LEFT JOIN opportunity_link k USING (opportunity_id)
    LEFT JOIN applicant a ON a.id = k.applicant_id
    LEFT JOIN f ON f.id = la.opportunity_id
    WHERE {IN_MONTH} GROUP BY 1, 2""")
def fuel_breakdown(t):
    return origination.fuel_breakdown(t, CALENDAR.rep_month_start, CALENDAR.rep_month_end)


# ---------------------------------------------------------------- stock


def _event_sql(condition: str, day: str, extra: str = "") -> str:
    """Events of agreements that have a status snapshot on the day of the first action."""
    return f"""
    SELECT h.agreement_code, h.status, CAST(h.dateat AS DATE) AS dt, e.*
    FROM (SELECT contact_id, CAST(min(created_at) AS DATE) AS {day} {extra}
          FROM action_log WHERE {condition} GROUP BY contact_id) e
    LEFT JOIN contact c ON c.id = e.contact_id
    LEFT JOIN loan_link k ON k.main_borrower = c.account_id
    LEFT JOIN status_history h ON h.agreement_code = k.agreement_code
                              AND h.dateat = CAST({day} AS VARCHAR)"""


AMOUNT = "try_cast(nullif(regexp_extract(description, '.£([0-9]+)[.]', 1), '') AS DECIMAL(18,2))"
SOLD_ON = "try_cast(nullif(regexp_extract(description, '.sold on (.{10}) and ', 1), '') AS DATE)"
REPO_SQL = _event_sql("description ILIKE '%vehicle disposal record%'", "repo_date")
SALE_SQL = _event_sql(
    "description ILIKE '%vehicle have been sold%'", "vehicle_sale_date",
    f", first({SOLD_ON} ORDER BY created_at, action_id) AS actual_sale_date"
    f", first({AMOUNT} ORDER BY created_at, action_id) AS gross_sale_amount")
TERMINATION_SQL = _event_sql("name ILIKE '%loan terminated%'", "termination_date")
EVENT_COLUMNS = columns("agreement_code", "status", "contact_id", d("dt", "dt"))


@query("first_event_per_loan", f"""
    SELECT {EVENT_COLUMNS}, {d("vehicle_sale_date", "vehicle_sale_date")},
           {d("actual_sale_date", "actual_sale_date")}, {x("gross_sale_amount", "gross_sale_amount")}
    FROM ({SALE_SQL}) s""")
def first_event_per_loan(t):
    return stock.vehicle_sales(t)


@query("repossessions", f"SELECT {EVENT_COLUMNS}, {d('repo_date', 'repo_date')} FROM ({REPO_SQL}) s")
def repossessions(t):
    return stock.repossessions(t)


@query("terminations",
       f"SELECT {EVENT_COLUMNS}, {d('termination_date', 'termination_date')} FROM ({TERMINATION_SQL}) s")
def terminations(t):
    return stock.terminations(t)


INSURANCE_SQL = """
    SELECT agreement_code, CAST(dateat AS DATE) AS insurance_date
    FROM (SELECT *, lag(status) OVER (PARTITION BY agreement_code ORDER BY dateat) AS before
          FROM status_history) h
    WHERE status = 'AG_INSURANCE SHORTFALL' AND before <> status
      AND dateat >= '1996-01-01' AND dateat <> '1997-06-01'"""


@query("insurance_writeoff", f"SELECT agreement_code, {d('insurance_date', 'insurance_date')}"
       f" FROM ({INSURANCE_SQL}) w")
def insurance_writeoff(t):
    return stock.insurance_writeoffs(t["status_history"], INSURANCE_SINCE, BAD_SNAPSHOTS)


def _rung(arrears: str, payment: str, status: str) -> str:
    return f"""CASE WHEN {status} IS DISTINCT FROM 'AG_LIVE_PRIMARY' THEN -1
                    WHEN {arrears} > 0 AND {arrears} < {payment} THEN 0.1
                    ELSE least(floor(CAST({arrears} AS DOUBLE) / CAST({payment} AS DOUBLE)), 6) END"""


LADDER_SQL = f"""
    SELECT last_day(CAST(c.dateat AS DATE) - 10) AS report_month,
           CAST(epoch_ms(c.contract_date_ms) AS DATE) AS contract_date, c.agreement_code, c.status,
           c.arrears_value, c.capital_outstanding, p.status AS previous_status,
           p.arrears_value AS previous_arrears_value,
           {_rung("c.arrears_value", "c.payment", "c.status")} AS current_arrears,
           {_rung("p.arrears_value", "c.payment", "p.status")} AS previous_arrears
    FROM (SELECT * FROM status_history WHERE dateat IN ('1998-03-01', '1998-04-01')
          QUALIFY dateat = max(dateat) OVER (PARTITION BY agreement_code)) c
    LEFT JOIN status_history p ON p.agreement_code = c.agreement_code
                              AND p.dateat = '1998-03-01' AND c.dateat = '1998-04-01'"""
LADDER_COLUMNS = columns(
    d("report_month", "report_month"), d("contract_date", "contract_date"), "agreement_code", "status",
    x("arrears_value", "arrears_value"), x("capital_outstanding", "capital_outstanding"),
    "previous_status", x("previous_arrears_value", "previous_arrears_value"),
    x("current_arrears", "current_arrears"), x("previous_arrears", "previous_arrears"))


@query("arrears_ladder", f"SELECT {LADDER_COLUMNS} FROM ({LADDER_SQL}) l")
def arrears_ladder(t):
    return stock.status_ladder(t["status_history"], (CALENDAR.snapshot_start, CALENDAR.snapshot_end))


@query("snapshot_pair", """
    SELECT agreement_code, dateat, status FROM status_history
    WHERE CAST(dateat AS DATE) IN (DATE '1998-03-01', DATE '1998-04-01')""")
def snapshot_pair(t):
    days = [CALENDAR.snapshot_start.isoformat(), CALENDAR.snapshot_end.isoformat()]
    history = t["status_history"]
    return history.filter(history["dateat"].isin(days)).select("agreement_code", "dateat", "status")


CRYSTALISED = "status IN ('AG_REPO_CRYSTALISED', 'AG_VT_CRYSTALISED')"
WAS_CRYSTALISED = "before IN ('AG_REPO_CRYSTALISED', 'AG_VT_CRYSTALISED')"
EVENTS_SQL = {
    "": f"{CRYSTALISED} AND NOT {WAS_CRYSTALISED}",
    "2": "status = 'AG_REPO_SHORTFALL' AND before = 'AG_REPO'",
    "3": "status = 'AG_WRITTEN_OFF' AND before <> 'AG_WRITTEN_OFF'",
}
FIRST_SHORTFALL = "visit = 1 AND status IN ('AG_REPO_SHORTFALL', 'AG_VT_CRYSTALISED')"


def _changes_sql(source: str, bad: str) -> str:
    parts = [f"nullif(count(*) FILTER (WHERE {EVENTS_SQL['']}), 0) AS dups_check"]
    for tag, cond in EVENTS_SQL.items():
        parts.append(f"{total(cond, 'balance_before')} AS crystalised_from{tag}")
        if tag != "3":
            parts.append(f"{total(cond, 'arrears_value')} AS crystalised_to{tag}")
            days = "CAST(dateat AS DATE) - DATE '2000-01-01'"
            parts.append(f"{total(cond, days)} AS crystalised_date{tag}")
    parts.append(f"{total(FIRST_SHORTFALL, 'arrears_value')} AS shortfall_balance")
    parts.append(f"nullif(count(*) FILTER (WHERE {FIRST_SHORTFALL}), 0) AS dups_check2")
    return f"""
    SELECT agreement_code, {columns(*parts)}
    FROM (SELECT *, lag(status) OVER (PARTITION BY agreement_code ORDER BY dateat) AS before,
                 lag(capital_outstanding) OVER (PARTITION BY agreement_code ORDER BY dateat)
                   AS balance_before,
                 row_number() OVER (PARTITION BY agreement_code, status ORDER BY dateat) AS visit
          FROM {source} WHERE dateat <> '{bad}') h
    WHERE before IS NOT NULL GROUP BY agreement_code"""


CHANGE_COLUMNS = columns(
    "agreement_code",
    *[n(c, c) for c in ("dups_check", "dups_check2", "crystalised_date", "crystalised_date2")],
    *[x(c, c) for c in ("crystalised_from", "crystalised_to", "crystalised_from2",
                        "crystalised_to2", "crystalised_from3", "shortfall_balance")])


@query("crystallisation",
       f"SELECT {CHANGE_COLUMNS} FROM ({_changes_sql('status_history', '1997-06-01')}) c")
def crystallisation(t):
    return stock.crystallisation(t["status_history"], BAD_SNAPSHOTS)


@query("crystallisation_irregular",
       f"SELECT {CHANGE_COLUMNS} FROM ({_changes_sql('event_history', '2024-01-10')}) c")
def crystallisation_irregular(t):
    return stock.crystallisation(t["event_history"], [dt.date(2024, 1, 10)])


CLOSED_SQL = """
    SELECT la.agreement_code, la.contract_date, la.contract_end_date,
           lt.cash_transactions_cumulative, la.total_finance_amount, la.total_payable
    FROM loan_agreements la JOIN loan_timeline lt USING (agreement_code)
    WHERE lt.date = DATE '1998-04-30' AND lt.status_code = 'AG_CLOSED'
      AND la.agreement_code NOT IN (SELECT agreement_code FROM settlements_and_defaults)"""


@query("closures_at_term", "SELECT agreement_code, " + columns(
    d("contract_date", "contract_date"), d("contract_end_date", "contract_end_date"),
    *[x(c, c) for c in ("cash_transactions_cumulative", "total_finance_amount", "total_payable")])
       + f" FROM ({CLOSED_SQL}) c")
def closures_at_term(t):
    return stock.closures_at_term(t, CALENDAR.as_of)


POSITION_ROWS_SQL = f"""
    WITH ladder AS ({LADDER_SQL}),
    term AS ({TERMINATION_SQL}), repo AS ({REPO_SQL}), sale AS ({SALE_SQL}),
    exits AS (SELECT s.agreement_code, s.type, s.processed_date, s.amount AS settlement_amount,
                     s.date AS exit_date, termination_date, repo_date, vehicle_sale_date,
                     actual_sale_date, gross_sale_amount
              FROM settlements_and_defaults s LEFT JOIN term USING (agreement_code)
              LEFT JOIN repo USING (agreement_code) LEFT JOIN sale USING (agreement_code)),
    joined AS (
        SELECT l.*, e.* EXCLUDE (agreement_code), c.contract_end_date, w.insurance_date,
               coalesce(crystalised_from, crystalised_from2, crystalised_from3) AS bal_from,
               coalesce(crystalised_to, crystalised_to2) AS bal_to, shortfall_balance
        FROM ladder l LEFT JOIN exits e USING (agreement_code)
        LEFT JOIN ({CLOSED_SQL}) c USING (agreement_code)
        LEFT JOIN ({INSURANCE_SQL}) w USING (agreement_code)
        LEFT JOIN ({_changes_sql("status_history", "1997-06-01")}) v USING (agreement_code)),
    stock AS (
        SELECT * EXCLUDE (bal_from, bal_to), bal_from AS crystalised_from, bal_to AS crystalised_to,
               bal_to - shortfall_balance AS net_sale_amount,
               CASE WHEN type IN ('Settlement', 'Unwind') AND processed_date <= report_month THEN -10
                    WHEN last_day(contract_end_date) <= report_month THEN -9
                    WHEN type = 'VT' AND last_day(processed_date) <= report_month THEN -8
                    WHEN last_day(insurance_date) <= report_month THEN 97
                    WHEN type = 'VT - Default' AND last_day(processed_date) <= report_month THEN 98
                    WHEN type = 'Default' AND last_day(termination_date) <= report_month THEN 99
                    ELSE current_arrears END AS end_status
        FROM joined)"""
STOCK_SQL = POSITION_ROWS_SQL + """,
    reported AS (SELECT *, status = 'AG_LIVE_PRIMARY' AS is_live,
                        type IN ('Default', 'VT - Default', 'VT')
                          AND coalesce(vehicle_sale_date > report_month, true) AS is_unsold,
                        last_day(processed_date) = report_month AS out_now,
                        last_day(termination_date) = report_month AS terminated_now,
                        last_day(contract_end_date) = report_month AS term_now,
                        last_day(insurance_date) = report_month AS insured_now,
                        last_day(repo_date) = report_month AS repo_now,
                        last_day(vehicle_sale_date) = report_month AS sold_now,
                        coalesce(gross_sale_amount, net_sale_amount) AS proceeds,
                        coalesce(settlement_amount, crystalised_from, 1) AS exit_balance,
                        coalesce(crystalised_from, settlement_amount) AS closing
                 FROM stock WHERE report_month = DATE '1998-03-31')"""

CLOSED_NOW = ("CASE type WHEN 'Default' THEN terminated_now WHEN 'VT' THEN out_now "
              "WHEN 'VT - Default' THEN out_now WHEN 'Settlement' THEN out_now "
              "WHEN 'Unwind' THEN out_now END OR term_now OR insured_now")
AT_LOSS = "sold_now AND proceeds < exit_balance"
REPORT_MONTH = d("report_month", "report_month")


def stock_rows(t):
    """The position that all reports of a session share, stored by the first that reads it."""
    return t.shared("stock_position", lambda: stock.stored_position(
        t, CALENDAR, INSURANCE_SINCE, BAD_SNAPSHOTS))


POSITION_OUT = "SELECT " + columns(
    LADDER_COLUMNS, "type",
    *[d(c, c) for c in ("processed_date", "exit_date", "termination_date", "repo_date",
                        "vehicle_sale_date", "actual_sale_date", "contract_end_date",
                        "insurance_date")],
    *[x(c, c) for c in ("settlement_amount", "gross_sale_amount", "crystalised_from",
                        "crystalised_to", "shortfall_balance", "net_sale_amount", "end_status")]
) + " FROM stock"


@query("stock_position", POSITION_ROWS_SQL + POSITION_OUT)
def stock_position(t):
    return stock.stock_position(t, CALENDAR, INSURANCE_SINCE, BAD_SNAPSHOTS)


@query("stock_position_counts", POSITION_ROWS_SQL + "SELECT " + columns(
    n("count(*)", "rows"), n("count(DISTINCT (agreement_code, report_month))", "keys"),
    n("count(*) FILTER (WHERE agreement_code IS NULL OR report_month IS NULL)", "null_keys"),
    n("count(*) - count(type)", "null_type"),
    n("count(*) - count(crystalised_from)", "null_crystalised_from")) + " FROM stock")
def stock_position_counts(t):
    report, watch = checks.watched(stock_rows(t), ["agreement_code", "report_month"],
                                   nulls_of=["type", "crystalised_from"], parts=t.timeline_parts())
    materialize(report, "stock_position")
    return watch.frame(t.spark)


# The history as it was known at the closing snapshot
KNOWN_SQL = "known_history AS (SELECT * FROM status_history WHERE dateat <= '1998-04-01')"


def _known(sql: str) -> str:
    return f"WITH {KNOWN_SQL}, {sql.replace('status_history', 'known_history').strip()[5:]}"


def state_rows(t):
    """State and life events up to the opening snapshot, and both after the closing one."""
    history, last = t["status_history"], CALENDAR.snapshot_end.isoformat()
    earlier, snapshot = history.filter(history["dateat"] < last), history.filter(history["dateat"] == last)
    state = materialize(stock.position_state(earlier, BAD_SNAPSHOTS, INSURANCE_SINCE), "state")
    log = {name: t[name] for name in ("action_log", "contact", "loan_link")}
    events = materialize(stock.life_events(log | {"status_history": earlier}), "events")
    return (stock.advanced_state(state, snapshot, BAD_SNAPSHOTS, INSURANCE_SINCE, t.timeline_parts()),
            stock.advanced_events(t, events, snapshot))


@query("stock_position_from_state", _known(POSITION_ROWS_SQL + POSITION_OUT))
def stock_position_from_state(t):
    state, events = state_rows(t)
    return stock.position_of_state(t, CALENDAR, materialize(state, "state"), materialize(events, "events"),
                                   t.timeline_parts())


@query("crystallisation_from_state", f"WITH {KNOWN_SQL} SELECT {CHANGE_COLUMNS} FROM ("
       + _changes_sql("known_history", "1997-06-01") + ") c")
def crystallisation_from_state(t):
    return stock.changes_of(state_rows(t)[0]).filter("has_previous").drop("has_previous", "insurance_dates")


#: The SELECT of each report of the pack, over the same position.
PACK_SQL: dict[str, str] = {}


def pack_query(name: str, body: str):
    PACK_SQL[name] = body
    return query(name, STOCK_SQL + body)


def _behind(payments: int) -> str:
    waiting = ("vehicle_sale_date > report_month AND ((type = 'Default' AND termination_date <= "
               "report_month) OR (type = 'VT - Default' AND last_day(processed_date) <= report_month))")
    return sql_tally(f"current_arrears >= {payments} OR ({waiting})")


@pack_query("portfolio_volumes", "SELECT " + columns(
    REPORT_MONTH,
    n(sql_tally("is_live OR is_unsold"), "total_portfolio"),
    n(sql_tally(CLOSED_NOW), "total_closed"),
    n(sql_tally("type = 'VT' AND out_now"), "vt_no_liability"),
    n(sql_tally("type = 'VT - Default' AND out_now"), "vt_vs"),
    n(sql_tally("type IN ('Settlement', 'Unwind') AND out_now"), "settlement"),
    n(sql_tally("term_now"), "end_of_term"),
    n("sum(CASE WHEN insured_now THEN 0 WHEN type = 'Default' AND terminated_now THEN 1 END)", "repo"),
    n(sql_tally("insured_now"), "write_off"),
    n(_behind(2), "mia_2m"), n(_behind(3), "mia_3m")) + " FROM reported GROUP BY report_month")
def portfolio_volumes(t):
    return stock.portfolio_volumes(stock_rows(t), MONTH)


OUTCOMES_SQL = {
    "vol": "true", "closed_good": "end_status IN (-10, -9, -1)", "to_utd": "end_status = 0",
    "to_0plus": "end_status = 0.1", "to_1": "end_status = 1", "to_2": "end_status = 2",
    "to_3": "end_status = 3", "to_4": "end_status BETWEEN 4 AND 6",
    "to_bad": "end_status BETWEEN 97 AND 99", "to_vt": "end_status = -8"}
OPENINGS_SQL = {"utd": "0", "oneplus": "0.1", "one": "1", "two": "2", "three": "3", "four": "4"}


@pack_query("roll_rate_matrix", "SELECT " + columns(
    REPORT_MONTH, "opening", *[n(sql_tally(cond), name) for name, cond in OUTCOMES_SQL.items()])
       + " FROM reported JOIN (VALUES "
       + ", ".join(f"('{name}', CAST({code} AS DOUBLE))" for name, code in OPENINGS_SQL.items())
       + ") o(opening, code) ON code = previous_arrears GROUP BY report_month, opening")
def roll_rate_matrix(t):
    return stock.roll_rates(stock_rows(t), MONTH)


@query("roll_rate_wide", STOCK_SQL + "SELECT " + columns(
    REPORT_MONTH, *[n(sql_tally(f"previous_arrears = {code} AND ({cond})"), f"{opening}_{name}")
                    for opening, code in OPENINGS_SQL.items()
                    for name, cond in OUTCOMES_SQL.items()]) + " FROM reported GROUP BY report_month")
def roll_rate_wide(t):
    return stock.roll_rates_wide(stock_rows(t), MONTH)


@pack_query("sales_performance", "SELECT " + columns(
    REPORT_MONTH, n(tally0("repo_now"), "vehicles_recovered"), n(tally0("sold_now"), "vehicles_sold"),
    n(sql_tally(AT_LOSS), "vehicle_loss")) + " FROM reported GROUP BY report_month")
def sales_performance(t):
    return stock.sales_performance(stock_rows(t), MONTH)


AGE_METRICS_SQL = {
    "vol": "true", "early": "end_status IN (1, 2)", "middle": "end_status IN (3, 4, 5)",
    "late": "end_status = 6", "written_off": "end_status >= 6",
    "written_off_le1_payment": "end_status >= 6 AND instalments_satisfied <= 1",
    "written_off_gt1_payment": "end_status >= 6 AND instalments_satisfied > 1",
    "no_payment": "end_status >= 0 AND instalments_satisfied = 0",
    "one_payment": "end_status >= 0 AND instalments_satisfied = 1"}


def _age_metric(name: str, cond: str, age: int) -> str:
    months = "date_diff('month', r.contract_date, report_month)"
    return n(sql_tally(f"{months} = {age} AND ({cond})"), f"{name}_{age}m")


@pack_query("months_on_book", "SELECT " + columns(
    REPORT_MONTH,
    *[_age_metric(name, cond, age) for name, cond in AGE_METRICS_SQL.items()
      for age in ((3, 6) if name.endswith(("no_payment", "one_payment")) else (3, 6, 12, 18))],
    *[f"CAST(NULL AS BIGINT) AS {name}_{age}m" for name in ("fraud", "fraud_value")
      for age in (3, 6, 12, 18)])
       + """ FROM reported r LEFT JOIN loan_timeline lt
             ON lt.agreement_code = r.agreement_code AND lt.date = report_month
             GROUP BY report_month""")
def months_on_book(t):
    return stock.months_on_book(stock_rows(t), t["loan_timeline"], MONTH)


@pack_query("portfolio_values", "SELECT " + columns(
    REPORT_MONTH,
    x("sum(CASE WHEN is_live THEN capital_outstanding WHEN is_unsold THEN arrears_value END)",
      "total_portfolio"),
    n(total("(is_live OR is_unsold) AND report_month < la.contract_end_date",
            "date_diff('month', report_month, la.contract_end_date)"), "total_term"),
    x(total(CLOSED_NOW, "closing"), "total_closed"),
    x(total("type = 'VT' AND out_now", "closing"), "vt_no_liability"),
    x(total("type = 'VT - Default' AND out_now", "closing"), "vt_vs"),
    x(total0("repo_now", "exit_balance"), "vehicles_recovered"),
    n("0", "vehicles_recovered_cap_val"),
    x(total0("sold_now", "exit_balance"), "vehicles_sold_bal"),
    n("0", "vehicles_sold_cap_val"),
    x(total0("sold_now", "gross_sale_amount"), "vehicles_sold_price"),
    x(total(AT_LOSS, "exit_balance"), "vehicle_loss_bal"),
    n(total("sold_now AND proceeds < crystalised_from + 1", "0"), "vehicle_loss_cap_val"),
    x(total(AT_LOSS, "gross_sale_amount"), "vehicle_loss_sold_price"))
       + " FROM (SELECT * EXCLUDE (contract_end_date) FROM reported) r"
       + " LEFT JOIN loan_agreements la USING (agreement_code) GROUP BY report_month")
def portfolio_values(t):
    return stock.portfolio_values(stock_rows(t), t["loan_agreements"], MONTH)


OPEN_NOW = ("status NOT IN ('AG_PENDING_CLOSURE', 'AG_CLOSED', 'AG_WRITTEN_OFF') "
            "AND capital_outstanding + arrears_value > 0")
TAKEN = "type = 'Default' AND repo_date <= report_month"
HANDED = "processed_date <= report_month AND repo_date <= report_month"


@pack_query("cohort_performance", "SELECT " + columns(
    REPORT_MONTH,
    "CAST(year(la.contract_date) AS VARCHAR) || ' Q' || CAST(quarter(la.contract_date) AS VARCHAR)"
    " AS vintage",
    n("count(*)", "new_business_volume"), x("sum(total_finance_amount)", "new_business_value"),
    n(sql_tally(OPEN_NOW), "still_open"),
    x(total(OPEN_NOW, "capital_outstanding + arrears_value"), "still_open_balance"),
    n(sql_tally("end_status >= 2"), "vol_2_plus"), n(sql_tally("end_status >= 3"), "vol_3_plus"),
    n(sql_tally(f"type = 'VT - Default' AND {HANDED}"), "vol_handback_liability"),
    n(sql_tally(f"type = 'VT' AND {HANDED}"), "vol_handback_no_liability"),
    n("sum(CASE WHEN insurance_date <= report_month THEN 0 WHEN type = 'Default' "
      "AND termination_date <= report_month THEN 1 END)", "terminations"),
    n(sql_tally(TAKEN), "forced_possession"),
    x(f"avg(nullif({_age_months('repo_date')}, 0)) FILTER (WHERE {TAKEN})", "forced_possession_age"),
    x(f"avg(mileage) FILTER (WHERE {TAKEN})", "forced_possession_mileage"),
    *[f"CAST(NULL AS BIGINT) AS {c}" for c in (
        "return_of_goods_requests", "accounts_return_of_goods_requests",
        "possession_after_request", "possession_no_request")])
       + """ FROM (SELECT * EXCLUDE (contract_date, contract_end_date) FROM reported) r
             JOIN loan_agreements la USING (agreement_code)
             WHERE la.contract_date <= DATE '1998-03-31' GROUP BY 1, 2""")
def cohort_performance(t):
    return stock.cohort_performance(stock_rows(t), t["loan_agreements"], MONTH)


PACK_PARTS = {"roll_rate_matrix": "opening", "cohort_performance": "vintage"}
PACK_NAMES = {"roll_rates": "roll_rate_matrix"}


def _pack_sql() -> str:
    parts = []
    for name, body in PACK_SQL.items():
        part = PACK_PARTS.get(name)
        other = f"CAST({part} AS VARCHAR)" if part else "CAST(NULL AS VARCHAR)"
        out = f", {part}" if part else ""
        parts.append(
            f"SELECT '{name}' AS report, {other} AS part, metric, round(value, 6) AS value FROM ("
            f"UNPIVOT (SELECT report_month{out}, CAST(COLUMNS(* EXCLUDE (report_month{out})) AS DOUBLE) "
            f"FROM ({body}) b) t ON COLUMNS(* EXCLUDE (report_month{out})) INTO NAME metric VALUE value) u "
            "WHERE value IS NOT NULL")
    return STOCK_SQL + " UNION ALL ".join(parts)


@query("monthly_pack", _pack_sql())
def monthly_pack(t):
    """All reports of the month from one pass, as rows of report, part, metric and value."""
    pack = stock.monthly_pack(stock_rows(t), t["loan_agreements"], t["loan_timeline"], MONTH)
    rows = []
    for report, df in pack.items():
        name = PACK_NAMES.get(report, report)
        part = PACK_PARTS.get(name)
        values = [c for c in df.columns if c not in ("report_month", part)]
        rows.append(df.select(
            F.lit(name).alias("report"), (F.col(part) if part else F.lit(None).cast("string")).alias("part"),
            F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
                               for c in values]))))
    return reduce(lambda a, b: a.unionByName(b), rows).filter("value is not null")


# ---------------------------------------------------------------- forbearance book


def _down(prefix: str) -> str:
    ended = " OR ".join(f"{prefix}.{c}" for c in ("is_vt", "is_defaulted", "is_settled"))
    return (f"CASE WHEN NOT ({ended}) THEN CASE {prefix}.arrears_status WHEN 'Up-to-Date' THEN 0 "
            f"WHEN '0-Down' THEN 0.5 ELSE CAST(left({prefix}.arrears_status, 1) AS INT) END END")


POSITION_SQL = f"""
    SELECT f.*, s.amount AS def_bal, g.def_date, {_down("f")} AS cur_arrs_num,
           {_down("lt")} AS pre_ph_arrs_num, lt.date AS loan_timeline_join_date
    FROM forbearance_timeline f
    LEFT JOIN (SELECT agreement_code, min(date) AS def_date FROM forbearance_timeline
               WHERE has_initial_forbearance AND (is_defaulted OR is_vt OR is_settled)
               GROUP BY agreement_code) g USING (agreement_code)
    LEFT JOIN settlements_and_defaults s ON s.agreement_code = g.agreement_code
    LEFT JOIN loan_timeline lt ON lt.agreement_code = f.agreement_code
                              AND lt.date = f.initial_forbearance_start_date
    WHERE f.date = DATE '1998-03-31'"""


@query("forbearance_position", "SELECT " + columns(
    "agreement_code", "loan_id", d("date", "date"), x("capital_balance", "capital_balance"),
    *["is_live", "is_settled", "is_defaulted", "is_vt", "has_application", "in_initial_forbearance",
      "has_initial_forbearance", "in_forbearance", "initial_forbearance_start",
      "initial_forbearance_end", "payment_since_forbearance", "status", "arrears_status"],
    *[n(c, c) for c in ("payments_down", "payments_down_end_of_initial_forbearance")],
    *[d(c, c) for c in ("initial_forbearance_start_date", "initial_forbearance_end_date", "def_date",
                        "loan_timeline_join_date")],
    *[x(c, c) for c in ("def_bal", "cur_arrs_num", "pre_ph_arrs_num")]) + f" FROM ({POSITION_SQL}) p")
def forbearance_position(t):
    return forbearance.forbearance_position(t, MONTH)


LEFT_FB = "NOT in_forbearance AND NOT (is_vt OR is_defaulted OR is_settled)"
FB_OUTCOMES = {
    "in_initial_fb": ("in_initial_forbearance", "in_initial_forbearance", "capital_balance"),
    "in_ph_ext": ("open_ended AND in_forbearance AND NOT in_initial_forbearance",) * 2
    + ("capital_balance",),
    "exited_static_imp": ("open_ended AND NOT in_forbearance AND cur_arrs_num <= pre_ph_arrs_num",) * 2
    + ("capital_balance",),
    "exited_deteriorate": (
        "is_defaulted OR (NOT in_forbearance AND NOT is_settled AND NOT is_vt "
        "AND cur_arrs_num > pre_ph_arrs_num)",) * 2 + ("last_balance",),
    "exited_vt": ("is_vt AND NOT in_forbearance AND NOT is_defaulted AND NOT is_settled",) * 2
    + ("def_bal",),
    "settled": ("is_settled AND NOT is_defaulted AND NOT is_vt",
                "is_settled AND NOT in_forbearance AND NOT is_defaulted AND NOT is_vt", "def_bal"),
}


@query("forbearance_summary", f"""
    SELECT CAST(last_day(date) AS VARCHAR) AS month_end,
           {n("count(DISTINCT agreement_code)", "vol_fb_granted")},
           {x("sum(last_balance)", "val_fb_granted")},
           {columns(*[n(tally0(vol), f"vol_{k}") for k, (vol, _, _) in FB_OUTCOMES.items()],
                    *[x(total0(cond, value), f"val_{k}")
                      for k, (_, cond, value) in FB_OUTCOMES.items()])}
    FROM (SELECT *, NOT (is_vt OR is_defaulted OR is_settled) AS open_ended,
                 CASE WHEN capital_balance <> 0 THEN capital_balance ELSE def_bal END AS last_balance
          FROM ({POSITION_SQL}) p WHERE has_initial_forbearance) q
    GROUP BY 1""")
def forbearance_summary(t):
    return forbearance.forbearance_summary(forbearance.forbearance_position(t, MONTH))


# ---------------------------------------------------------------- payment holidays

HOLIDAY_MONTHS = (dt.date(1998, 1, 31), dt.date(1998, 6, 30))
MONTH_DAYS = ("1998-01-31", "1998-02-28", "1998-03-31", "1998-04-30",
              "1998-05-31", "1998-06-30")
MONTHS_SQL = {day[:7].replace("-", "_"): day for day in MONTH_DAYS}
CUTOFF = MONTH
HOLIDAY_KINDS = {"ph": "type IN ('Payment Holiday', 'Retrospective Payment Holiday')",
                 "rmp": "type = 'Payment Reduction'", "add_ph": "type = 'Additional Payment Holiday'"}


def _windows_sql() -> str:
    ends = []
    for tag, cond in HOLIDAY_KINDS.items():
        ends.append(f"min(start_date) FILTER (WHERE {cond}) AS {tag}_start_date")
        ends.append(f"max(end_date) FILTER (WHERE {cond}) AS {tag}_end_date")
        if tag != "add_ph":
            ends.append(f"min(created_date) FILTER (WHERE {cond}) AS {tag}_created_date")
    return f"""
    SELECT *, least(greatest(ph_start_date, ph_created_date),
                    greatest(rmp_start_date, rmp_created_date)) AS first_fb_start_date,
           least(ph_end_date, rmp_end_date) AS first_fb_end_date
    FROM (SELECT a.agreement_code, g.* EXCLUDE (agreement_code)
          FROM (SELECT DISTINCT agreement_code FROM forbearance) a
          LEFT JOIN (SELECT agreement_code, {columns(*ends)} FROM forbearance
                     WHERE status <> 'Declined' AND booking_status <> 'Open'
                     GROUP BY agreement_code) g USING (agreement_code)) w"""


ARREARS_SQL = ("CASE payment_reduction_adjusted_arrears_status WHEN 'Up-to-Date' THEN -1 "
               "ELSE CAST(left(payment_reduction_adjusted_arrears_status, 1) AS INT) END")
ARREARS_BY_MONTH = columns(*[
    f"sum({ARREARS_SQL}) FILTER (WHERE date = DATE '{day}') AS arr_{m}" for m, day in MONTHS_SQL.items()])
BALANCE_BY_MONTH = columns(*[
    f"sum(capital_balance) FILTER (WHERE date = DATE '{day}') AS bal_{m}" for m, day in MONTHS_SQL.items()])
HOLIDAY_SQL = f"""
    WITH windows AS ({_windows_sql()}),
    seen AS (SELECT w.agreement_code, {ARREARS_BY_MONTH}, {BALANCE_BY_MONTH},
                    count(*) FILTER (WHERE date IN ({", ".join(f"DATE '{v}'" for v in MONTHS_SQL.values())}))
                      AS months,
                    max({ARREARS_SQL}) FILTER (WHERE date = first_fb_start_date) AS pre_arr
             FROM windows w JOIN loan_timeline lt USING (agreement_code) GROUP BY w.agreement_code),
    before AS (SELECT agreement_code, pre_arr FROM seen),
    monthly AS (SELECT * EXCLUDE (months, pre_arr) FROM seen WHERE months > 0),
    exits AS (SELECT e.agreement_code, e.type, e.sd_date, lt.capital_balance AS sd_balance
              FROM (SELECT agreement_code, type, min(date) AS sd_date FROM settlements_and_defaults
                    WHERE type <> 'Unwind' AND agreement_code IN (SELECT agreement_code FROM windows)
                    GROUP BY agreement_code, type) e
              LEFT JOIN loan_timeline lt ON lt.agreement_code = e.agreement_code
                                        AND lt.date = e.sd_date - 1),
    loans AS (SELECT w.*, pre_arr, m.* EXCLUDE (agreement_code), type, sd_date, sd_balance
              FROM windows w LEFT JOIN before USING (agreement_code)
              LEFT JOIN monthly m USING (agreement_code) LEFT JOIN exits USING (agreement_code))"""
ARREARS_OUT = [n(f"arr_{m}", f"arr_{m}") for m in MONTHS_SQL]
BALANCES_OUT = [x(f"bal_{m}", f"bal_{m}") for m in MONTHS_SQL]


@query("ph_windows", HOLIDAY_SQL + "SELECT agreement_code, " + columns(*[d(c, c) for c in (
    "ph_created_date", "ph_start_date", "ph_end_date", "rmp_created_date", "rmp_start_date",
    "rmp_end_date", "add_ph_start_date", "add_ph_end_date", "first_fb_start_date",
    "first_fb_end_date")]) + " FROM windows")
def ph_windows(t):
    return holidays.ph_windows(t["forbearance"])


@query("ph_arrears", HOLIDAY_SQL + "SELECT agreement_code, "
       + columns(n("pre_arr", "pre_arr"), *ARREARS_OUT)
       + " FROM windows LEFT JOIN before USING (agreement_code) LEFT JOIN monthly USING (agreement_code)")
def ph_arrears(t):
    return holidays.ph_arrears(holidays.ph_windows(t["forbearance"]), t["loan_timeline"], *HOLIDAY_MONTHS)


@query("ph_exits", HOLIDAY_SQL + "SELECT agreement_code, type, "
       + columns(d("sd_date", "sd_date"), x("sd_balance", "sd_balance")) + " FROM exits")
def ph_exits(t):
    return holidays.ph_exits(holidays.ph_windows(t["forbearance"]), t["settlements_and_defaults"],
                             t["loan_timeline"])


@query("ph_balances", HOLIDAY_SQL + "SELECT agreement_code, " + columns(*BALANCES_OUT) + " FROM monthly")
def ph_balances(t):
    return holidays.ph_balances(holidays.ph_windows(t["forbearance"]), t["loan_timeline"], *HOLIDAY_MONTHS)


@query("ph_loan_table", HOLIDAY_SQL + "SELECT agreement_code, type, " + columns(
    *[d(c, c) for c in ("first_fb_start_date", "first_fb_end_date", "rmp_start_date", "rmp_end_date",
                        "add_ph_start_date", "add_ph_end_date", "sd_date")],
    x("sd_balance", "sd_balance"), n("pre_arr", "pre_arr"), *ARREARS_OUT, *BALANCES_OUT) + " FROM loans")
def ph_loan_table(t):
    return holidays.ph_loan_table(t, *HOLIDAY_MONTHS)


ON = "DATE '1998-03-31'"
STILL = f"coalesce(sd_date > {ON}, true)"
DONE = (f"greatest(first_fb_end_date, add_ph_end_date, rmp_end_date) <= {ON} AND {STILL}")
HOLIDAY_OUTCOMES = {
    "ph": (f"first_fb_start_date <= {ON}", "greatest(bal_1998_03, sd_balance)"),
    "first_ph": (f"{ON} >= first_fb_start_date AND {ON} < first_fb_end_date AND {STILL}", "bal_1998_03"),
    "ext_ph": (f"first_fb_end_date <= {ON} AND {STILL} AND (add_ph_start_date IS NOT NULL OR "
               "rmp_start_date <> first_fb_start_date) AND "
               f"least(add_ph_start_date, rmp_start_date) <= {ON} AND "
               f"greatest(add_ph_end_date, rmp_end_date) > {ON}", "bal_1998_03"),
    "perf": (f"{DONE} AND arr_1998_03 <= pre_arr", "bal_1998_03"),
    "notperf": (f"{DONE} AND arr_1998_03 > pre_arr", "bal_1998_03"),
    "def": (f"sd_date <= {ON} AND type <> 'Settlement'", "sd_balance"),
    "set": (f"sd_date <= {ON} AND type = 'Settlement'", "sd_balance"),
}


@query("ph_monthly", HOLIDAY_SQL + "SELECT " + columns(
    *[n(tally0(cond), f"vol_{k}") for k, (cond, _) in HOLIDAY_OUTCOMES.items()],
    *[x(total0(cond, value), f"val_{k}") for k, (cond, value) in HOLIDAY_OUTCOMES.items()])
       + " FROM loans")
def ph_monthly(t):
    return holidays.ph_monthly(holidays.ph_loan_table(t, *HOLIDAY_MONTHS), CUTOFF)


# ---------------------------------------------------------------- weekly regulatory report

COMMITTED = ("COMMITTED_0", "COMMITTED_1", "COMMITTED_2")
WEEKLY_ROWS = """
    rows AS (SELECT lt.agreement_code AS code, lt.capital_balance AS bal, payment_holiday AS ph,
                    holiday_adjusted_days_in_arrears AS days,
                    lt.agreement_code IN (
                      SELECT agreement_code FROM forbearance
                      WHERE status IN ('Agreed', 'Expired') AND booking_status IN ('Completed', 'Reviewed')
                        AND contains(type, 'Payment Holiday')
                        AND created_date BETWEEN DATE '1998-03-24' AND DATE '1998-03-31') AS fresh
             FROM loan_timeline lt JOIN funding_entity fe USING (agreement_code, date)
             WHERE date = DATE '1998-03-31' AND is_live AND current_funding_entity LIKE 'COMMITTED%')"""
MISSED_SQL = """
    SELECT sum(bal) AS value_of_loans_missing, count(DISTINCT code) AS number_of_loans_missing
    FROM (SELECT agreement_code AS code, date, capital_balance AS bal, arrears,
                 days_since_last_payment_date AS since,
                 lag(arrears_yesterday, CAST(coalesce(days_since_last_payment_date, 0) AS INT))
                   OVER (PARTITION BY agreement_code ORDER BY date) AS earlier
          FROM loan_timeline) h
    WHERE date = DATE '1998-03-31' AND since <= 7 AND arrears > earlier"""
DECLINED_SQL = """
    SELECT sum(total_finance_amount) AS sum_finance_declined,
           count(total_finance_amount) AS number_declined
    FROM applications WHERE stage_name = 'Closed - Declined'
      AND closed_date BETWEEN DATE '1998-03-25' AND DATE '1998-03-31'"""
DAYS_SQL = {"less_than_1m": "days BETWEEN 1 AND 30", "1m_3m": "days BETWEEN 31 AND 91",
            "3m_1y": "days BETWEEN 92 AND 365", "more_than_1y": "days > 365"}


def _codes(cond: str) -> str:
    return f"count(DISTINCT code) FILTER (WHERE {cond})"


def _rows_with(cond: str, column: str) -> str:
    return f"count({column}) FILTER (WHERE {cond})"


def _weekly_sql() -> dict[str, str]:
    out = {
        "total_drawn_from_committed_facilities": "sum(bal)",
        "number_of_loans_committed_facility": "count(DISTINCT code)",
        "impaired_loans": total("days > 0", "bal"),
        "number_impaired_loans": "count(DISTINCT bal) FILTER (WHERE days > 0)",
        "total_unimpaired_loans_ph": total("days = 0 AND ph", "bal"),
        "number_total_unimpaired_loans_ph": _codes("days = 0 AND ph"),
        "impaired_loans_ph": total("days > 0 AND ph", "bal"),
        "number_impaired_loans_ph": _rows_with("days > 0 AND ph", "bal"),
        "sum_unimpaired_cb_newly_entering_ph": total("days = 0 AND fresh", "bal"),
        "number_unimpaired_newly_entering_ph": _codes("days = 0 AND fresh"),
        "sum_impaired_cb_newly_entering_ph": total("days > 0 AND fresh", "bal"),
        "number_impaired_newly_entering_ph": _codes("days > 0 AND fresh"),
    }
    for band, cond in DAYS_SQL.items():
        out[f"impaired_loans_{band}"] = total(cond, "bal")
        out[f"impaired_loans_{band}_ph"] = total(f"{cond} AND ph", "bal")
    out["number_impaired_loans_less_than_1d"] = _codes(DAYS_SQL["less_than_1m"])
    for band in ("1m_3m", "3m_1y"):
        out[f"number_impaired_loans_{band}"] = _codes(DAYS_SQL[band])
    out["number_impaired_loans_more_than_1y"] = "count(DISTINCT bal) FILTER (WHERE days > 365)"
    for band in ("less_than_1m", "1m_3m"):
        out[f"number_impaired_loans_{band}_ph"] = _codes(f"{DAYS_SQL[band]} AND ph")
    out["number_impaired_loans_3m_1y_ph"] = _rows_with(f"{DAYS_SQL['3m_1y']} AND ph", "code")
    out["number_impaired_loans_more_than_1y_ph"] = _rows_with("days > 365 AND ph", "bal")
    return out


def _as_output(name: str) -> str:
    return (n if name.startswith("number") else x)(name, name)


@query("fca_weekly", f"WITH {WEEKLY_ROWS}, w AS (SELECT "
       + columns(*[f"{sql} AS {name}" for name, sql in _weekly_sql().items()]) + " FROM rows) SELECT "
       + columns(*[_as_output(name) for name in V.WEEKLY_METRICS])
       + f" FROM w, ({MISSED_SQL}) m, ({DECLINED_SQL}) d")
def fca_weekly(t):
    return regulatory.fca_weekly(t, MONTH, COMMITTED)


@query("missed_not_cured", "SELECT " + columns(
    _as_output("value_of_loans_missing"), _as_output("number_of_loans_missing")) + f" FROM ({MISSED_SQL}) m")
def missed_not_cured(t):
    return regulatory.missed_not_cured(t["loan_timeline"], MONTH)


@query("missed_from_state", "SELECT " + columns(
    _as_output("value_of_loans_missing"), _as_output("number_of_loans_missing")) + f" FROM ({MISSED_SQL}) m")
def missed_from_state(t):
    """Last week's state, stored, and the week since."""
    timeline = t["loan_timeline"]
    last_week = materialize(
        regulatory.arrears_state(timeline, MONTH - dt.timedelta(days=regulatory.WEEK)), "arrears")
    return regulatory.missed_from_state(
        regulatory.advanced_arrears_state(last_week, timeline, MONTH), MONTH)


@query("declined_applications", "SELECT " + columns(
    x("sum_finance_declined", "sum_finance_declined"), _as_output("number_declined"))
       + f" FROM ({DECLINED_SQL}) d")
def declined_applications(t):
    return regulatory.declined_applications(t["applications"], MONTH)


# ---------------------------------------------------------------- vehicle list

STATE_SQL = """
    p AS (SELECT la.agreement_code, registration, vin, first_name, last_name, status_code,
                 capital_balance, arrears, days_in_arrears, current_address
          FROM loan_agreements la
          LEFT JOIN customer_dim ON account_id = main_borrower_account_id
          LEFT JOIN account_address ad ON ad.id = main_borrower_account_id
          LEFT JOIN loan_timeline lt ON lt.agreement_code = la.agreement_code
                                    AND lt.date = DATE '1998-03-31')"""
STATE_OUT = columns("agreement_code", "first_name", "last_name", "status_code",
                    x("capital_balance", "capital_balance"), x("arrears", "arrears"),
                    n("days_in_arrears", "days_in_arrears"), "current_address")


@query("keeper_match", f"WITH {STATE_SQL} SELECT v.VIN, v.VRM AS VRM_list, p.registration AS "
       f"VRM_portfolio, {STATE_OUT} FROM vehicle_list v LEFT JOIN p ON p.vin = v.VIN")
def keeper_match(t):
    return matching.keeper_match_by_vin(t["vehicle_list"], t, MONTH)


@query("keeper_match_by_registration", f"WITH {STATE_SQL} SELECT v.VIN, v.VRM, {STATE_OUT} FROM "
       "(SELECT DISTINCT VIN, VRM FROM vehicle_list) v LEFT JOIN p ON p.registration = v.VRM")
def keeper_match_by_registration(t):
    return matching.keeper_match_by_registration(t["vehicle_list"], t, MONTH)


# ---------------------------------------------------------------- bureau

SEARCHED_AFTER = dt.date(1996, 6, 30)


def _bureau_select(source: str, public: str, partial: str, score: str, extra: str = "") -> str:
    fields = {f"{public}both_gd": "ccj_count_all", f"{public}both_hd": "val_act_ccj",
              f"{public}both_kd": "ccj_count_l12m", f"{public}both_ld": "ccj_count_l36m",
              f"{partial}both_or": "def_crnt_count", f"{partial}both_rr": "def_crnt_val",
              f"{partial}both_vr": "def_count_l12m", f"{partial}both_tpb": "def_count_l36m",
              score: "bur_score"}
    decisions = ("score_decline", "policy_decline", "auto_accept", "auto_decline", "auto_refer",
                 "underwriter_accept", "affordability_fail", "manual_override")
    return "SELECT " + columns(
        "la.agreement_code", "la.opportunity_id", x("affordability_gross_salary", "gross_salary"),
        d("k.created_date", "app_date"), d("la.contract_date", "contract_date"),
        x("la.total_finance_amount", "total_finance_amount"),
        x("max_monthly_allowance", "max_monthly_allowance"),
        x("max_monthly_allowance - payment", "affordability"),
        x("CAST(interest_payable AS DOUBLE) / CAST(la.total_finance_amount AS DOUBLE)", "itc_profile"),
        *[n(field, name) for field, name in fields.items()],
        d(f"{public}both_od", "date_last_ccj"), "internal_score_a", "internal_score_b",
        *[n(c, c) for c in decisions]) + extra + f"""
    FROM loan_agreements la
    JOIN loan_timeline lt ON lt.agreement_code = la.agreement_code AND lt.date = la.contract_date
    JOIN credit_score_summary css ON css.application_id = la.opportunity_id {source}"""


DEBT = "CASE WHEN full_debt_tm NOT LIKE '{%' THEN CAST(full_debt_tm AS DECIMAL(12,2)) END"
# ratio of whole numbers, rounded half up to cents in whole-number arithmetic
DTI = (f"CASE WHEN affordability_gross_salary > 0 THEN CAST(({DEBT}) AS BIGINT) * 200 "
       "+ CAST(affordability_gross_salary AS BIGINT) END"
       " // (2 * CAST(affordability_gross_salary AS BIGINT)) / 100.0")


@query("bureau_forward", _bureau_select("""
    JOIN pipeline_last ON external_ref = la.opportunity_id AND created_at > DATE '1996-06-30'
    JOIN credit_search_requests USING (pipeline_uuid) JOIN bureau_response USING (credit_search_id)
    JOIN opportunity_link k ON k.opportunity_id = la.opportunity_id
    JOIN applicant a ON a.id = k.applicant_id
    JOIN funnel_summary fs ON fs.loan_application_id = k.opportunity_id""",
    "public_", "partial_", "score_main_jf",
    f", {n('current_age', 'age_at_app')}, {x(DEBT, 'act_unsec_debt')}, {x(DTI, 'dti')}"))
def bureau_forward(t):
    return bureau.bureau_forward(t, SEARCHED_AFTER)


BUREAU_BACK_SQL = _bureau_select("""
    LEFT JOIN global_search gs ON gs.opportunity_id = la.opportunity_id
    LEFT JOIN retro_public USING (global_search_id) LEFT JOIN retro_partial USING (global_search_id)
    LEFT JOIN retro_score USING (global_search_id)
    LEFT JOIN opportunity_link k ON k.opportunity_id = la.opportunity_id
    LEFT JOIN funnel_summary fs ON fs.loan_application_id = k.opportunity_id""".replace(
        "global_search gs", "(SELECT id AS global_search_id, opportunity_id FROM global_search) gs"),
    "", "", "main_jf")


@query("bureau_back", BUREAU_BACK_SQL)
def bureau_back(t):
    return bureau.bureau_back(t)


@query("bureau_back_counts", "SELECT " + columns(
    n("count(*)", "rows"), n("count(DISTINCT agreement_code)", "keys"),
    n("count(*) - count(agreement_code)", "null_keys"), n("count(*) - count(bur_score)", "null_bur_score"),
    n("count(*) - count(gross_salary)", "null_gross_salary")) + f" FROM ({BUREAU_BACK_SQL}) r")
def bureau_back_counts(t):
    """Counts that arrive with the report, which is written once."""
    report, watch = checks.watched(bureau.bureau_back(t), ["agreement_code"],
                                   nulls_of=["bur_score", "gross_salary"])
    materialize(report, "bureau_back")
    return watch.frame(t.spark)


# the join-heavy feature table doubles as the star-join example
@query("bureau_features", _bureau_select("""
    JOIN opportunity_link k ON k.opportunity_id = la.opportunity_id
    JOIN funnel_summary fs ON fs.loan_application_id = la.opportunity_id
    JOIN (SELECT *, 'P' || substr(credit_search_id, 2) AS uuid FROM bureau_response) b
      ON b.uuid = 'P' || CAST(la.opportunity_id AS VARCHAR)""",
    "public_", "partial_", "score_main_jf",
    f", {n('(SELECT current_age FROM applicant WHERE id = k.applicant_id)', 'age_at_app')}"
    f", {x(DEBT, 'act_unsec_debt')}, {x(DTI, 'dti')}"))
def bureau_features(t):
    return bureau.bureau_forward(t, dt.date(1900, 1, 1))


# ---------------------------------------------------------------- segments

DAY, BASELINE, CONTRACTS_BEFORE, REFERENCE_YEAR = (
    dt.date(1998, 10, 31), dt.date(1998, 3, 31), dt.date(1998, 4, 1), 2020)


def _rank(column: str) -> str:
    return (f"CASE {column} WHEN 'Up-to-Date' THEN 0 WHEN '0-Down' THEN 1 "
            f"ELSE CAST(left({column}, 1) AS INT) END")


EXPOSURE_SQL = f"""
    WITH portfolio AS (
        SELECT lt.agreement_code, lt.status_code, lt.capital_balance, lt.days_in_arrears, lt.arrears,
               lt.arrears_status, lt.arrears_status_last_payment_date,
               b.arrears_status AS base_arr_stat, {_rank("b.arrears_status")} AS base_arr_num,
               {_rank("lt.arrears_status")} AS arr_num,
               {_rank("lt.arrears_status_last_payment_date")} AS pre_arr_num,
               account_id, 2020 - CAST(birth_year AS INT) AS age_yr, is_with_solicitors, region,
               employment_status, total_months_of_forbearance, had_covid_ph, is_vulnerable,
               industry, cv_impact
        FROM loan_timeline lt
        LEFT JOIN loan_timeline b ON b.agreement_code = lt.agreement_code AND b.is_live
                                 AND b.date = DATE '1998-03-31'
        LEFT JOIN loan_agreements la ON la.agreement_code = lt.agreement_code
        LEFT JOIN customer_dim ON account_id = main_borrower_account_id
        LEFT JOIN (SELECT agreement_code, max(employment_industry) AS industry,
                          max(employment_impact) AS cv_impact
                   FROM case_notes GROUP BY agreement_code) c ON c.agreement_code = lt.agreement_code
        WHERE lt.date = DATE '1998-10-31' AND lt.is_live AND lt.contract_date < DATE '1998-04-01'),
    grouped AS (SELECT *, CASE WHEN age_yr >= 50 THEN '50+' WHEN age_yr >= 35 THEN '35-49'
                               WHEN age_yr >= 25 THEN '25-34' WHEN age_yr >= 16 THEN '16-24'
                               ELSE 'Unknown' END AS age_group FROM portfolio)"""


def exposure(t):
    return segments.exposure_portfolio(t, DAY, BASELINE, CONTRACTS_BEFORE, REFERENCE_YEAR)


@query("exposure_portfolio", EXPOSURE_SQL + "SELECT " + columns(
    "agreement_code", "status_code", x("capital_balance", "capital_balance"),
    n("days_in_arrears", "days_in_arrears"), x("arrears", "arrears"), "arrears_status",
    "arrears_status_last_payment_date", "base_arr_stat",
    *[n(c, c) for c in ("base_arr_num", "arr_num", "pre_arr_num", "age_yr",
                        "total_months_of_forbearance")],
    "account_id", "is_with_solicitors", "region", "employment_status", "had_covid_ph",
    "is_vulnerable", "industry", "cv_impact") + " FROM portfolio")
def exposure_portfolio(t):
    return exposure(t)


MOVES = {"det": "arr_num > base_arr_num", "hold": "arrears_status = base_arr_stat",
         "imp": "arr_num < base_arr_num"}


def _share(part: str, whole: str) -> str:
    return f"CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0)"


def _migration_sql(segment: str, where: str = "") -> str:
    sums = ["count(DISTINCT agreement_code) AS cust", "sum(capital_balance) AS portfolio_bal",
            "count(*) FILTER (WHERE had_covid_ph) AS covid",
            f"{total0('had_covid_ph', 'capital_balance')} AS covid_bal"]
    for tag, scope in (("", ""), ("_cv", " AND had_covid_ph")):
        for name, cond in MOVES.items():
            sums.append(f"count(*) FILTER (WHERE {cond}{scope}) AS {name}{tag}_vol")
            sums.append(f"{total0(cond + scope, 'capital_balance')} AS {name}{tag}_bal")
    return (f"SELECT *, {_share('covid_bal', 'portfolio_bal')} AS cv_exp, "
            + columns(*[f"{_share(f'{m}{tag}_bal', whole)} AS per{tag}_{out}"
                        for tag, whole in (("", "portfolio_bal"), ("_cv", "covid_bal"))
                        for m, out in (("det", "det"), ("hold", "held"), ("imp", "imp"))])
            + f" FROM (SELECT {segment}, {columns(*sums)} FROM grouped {where} GROUP BY 1) s")


MOVE_OUT = [f"{m}{tag}_{kind}" for m in MOVES for tag in ("", "_cv") for kind in ("vol", "bal")]
RATIOS = ["per_det", "per_held", "per_imp", "per_cv_det", "per_cv_held", "per_cv_imp", "cv_exp"]


def _migration_out(segment: str) -> str:
    return columns(segment, n("cust", "cust"), x("portfolio_bal", "portfolio_bal"), n("covid", "covid"),
                   x("covid_bal", "covid_bal"),
                   *[(n if c.endswith("vol") else x)(c, c) for c in MOVE_OUT],
                   *[x(c, c) for c in RATIOS])


@query("migration_by_region",
       EXPOSURE_SQL + f"SELECT {_migration_out('region')} FROM ({_migration_sql('region')}) m")
def migration_by_region(t):
    return segments.segment_migration(exposure(t), "region")


@query("migration_by_age",
       EXPOSURE_SQL + f"SELECT {_migration_out('age_group')} FROM ({_migration_sql('age_group')}) m")
def migration_by_age(t):
    return segments.segment_migration(segments.with_age_group(exposure(t)), "age_group")


IN_WORK = "WHERE employment_status IN ('SELF EMPLOYED', 'EMPLOYED')"


@query("migration_by_employment", EXPOSURE_SQL + f"SELECT {_migration_out('employment_status')} "
       f"FROM ({_migration_sql('employment_status', IN_WORK)}) m")
def migration_by_employment(t):
    return segments.segment_migration(segments.in_employment(exposure(t)), "employment_status")


MEANS = "SELECT " + columns(*[x(f"avg({c})", f"avg_{c}") for c in RATIOS])


@query("mean_of_group_ratios", EXPOSURE_SQL + f"{MEANS} FROM ({_migration_sql('region')}) m")
def mean_of_group_ratios(t):
    return segments.mean_ratios(segments.segment_migration(exposure(t), "region"))


@query("mean_of_age_ratios", EXPOSURE_SQL + f"{MEANS} FROM ({_migration_sql('age_group')}) m")
def mean_of_age_ratios(t):
    return segments.mean_ratios(
        segments.segment_migration(segments.with_age_group(exposure(t)), "age_group"))


def _band_sql(segment: str, where: str = "") -> str:
    return EXPOSURE_SQL + "SELECT " + columns(
        segment, n("arr_num", "arr_num"), x("sum(capital_balance)", "total_cb"),
        x(total0("NOT had_covid_ph", "capital_balance"), "non_cv_cb"),
        x(total0("had_covid_ph", "capital_balance"), "cv_bal")) + (
        f" FROM portfolio {where} GROUP BY portfolio.{segment}, portfolio.arr_num")


@query("region_band_balance", _band_sql("region"))
def region_band_balance(t):
    return segments.segment_band_balance(exposure(t), "region")


@query("employment_band_balance", _band_sql("employment_status", IN_WORK))
def employment_band_balance(t):
    return segments.segment_band_balance(segments.in_employment(exposure(t)), "employment_status")


EXITS_AFTER = dt.date(1998, 3, 30)
SEGMENT_COLUMNS = """main_borrower_account_id, coalesce(region, 'Unknown') AS region, employment_status,
               had_covid_ph, 2020 - CAST(birth_year AS INT) AS age_yr,
               CASE WHEN 2020 - CAST(birth_year AS INT) >= 50 THEN '50+'
                    WHEN 2020 - CAST(birth_year AS INT) >= 35 THEN '35-49'
                    WHEN 2020 - CAST(birth_year AS INT) >= 25 THEN '25-34'
                    WHEN 2020 - CAST(birth_year AS INT) >= 16 THEN '16-24' ELSE 'Unknown' END AS age_group
        FROM {} r LEFT JOIN loan_agreements la ON la.agreement_code = r.agreement_code
        LEFT JOIN customer_dim ON account_id = main_borrower_account_id"""
BOOK_SQL = f"""
    WITH book AS (SELECT r.agreement_code, capital_balance, {SEGMENT_COLUMNS.format("loan_timeline")}
                  WHERE r.date = DATE '1998-03-31' AND r.is_live),
    gone AS (SELECT r.agreement_code, amount, type, {SEGMENT_COLUMNS.format("settlements_and_defaults")}
             WHERE processed_date > DATE '1998-03-30')"""
SEGMENTS_OUT = columns("main_borrower_account_id", "region", "employment_status", "had_covid_ph",
                       n("age_yr", "age_yr"), "age_group")


def book(t):
    return segments.opening_book(t, BASELINE, REFERENCE_YEAR)


def gone(t):
    return segments.exits_segmented(t, EXITS_AFTER, REFERENCE_YEAR)


@query("opening_book", BOOK_SQL + f"SELECT agreement_code, {x('capital_balance', 'capital_balance')}, "
       f"{SEGMENTS_OUT} FROM book")
def opening_book(t):
    return book(t)


@query("exits_segmented", BOOK_SQL + f"SELECT agreement_code, type, {x('amount', 'amount')}, "
       f"{SEGMENTS_OUT} FROM gone")
def exits_segmented(t):
    return gone(t)


EXIT_KINDS = {"def": "type IN ('Default', 'VT - Default')", "vt": "type = 'VT'",
              "set": "type = 'Settlement'", "unw": "type = 'Unwind'"}


def _exit_rates_sql(segment: str, where: str = "") -> str:
    exits = [f"{tally0('had_covid_ph')} AS cv_vol", f"{total0('had_covid_ph', 'amount')} AS cv_val",
             f"{total('had_covid_ph', 'amount')} AS cv_cb",
             f"{total('NOT had_covid_ph', 'amount')} AS non_cv_bal"]
    out = [segment, n("cv_vol", "cv_vol"), x("cv_val", "cv_val"), x("cv_cb", "cv_cb"),
           x("non_cv_bal", "non_cv_bal"), n("vol", "vol"), x("val", "val"), x("cv_bal", "cv_bal"),
           x("noncv_val", "noncv_val"), x(_share("cv_bal", "val"), "cv_exp")]
    for kind, cond in EXIT_KINDS.items():
        exits += [f"{tally0(cond)} AS {kind}_vol", f"{total0(cond, 'amount')} AS {kind}_val",
                  f"{total0(cond + ' AND NOT had_covid_ph', 'amount')} AS {kind}_val_noncv",
                  f"{total0(cond + ' AND had_covid_ph', 'amount')} AS {kind}_val_cv"]
        out += [n(f"{kind}_vol", f"{kind}_vol"), x(f"{kind}_val", f"{kind}_val"),
                x(f"{kind}_val_noncv", f"{kind}_val_noncv"), x(f"{kind}_val_cv", f"{kind}_val_cv")]
        if kind != "unw":
            out += [x(_share(f"{kind}_val", "val"), f"{kind}_per"),
                    x(_share(f"{kind}_val_noncv", "noncv_val"), f"noncv_{kind}_per"),
                    x(_share(f"{kind}_val_cv", "cv_bal"), f"cv_{kind}_per")]
    return BOOK_SQL + f"""
    SELECT {columns(*out)}
    FROM (SELECT {segment}, {columns(*exits)} FROM gone {where} GROUP BY 1) e
    JOIN (SELECT {segment}, count(*) AS vol, sum(capital_balance) AS val,
                 {total0("had_covid_ph", "capital_balance")} AS cv_bal,
                 {total0("NOT had_covid_ph", "capital_balance")} AS noncv_val
          FROM book GROUP BY 1) b USING ({segment})"""


@query("exit_rates_age", _exit_rates_sql("age_group"))
def exit_rates_age(t):
    return segments.exit_rates(gone(t), book(t), "age_group")


@query("exit_rates_region", _exit_rates_sql("region"))
def exit_rates_region(t):
    return segments.exit_rates(gone(t), book(t), "region")


@query("exit_rates_employment", _exit_rates_sql("employment_status", IN_WORK))
def exit_rates_employment(t):
    return segments.exit_rates(segments.in_employment(gone(t)), book(t), "employment_status")


# ---------------------------------------------------------------- provision bridge

MOVES_AT = "provision_timeline WHERE date = DATE '1998-03-31'"
STAYED_LIVE = "previous_scenario = 'live' AND scenario = 'live'"
CHANGE = "provision_held - previous_provision_held"


def cube(t):
    return provision.movement_cube(t["provision_timeline"], MONTH)


def _summary_sql(scenario: str) -> str:
    now = total(f"scenario = '{scenario}'", "provision_held")
    before = total(f"previous_scenario = '{scenario}'", "previous_provision_held")
    return "SELECT " + columns(x(now, "current_prov"), x(before, "last_prov"),
                               x(f"{now} - {before}", "provision_charge")) + f" FROM {MOVES_AT}"


def _moved_sql(before: str, after: str, value: str) -> str:
    return (f"SELECT {x(f'sum({value})', 'movement')} FROM {MOVES_AT} "
            f"AND (previous_scenario, scenario) = ('{before}', '{after}')")


def _rolls_sql(cond: str, keys: str = "previous_state, state") -> str:
    return f"SELECT {keys}, {x(f'sum({CHANGE})', 'charge')} FROM {MOVES_AT} AND {cond} GROUP BY {keys}"


@query("prov_live_summary", _summary_sql("live"))
def prov_live_summary(t):
    return provision.scenario_summary(cube(t), provision.LIVE)


@query("prov_live_to_covid", _moved_sql("live", "covid", "-previous_provision_held"))
def prov_live_to_covid(t):
    return provision.left_live(cube(t), provision.COVID)


@query("prov_live_to_terminated", _moved_sql("live", "terminated", "-previous_provision_held"))
def prov_live_to_terminated(t):
    return provision.left_live(cube(t), provision.TERMINATED)


@query("prov_covid_to_live", _moved_sql("covid", "live", "provision_held"))
def prov_covid_to_live(t):
    return provision.joined_live(cube(t), provision.COVID)


@query("prov_terminated_to_live", _moved_sql("terminated", "live", "provision_held"))
def prov_terminated_to_live(t):
    return provision.joined_live(cube(t), provision.TERMINATED)


@query("prov_new_business", "SELECT " + columns(
    x("sum(provision_held)", "provision"), n("count(DISTINCT agreement_code)", "agreements"))
       + f" FROM {MOVES_AT} AND coalesce(previous_scenario, CAST(previous_state AS VARCHAR)) IS NULL")
def prov_new_business(t):
    return provision.new_business(t["provision_timeline"], MONTH)


@query("prov_static", _rolls_sql(f"{STAYED_LIVE} AND previous_state = state", "state"))
def prov_static(t):
    return provision.static_rolls(cube(t))


@query("prov_improved_linear", _rolls_sql(
    f"{STAYED_LIVE} AND state BETWEEN 0 AND 4 AND previous_state - state = 1"))
def prov_improved_linear(t):
    return provision.improved_rolls(cube(t), one_step=True)


@query("prov_improved_other", _rolls_sql(
    f"{STAYED_LIVE} AND state BETWEEN 0 AND 4 AND previous_state - state > 1"))
def prov_improved_other(t):
    return provision.improved_rolls(cube(t), one_step=False)


@query("prov_deteriorated", _rolls_sql(
    f"{STAYED_LIVE} AND state BETWEEN 0 AND 4 AND state - previous_state >= 1"))
def prov_deteriorated(t):
    return provision.deteriorated_rolls(cube(t))


@query("prov_deteriorated_other", _rolls_sql(
    f"{STAYED_LIVE} AND state BETWEEN 0 AND 4 AND state - previous_state >= 2"))
def prov_deteriorated_other(t):
    return provision.deteriorated_rolls(cube(t), skip_one_step=True)


@query("prov_settled", _rolls_sql(f"{STAYED_LIVE} AND state >= 9001 AND previous_state < 9001", "state"))
def prov_settled(t):
    return provision.settled_rolls(cube(t))


@query("prov_term_summary", _summary_sql("terminated"))
def prov_term_summary(t):
    return provision.scenario_summary(cube(t), provision.TERMINATED)


@query("prov_term_inter_scenario", f"""
    SELECT previous_scenario, scenario, {x("sum(provision_held)", "provision")} FROM {MOVES_AT}
      AND scenario = 'terminated' AND previous_scenario IN ('live', 'covid') GROUP BY ALL""")
def prov_term_inter_scenario(t):
    return provision.terminated_inflow(cube(t))


STAYED_OUT = "previous_scenario = 'terminated' AND scenario = 'terminated'"


@query("prov_term_inter_state", _rolls_sql(f"{STAYED_OUT} AND previous_state <> state"))
def prov_term_inter_state(t):
    return provision.terminated_state_moves(cube(t))


@query("prov_term_same_state", _rolls_sql(f"{STAYED_OUT} AND previous_state = state", "state"))
def prov_term_same_state(t):
    return provision.terminated_static(cube(t))


LADDER = f"{STAYED_LIVE} AND state BETWEEN 0 AND 4 AND"
BRIDGE_SQL = {
    "live_to_covid": ("previous_scenario = 'live' AND scenario = 'covid'", "-previous_provision_held", 0),
    "live_to_terminated": ("previous_scenario = 'live' AND scenario = 'terminated'",
                           "-previous_provision_held", 0),
    "covid_to_live": ("previous_scenario = 'covid' AND scenario = 'live'", "provision_held", 0),
    "terminated_to_live": ("previous_scenario = 'terminated' AND scenario = 'live'", "provision_held", 0),
    "new_business": ("previous_scenario IS NULL AND previous_state IS NULL", "provision_held", 0),
    "terminated_inflow": ("previous_scenario <> 'terminated' AND scenario = 'terminated'",
                          "provision_held", 0),
    "static": (f"{STAYED_LIVE} AND previous_state = state", CHANGE, 1),
    "improved_linear": (f"{LADDER} previous_state - state = 1", CHANGE, 1),
    "improved_other": (f"{LADDER} previous_state - state > 1", CHANGE, 1),
    "deteriorated": (f"{LADDER} state > previous_state", CHANGE, 1),
    "deteriorated_other": (f"{LADDER} state - previous_state > 1", CHANGE, 1),
    "settled": (f"{STAYED_LIVE} AND state >= 9001 AND previous_state < 9001", CHANGE, 1),
    "terminated_state_moves": (f"{STAYED_OUT} AND previous_state <> state", CHANGE, 1),
    "terminated_static": (f"{STAYED_OUT} AND previous_state = state", CHANGE, 1),
}


@query("provision_bridge", " UNION ALL ".join(
    f"SELECT '{name}' AS movement, {'previous_state' if by_state else 'NULL'} AS previous_state, "
    f"{'state' if by_state else 'NULL'} AS state, {x(f'sum({value})', 'amount')} "
    f"FROM {MOVES_AT} AND {cond} GROUP BY ALL HAVING count(*) > 0"
    for name, (cond, value, by_state) in BRIDGE_SQL.items()))
def provision_bridge(t):
    return provision.provision_bridge(t["provision_timeline"], MONTH)
