"""Applications and new business: funnel, profile, loan-to-value and fuel breakdowns."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import values as V
from ..functions.aggregates import sum_if, tally, tally0
from ..functions.dates import age_from_dob, months_diff, whole_years
from ..functions.numeric import bands, floor_to, lookup, ratio
from ..operators.joins import between_dates, left_join_many
from ..operators.reshape import with_total
from ..sources.tables import dimension

Tables = Mapping[str, DataFrame]

FUNNEL_CHANNELS = {
    "aggregator": "1. Aggregator",
    "dtc": "2. DTC",
    "dealer": "3. Dealer",
    "non_internet_broker": "4. Non-Internet Broker",
    "other": "5. Other",
}
TOTAL = "TOTAL"

KNOWN_FUELS = (*V.PETROL, *V.DIESEL, *V.HYBRID, *V.ELECTRIC, *V.LPG, V.FUEL_UNKNOWN)


def _channel(category: Column) -> Column:
    pos = F.col("platform") == V.POINT_OF_SALE
    dealer = category.isin(*V.DEALER_CATEGORIES) | category.isNull()
    return (
        F.when(pos & dealer, FUNNEL_CHANNELS["dealer"])
        .when(pos & category.isin(*V.OFFLINE_BROKER_CATEGORIES),
              FUNNEL_CHANNELS["non_internet_broker"])
        .when(pos & (category == V.ONLINE_BROKER), FUNNEL_CHANNELS["aggregator"])
        .when((F.col("platform") == V.DIRECT) | (category == V.DIRECT), FUNNEL_CHANNELS["dtc"])
        .otherwise(FUNNEL_CHANNELS["other"])
    )


def introducer_channel(applications: DataFrame, dealers: DataFrame) -> DataFrame:
    """Sales channel of every application."""
    dealers = dealers.select(F.col("dealer_id").alias("introducer_id"), "introducer_category")
    return (
        applications.join(dealers, "introducer_id", "left")
        .select("application_id", _channel(F.col("introducer_category")).alias("introducer_channel"))
    )


def application_funnel(t: Tables, start: dt.date, end: dt.date, by_channel: bool = True,
                       drop_test: bool = True) -> DataFrame:
    """Volumes and values from application to new business, per month and channel.

    With ``by_channel`` a TOTAL row per month is added. ``by_channel=False`` and
    ``drop_test=False`` give the earlier, unsplit report.
    """
    apps = between_dates(t["funnel_summary"], "created_date", start, end)
    if drop_test:
        apps = apps.filter(~F.col("test_application_flag"))
    keys = ["month_end"]
    if by_channel:
        keys.append("introducer_channel")
        channel = introducer_channel(t["applications"], dimension(t, "dealer_dim"))
        apps = apps.join(channel.withColumnRenamed("application_id", "loan_application_id"),
                         "loan_application_id", "left")
    loans = dimension(t, "loan_agreements").select(
        F.col("opportunity_id").alias("loan_application_id"), "total_finance_amount")
    opportunities = dimension(t, "opportunity").select(
        F.col("id").alias("loan_application_id"), "finance_amount")
    rows = (
        apps.join(loans, "loan_application_id", "left")
        .join(opportunities, "loan_application_id", "left")
        .withColumn("month_end", F.last_day("created_date"))
    )

    asked, lent = F.col("finance_amount"), F.col("total_finance_amount")
    referred = F.coalesce(F.col("auto_refer"), F.lit(1))
    manual, decided = referred == 1, F.col("underwriter_accept")
    main_provider = F.col("credit_search_provider") == "TU"
    auto_declined = (main_provider & (F.col("auto_decline") == 1)) | (
        ~main_provider & (F.col("auto_accept") == 0) & (F.col("auto_refer") == 0))
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("app_vol"),
        F.sum(asked).alias("app_val"),
        F.sum("auto_accept").alias("auto_accept"),
        tally(auto_declined).alias("auto_declines"),
        F.sum(referred).alias("auto_refer"),
        tally(manual & (decided == 1)).alias("manual_acc"),
        tally(manual & (decided == 0)).alias("manual_dec"),
        tally(manual & decided.isNull()).alias("manual_pend"),
        F.sum(decided).alias("final_accepts"),
        sum_if(decided == 1, asked).alias("final_accept_amt"),
        tally0(decided == 0).alias("final_declines"),
        tally0(decided.isNull()).alias("final_pending"),
        tally(lent > 0).alias("new_business"),
        F.sum(lent).alias("new_business_amt"),
    )
    return with_total(sums, "month_end", "introducer_channel", TOTAL) if by_channel else sums


def _new_loans(t: Tables, start: dt.date, end: dt.date) -> DataFrame:
    return between_dates(t["loan_agreements"], "contract_date", start, end)


def car_age(registered: Column, contracted: Column) -> Column:
    """Car age in whole years at contract; -1 for a car registered in the contract month."""
    return F.when(months_diff(registered, contracted) == 0, F.lit(-1)).otherwise(
        whole_years(registered, contracted))


def profile_rows(t: Tables, start: dt.date, end: dt.date, age_from_birth: bool = False,
                 opportunities: DataFrame | None = None) -> DataFrame:
    """New loans of a period with everything the profile breaks them down by.

    A loan appears more than once if its borrower has several current residences. Vehicle and
    fuel come from two opportunity tables; in the older variant ``opportunities`` (``id``,
    ``vehicle_name``, ``fuel_type``) is the only one.
    """
    car = (t["opportunity"] if opportunities is None else opportunities).select(
        F.col("id").alias("opportunity_id"), "vehicle_name", F.col("fuel_type").alias("fuel"))
    if opportunities is not None:
        car = car.withColumn("earlier_fuel", F.col("fuel"))
    loans = _new_loans(t, start, end).select(
        "agreement_code", "opportunity_id", "main_borrower_account_id", "introducer_id", "platform",
        "contract_date", "registration_date", "term", "total_finance_amount",
        "current_retail_value", "mileage")
    accounts = (
        t["account"].filter("is_person").select(F.col("id").alias("main_borrower_account_id"),
                                                F.col("employment_status").alias("employment"))
        .distinct()
    )
    link = t["opportunity_link"]
    residence = (
        t["residence"].filter(F.col("is_current") == 1)
        .select(F.col("applicant_id").alias("account_id"), F.col("status").alias("residence"))
        .join(link.select("account_id", "opportunity_id"), "account_id")
        .select("opportunity_id", "residence")
    )
    funded = link.filter(F.col("exclusion_reason").isNull() & F.col("loan_id").isNotNull())
    income = t["income_summary"].select(F.col("loan_application_id").alias("opportunity_id"),
                                        F.col("gross_annual_income").alias("income"))
    age = age_from_dob(F.col("date_of_birth"), end) if age_from_birth else F.col("current_age")
    applicants = t["applicant"].select(F.col("id").alias("applicant_id"), age.alias("age"))
    rows = (
        left_join_many(loans, residence, "opportunity_id")
        .join(funded.select("opportunity_id").join(income, "opportunity_id", "left"),
              "opportunity_id", "left")
        .join(funded.select("opportunity_id", "applicant_id").join(applicants, "applicant_id", "left")
              .drop("applicant_id"), "opportunity_id", "left")
        .join(car, "opportunity_id", "left")
        .join(t["dealer_dim"].select(F.col("dealer_id").alias("introducer_id"),
                                     F.col("introducer_category").alias("category")),
              "introducer_id", "left")
        .join(accounts, "main_borrower_account_id", "left")
        .withColumn("car_age", car_age(F.col("registration_date"), F.col("contract_date")))
    )
    if opportunities is None:
        rows = rows.join(t["opportunity_history"].select(
            F.col("id").alias("opportunity_id"), F.col("fuel_type").alias("earlier_fuel")),
            "opportunity_id", "left")
    return rows


def _ranges(column: str, prefix: str, edges: list[tuple[int | None, int | None, str]]) -> dict[str, Column]:
    value = F.col(column)
    return {f"{prefix}{name}": bands(value, [(low, high, True)]) for low, high, name in edges}


def _any_of(column: str, groups: dict[str, tuple[str, ...]]) -> dict[str, Column]:
    return {name: F.col(column).isin(*members) for name, members in groups.items()}


def profile_groups() -> dict[str, Column]:
    """Metric name -> the condition a loan must meet to count in it."""
    category, platform = F.col("category"), F.col("platform")
    pos = platform == V.POINT_OF_SALE
    vehicle, fuel = F.col("vehicle_name"), F.col("fuel")
    return {
        "dealer": pos & (category.isin(*V.DEALER_CATEGORIES) | category.isNull()),
        "non_internet_broker": pos & category.isin(*V.OFFLINE_BROKER_CATEGORIES),
        "aggregator": pos & (category == V.ONLINE_BROKER),
        "dtc": (platform == V.DIRECT) | (category == V.DIRECT),
        "other_channel": platform.isNull() & ((category != V.DIRECT) | category.isNull()),
        **_ranges("age", "cust_age_", [
            (None, 21, "lt21"), (21, 30, "lt30"), (30, 40, "lt40"), (40, 50, "lt50"),
            (50, 60, "lt60"), (60, 70, "lt70"), (70, None, "gt70")]),
        "cust_age_missing": F.col("age").isNull(),
        **_any_of("employment", {
            "employed": V.EMPLOYED, "self_employed": V.SELF_EMPLOYED, "retired": V.RETIRED,
            "homemaker": V.HOMEMAKER, "employed_other": V.EMPLOYED_OTHER}),
        "employed_unknown": F.col("employment").isin(*V.EMPLOYED_UNKNOWN)
        | F.col("employment").isNull(),
        **_any_of("residence", {
            "homeowner": V.HOME_OWNER, "tenant": V.TENANT, "living_with_parent": V.WITH_PARENTS,
            "resident_other": V.RESIDENT_OTHER}),
        "resident_unknown": F.col("residence").isin(*V.RESIDENT_UNKNOWN)
        | F.col("residence").isNull(),
        **{f"car_age_{name}": F.col("car_age") == code for name, code in
           (("new", -1), ("lt1", 0))},
        **_ranges("car_age", "car_age_", [
            (1, 4, "lt4"), (4, 7, "lt7"), (7, 10, "lt10"), (10, None, "gt10")]),
        "car": (vehicle != V.LIGHT_COMMERCIAL) | vehicle.isNull(),
        "lcv": vehicle == V.LIGHT_COMMERCIAL,
        **_ranges("mileage", "mileage_", [
            (None, 10_000, "lt10k"), (10_000, 25_000, "lt25k"), (25_000, 50_000, "lt50k"),
            (50_000, 75_000, "lt75k"), (75_000, 100_000, "lt100k"), (100_000, None, "gt100k")]),
        "mileage_unknown": F.col("mileage").isNull(),
        **_any_of("fuel", {"petrol": V.PETROL, "diesel": V.DIESEL, "hybrid": V.HYBRID,
                           "electric": V.ELECTRIC, "lpg": V.LPG}),
        # the value list is tested on one table, the NULL test on the other: as reported
        "fuel_other": ~fuel.isin(*KNOWN_FUELS) & F.col("earlier_fuel").isNotNull(),
        "fuel_unknown": fuel.isNull() | (fuel == V.FUEL_UNKNOWN),
    }


def _profile_metrics(measure: str) -> dict[str, Column]:
    amount, age_months = F.col("total_finance_amount"), months_diff(
        F.col("registration_date"), F.col("contract_date"))
    income = F.col("income")
    declared = income.between(0, 150_000)
    by_value = measure == "value"
    weight = amount if by_value else F.lit(1)
    counted = {name: sum_if(cond, weight) for name, cond in profile_groups().items()}
    return {
        "nb_total": F.sum(amount) if by_value else F.count_distinct("agreement_code"),
        "retail_value": F.sum("current_retail_value"),
        "term": F.sum("term"),
        "cust_age_avg": F.round(F.avg("age"), 2),
        # loans are counted, incomes are summed
        "gross_income": sum_if(declared, income if by_value else F.lit(1)),
        # the volume report leaves out cars registered in the contract month
        "avg_car_age": F.avg(age_months if by_value else F.when(age_months != 0, age_months)),
        "avg_mileage": floor_to(F.avg("mileage"), 2),
        **counted,
    }


def new_business_profile(t: Tables, start: dt.date, end: dt.date, measure: str = "volume",
                         age_from_birth: bool = False,
                         opportunities: DataFrame | None = None) -> DataFrame:
    """New loans per month broken down by channel, customer and car: counts or amounts.

    ``opportunities`` makes it the older variant (see ``profile_rows``).
    """
    metrics = _profile_metrics(measure)
    return (
        profile_rows(t, start, end, age_from_birth, opportunities)
        .groupBy(F.last_day("contract_date").alias("month_end"))
        .agg(*[column.alias(name) for name, column in metrics.items()])
    )


def new_business_stack(t: Tables, start: dt.date, end: dt.date) -> DataFrame:
    """Volume rows and value rows of the profile in one frame, from a single pass."""
    measures = {m: _profile_metrics(m) for m in ("volume", "value")}
    wide = (
        profile_rows(t, start, end)
        .groupBy(F.last_day("contract_date").alias("month_end"))
        .agg(*[column.cast("double").alias(f"{m}__{name}")
               for m, metrics in measures.items() for name, column in metrics.items()])
    )
    rows = [
        F.struct(F.lit(m).alias("measure"),
                 *[F.col(f"{m}__{name}").alias(name) for name in metrics])
        for m, metrics in measures.items()
    ]
    return wide.select("month_end", F.inline(F.array(*rows)))


def ltv_buckets(loans: DataFrame) -> DataFrame:
    """Loans with their loan-to-value ratio and its label.

    A ratio from 1.09 up to 1.1 falls between two labels and stays NULL.
    """
    ltv = ratio(F.col("total_finance_amount"), F.col("current_retail_value"))
    label = bands(F.col("ltv"), [
        (None, 0.7, "1. 0.7"), (0.7, 0.8, "2. 0.7-0.79"), (0.8, 0.9, "3. 0.8-0.89"),
        (0.9, 1.0, "4. 0.9-0.99"), (1.0, 1.09, "5. 1-1.09"), (1.1, None, "6. 1.1")])
    return loans.withColumn("ltv", ltv).withColumn(
        "ltv_bucket", F.when(F.col("ltv").isNull(), "7. Unknown").otherwise(label))


def ltv_breakdown(t: Tables, start: dt.date, end: dt.date) -> DataFrame:
    """New loans and amounts per loan-to-value label."""
    return (
        ltv_buckets(_new_loans(t, start, end))
        .groupBy(F.last_day("contract_date").alias("rep_month"), "ltv_bucket")
        .agg(F.count_distinct("agreement_code").alias("vol"),
             F.sum("total_finance_amount").alias("val"))
        .orderBy(F.col("ltv_bucket").asc_nulls_last())
    )


def fuel_label(fuel: Column) -> Column:
    named = lookup(fuel, [
        (V.PETROL, "4. Petrol"), (V.DIESEL, "1. Diesel"), (V.ELECTRIC, "2. Electric"),
        (V.HYBRID, "3. Hybrid"), (V.LPG, "6. LPG")])
    return F.coalesce(named, F.when(~fuel.isin(*KNOWN_FUELS), "5. Other"), F.lit("Unknown"))


def fuel_breakdown(t: Tables, start: dt.date, end: dt.date) -> DataFrame:
    """New loans per fuel group with average term, age, car age and mileage.

    ``avg_retail_val`` is a rounded sum, as reported. A loan whose opportunity is missing
    has a NULL fuel group; an opportunity without a known fuel is "Unknown".
    """
    opportunities = t["opportunity"].select(
        F.col("id").alias("opportunity_id"), F.col("mileage").alias("listed_mileage"),
        fuel_label(F.col("fuel_type")).alias("fuel_type"))
    applicants = t["applicant"].select(F.col("id").alias("applicant_id"), "current_age")
    link = t["opportunity_link"].select("opportunity_id", "applicant_id")
    age_months = F.abs(months_diff(F.col("contract_date"), F.col("registration_date")))
    return (
        _new_loans(t, start, end)
        .join(link, "opportunity_id", "left")
        .join(opportunities, "opportunity_id", "left")
        .join(applicants, "applicant_id", "left")
        .groupBy(F.last_day("contract_date").alias("month_end"), "fuel_type")
        .agg(F.count(F.lit(1)).alias("vol"),
             F.round(F.avg("term"), 2).alias("avg_term"),
             F.round(F.sum("current_retail_value"), 2).alias("avg_retail_val"),
             F.round(F.avg("current_age"), 2).alias("avg_age"),
             F.round(F.avg(age_months), 2).alias("car_age"),
             F.round(F.avg("listed_mileage"), 2).alias("avg_mileage"))
        .orderBy(F.col("fuel_type").asc_nulls_last())
    )
