"""Exposure, migration and exits by customer segment."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import values as V
from ..functions.aggregates import sum_if, sum_if0, tally0
from ..functions.dates import age_from_birth_year
from ..functions.numeric import lookup, ratio
from ..operators.joins import on_date, snapshot_compare

Tables = Mapping[str, DataFrame]

# Arrears band -> rank; the two mildest arrears bands share one
BAND_RANK = [(("Up-to-Date",), 0), (("0-Down", "1-Down"), 1), (("2-Down",), 2),
             (("3-Down",), 3), (("4-Down",), 4), (("5+ Down",), 5)]
UNKNOWN = "Unknown"


def band_rank(band: Column) -> Column:
    return lookup(band, BAND_RANK)


def age_group(age: Column) -> Column:
    return (
        F.when(age.between(16, 24), "16-24").when(age.between(25, 34), "25-34")
        .when(age.between(35, 49), "35-49").when(age >= 50, "50+").otherwise(UNKNOWN)
    )


def _borrowers(t: Tables) -> DataFrame:
    return t["loan_agreements"].select("agreement_code", "main_borrower_account_id")


def _customers(t: Tables, *columns: str) -> DataFrame:
    return t["customer_dim"].select(F.col("account_id").alias("main_borrower_account_id"),
                                    "account_id", "birth_year", *columns)


def exposure_portfolio(t: Tables, day: dt.date, baseline: dt.date, contracts_before: dt.date,
                       reference_year: int) -> DataFrame:
    """Loans live at ``day`` with their arrears then and at ``baseline``, and their borrower."""
    live = t["loan_timeline"].filter("is_live")
    compared = snapshot_compare(live, "agreement_code", day, baseline,
                                {"arrears_status": "base_arr_stat"})
    cases = t["case_notes"].groupBy("agreement_code").agg(
        F.max("employment_industry").alias("industry"),
        F.max("employment_impact").alias("cv_impact"))
    customers = _customers(t, "is_with_solicitors", "region", "employment_status",
                           "total_months_of_forbearance", "had_covid_ph", "is_vulnerable")
    return (
        compared.filter(F.col("contract_date") < F.lit(contracts_before))
        .select("agreement_code", "status_code", "capital_balance", "days_in_arrears", "arrears",
                "arrears_status", "arrears_status_last_payment_date", "base_arr_stat",
                band_rank(F.col("base_arr_stat")).alias("base_arr_num"),
                band_rank(F.col("arrears_status")).alias("arr_num"),
                band_rank(F.col("arrears_status_last_payment_date")).alias("pre_arr_num"))
        .join(_borrowers(t), "agreement_code", "left")
        .join(cases, "agreement_code", "left")
        .join(customers, "main_borrower_account_id", "left")
        .withColumn("age_yr", age_from_birth_year(F.col("birth_year"), reference_year))
        .drop("birth_year", "main_borrower_account_id")
    )


def with_age_group(portfolio: DataFrame) -> DataFrame:
    return portfolio.withColumn("age_group", age_group(F.col("age_yr")))


def segment_migration(portfolio: DataFrame, segment: str) -> DataFrame:
    """Per segment: customers, balance, holiday share, and loans that got worse, held or improved.

    ``cv`` columns are the part of borrowers who had a payment holiday. Ratios are of
    balances; a zero denominator gives NULL.
    """
    holiday, balance = F.col("had_covid_ph"), F.col("capital_balance")
    moves = {
        "det": F.col("arr_num") > F.col("base_arr_num"),
        "hold": F.col("arrears_status") == F.col("base_arr_stat"),
        "imp": F.col("arr_num") < F.col("base_arr_num"),
    }
    counted = {f"{name}{tag}": cond & scope
               for tag, scope in (("", F.lit(True)), ("_cv", holiday))
               for name, cond in moves.items()}
    sums = portfolio.groupBy(segment).agg(
        F.count_distinct("agreement_code").alias("cust"),
        F.sum(balance).alias("portfolio_bal"),
        tally0(holiday).alias("covid"),
        sum_if0(holiday, balance).alias("covid_bal"),
        *[tally0(cond).alias(f"{name}_vol") for name, cond in counted.items()],
        *[sum_if0(cond, balance).alias(f"{name}_bal") for name, cond in counted.items()],
    )
    shares = {
        "cv_exp": ("covid_bal", "portfolio_bal"),
        "per_det": ("det_bal", "portfolio_bal"),
        "per_held": ("hold_bal", "portfolio_bal"),
        "per_imp": ("imp_bal", "portfolio_bal"),
        "per_cv_det": ("det_cv_bal", "covid_bal"),
        "per_cv_held": ("hold_cv_bal", "covid_bal"),
        "per_cv_imp": ("imp_cv_bal", "covid_bal"),
    }
    return sums.withColumns({name: ratio(F.col(a), F.col(b)) for name, (a, b) in shares.items()})


def mean_ratios(migration: DataFrame) -> DataFrame:
    """Unweighted mean over segments of every migration ratio, one row."""
    names = ("per_det", "per_held", "per_imp", "per_cv_det", "per_cv_held", "per_cv_imp", "cv_exp")
    return migration.agg(*[F.avg(name).alias(f"avg_{name}") for name in names])


def segment_band_balance(portfolio: DataFrame, segment: str) -> DataFrame:
    """Balance per segment and arrears rank, split by payment holiday."""
    balance, holiday = F.col("capital_balance"), F.col("had_covid_ph")
    return portfolio.groupBy(segment, "arr_num").agg(
        F.sum(balance).alias("total_cb"),
        sum_if0(~holiday, balance).alias("non_cv_cb"),
        sum_if0(holiday, balance).alias("cv_bal"),
    )


def in_employment(df: DataFrame) -> DataFrame:
    return df.filter(F.col("employment_status").isin(*V.SEGMENT_EMPLOYMENT))


def _with_segments(rows: DataFrame, t: Tables, reference_year: int) -> DataFrame:
    customers = _customers(t, "region", "employment_status", "had_covid_ph").drop("account_id")
    return (
        rows.join(customers, "main_borrower_account_id", "left")
        .withColumn("region", F.coalesce("region", F.lit(UNKNOWN)))
        .withColumn("age_yr", age_from_birth_year(F.col("birth_year"), reference_year))
        .withColumn("age_group", age_group(F.col("age_yr")))
        .drop("birth_year")
    )


def opening_book(t: Tables, day: dt.date, reference_year: int) -> DataFrame:
    """Live loans at the baseline date with the borrower's segments."""
    live = on_date(t["loan_timeline"], day).filter("is_live").select(
        "agreement_code", "capital_balance")
    return _with_segments(live.join(_borrowers(t), "agreement_code", "left"), t, reference_year)


def exits_segmented(t: Tables, after: dt.date, reference_year: int) -> DataFrame:
    """Settlements and defaults processed after a date with the borrower's segments."""
    exits = t["settlements_and_defaults"].filter(F.col("processed_date") > F.lit(after)).select(
        "agreement_code", "amount", "type")
    return _with_segments(exits.join(_borrowers(t), "agreement_code", "left"), t, reference_year)


EXIT_KINDS: dict[str, Sequence[str]] = {
    "def": (V.DEFAULT, V.VT_DEFAULT), "vt": (V.VT,), "set": (V.SETTLEMENT,), "unw": (V.UNWIND,)}
RATED_KINDS = ("def", "vt", "set")


def exit_rates(exits: DataFrame, opening: DataFrame, segment: str) -> DataFrame:
    """Exits per segment against its opening balance.

    Only segments found on both sides are kept; a NULL segment never matches.
    """
    holiday, amount, balance = F.col("had_covid_ph"), F.col("amount"), F.col("capital_balance")
    kinds = {kind: F.col("type").isin(*types) for kind, types in EXIT_KINDS.items()}
    left = exits.groupBy(segment).agg(
        tally0(holiday).alias("cv_vol"),
        sum_if0(holiday, amount).alias("cv_val"),
        sum_if(holiday, amount).alias("cv_cb"),
        sum_if(~holiday, amount).alias("non_cv_bal"),
        *[tally0(cond).alias(f"{k}_vol") for k, cond in kinds.items()],
        *[sum_if0(cond, amount).alias(f"{k}_val") for k, cond in kinds.items()],
        *[sum_if0(~holiday & cond, amount).alias(f"{k}_val_noncv") for k, cond in kinds.items()],
        *[sum_if0(holiday & cond, amount).alias(f"{k}_val_cv") for k, cond in kinds.items()],
    )
    book = opening.groupBy(segment).agg(
        F.count(F.lit(1)).alias("vol"),
        F.sum(balance).alias("val"),
        sum_if0(holiday, balance).alias("cv_bal"),
        sum_if0(~holiday, balance).alias("noncv_val"),
    )
    rates = {"cv_exp": ("cv_bal", "val")}
    for kind in RATED_KINDS:
        rates[f"{kind}_per"] = (f"{kind}_val", "val")
        rates[f"noncv_{kind}_per"] = (f"{kind}_val_noncv", "noncv_val")
        rates[f"cv_{kind}_per"] = (f"{kind}_val_cv", "cv_bal")
    return left.join(book, segment).withColumns(
        {name: ratio(F.col(a), F.col(b)) for name, (a, b) in rates.items()})
