"""Credit-bureau features of loans at application."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import values as V
from ..functions.numeric import clean_numeric, ratio, safe_ratio
from ..operators.joins import at_own_date
from ..sources.tables import dimension

Tables = Mapping[str, DataFrame]

# Bureau field -> feature name
COURT_AND_DEFAULT_FIELDS = {
    "both_gd": "ccj_count_all", "both_hd": "val_act_ccj", "both_kd": "ccj_count_l12m",
    "both_ld": "ccj_count_l36m", "both_od": "date_last_ccj", "both_or": "def_crnt_count",
    "both_rr": "def_crnt_val", "both_vr": "def_count_l12m", "both_tpb": "def_count_l36m",
}
PUBLIC_FIELDS = ("both_gd", "both_hd", "both_kd", "both_ld", "both_od")
DECISIONS = ("score_decline", "policy_decline", "auto_accept", "auto_decline", "auto_refer",
             "underwriter_accept", "affordability_fail", "manual_override")


def _features(rows: DataFrame, extra: dict[str, Column]) -> DataFrame:
    allowance = F.col("max_monthly_allowance")
    return rows.select(
        "agreement_code", "opportunity_id",
        F.col("affordability_gross_salary").alias("gross_salary"), F.col("app_date"),
        "contract_date", "total_finance_amount", "max_monthly_allowance",
        (allowance - F.col("payment")).alias("affordability"),
        ratio(F.col("interest_payable"), F.col("total_finance_amount")).alias("itc_profile"),
        *[F.col(field).alias(name) for field, name in COURT_AND_DEFAULT_FIELDS.items()],
        F.col("main_jf").alias("bur_score"), "internal_score_a", "internal_score_b", *DECISIONS,
        *[column.alias(name) for name, column in extra.items()],
    )


def _first_payment_terms(t: Tables) -> DataFrame:
    return t["loan_timeline"].select("agreement_code", "date", "payment", "interest_payable")


def _scores(t: Tables) -> DataFrame:
    return dimension(t, "credit_score_summary").withColumnRenamed("application_id", "opportunity_id")


def _funnel(t: Tables) -> DataFrame:
    return dimension(t, "funnel_summary").select(
        F.col("loan_application_id").alias("opportunity_id"), "affordability_gross_salary",
        "max_monthly_allowance", *DECISIONS)


def _link(t: Tables) -> DataFrame:
    return dimension(t, "opportunity_link").select("opportunity_id", "applicant_id",
                                        F.col("created_date").alias("app_date"))


def _loans(t: Tables) -> DataFrame:
    return dimension(t, "loan_agreements").select("agreement_code", "opportunity_id", "contract_date",
                                       "total_finance_amount")


def bureau_forward(t: Tables, searched_after: dt.date) -> DataFrame:
    """Loans whose credit search ran after a date, with bureau data from the live search."""
    searches = (
        t["pipeline_last"].filter(F.col("created_at") > F.lit(searched_after))
        .select(F.col("external_ref").alias("opportunity_id"), "pipeline_uuid")
    )
    responses = t["bureau_response"].withColumnsRenamed(
        {f"public_{f}" if f in PUBLIC_FIELDS else f"partial_{f}": f
         for f in COURT_AND_DEFAULT_FIELDS} | {"score_main_jf": "main_jf"})
    applicants = dimension(t, "applicant").select(F.col("id").alias("applicant_id"), "current_age")
    opportunities = dimension(t, "opportunity").select(F.col("id").alias("opportunity_id"))
    loans = at_own_date(_loans(t), _first_payment_terms(t), "agreement_code", "contract_date",
                        "inner")
    rows = (
        loans.join(searches, "opportunity_id").join(_link(t), "opportunity_id")
        .join(_funnel(t), "opportunity_id").join(opportunities, "opportunity_id")
        .join(_scores(t), "opportunity_id")
        .join(dimension(t, "credit_search_requests"), "pipeline_uuid")
        .join(responses, "credit_search_id")
        .join(applicants, "applicant_id")
        .withColumn("debt", clean_numeric(F.col("full_debt_tm"), V.BUREAU_SENTINELS))
    )
    salary = F.col("affordability_gross_salary").cast("decimal(12,2)")
    return _features(rows, {
        "age_at_app": F.col("current_age").cast("int"),
        "act_unsec_debt": F.col("debt"),
        "dti": safe_ratio(F.col("debt"), salary).cast("decimal(12,2)"),
    })


def bureau_back(t: Tables) -> DataFrame:
    """All loans with scores and first payment terms, with retrospective bureau data if any.

    Search tables that add no column are not joined; they must be unique per search (see
    ``checks.duplicate_keys``), or the loans would repeat.
    """
    retro = (
        t["global_search"].withColumnRenamed("id", "global_search_id")
        .join(dimension(t, "retro_public"), "global_search_id", "left")
        .join(dimension(t, "retro_partial"), "global_search_id", "left")
        .join(dimension(t, "retro_score"), "global_search_id", "left")
        .drop("global_search_id")
    )
    loans = at_own_date(_loans(t), _first_payment_terms(t), "agreement_code", "contract_date",
                        "inner")
    funnel = _funnel(t)
    rows = (
        loans.join(_scores(t), "opportunity_id")
        .join(retro, "opportunity_id", "left")
        .join(_link(t).drop("applicant_id").join(funnel, "opportunity_id", "left"),
              "opportunity_id", "left")
    )
    return _features(rows, {})
