"""Matching an external vehicle list to the portfolio."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.history import latest_per_key
from ..operators.joins import enrich_left, left_join_many, on_date

Tables = Mapping[str, DataFrame]


def portfolio_at(t: Tables, day: dt.date, vehicles: DataFrame | None = None,
                 key: str = "vin") -> DataFrame:
    """Agreements with their vehicle, borrower and loan state at ``day``.

    A list of ``vehicles`` limits the work to agreements whose key is in it: the list is the
    small side, so the portfolio is reduced before anything is joined to it. NULL is a key
    like any other, as in the merge this feeds.
    """
    loans = t["loan_agreements"].select("agreement_code", "registration", "vin",
                                        "main_borrower_account_id")
    if vehicles is not None:
        wanted = vehicles.select(F.col(key).alias("_key")).distinct()
        loans = loans.join(wanted, F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    state = on_date(t["loan_timeline"], day).select(
        "agreement_code", "status_code", "capital_balance", "arrears", "days_in_arrears")
    customers = t["customer_dim"].select(
        F.col("account_id").alias("main_borrower_account_id"), "first_name", "last_name")
    addresses = t["account_address"].select(
        F.col("id").alias("main_borrower_account_id"), "current_address")
    return (
        loans.join(state, "agreement_code", "left")
        .join(customers, "main_borrower_account_id", "left")
        .join(addresses, "main_borrower_account_id", "left")
        .select("agreement_code", "registration", "vin", "first_name", "last_name", "status_code",
                "capital_balance", "arrears", "days_in_arrears", "current_address")
    )


def keeper_match_by_vin(vehicles: DataFrame, t: Tables, day: dt.date,
                        dedupe: bool = False) -> DataFrame:
    """Every row of the list with the portfolio data of its VIN, both registrations side by side.

    Duplicates and NULL VINs of the list are kept, and NULL matches NULL. ``dedupe`` keeps
    one row per VIN, the one with the largest registration, instead.
    """
    listed = latest_per_key(vehicles, ["VIN"], "VRM") if dedupe else vehicles
    portfolio = portfolio_at(t, day, vehicles, "vin").withColumnsRenamed(
        {"registration": "VRM", "vin": "VIN"})
    return enrich_left(listed, portfolio, ["VIN"], ("_list", "_portfolio"))


def keeper_match_by_registration(vehicles: DataFrame, t: Tables, day: dt.date) -> DataFrame:
    """Distinct rows of the list with the portfolio data of their registration."""
    listed = vehicles.select("VRM", "VIN").distinct()
    wanted = listed.withColumnRenamed("VRM", "registration")
    portfolio = portfolio_at(t, day, wanted, "registration").drop("vin").withColumnRenamed(
        "registration", "VRM")
    return left_join_many(listed, portfolio, "VRM").orderBy(F.col("VRM").asc_nulls_last())
