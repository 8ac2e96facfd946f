"""Sources and sinks, and the shapes that move data between them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.reshape import transpose_metrics
from ..sources.tables import (
    SCHEMAS, materialize, read_delimited, scratch_path, write_report)
from . import query


@query("scan_table", """
    SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice,
           CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate, o_orderpriority
    FROM orders""")
def scan_table(t):
    return t["orders"].withColumn("o_orderdate", F.to_date("o_orderdate"))


STATUS_NAMES = [("F", "finished"), ("O", "open"), ("P", "partial")]


@query("inline_values", """
    SELECT name, CAST(count(o_orderkey) AS BIGINT) AS orders
    FROM (VALUES ('F', 'finished'), ('O', 'open'), ('P', 'partial')) AS s(code, name)
    LEFT JOIN orders ON o_orderstatus = code GROUP BY name""")
def inline_values(t):
    names = t.spark.createDataFrame(STATUS_NAMES, "code string, name string")
    counts = t["orders"].groupBy(F.col("o_orderstatus").alias("code")).agg(
        F.count("o_orderkey").alias("orders"))
    return names.join(counts, "code", "left").select("name", F.coalesce("orders", F.lit(0)).alias("orders"))


VEHICLES = "SELECT VIN, VRM FROM vehicle_list"


@query("read_delimited", VEHICLES)
def delimited_roundtrip(t):
    path = scratch_path(t.spark, "vehicle_list")
    write_report(t["vehicle_list"], path)
    return read_delimited(t.spark, path, SCHEMAS["vehicle_list"])


@query("write_report", VEHICLES)
def report_roundtrip(t):
    path = scratch_path(t.spark, "vehicle_list")
    write_report(t["vehicle_list"], path, "parquet")
    return t.spark.read.parquet(path)


MONTHLY_SQL = """
    SELECT CAST(last_day(CAST(o_orderdate AS DATE)) AS VARCHAR) AS month_end,
           CAST(count(*) AS BIGINT) AS orders,
           round(CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE), 6) AS amount
    FROM orders GROUP BY 1"""


def monthly_orders(t) -> DataFrame:
    return t["loan_agreements"].groupBy(F.last_day("contract_date").alias("month_end")).agg(
        F.count(F.lit(1)).alias("orders"), F.sum("total_finance_amount").alias("amount"))


@query("ctas_roundtrip", MONTHLY_SQL)
def ctas_roundtrip(t):
    return materialize(monthly_orders(t), "monthly_orders")


@query("temp_view", MONTHLY_SQL)
def temp_view(t):
    monthly_orders(t).createOrReplaceTempView("ledgerlens_monthly_orders")
    return t.spark.sql("SELECT month_end, orders, amount FROM ledgerlens_monthly_orders")


@query("metrics_long", """
    WITH w AS (SELECT CAST(count(*) AS DOUBLE) AS loans,
                      CAST(sum(total_finance_amount) AS DOUBLE) AS financed,
                      CAST(min(term) AS DOUBLE) AS shortest_term FROM loan_agreements)
    SELECT 'loans' AS metric, round(loans, 6) AS value FROM w
    UNION ALL SELECT 'financed', round(financed, 6) FROM w
    UNION ALL SELECT 'shortest_term', round(shortest_term, 6) FROM w""")
def metrics_long(t):
    wide = t["loan_agreements"].agg(
        F.count(F.lit(1)).alias("loans"), F.sum("total_finance_amount").alias("financed"),
        F.min("term").alias("shortest_term"))
    return transpose_metrics(wide, ["loans", "financed", "shortest_term"])


@query("query_parameters", """
    SELECT CAST(count(*) AS BIGINT) AS loans FROM loan_agreements
    WHERE contract_date > DATE '1998-03-24' AND contract_date <= DATE '1998-03-31'""")
def query_parameters(t):
    t["loan_agreements"].createOrReplaceTempView("ledgerlens_parametrised")
    return t.spark.sql(
        "SELECT count(*) AS loans FROM ledgerlens_parametrised "
        "WHERE contract_date > date_sub(:day, :back) AND contract_date <= :day",
        args={"day": dt.date(1998, 3, 31), "back": 7})
