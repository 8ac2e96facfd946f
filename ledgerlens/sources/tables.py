"""Domain tables: schemas, loading, scratch tables and report files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# One DDL schema per input table. Delimited files are read with these, never inferred.
SCHEMAS: dict[str, str] = {
    "loan_agreements": (
        "agreement_code bigint, opportunity_id bigint, main_borrower_account_id bigint, "
        "introducer_id bigint, platform string, contract_date date, contract_end_date date, "
        "registration_date date, term int, total_finance_amount decimal(14,2), "
        "total_payable decimal(14,2), current_retail_value decimal(14,2), mileage bigint, "
        "registration string, vin string"),
    "dealer_dim": "dealer_id bigint, introducer_category string",
    "customer_dim": (
        "account_id bigint, first_name string, last_name string, region string, "
        "employment_status string, birth_year string, had_covid_ph boolean, "
        "is_vulnerable boolean, is_with_solicitors boolean, total_months_of_forbearance int"),
    "loan_timeline": (
        "agreement_code bigint, date date, contract_date date, status_code string, "
        "capital_balance decimal(14,2), arrears decimal(14,2), arrears_yesterday decimal(14,2), "
        "days_in_arrears int, holiday_adjusted_days_in_arrears int, arrears_status string, "
        "arrears_status_last_payment_date string, "
        "payment_reduction_adjusted_arrears_status string, days_since_last_payment_date int, "
        "payment_holiday boolean, is_live boolean, is_vt boolean, is_defaulted boolean, "
        "is_settled boolean, instalments_satisfied int, "
        "cash_transactions_cumulative decimal(14,2), payment decimal(14,2), "
        "interest_payable decimal(14,2)"),
    "provision_timeline": (
        "agreement_code bigint, date date, scenario string, state bigint, "
        "provision_held decimal(14,2), previous_scenario string, previous_state bigint, "
        "previous_provision_held decimal(14,2)"),
    "status_history": (
        "agreement_code bigint, dateat string, status string, arrears_value decimal(14,2), "
        "capital_outstanding decimal(14,2), payment decimal(14,2), contract_date_ms bigint"),
    "settlements_and_defaults": (
        "agreement_code bigint, type string, date date, processed_date date, "
        "crm_date date, ledger_date date, amount decimal(18,2)"),
    "forbearance": (
        "agreement_code bigint, type string, status string, booking_status string, "
        "created_date date, start_date date, end_date date"),
    "forbearance_timeline": (
        "agreement_code bigint, loan_id bigint, date date, capital_balance decimal(14,2), "
        "is_live boolean, is_settled boolean, is_defaulted boolean, is_vt boolean, "
        "payments_down int, has_application boolean, in_initial_forbearance boolean, "
        "has_initial_forbearance boolean, in_forbearance boolean, "
        "initial_forbearance_start_date date, initial_forbearance_end_date date, "
        "initial_forbearance_start boolean, initial_forbearance_end boolean, "
        "payment_since_forbearance boolean, payments_down_end_of_initial_forbearance int, "
        "status string, arrears_status string"),
    "case_notes": "agreement_code bigint, employment_industry string, employment_impact string",
    "funding_entity": "agreement_code bigint, date date, current_funding_entity string",
    "applications": (
        "application_id bigint, platform string, introducer_id bigint, stage_name string, "
        "total_finance_amount decimal(14,2), closed_date date"),
    "funnel_summary": (
        "loan_application_id bigint, created_date date, auto_accept int, auto_decline int, "
        "auto_refer int, underwriter_accept int, credit_search_provider string, "
        "test_application_flag boolean, affordability_gross_salary decimal(12,2), "
        "max_monthly_allowance decimal(12,2), score_decline int, policy_decline int, "
        "affordability_fail int, manual_override int"),
    "opportunity": (
        "id bigint, finance_amount decimal(14,2), vehicle_name string, fuel_type string, "
        "mileage bigint"),
    "opportunity_history": "id bigint, vehicle_name string, fuel_type string",
    "opportunity_link": (
        "opportunity_id bigint, account_id bigint, applicant_id string, loan_id string, "
        "exclusion_reason string, created_date date"),
    "applicant": "id string, current_age int, date_of_birth date",
    "residence": "applicant_id bigint, status string, is_current int, created_date date",
    "income_summary": "loan_application_id bigint, gross_annual_income bigint",
    "account": "id bigint, employment_status string, is_person boolean",
    "account_address": "id bigint, current_address string",
    "action_log": (
        "action_id bigint, contact_id bigint, created_at timestamp, description string, "
        "name string"),
    "contact": "id bigint, account_id string",
    "loan_link": "main_borrower string, agreement_code bigint",
    "vehicle_list": "VIN string, VRM string",
    "pipeline_last": "external_ref bigint, pipeline_uuid string, created_at date",
    "credit_search_requests": "pipeline_uuid string, credit_search_id string",
    "bureau_response": (
        "credit_search_id string, full_debt_tm string, public_both_gd bigint, "
        "public_both_hd bigint, public_both_kd bigint, public_both_ld bigint, "
        "public_both_od date, partial_both_or bigint, partial_both_rr bigint, "
        "partial_both_vr bigint, partial_both_tpb bigint, score_main_jf bigint"),
    "credit_score_summary": (
        "application_id bigint, internal_score_a bigint, internal_score_b bigint"),
    "global_search": "id string, opportunity_id bigint",
    "retro_public": (
        "global_search_id string, both_gd bigint, both_hd bigint, both_kd bigint, "
        "both_ld bigint, both_od date"),
    "retro_partial": (
        "global_search_id string, both_or bigint, both_rr bigint, both_vr bigint, "
        "both_tpb bigint"),
    "retro_score": "global_search_id string, main_jf bigint",
}


class Tables(Mapping[str, DataFrame]):
    """Domain tables by name, opened on first use."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._open: dict[str, DataFrame] = {}
        self._small: dict[str, bool] = {}

    def _read(self, name: str) -> DataFrame:
        raise NotImplementedError

    def _names(self) -> list[str]:
        return list(SCHEMAS)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._open:
            if name not in self._names():
                raise KeyError(name)
            self._open[name] = self._read(name)
        return self._open[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._names())

    def __len__(self) -> int:
        return len(self._names())

    def file_bytes(self, name: str) -> int | None:
        """Size of a table's files by the file system; None where it has no files of its own."""
        return None

    def small(self, name: str, file_limit: int = 8 << 20, limit: int = 32 << 20) -> bool:
        """May a table be broadcast? Asked of the file system first, then of the rows.

        Files can hold far more than their size, so those within ``file_limit`` are read once to
        add up what their rows take. The answer is kept as long as this object.
        """
        if name not in self._small:
            size = self.file_bytes(name)
            self._small[name] = (size is not None and size <= file_limit
                                 and (row_bytes(self[name]) or limit + 1) <= limit)
        return self._small[name]


def row_bytes(df: DataFrame) -> int | None:
    """What the rows take in memory, about; None if there are columns of nested types."""
    if any(isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) for f in df.schema):
        return None
    texts = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    length = reduce(add, [F.coalesce(F.octet_length(c), F.lit(0)) for c in texts], F.lit(0))
    # a row has a header of 16 bytes and 16 a column, decimals and text padding included
    return df.agg(F.count(F.lit(1)) * (16 + 16 * len(df.columns))
                  + F.coalesce(F.sum(length), F.lit(0)) + 1).first()[0]


def dimension(t: Mapping[str, DataFrame], name: str) -> DataFrame:
    """A table for the other side of a join with facts: broadcast if it is measured to be small."""
    return F.broadcast(t[name]) if isinstance(t, Tables) and t.small(name) else t[name]


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes below a path, by one request to its file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return system.getContentSummary(target).getLength()


class ParquetTables(Tables):
    """Domain tables stored as ``<root>/<name>``, in parquet."""

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark)
        self.root = root.rstrip("/")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}")

    def file_bytes(self, name: str) -> int | None:
        return stored_bytes(self.spark, f"{self.root}/{name}")


class CatalogTables(Tables):
    """Domain tables registered in a catalog schema."""

    def __init__(self, spark: SparkSession, schema: str):
        super().__init__(spark)
        self.schema = schema

    def _read(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.schema}.{name}")

    def file_bytes(self, name: str) -> int | None:
        details = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.schema}.{name}").where(
            "col_name = 'Location'").first()
        return stored_bytes(self.spark, details["data_type"]) if details else None


def read_delimited(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Delimited file with a header line, under an explicit schema; a value that does not fit fails."""
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False, mode="FAILFAST")


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write a report as delimited text with a header, or as parquet."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.csv(path, header=True)
    else:
        writer.format(fmt).save(path)


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for scratch tables: ``spark.checkpoint.dir``, else one in the warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return (shared or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch").rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the scratch folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Clean-up steps of the runs that are open, innermost last.
_RUNS: list[list] = []


@contextmanager
def scratch_run(spark: SparkSession) -> Iterator[None]:
    """Remove all scratch tables made inside the block at its end, also after an error.

    Frames that read them are of no use afterwards: write or collect results inside the block.
    """
    steps: list = []
    _RUNS.append(steps)
    try:
        yield
    finally:
        _RUNS.remove(steps)
        for step in reversed(steps):
            step()


def _in_run(step) -> None:
    if _RUNS:
        _RUNS[-1].append(step)


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as a scratch table and return the stored copy.

    The copy lives in shared storage, so it cuts the lineage and outlives lost executors. Inside a
    ``scratch_run`` it is removed at the end of the run.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    _in_run(lambda: _remove(spark, path))
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_by_key(df: DataFrame, name: str, key: str, buckets: int | None = None) -> DataFrame:
    """Like ``materialize``, in buckets of ``key``: joins and groups on it need no exchange.

    ``buckets`` defaults to the number of shuffle partitions; tables that are to be joined need the
    same number. The catalog entry goes with the data at the end of a ``scratch_run``.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, name)
    entry = f"scratch_{name}_{uuid.uuid4().hex}"
    _in_run(lambda: (drop_table(spark, entry), _remove(spark, path)))
    # dealt as the buckets are, so each bucket is one file
    (df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path)
     .format("parquet").saveAsTable(entry))
    return spark.table(entry)


def save_table(df: DataFrame, name: str) -> DataFrame:
    """Create or replace a catalog table from a query and return it."""
    df.write.mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def drop_table(spark: SparkSession, name: str) -> None:
    """Drop a catalog table if it exists."""
    spark.sql("DROP TABLE IF EXISTS IDENTIFIER(:name)", args={"name": name})
