"""Every operator and report as a query on the test tables, with equivalent SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import tune
from ..sources.driver_tables import DERIVED, TIMELINE_BASE_ANSI, DriverTables, needed


@dataclass(frozen=True)
class Query:
    run: Callable[[DriverTables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}
#: Derived tables that the checking SQL computes once.
STORED = ("timeline_base", "loan_timeline", "status_history")


def query(name: str, sql: str | None = None):
    """Register a function of the domain tables under ``name``."""

    def add(run: Callable[[DriverTables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = Query(run, sql and with_sources(sql))
        return run

    return add


def with_sources(body: str) -> str:
    """Prefix a SELECT with the definitions of the derived tables it mentions."""
    words = set(re.findall(r"\w+", body))
    ctes = [
        f"{name} AS {'MATERIALIZED ' * (name in STORED)}"
        f"({TIMELINE_BASE_ANSI if name == 'timeline_base' else DERIVED[name][1]})"
        for name in needed([n for n in DERIVED if n in words])
    ]
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join([*ctes, body[5:]])}"
    return f"WITH {', '.join(ctes)} {body}" if ctes else body


def comparable(df: DataFrame) -> DataFrame:
    """Cast to the few types two engines print alike: bigint, double, text, boolean."""
    columns = []
    for field in df.schema:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType, T.LongType)):
            column = column.cast("bigint")
        elif isinstance(kind, (T.DecimalType, T.DoubleType, T.FloatType)):
            column = F.round(column.cast("double"), 6)
        elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            column = column.cast("string")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return comparable(QUERIES[name].run(DriverTables(tune(spark), sf_dir)))

    return run


def load() -> dict[str, Query]:
    """Import every module that registers queries."""
    from . import columns, frames, reports, sources  # noqa: F401

    return QUERIES
