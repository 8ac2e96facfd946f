"""Pivot, unpivot and total rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def month_pivot(df: DataFrame, key: str, value: str, months: Mapping[str, dt.date],
                date_column: str = "date") -> DataFrame:
    """One row per key, one summed column per month end; no rows gives NULL."""
    wanted = F.col(date_column).isin(*[F.lit(d) for d in months.values()])
    return (
        df.filter(wanted).groupBy(key)
        .pivot(date_column, list(months.values())).agg(F.sum(value))
        .toDF(key, *months)
    )


def transpose_metrics(df: DataFrame, columns: Sequence[str], type_name: str = "double") -> DataFrame:
    """One wide row to ``metric, value`` rows, in one common type."""
    wide = df.select(*[F.col(c).cast(type_name).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "metric", "value")


def side_by_side(*one_row: DataFrame) -> DataFrame:
    """Put one-row frames with different columns next to each other, without a cross join.

    A frame with a second row is an error, whichever columns are read.
    """
    names = [c for frame in one_row for c in frame.columns]
    stacked = one_row[0].withColumn("_frame", F.lit(0))
    for number, frame in enumerate(one_row[1:], 1):
        stacked = stacked.unionByName(frame.withColumn("_frame", F.lit(number)), allowMissingColumns=True)
    single = reduce(Column.__and__, [F.count(F.when(F.col("_frame") == k, 1)) <= 1
                                     for k in range(len(one_row))])
    return stacked.agg(*[F.when(single, F.max(c)).otherwise(F.raise_error(F.lit(
        "side_by_side takes frames of one row"))).alias(c) for c in dict.fromkeys(names)])


def with_total(df: DataFrame, keep: str, split: str, total_label: str) -> DataFrame:
    """Add per-``keep`` total rows to a small frame of sums already grouped by (keep, split)."""
    sums = [c for c in df.columns if c not in (keep, split)]
    totals = F.grouping(split) == 1
    return (
        df.rollup(keep, split)
        .agg(*[F.sum(c).alias(c) for c in sums], F.grouping(keep).alias("_all"),
             totals.alias("_total"))
        .filter(F.col("_all") == 0)
        .withColumn(split, F.when(F.col("_total"), F.lit(total_label)).otherwise(F.col(split)))
        .drop("_all", "_total")
    )
