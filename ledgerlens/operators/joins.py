"""Join shapes the reports share."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def on_date(df: DataFrame, day: dt.date, column: str = "date") -> DataFrame:
    """One snapshot of a time series; the literal lets Spark prune files and partitions."""
    return df.filter(F.col(column) == F.lit(day))


def between_dates(df: DataFrame, column: str, start: dt.date, end: dt.date) -> DataFrame:
    return df.filter(F.col(column).between(F.lit(start), F.lit(end)))


def at_own_date(df: DataFrame, timeline: DataFrame, key: str, day: Column | str, how: str = "left",
                date_column: str = "date") -> DataFrame:
    """Join each row to the timeline at a date of its own: an equi-join on (key, date)."""
    left = df.withColumn("_day", F.col(day) if isinstance(day, str) else day)
    right = timeline.withColumnsRenamed({key: "_k", date_column: "_d"})
    match = (left[key] == right["_k"]) & (left["_day"] == right["_d"])
    return left.join(right, match, how).drop("_day", "_k", "_d")


def snapshot_compare(df: DataFrame, key: str, later: dt.date, baseline: dt.date,
                     columns: dict[str, str], date_column: str = "date") -> DataFrame:
    """Rows at ``later`` with values of the same key at ``baseline`` under new names."""
    before = on_date(df, baseline, date_column).select(
        key, *[F.col(c).alias(out) for c, out in columns.items()])
    return on_date(df, later, date_column).join(before, key, "left")


def left_join_many(left: DataFrame, right: DataFrame, on: str,
                   keys: DataFrame | None = None) -> DataFrame:
    """Left join to a side in which one key may own a large share of the rows.

    An outer join can only be split on its preserved side. The matching rows therefore come
    from an inner join, which Spark splits on either side, and the others from an anti-join
    against the distinct keys. ``keys`` may name a cheaper frame with the same keys.
    """
    known = (right if keys is None else keys).select(on).distinct()
    unmatched = left.join(known, on, "left_anti")
    return left.join(right, on).unionByName(unmatched, allowMissingColumns=True)


def enrich_left(left: DataFrame, right: DataFrame, on: Sequence[str],
                suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Left merge in which NULL keys match NULL keys and clashing columns get suffixes."""
    clash = (set(left.columns) & set(right.columns)) - set(on)
    # a struct of NULLs equals a struct of NULLs
    key = F.struct(*on)
    lhs = left.withColumn("_key", key).withColumnsRenamed({c: c + suffixes[0] for c in clash})
    rhs = right.withColumn("_key", key).drop(*on).withColumnsRenamed(
        {c: c + suffixes[1] for c in clash})
    return left_join_many(lhs, rhs, "_key").drop("_key")


def first_match(left: DataFrame, dimension: DataFrame, on: str) -> DataFrame:
    """Left join to a dimension whose exact duplicate rows are removed first."""
    return left.join(dimension.distinct(), on, "left")
