"""Newest rows per key as a state that is kept from run to run.

The state holds one row per key with its newest ``k`` rows, newest first. States of different
stretches of a history merge in any grouping, so a run reads only what came since the last one.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .history import top_per_key


def newest_rows(rows: DataFrame, key: str, date: str, columns: Sequence[str], k: int) -> DataFrame:
    """One row per key: ``newest``, an array of at most ``k`` structs of the date and the columns.

    Rows without a date are left out. Equal dates are ordered by the columns, largest first, so the
    result does not depend on the order of rows. Spark cuts every task's rows to ``k`` per key before
    the exchange, so no key is too large.
    """
    kept = [date, *columns]
    top = top_per_key(rows.filter(F.col(date).isNotNull()).select(key, *kept), [key],
                      [F.col(c).desc_nulls_last() for c in kept], k)
    return top.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct(*kept)), asc=False).alias("newest"))


def merged_newest(states: Sequence[DataFrame], key: str, k: int) -> DataFrame:
    """The state of all stretches together, of which no two may hold the same row."""
    every = reduce(DataFrame.unionByName, states).groupBy(key).agg(
        F.flatten(F.collect_list("newest")).alias("newest"))
    return every.select(key, F.slice(F.sort_array("newest", asc=False), 1, k).alias("newest"))


def known_until(state: DataFrame, date: str) -> dt.date | None:
    """Date of the newest row in a state."""
    return state.agg(F.max(F.element_at("newest", 1)[date])).first()[0]


def advanced_newest(state: DataFrame, rows: DataFrame, key: str, date: str,
                    columns: Sequence[str], k: int, until: dt.date) -> DataFrame:
    """A state after the rows up to ``until``; only those later than its newest row are read.

    Advancing twice to one date changes nothing. Rows that arrive late, for dates that the state
    already knows, are not seen: build the state anew for them.
    """
    since = known_until(state, date)
    later = rows.filter(F.col(date) <= F.lit(until))
    if since is not None:
        later = later.filter(F.col(date) > F.lit(since))
    return merged_newest([state, newest_rows(later, key, date, columns, k)], key, k)
