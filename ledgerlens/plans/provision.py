"""Provision bridge: how the provision moved between two dates, by kind of movement.

All movements but new business are sums over one small table: the snapshot grouped by
scenario and state before and after. It is built once, with one scan and one shuffle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import values as V
from ..functions.aggregates import sum_if
from ..operators.joins import on_date

LIVE, COVID, TERMINATED = "live", "covid", "terminated"
FROM = ("previous_scenario", "previous_state")
TO = ("scenario", "state")


def movement_cube(timeline: DataFrame, day: dt.date) -> DataFrame:
    """The snapshot at ``day`` summed per scenario and state, before and after."""
    held, before = F.col("provision_held"), F.col("previous_provision_held")
    return on_date(timeline, day).groupBy(*FROM, *TO).agg(
        F.sum(held).alias("held"),
        F.sum(before).alias("previous_held"),
        # a row without a previous provision adds nothing to the change
        F.sum(held - before).alias("change"),
    )


def _between(before: str, after: str) -> Column:
    return (F.col("previous_scenario") == before) & (F.col("scenario") == after)


def _state() -> tuple[Column, Column]:
    return F.col("previous_state"), F.col("state")


def scenario_summary(cube: DataFrame, scenario: str) -> DataFrame:
    """Provision of a scenario now and before, and the charge between; one row."""
    return cube.agg(
        sum_if(F.col("scenario") == scenario, F.col("held")).alias("current_prov"),
        sum_if(F.col("previous_scenario") == scenario, F.col("previous_held")).alias("last_prov"),
    ).withColumn("provision_charge", F.col("current_prov") - F.col("last_prov"))


def left_live(cube: DataFrame, to: str) -> DataFrame:
    """Provision released by loans that left the live scenario; one row."""
    return cube.filter(_between(LIVE, to)).agg((-F.sum("previous_held")).alias("movement"))


def joined_live(cube: DataFrame, origin: str) -> DataFrame:
    """Provision brought by loans that came back to the live scenario; one row."""
    return cube.filter(_between(origin, LIVE)).agg(F.sum("held").alias("movement"))


def new_business(timeline: DataFrame, day: dt.date) -> DataFrame:
    """Provision and number of loans without a previous scenario and state; one row."""
    return (
        on_date(timeline, day)
        .filter(F.col("previous_scenario").isNull() & F.col("previous_state").isNull())
        .agg(F.sum("provision_held").alias("provision"),
             F.count_distinct("agreement_code").alias("agreements"))
    )


def _rolls(cube: DataFrame, cond: Column, *keys: str) -> DataFrame:
    return (
        cube.filter(cond).groupBy(*keys).agg(F.sum("change").alias("charge"))
        .orderBy(*[F.col(k).asc_nulls_last() for k in keys])
    )


def static_rolls(cube: DataFrame) -> DataFrame:
    """Change for live loans that stayed in their state."""
    before, after = _state()
    return _rolls(cube, _between(LIVE, LIVE) & (before == after), "state")


def improved_rolls(cube: DataFrame, one_step: bool) -> DataFrame:
    """Change for live loans that moved to a better state, by one step or by more."""
    before, after = _state()
    better = (after < before) & after.isin(*V.LIVE_STATES)
    step = after == before - 1
    return _rolls(cube, _between(LIVE, LIVE) & better & (step if one_step else ~step), *_keys())


def deteriorated_rolls(cube: DataFrame, skip_one_step: bool = False) -> DataFrame:
    """Change for live loans that moved to a worse state.

    The default keeps every size of step: the report that is called linear does so too.
    """
    before, after = _state()
    worse = (after > before) & after.isin(*V.LIVE_STATES)
    if skip_one_step:
        worse = worse & (after != before + 1)
    return _rolls(cube, _between(LIVE, LIVE) & worse, *_keys())


def _keys() -> tuple[str, str]:
    return "previous_state", "state"


def settled_rolls(cube: DataFrame) -> DataFrame:
    """Change for live loans that were settled or unwound."""
    before, after = _state()
    ended = after.isin(*V.SETTLED_STATES) & ~before.isin(*V.SETTLED_STATES)
    return _rolls(cube, _between(LIVE, LIVE) & ended, "state")


def terminated_inflow(cube: DataFrame) -> DataFrame:
    """Provision of loans that were terminated from another scenario."""
    moved = (F.col("scenario") == TERMINATED) & (F.col("previous_scenario") != F.col("scenario"))
    return cube.filter(moved).groupBy("previous_scenario", "scenario").agg(
        F.sum("held").alias("provision"))


def terminated_state_moves(cube: DataFrame) -> DataFrame:
    """Change for terminated loans that changed state."""
    before, after = _state()
    return _rolls(cube, _between(TERMINATED, TERMINATED) & (before != after), *_keys())


def terminated_static(cube: DataFrame) -> DataFrame:
    """Change for terminated loans that stayed in their state."""
    before, after = _state()
    return _rolls(cube, _between(TERMINATED, TERMINATED) & (before == after), "state")


def provision_bridge(timeline: DataFrame, day: dt.date) -> DataFrame:
    """All movements in one frame: ``movement, previous_state, state, amount``.

    Every group of the snapshot is labelled with the movements it belongs to, so the
    bridge takes one pass. Scenario moves and new business carry no states.
    """
    before, after = _state()
    live, terminated = _between(LIVE, LIVE), _between(TERMINATED, TERMINATED)
    in_ladder = after.isin(*V.LIVE_STATES)
    change, held = F.col("change"), F.col("held")
    released = -F.col("previous_held")
    is_new = F.col("previous_scenario").isNull() & before.isNull()
    movements = [
        ("live_to_covid", _between(LIVE, COVID), released, False),
        ("live_to_terminated", _between(LIVE, TERMINATED), released, False),
        ("covid_to_live", _between(COVID, LIVE), held, False),
        ("terminated_to_live", _between(TERMINATED, LIVE), held, False),
        ("new_business", is_new, held, False),
        ("static", live & (before == after), change, True),
        ("improved_linear", live & in_ladder & (after == before - 1), change, True),
        ("improved_other", live & in_ladder & (after < before - 1), change, True),
        ("deteriorated", live & in_ladder & (after > before), change, True),
        ("deteriorated_other", live & in_ladder & (after > before + 1), change, True),
        ("settled", live & after.isin(*V.SETTLED_STATES) & ~before.isin(*V.SETTLED_STATES),
         change, True),
        ("terminated_inflow", (F.col("scenario") == TERMINATED)
         & (F.col("previous_scenario") != TERMINATED), held, False),
        ("terminated_state_moves", terminated & (before != after), change, True),
        ("terminated_static", terminated & (before == after), change, True),
    ]
    labels = F.array(*[
        F.when(cond, F.struct(
            F.lit(name).alias("movement"), amount.cast("decimal(38,2)").alias("amount"),
            F.lit(by_state).alias("by_state")))
        for name, cond, amount, by_state in movements
    ])
    return (
        movement_cube(timeline, day)
        .select("previous_state", "state", F.explode(labels).alias("m"))
        .filter(F.col("m").isNotNull())
        .groupBy(F.col("m.movement").alias("movement"),
                 F.when(F.col("m.by_state"), before).alias("previous_state"),
                 F.when(F.col("m.by_state"), after).alias("state"))
        .agg(F.sum("m.amount").alias("amount"))
    )
