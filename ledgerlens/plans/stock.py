"""Loan stock at a month end: life events, arrears ladder, end status and the reports on it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import values as V
from ..functions.aggregates import placeholder, sum_if, sum_if0, tally, tally0
from ..functions.dates import epoch_ms_to_date, months_diff, parse_date, vintage_label
from ..functions.text import amount_between, date_after
from ..operators.history import first_per_key, top_per_key
from ..operators.joins import left_join_many, on_date
from ..sources.tables import materialize
from .calendar import ReportCalendar
from .summaries import changes_of, merged, newest_two, stretches

Tables = Mapping[str, DataFrame]

CODE = "decimal(4,1)"
PART_PAYMENT = Decimal("0.1")
TERMINATION, REPOSSESSION, SALE = "termination", "repossession", "sale"

# Opening arrears code -> label in the roll-rate report
OPENINGS = {Decimal("0"): "utd", PART_PAYMENT: "oneplus", Decimal("1"): "one",
            Decimal("2"): "two", Decimal("3"): "three", Decimal("4"): "four"}
AGES = (3, 6, 12, 18)


def _code(value) -> Column:
    return F.lit(value).cast(CODE)


# ---------------------------------------------------------------- life events


def first_action(log: DataFrame, column: str, phrase: str, **extra: Column) -> DataFrame:
    """Earliest log entry per contact whose ``column`` matches ``phrase``."""
    hits = log.filter(F.col(column).ilike(phrase)).withColumns(extra)
    return first_per_key(hits, ["contact_id"], "created_at", tie=["action_id"])


def life_event(t: Tables, actions: DataFrame, day: str) -> DataFrame:
    """Bring first actions to the borrower's loans and to the status held on that day.

    The agreement code comes from the status history, so it is NULL for a loan without a
    snapshot on the day of the action.
    """
    contacts = t["contact"].select(F.col("id").alias("contact_id"), "account_id")
    loans = t["loan_link"].select(F.col("main_borrower").alias("account_id"),
                                  F.col("agreement_code").alias("loan"))
    history = t["status_history"].select(
        "agreement_code", "status", parse_date(F.col("dateat")).alias("dt"))
    linked = (
        actions.withColumn(day, F.to_date("created_at")).drop("created_at")
        .join(contacts, "contact_id", "left")
    )
    linked = left_join_many(linked, loans, "account_id")
    match = (linked["loan"] == history["agreement_code"]) & (linked[day] == history["dt"])
    return linked.join(history, match, "left").drop("loan", "account_id")


def repossessions(t: Tables) -> DataFrame:
    actions = first_action(t["action_log"], "description", V.REPOSSESSION_PHRASE)
    return life_event(t, actions.select("contact_id", "created_at"), "repo_date")


def sale_amount(text: Column) -> Column:
    return amount_between(text, "£", ".")


def sale_date(text: Column) -> Column:
    return date_after(text, "sold on ", " and ", 35)


def vehicle_sales(t: Tables) -> DataFrame:
    text = F.col("description")
    actions = first_action(t["action_log"], "description", V.SALE_PHRASE,
                           gross_sale_amount=sale_amount(text), actual_sale_date=sale_date(text))
    return life_event(
        t, actions.select("contact_id", "created_at", "actual_sale_date", "gross_sale_amount"),
        "vehicle_sale_date")


def terminations(t: Tables) -> DataFrame:
    actions = first_action(t["action_log"], "name", V.TERMINATION_PHRASE)
    return life_event(t, actions.select("contact_id", "created_at"), "termination_date")


def life_events(t: Tables) -> DataFrame:
    """Terminations, repossessions and sales of all loans from one pass over the action log.

    One row per first action of a contact and loan of the contact's account: ``agreement_code``,
    ``kind``, ``day`` and, for sales, the date and amount in the text. Only loans with a snapshot
    on the day of the action count, as the events above name no other.
    """
    text, stamp = F.col("description"), F.col("created_at")
    place = [stamp.isNull().alias("undated"), stamp, F.col("action_id").isNull().alias("unnamed"),
             "action_id"]
    sold = [sale_date(text).alias("actual_sale_date"), sale_amount(text).alias("gross_sale_amount")]
    phrases = {TERMINATION: F.col("name").ilike(V.TERMINATION_PHRASE),
               REPOSSESSION: text.ilike(V.REPOSSESSION_PHRASE), SALE: text.ilike(V.SALE_PHRASE)}
    firsts = (
        t["action_log"].filter(reduce(Column.__or__, phrases.values())).groupBy("contact_id")
        .agg(*[F.min(F.when(hit, F.struct(*place, *(sold if kind == SALE else [])))).alias(kind)
               for kind, hit in phrases.items()])
    )
    contacts = t["contact"].select(F.col("id").alias("contact_id"), "account_id")
    loans = t["loan_link"].select(F.col("main_borrower").alias("account_id"),
                                  F.col("agreement_code").alias("loan"))
    events = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.to_date(F.col(kind)["created_at"]).alias("day"),
                 *[(F.col(kind)[c] if kind == SALE else F.lit(None)).alias(c)
                   for c in ("actual_sale_date", "gross_sale_amount")])
        for kind in phrases])
    dated = (
        firsts.join(contacts, "contact_id").join(loans, "account_id")
        .select("loan", F.inline(events)).filter("day is not null")
    )
    snapshots = t["status_history"].select(
        "agreement_code", parse_date(F.col("dateat")).alias("_snapshot"))
    match = (F.col("loan") == F.col("agreement_code")) & (F.col("day") == F.col("_snapshot"))
    return dated.join(snapshots, match).select(
        "agreement_code", "kind", "day", "actual_sale_date", "gross_sale_amount")


def advanced_events(t: Tables, events: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The life events after one more snapshot: those known, and those on its own day."""
    names = ("action_log", "contact", "loan_link")
    return events.unionByName(life_events({name: t[name] for name in names} | {"status_history": snapshot}))


# ---------------------------------------------------------------- status history


def _iso(days: Iterable[dt.date]) -> list[str]:
    return [d.isoformat() for d in days]


def arrears_ladder(arrears: Column, payment: Column, status: Column) -> Column:
    """Payments in arrears: 6 (or more) down to 1, 0.1 for less than one, 0, or -1 if not live.

    A zero payment counts as no arrears.
    """
    owing = (arrears > 0) & (payment > 0)
    rungs = F.when(owing & (arrears >= payment * 6), _code(6))
    for payments in (5, 4, 3, 2, 1):
        rungs = rungs.when(owing & (arrears >= payment * payments), _code(payments))
    rungs = rungs.when(owing, _code(PART_PAYMENT)).otherwise(_code(0))
    return F.when(status == V.LIVE, rungs).otherwise(_code(V.END_NOT_LIVE))


def status_ladder(history: DataFrame, snapshots: tuple[dt.date, dt.date]) -> DataFrame:
    """Latest of the two snapshots per agreement, with arrears codes now and before."""
    chosen = history.filter(F.col("dateat").isin(*_iso(snapshots)))
    newest_first = [F.col("dateat").desc_nulls_last()]
    pair = top_per_key(chosen, ["agreement_code"], newest_first, k=2, rank="_rank")
    # two rows per agreement are left at most: the newest, and the one before it
    older = Window.partitionBy("agreement_code").orderBy(*newest_first)
    return _ladder(pair.withColumns({
        "previous_status": F.lead("status").over(older),
        "previous_arrears_value": F.lead("arrears_value").over(older),
    }).filter(F.col("_rank") == 1))


def ladder_of_state(state: DataFrame, snapshots: tuple[dt.date, dt.date]) -> DataFrame:
    """The same from the newest two snapshots that a state of the history keeps."""
    start, end = _iso(snapshots)
    now, before = F.col("newest"), F.col("older")
    paired = (now["dateat"] == end) & (before["dateat"] == start)
    return _ladder(state.filter(now["dateat"].isin(start, end)).select(
        "agreement_code", "newest.*",
        F.when(paired, before["status"]).alias("previous_status"),
        F.when(paired, before["arrears_value"]).alias("previous_arrears_value")))


def _ladder(latest: DataFrame) -> DataFrame:
    return latest.select(
        F.last_day(F.date_sub(parse_date(F.col("dateat")), 10)).alias("report_month"),
        epoch_ms_to_date(F.col("contract_date_ms")).alias("contract_date"),
        "agreement_code", "status", "arrears_value", "previous_status", "previous_arrears_value",
        "capital_outstanding",
        arrears_ladder(F.col("arrears_value"), F.col("payment"), F.col("status"))
        .alias("current_arrears"),
        arrears_ladder(F.col("previous_arrears_value"), F.col("payment"), F.col("previous_status"))
        .alias("previous_arrears"),
    )


def status_changes(history: DataFrame, bad_dates: Iterable[dt.date] = (),
                   insurance_since: dt.date | None = None) -> DataFrame:
    """What the status history says about the end of each loan, one row per agreement.

    Balances around the status changes that end a loan, and the dates it entered the
    insurance-shortfall status. Bad snapshots are treated in two ways, as reported. For the
    balances they do not exist. For the insurance dates they are only dropped afterwards, so
    they still serve as the previous status of the next snapshot.

    ``crystalised_date`` counts days since 2000-01-01; ``dups_check`` and ``dups_check2``
    above 1 mean that sums mix several events. ``has_previous`` is false for agreements
    without any change to look at.
    """
    return changes_of(merged(stretches(history, bad_dates, insurance_since)))


def insurance_writeoffs(history: DataFrame, since: dt.date,
                        bad_dates: Iterable[dt.date] = ()) -> DataFrame:
    """Dates from ``since`` on at which loans entered the insurance-shortfall status."""
    return status_changes(history, bad_dates, since).select(
        "agreement_code", F.explode("insurance_dates").alias("insurance_date"))


def crystallisation(history: DataFrame, bad_dates: Iterable[dt.date] = ()) -> DataFrame:
    """Balances around the status changes that end a loan (see ``status_changes``)."""
    return status_changes(history, bad_dates).filter("has_previous").drop(
        "has_previous", "insurance_dates")


# ---------------------------------------------------------------- stock position


def closures_at_term(t: Tables, as_of: dt.date) -> DataFrame:
    """Loans shown as closed the day before ``as_of`` that were never settled or defaulted."""
    ended = t["settlements_and_defaults"].filter(F.col("date").isNotNull())
    closed = (
        on_date(t["loan_timeline"], as_of - dt.timedelta(days=1))
        .filter(F.col("status_code") == V.CLOSED)
        .select("agreement_code", "cash_transactions_cumulative")
    )
    return (
        t["loan_agreements"]
        .select("agreement_code", "contract_date", "contract_end_date", "total_finance_amount",
                "total_payable")
        .join(closed, "agreement_code").join(ended, "agreement_code", "left_anti")
    )


def exit_events(t: Tables, events: DataFrame) -> DataFrame:
    """Settlements and defaults with the borrower's termination, repossession and sale dates.

    ``events`` are the ``life_events``. They are read once: a loan's events of each kind are brought
    together first. A loan with several events of a kind repeats its exits, as reported.
    """
    exits = t["settlements_and_defaults"].select(
        "agreement_code", "type", "processed_date", F.col("amount").alias("settlement_amount"),
        F.col("date").alias("exit_date"))
    kinds = {TERMINATION: [F.col("day").alias("termination_date")],
             REPOSSESSION: [F.col("day").alias("repo_date")],
             SALE: [F.col("day").alias("vehicle_sale_date"), "actual_sale_date", "gross_sale_amount"]}
    known = events.groupBy("agreement_code").agg(*[
        F.collect_list(F.when(F.col("kind") == kind, F.struct(*columns))).alias(kind)
        for kind, columns in kinds.items()])
    rows = exits.join(known, "agreement_code", "left")
    for kind in kinds:
        rows = rows.select(*[c for c in rows.columns if c != kind],
                           F.explode_outer(kind).alias("_event")).select("*", "_event.*").drop("_event")
    return rows


def stock_position(t: Tables, calendar: ReportCalendar, insurance_since: dt.date,
                   bad_dates: Iterable[dt.date] = (), events: DataFrame | None = None) -> DataFrame:
    """Every loan of the snapshot pair with its end status.

    A loan with several exits or write-offs has several rows, as reported. ``events`` may be the
    stored ``life_events``. Store the position itself where several reports read it
    (``stored_position``).
    """
    ladder = status_ladder(t["status_history"],
                           (calendar.snapshot_start, calendar.snapshot_end))
    changes = status_changes(t["status_history"], bad_dates, insurance_since)
    return _position(t, calendar, ladder, changes, life_events(t) if events is None else events)


def position_state(history: DataFrame, bad_dates: Iterable[dt.date] = (),
                   insurance_since: dt.date | None = None) -> DataFrame:
    """All that later months need of a status history: one row per agreement.

    Its newest two snapshots, and the summary of its status changes (see ``summaries``).
    """
    summary = merged(stretches(history, bad_dates, insurance_since))
    return newest_two(history).join(summary, "agreement_code", "left")


def advanced_state(state: DataFrame, snapshot: DataFrame, bad_dates: Iterable[dt.date] = (),
                   insurance_since: dt.date | None = None, parts: int | None = None) -> DataFrame:
    """The state after one more snapshot, or more of them, all newer than those in the state.

    Equals ``position_state`` of the whole history, without reading it. ``parts`` states the
    partitions of its exchanges for large states: shuffle partitions do not grow with the loans, and
    adaptive execution joins them by their compressed size.
    """
    later = position_state(snapshot, bad_dates, insurance_since)

    def together(*columns: str | Column) -> DataFrame:
        both = state.select(*columns).unionByName(later.select(*columns))
        return both.repartition(parts, "agreement_code") if parts else both

    summary = merged(together(*[c for c in state.columns if c not in ("newest", "older")]))
    newest = newest_two(
        together("agreement_code", F.array("newest", "older").alias("pair"))
        .select("agreement_code", F.explode("pair").alias("s")).filter("s is not null")
        .select("agreement_code", "s.*"))
    return newest.join(summary, "agreement_code", "left")


def position_of_state(t: Tables, calendar: ReportCalendar, state: DataFrame,
                      events: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """The stock position from a state as of the closing snapshot; the history is not read.

    ``parts`` states the partitions in which a large state meets exits and closures.
    """
    if parts:
        state = state.repartition(parts, "agreement_code")
    ladder = ladder_of_state(state, (calendar.snapshot_start, calendar.snapshot_end))
    return _position(t, calendar, ladder, changes_of(state), life_events(t) if events is None else events)


def _position(t: Tables, calendar: ReportCalendar, ladder: DataFrame, changes: DataFrame,
              events: DataFrame) -> DataFrame:
    closures = closures_at_term(t, calendar.as_of).select("agreement_code", "contract_end_date")
    crystalised_to = F.coalesce("crystalised_to", "crystalised_to2")
    changes = changes.select(
        "agreement_code", "insurance_dates", "shortfall_balance",
        F.coalesce("crystalised_from", "crystalised_from2", "crystalised_from3")
        .alias("crystalised_from"),
        crystalised_to.alias("crystalised_to"),
        (crystalised_to - F.col("shortfall_balance")).alias("net_sale_amount"))
    rows = (
        left_join_many(ladder, exit_events(t, events), "agreement_code",
                       t["settlements_and_defaults"])
        .join(closures, "agreement_code", "left")
        .join(changes, "agreement_code", "left")
        .select("*", F.explode_outer("insurance_dates").alias("insurance_date"))
        .drop("insurance_dates")
    )
    month, kind = F.col("report_month"), F.col("type")

    def by_month_end(column: str) -> Column:
        return F.last_day(column) <= month

    end_status = (
        F.when(kind.isin(V.SETTLEMENT, V.UNWIND) & (F.col("processed_date") <= month),
               _code(V.END_EARLY_CLOSURE))
        .when(by_month_end("contract_end_date"), _code(V.END_FULL_TERM))
        .when((kind == V.VT) & by_month_end("processed_date"), _code(V.END_VT))
        .when(by_month_end("insurance_date"), _code(V.END_INSURANCE))
        .when((kind == V.VT_DEFAULT) & by_month_end("processed_date"), _code(V.END_VT_DEFAULT))
        .when((kind == V.DEFAULT) & by_month_end("termination_date"), _code(V.END_REPOSSESSION))
        .otherwise(F.col("current_arrears"))
    )
    return rows.withColumn("end_status", end_status)


def stored_position(t: Tables, calendar: ReportCalendar, insurance_since: dt.date,
                    bad_dates: Iterable[dt.date] = ()) -> DataFrame:
    """The stock position written once, by month, for all reports that read it."""
    events = materialize(life_events(t), "life_events")
    return materialize(stock_position(t, calendar, insurance_since, bad_dates, events),
                       "stock_position", partition_by=("report_month",))


# ---------------------------------------------------------------- reports on the stock


def _at(sp: DataFrame, month: dt.date) -> DataFrame:
    return sp.filter(F.col("report_month") == F.lit(month))


def _by(rows: DataFrame, metrics: dict[str, Column], *parts: str) -> DataFrame:
    return rows.groupBy("report_month", *parts).agg(*[c.alias(name) for name, c in metrics.items()])


def _ends_in_month(column: str) -> Column:
    return F.last_day(column) == F.col("report_month")


def _type_is(*kinds: str) -> Column:
    return F.col("type").isin(*kinds)


def _unsold() -> Column:
    sold = F.col("vehicle_sale_date")
    return sold.isNull() | (sold > F.col("report_month"))


def _closed_in_month() -> Column:
    return (
        (_type_is(V.DEFAULT) & _ends_in_month("termination_date"))
        | (_type_is(V.VT_DEFAULT, V.VT, V.SETTLEMENT, V.UNWIND) & _ends_in_month("processed_date"))
        | _ends_in_month("contract_end_date")
        | _ends_in_month("insurance_date")
    )


def _exit_balance() -> Column:
    return F.coalesce("settlement_amount", "crystalised_from", F.lit(1))


def _sold_at_loss() -> Column:
    proceeds = F.coalesce("gross_sale_amount", "net_sale_amount")
    return _ends_in_month("vehicle_sale_date") & (proceeds < _exit_balance())


def _volume_metrics() -> dict[str, Column]:
    live = F.col("status") == V.LIVE
    defaulted_unsold = _type_is(V.DEFAULT, V.VT_DEFAULT, V.VT) & _unsold()
    sold_later = F.col("vehicle_sale_date") > F.col("report_month")
    awaiting_sale = sold_later & (
        (_type_is(V.DEFAULT) & (F.col("termination_date") <= F.col("report_month")))
        | (_type_is(V.VT_DEFAULT) & (F.last_day("processed_date") <= F.col("report_month"))))

    def in_month(*kinds: str) -> Column:
        return _type_is(*kinds) & _ends_in_month("processed_date")

    def behind(payments: int) -> Column:
        return tally((F.col("current_arrears") >= payments) | awaiting_sale)

    written_off = _ends_in_month("insurance_date")
    repossessed = F.when(written_off, F.lit(0)).when(
        _type_is(V.DEFAULT) & _ends_in_month("termination_date"), F.lit(1))
    return {
        "total_portfolio": tally(live | defaulted_unsold),
        "total_closed": tally(_closed_in_month()),
        "vt_no_liability": tally(in_month(V.VT)),
        "vt_vs": tally(in_month(V.VT_DEFAULT)),
        "settlement": tally(in_month(V.SETTLEMENT, V.UNWIND)),
        "end_of_term": tally(_ends_in_month("contract_end_date")),
        "repo": F.sum(repossessed),
        "write_off": tally(written_off),
        "mia_2m": behind(2),
        "mia_3m": behind(3),
    }


def portfolio_volumes(sp: DataFrame, month: dt.date) -> DataFrame:
    """Loans in the book, closed in the month by reason, and two or three months in arrears."""
    return _by(_at(sp, month), _volume_metrics())


def _roll_outcomes() -> dict[str, Column]:
    end = F.col("end_status")
    return {
        "vol": F.lit(True),
        # a loan that is no longer live for no known reason counts as closed well, as reported
        "closed_good": (end < _code(V.END_VT)) | (end == _code(V.END_NOT_LIVE)),
        "to_utd": end == _code(0),
        "to_0plus": end == _code(PART_PAYMENT),
        "to_1": end == _code(1),
        "to_2": end == _code(2),
        "to_3": end == _code(3),
        "to_4": end.isin(_code(4), _code(5), _code(6)),
        "to_bad": end > _code(10),
        "to_vt": end == _code(V.END_VT),
    }


def _opening() -> Column:
    label = None
    for code, name in OPENINGS.items():
        hit = F.col("previous_arrears") == _code(code)
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return label


def _roll_metrics() -> dict[str, Column]:
    return {name: tally(cond) for name, cond in _roll_outcomes().items()}


def roll_rates(sp: DataFrame, month: dt.date) -> DataFrame:
    """Roll-rate matrix: one row per opening arrears state, its volume and nine outcomes."""
    rows = _at(sp, month).withColumn("opening", _opening())
    return _by(rows.filter(F.col("opening").isNotNull()), _roll_metrics(), "opening")


def roll_rates_wide(sp: DataFrame, month: dt.date) -> DataFrame:
    """The roll-rate matrix as the one-row report: ``<opening>_<outcome>`` columns."""
    return (
        _at(sp, month).withColumn("opening", _opening()).groupBy("report_month")
        .pivot("opening", list(OPENINGS.values()))
        .agg(*[tally(cond).alias(name) for name, cond in _roll_outcomes().items()])
    )


def _sales_metrics() -> dict[str, Column]:
    return {
        "vehicles_recovered": tally0(_ends_in_month("repo_date")),
        "vehicles_sold": tally0(_ends_in_month("vehicle_sale_date")),
        "vehicle_loss": tally(_sold_at_loss()),
    }


def sales_performance(sp: DataFrame, month: dt.date) -> DataFrame:
    """Vehicles recovered, sold and sold at a loss in the month."""
    return _by(_at(sp, month), _sales_metrics())


def _age_metrics() -> dict[str, Column]:
    age = months_diff(F.col("contract_date"), F.col("report_month"))
    end, instalments = F.col("end_status"), F.col("instalments_satisfied")
    # late arrears are also part of the written-off count, as reported
    written_off = end >= _code(6)
    metrics = {
        "vol": F.lit(True),
        "early": end.isin(_code(1), _code(2)),
        "middle": end.isin(_code(3), _code(4), _code(5)),
        "late": end == _code(6),
        "written_off": written_off,
        "written_off_le1_payment": written_off & (instalments <= 1),
        "written_off_gt1_payment": written_off & (instalments > 1),
    }
    first_payments = {
        "no_payment": (instalments == 0) & (end >= _code(0)),
        "one_payment": (instalments == 1) & (end >= _code(0)),
    }
    return {
        f"{name}_{a}m": tally((age == a) & cond)
        for found, ages in ((metrics, AGES), (first_payments, AGES[:2]))
        for name, cond in found.items() for a in ages}


def _age_placeholders() -> dict[str, Column]:
    return {f"{name}_{a}m": placeholder() for name in ("fraud", "fraud_value") for a in AGES}


def _paid(timeline: DataFrame, month: dt.date) -> DataFrame:
    return on_date(timeline, month).select("agreement_code", "instalments_satisfied")


def months_on_book(sp: DataFrame, timeline: DataFrame, month: dt.date) -> DataFrame:
    """Arrears of loans that are 3, 6, 12 and 18 months old, one column per metric and age."""
    rows = _at(sp, month).join(_paid(timeline, month), "agreement_code", "left")
    return _by(rows, _age_metrics()).withColumns(_age_placeholders())


def _value_metrics() -> dict[str, Column]:
    live = F.col("status") == V.LIVE
    defaulted_unsold = _type_is(V.DEFAULT, V.VT_DEFAULT, V.VT) & _unsold()
    term_end = F.col("loan_end_date")
    closing = F.coalesce("crystalised_from", "settlement_amount")
    sold, recovered = _ends_in_month("vehicle_sale_date"), _ends_in_month("repo_date")
    below_crystalised = sold & (
        F.coalesce("gross_sale_amount", "net_sale_amount") < F.col("crystalised_from") + 1)
    return {
        "total_portfolio": F.sum(F.when(live, F.col("capital_outstanding"))
                                 .when(defaulted_unsold, F.col("arrears_value"))),
        "total_term": sum_if((live | defaulted_unsold) & (F.col("report_month") < term_end),
                             months_diff(F.col("report_month"), term_end)),
        "total_closed": sum_if(_closed_in_month(), closing),
        "vt_no_liability": sum_if(_type_is(V.VT) & _ends_in_month("processed_date"), closing),
        "vt_vs": sum_if(_type_is(V.VT_DEFAULT) & _ends_in_month("processed_date"), closing),
        "vehicles_recovered": sum_if0(recovered, _exit_balance()),
        "vehicles_recovered_cap_val": sum_if0(recovered, F.lit(0)),
        "vehicles_sold_bal": sum_if0(sold, _exit_balance()),
        "vehicles_sold_cap_val": sum_if0(sold, F.lit(0)),
        "vehicles_sold_price": sum_if0(sold, F.col("gross_sale_amount")),
        "vehicle_loss_bal": sum_if(_sold_at_loss(), _exit_balance()),
        "vehicle_loss_cap_val": sum_if(below_crystalised, F.lit(0)),
        "vehicle_loss_sold_price": sum_if(_sold_at_loss(), F.col("gross_sale_amount")),
    }


def portfolio_values(sp: DataFrame, loans: DataFrame, month: dt.date) -> DataFrame:
    """Balances behind the portfolio volumes, and the remaining term of the book."""
    ends = loans.select("agreement_code", F.col("contract_end_date").alias("loan_end_date"))
    return _by(_at(sp, month).join(ends, "agreement_code", "left"), _value_metrics())


def _cohort_metrics() -> dict[str, Column]:
    rep = F.col("report_month")
    owed = F.col("capital_outstanding") + F.col("arrears_value")
    open_now = ~F.col("status").isin(V.PENDING_CLOSURE, V.CLOSED, V.WRITTEN_OFF) & (owed > 0)
    handed_back = (F.col("processed_date") <= rep) & (F.col("repo_date") <= rep)
    repossessed = (F.col("repo_date") <= rep) & _type_is(V.DEFAULT)
    age_months = months_diff(F.col("registration_date"), F.col("repo_date"))
    terminated = F.when(F.col("insurance_date") <= rep, F.lit(0)).when(
        _type_is(V.DEFAULT) & (F.col("termination_date") <= rep), F.lit(1))
    return {
        "new_business_volume": F.count(F.lit(1)),
        "new_business_value": F.sum("total_finance_amount"),
        "still_open": tally(open_now),
        "still_open_balance": sum_if(open_now, owed),
        "vol_2_plus": tally(F.col("end_status") >= _code(2)),
        "vol_3_plus": tally(F.col("end_status") >= _code(3)),
        "vol_handback_liability": tally(_type_is(V.VT_DEFAULT) & handed_back),
        "vol_handback_no_liability": tally(_type_is(V.VT) & handed_back),
        "terminations": F.sum(terminated),
        "forced_possession": tally(repossessed),
        "forced_possession_age": F.avg(F.when(repossessed & (age_months != 0), age_months)),
        "forced_possession_mileage": F.avg(F.when(repossessed, F.col("mileage"))),
    }


def _cohort_placeholders() -> dict[str, Column]:
    return {name: placeholder() for name in (
        "return_of_goods_requests", "accounts_return_of_goods_requests",
        "possession_after_request", "possession_no_request")}


COHORT_COLUMNS = ("registration_date", "mileage", "total_finance_amount")


def cohort_performance(sp: DataFrame, loans: DataFrame, month: dt.date) -> DataFrame:
    """Performance per origination quarter."""
    cohort = loans.filter(F.col("contract_date") <= F.lit(month)).select(
        "agreement_code", vintage_label(F.col("contract_date")).alias("vintage"), *COHORT_COLUMNS)
    return (
        _by(_at(sp, month).join(cohort, "agreement_code"), _cohort_metrics(), "vintage")
        .withColumns(_cohort_placeholders()).orderBy("report_month", "vintage")
    )


# ---------------------------------------------------------------- all reports of a month

PACK = {
    "portfolio_volumes": (None, _volume_metrics), "roll_rates": ("opening", _roll_metrics),
    "sales_performance": (None, _sales_metrics), "months_on_book": (None, _age_metrics),
    "portfolio_values": (None, _value_metrics), "cohort_performance": ("vintage", _cohort_metrics)}


def monthly_pack(sp: DataFrame, loans: DataFrame, timeline: DataFrame, month: dt.date
                 ) -> dict[str, DataFrame]:
    """The six reports of a month from one pass over the position, by name.

    The position is read once and grouped three ways at once: as a whole, by opening arrears and by
    vintage. The few grouped rows are stored, and each report takes its own from them. Equals the
    six functions above; ``loans`` and ``timeline`` hold one row per agreement (and day).
    """
    known = loans.select(
        "agreement_code", F.col("contract_end_date").alias("loan_end_date"),
        F.when(F.col("contract_date") <= F.lit(month), vintage_label(F.col("contract_date")))
        .alias("vintage"), *COHORT_COLUMNS)
    rows = (
        _at(sp, month).withColumn("opening", _opening())
        .join(_paid(timeline, month), "agreement_code", "left")
        .join(known, "agreement_code", "left")
    )
    part = {"opening": 1, "vintage": 2}
    grouped = materialize(
        rows.groupingSets([["report_month"], ["report_month", "opening"], ["report_month", "vintage"]],
                          "report_month", "opening", "vintage")
        .agg(F.grouping_id().alias("grouping"),
             *[column.alias(f"{report}.{name}") for report, (_, metrics) in PACK.items()
               for name, column in metrics().items()]), "monthly_pack")
    whole = 3                                       # neither opening nor vintage
    out = {}
    for report, (by, metrics) in PACK.items():
        mine = grouped.filter(F.col("grouping") == (whole if by is None else part[by]))
        if by:
            mine = mine.filter(F.col(by).isNotNull())
        out[report] = mine.select("report_month", *([by] if by else []), *[
            F.col(f"`{report}.{name}`").alias(name) for name in metrics()])
    out["months_on_book"] = out["months_on_book"].withColumns(_age_placeholders())
    out["cohort_performance"] = out["cohort_performance"].withColumns(
        _cohort_placeholders()).orderBy("report_month", "vintage")
    return out
