"""Ordered histories: first / latest rows, previous values, entries into a state.

A single key may own a large share of all rows, so no operator here sorts the whole
history of a key in one task:

* "top k per key" is written as ``row_number() <= k``, which Spark turns into a
  group limit that runs before the shuffle;
* previous values and running numbers need the rows of a key in order. A counting pass
  finds the keys with more rows than one task should sort. Only their histories are cut, at
  points measured from a sample of their rows; the last row before each cut is carried
  across it. Where no key is that large, a plain window is all there is: one exchange, one sort.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialize

#: Rows of one key that a single task sorts.
HOT_ROWS = 2_000_000
#: Sampled rows per range of a hot key, so that ranges are even to about a tenth.
SAMPLED = 100


def top_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column], k: int = 1,
                rank: str | None = None) -> DataFrame:
    """First ``k`` rows of every key in the given order; ``rank`` keeps the row number."""
    name = rank or "_rank"
    window = Window.partitionBy(*key).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def first_per_key(df: DataFrame, key: Sequence[str], by: str, tie: Sequence[str] = ()) -> DataFrame:
    """Earliest row of every key; ``tie`` columns make equal dates deterministic."""
    return top_per_key(df, key, [F.col(c).asc_nulls_last() for c in (by, *tie)])


def latest_per_key(df: DataFrame, key: Sequence[str], by: str, tie: Sequence[str] = ()) -> DataFrame:
    """Latest row of every key."""
    return top_per_key(df, key, [F.col(c).desc_nulls_last() for c in (by, *tie)])


def _place(order: Sequence[str]) -> Column:
    """The order columns as one value that compares as they do, NULLs last."""
    return F.struct(*[part.alias(f"_{n}{end}") for n, c in enumerate(order)
                      for end, part in (("u", F.col(c).isNull()), ("v", F.col(c)))])


def _ascending(order: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in order]


@dataclass(frozen=True)
class _Ranges:
    """Rows with the range of their key's history that they fall into, in ``_range``.

    ``hot`` tells rows of keys that were cut from the others, which have one range each.
    """

    rows: DataFrame
    key: list[str]
    order: list[str]
    hot: bool

    def inside(self) -> list[str]:
        return [*self.key, "_range"] if self.hot else self.key


def _ranges(df: DataFrame, key: Sequence[str], order: Sequence[str], tie: Sequence[str] | None,
            hot_rows: int | None) -> _Ranges:
    """Cut the histories of keys with more than ``hot_rows`` rows.

    ``tie`` are the columns that decide between rows of equal ``order``; all others if not given.
    Ranges are no smaller than a shuffle partition's share, so there are at most a few times as many
    cuts as shuffle partitions, and they can be broadcast.
    """
    spark = df.sparkSession
    total_order = [*order, *(tie if tie is not None else
                             [c for c in df.columns if c not in (*key, *order)])]
    # one struct column holds the key: it compares equal on NULL fields
    rows = df.withColumn("_key", F.struct(*key))
    limit = hot_rows or HOT_ROWS
    sizes = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_rows"))
    total, largest = sizes.agg(F.sum("_rows"), F.max("_rows")).first()
    if not total or largest <= limit:
        return _Ranges(df, list(key), total_order, False)
    limit = max(limit, total // int(spark.conf.get("spark.sql.shuffle.partitions")))
    hot = sizes.filter(F.col("_rows") > limit)
    share = min(1.0, SAMPLED / limit)
    sampled = (
        rows.join(F.broadcast(hot), "_key").filter(F.rand(7) < share)
        .groupBy("_key").agg(F.sort_array(F.collect_list(_place(total_order))).alias("_all"))
    )
    step = max(1, round(limit * share))
    cuts = materialize(sampled.select("_key", F.filter(
        "_all", lambda _, i: i % step == step - 1).alias("_cuts")), "history_cuts")
    place = _place(total_order)
    ranged = rows.join(F.broadcast(cuts), "_key", "left").withColumns({
        "_range": F.when(F.col("_cuts").isNotNull(),
                         F.size(F.filter("_cuts", lambda cut: cut <= place))).otherwise(F.lit(0)),
        "_hot": F.col("_cuts").isNotNull(),
    }).drop("_cuts")
    return _Ranges(ranged, list(key), total_order, True)


def _edges(found: _Ranges, row: Column, kept: Column | None = None) -> DataFrame:
    """Per range of a hot key: its last row, its last kept row and its size; a few rows in all."""
    place = _place(found.order)

    def last(wanted: Column) -> Column:
        return F.max(F.when(wanted, F.struct(place.alias("at"), row.alias("row"))))["row"]

    return found.rows.filter("_hot").groupBy("_key", "_range").agg(
        last(F.lit(True)).alias("_last"),
        last(F.lit(True) if kept is None else kept).alias("_last_kept"),
        F.count(F.lit(1)).alias("_size"))


def previous(df: DataFrame, columns: dict[str, str], key: Sequence[str], order: Sequence[str],
             tie: Sequence[str] | None = None, kept: Column | None = None,
             kept_columns: dict[str, str] | None = None, hot_rows: int | None = None) -> DataFrame:
    """Add values of the preceding row: ``columns`` maps source to output names.

    The first row of a key gets NULL. ``kept_columns`` come from the last preceding row that
    meets ``kept`` instead. Rows that tie in ``order`` follow the columns in ``tie``, by default
    all others, so the result does not vary; these must be of types that sort.
    """
    skipping = kept_columns or {}
    found = _ranges(df, key, order, tie, hot_rows)
    inside = Window.partitionBy(*found.inside()).orderBy(*_ascending(found.order))
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    added = {out: F.lag(c).over(inside) for c, out in columns.items()}
    if skipping:
        wanted = F.when(kept, F.struct(*skipping))
        added["_kept"] = F.last(wanted, ignorenulls=True).over(earlier)
    if found.hot:
        added["_first"] = F.lag(F.lit(1)).over(inside).isNull()
    rows = found.rows.withColumns(added)
    if found.hot:
        row = F.struct(*dict.fromkeys([*columns, *skipping]))
        across = Window.partitionBy("_key").orderBy("_range")
        before = across.rowsBetween(Window.unboundedPreceding, -1)
        carried = _edges(found, row, kept).select(
            "_key", "_range", F.lag("_last").over(across).alias("_carried"),
            F.last("_last_kept", ignorenulls=True).over(before).alias("_carried_kept"))
        rows = rows.join(F.broadcast(carried), ["_key", "_range"], "left").withColumns({
            out: F.when(F.col("_first"), F.col("_carried")[c]).otherwise(F.col(out))
            for c, out in columns.items()})
        if skipping:
            rows = rows.withColumn("_kept", F.coalesce("_kept", F.when(
                F.col("_carried_kept").isNotNull(),
                F.struct(*[F.col("_carried_kept")[c].alias(c) for c in skipping]))))
    if skipping:
        rows = rows.withColumns({out: F.col("_kept")[c] for c, out in skipping.items()})
    return rows.select(*df.columns, *columns.values(), *skipping.values())


def numbered(df: DataFrame, key: Sequence[str], order: Sequence[str], name: str = "row_number",
             from_end: str | None = None, tie: Sequence[str] | None = None,
             hot_rows: int | None = None) -> DataFrame:
    """Add the 1-based position of every row within its key, and ``from_end``, the one from its end.

    Rows that tie in ``order`` follow the columns in ``tie``, by default all others.
    """
    found = _ranges(df, key, order, tie, hot_rows)
    group = Window.partitionBy(*found.inside())
    position = F.row_number().over(group.orderBy(*_ascending(found.order))).cast("bigint")
    added = {name: position}
    if from_end:
        added["_all"] = F.count(F.lit(1)).over(group)
    rows = found.rows.withColumns(added)
    if found.hot:
        across = Window.partitionBy("_key").orderBy("_range")
        earlier = across.rowsBetween(Window.unboundedPreceding, -1)
        sizes = _edges(found, F.lit(1)).select(
            "_key", "_range", F.sum("_size").over(earlier).alias("_before"),
            F.sum("_size").over(Window.partitionBy("_key")).alias("_whole"))
        rows = rows.join(F.broadcast(sizes), ["_key", "_range"], "left").withColumn(
            name, F.col(name) + F.coalesce("_before", F.lit(0)))
        if from_end:
            rows = rows.withColumn("_all", F.coalesce("_whole", "_all"))
    if from_end:
        rows = rows.withColumn(from_end, F.col("_all") - F.col(name) + 1)
    return rows.select(*df.columns, name, *([from_end] if from_end else []))


def lag_by_column(df: DataFrame, value: str, offset: str, key: Sequence[str], order: Sequence[str],
                  name: str, tie: Sequence[str] | None = None,
                  hot_rows: int | None = None) -> DataFrame:
    """Value of the row that lies ``offset`` rows earlier, with an offset per row.

    Offset 0 (or NULL) is the row itself; an offset past the start gives NULL. Every row sends its
    value to its own position and a request to the position it asks for; both meet in one group
    per position, so rows are numbered once and joined to nothing.
    """
    rows = numbered(df, key, order, "_at", tie=tie, hot_rows=hot_rows)
    asked = F.col("_at") - F.coalesce(F.col(offset).cast("int"), F.lit(0))
    sent = F.array(
        F.struct(F.col("_at").alias("_place"), F.struct(F.col(value).alias("_v")).alias("_held"),
                 F.lit(False).alias("_asks")),
        F.struct(asked.alias("_place"), F.lit(None).alias("_held"), F.lit(True).alias("_asks")))
    # rows that are dealt by key are not dealt again by key and place
    met = rows.select(*df.columns, F.inline(sent))
    place = Window.partitionBy(*key, "_place")
    return (
        met.withColumn("_found", F.max("_held").over(place)).filter("_asks")
        .withColumn(name, F.col("_found")["_v"]).select(*df.columns, name)
    )


def entered_state(state: str, status: Column | str = "status",
                  previous_status: Column | str = "previous_status") -> Column:
    """The row moved into ``state``; a first row has no previous status and never counts."""
    now, before = (F.col(c) if isinstance(c, str) else c for c in (status, previous_status))
    return (now == state) & (before != state)
