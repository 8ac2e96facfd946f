"""Mixing of sources to target weights by capped water-filling, in DataFrame operations alone.

Sources share all words by weight. A target above ``max_epochs`` times its source is clamped, and
the excess goes to the others by weight, until none is above. A source's documents are then
repeated as often as the target holds them whole, and those first in a seeded order of hashes once
more, as long as they fit; one document of the rest, whose size is nearest to what is then missing,
fills the gap.

The place in the hash order where a source's extra repetition ends is found by sums over 4096 hash
ranges, then 4096 ranges of the one that holds it, then single documents: no source is ever sorted
or summed in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import stored

WEIGHTS = (1, 2, 3)
FEW_SOURCES = 100_000       # rows of about 100 bytes that may be broadcast
DIGITS = 3                  # hexadecimal digits of a hash range
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source", seed: int = 17) -> DataFrame:
    """``docs`` with ``__size`` (words), ``__source`` and ``__hash``, the place in the seeded order.

    A document without id takes its place from its text.
    """
    name = F.coalesce(F.col(id_col).cast("string"),
                      F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    return docs.withColumns({
        "__size": F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint"),
        "__source": F.col(source_col),
        "__hash": F.md5(F.concat(F.lit(f"{seed}:"), name)),
    })


def _ranked(sources: DataFrame) -> DataFrame:
    """Add ``rank``, from 0, by code point with null last; no task needs all sources."""
    placed = stored(sources.orderBy(F.col("__source").asc_nulls_last()).withColumn(
        "at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("at", 33)
    parts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("before"))        # a row per partition
    return placed.withColumn("part", part).join(F.broadcast(parts), "part").select(
        "__source", "source_size", (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1))
        .alias("rank"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """One row per source: ``__source``, ``source_size``, ``rank``, ``weight``, ``target``.

    Each round of the loop clamps the sources above their limit and reads back three sums.
    """
    ranked = _ranked(sizes.groupBy("__source").agg(F.sum("__size").alias("source_size")))
    weight = F.element_at(F.array(*map(F.lit, weights)),
                          (F.col("rank") % len(weights) + 1).cast("int")).cast("bigint")
    sources = stored(ranked.withColumn("weight", weight), "weights")
    limit = max_epochs * F.col("source_size")
    level, clamped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > limit
        total, fixed, free, count = sources.agg(
            F.sum("source_size"), F.sum(F.when(over, limit)), F.sum(F.when(~over, F.col("weight"))),
            F.count(F.when(over, 1))).first()
        if count == clamped or not free:
            break
        clamped, level = count, float((total or 0) - (fixed or 0)) / float(free)
    over = F.col("weight") * F.lit(level) > limit
    return sources.withColumn("target", F.when(over, limit.cast("double")).otherwise(
        F.lit(level) * F.col("weight")))


def _cut(rows: DataFrame, key: str) -> DataFrame:
    """Per source, the first ``key`` whose running sum passes what is needed, and the sum before."""
    sums = rows.groupBy("rank", key).agg(F.sum("__size").alias("s"), F.first("need").alias("need"))
    done = F.sum("s").over(Window.partitionBy("rank").orderBy(key))
    sums = sums.withColumn("done", done).where("done > need")
    return sums.groupBy("rank").agg(F.min_by(key, key).alias(f"cut_{key}"),
                                    F.min_by(F.col("need") - (F.col("done") - F.col("s")), key)
                                    .alias("need"))


def plan(sizes: DataFrame, id_col: str, weights: tuple[int, ...] = WEIGHTS,
         max_epochs: int = 3) -> DataFrame:
    """One row per source: its target, ``whole`` repetitions, and ``cut``, where the extra one ends.

    ``sizes`` has the columns that ``sized`` adds, and the id. Documents up to ``cut`` in the order
    of hash, id and size are repeated once more, and ``filler``; rows alike in all three stay
    together.
    """
    found = stored(targets(sizes, weights, max_epochs).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
        .otherwise(F.lit(0))).withColumn(
        "need", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    rows = _with_source(sizes, found.select("__source", "rank", "need"), found).select(
        "rank", "need", F.col("__size"), F.substring("__hash", 1, DIGITS).alias("b1"),
        F.substring("__hash", DIGITS + 1, DIGITS).alias("b2"),
        F.struct(F.col("__hash").alias("hash"), F.col(id_col).cast("string").alias("id"),
                 F.col("__size").alias("size")).alias("place"))
    first = _cut(rows, "b1")
    inside = rows.drop("need").join(first, "rank").where("b1 = cut_b1")
    second = _cut(inside, "b2")
    inside = inside.drop("need").join(second, "rank").where("b2 = cut_b2")
    done = F.sum("__size").over(Window.partitionBy("rank").orderBy("place"))
    fits = F.col("done") <= F.col("need")
    ends = stored(inside.withColumn("done", done).groupBy("rank").agg(
        F.max(F.when(fits, F.col("place"))).alias("cut"),
        (F.first("need") - F.coalesce(F.max(F.when(fits, F.col("done"))), F.lit(0))).alias("gap"),
        F.first(F.concat("cut_b1", "cut_b2")).alias("cell")), "ends")
    start = F.substring("place.hash", 1, 2 * DIGITS)
    few = found.count() <= FEW_SOURCES
    rest = rows.join(F.broadcast(ends) if few else ends, "rank").where(
        (F.col("__size") > 0) & (start >= F.col("cell"))
        & ~F.coalesce(F.col("place") <= F.col("cut"), F.lit(False))
        & (F.abs(F.col("__size") - F.col("gap")) < F.col("gap")))
    fillers = rest.groupBy("rank").agg(F.min_by(
        "place", F.struct(F.abs(F.col("__size") - F.col("gap")), "place")).alias("filler"))
    return stored(found.join(ends.drop("gap"), "rank", "left").join(fillers, "rank", "left").select(
        "__source", "source_size", "target", F.col("whole").cast("bigint").alias("whole"),
        (F.col("need") > 0).alias("more"), "cell", "cut", "filler"), "mix")


def _with_source(rows: DataFrame, sources: DataFrame, counted: DataFrame) -> DataFrame:
    few = counted.count() <= FEW_SOURCES
    named = sources.withColumnRenamed("__source", "_named")
    return rows.join(F.broadcast(named) if few else named,
                     F.col("__source").eqNullSafe(F.col("_named"))).drop("_named")


def repeated(rows: DataFrame, mix: DataFrame, id_col: str) -> DataFrame:
    """Add ``source_size``, ``target`` and ``repeats`` to rows that ``sized`` made."""
    place = F.struct(F.col("__hash").alias("hash"), F.col(id_col).cast("string").alias("id"),
                     F.col("__size").alias("size"))
    start = F.substring("__hash", 1, 2 * DIGITS)
    # without a cell the whole source fits into what is needed
    extra = F.col("more") & (F.col("cell").isNull() | (start < F.col("cell")) | F.coalesce(
        place <= F.col("cut"), F.lit(False)) | F.coalesce(place == F.col("filler"), F.lit(False)))
    joined = _with_source(rows, mix, mix)
    return joined.withColumn("repeats", F.col("whole") + extra.cast("bigint")).drop(
        "whole", "more", "cell", "cut", "filler")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3,
            seed: int = 17) -> DataFrame:
    """One row per row: id, ``size``, ``source_size``, ``target`` and ``repeats``.

    A null text has no words; a null source is a source, the last in order. Empty tables give empty
    results, sources without words the target 0. Rows alike in id and size are repeated alike.
    """
    sizes = stored(sized(docs.select(id_col, text_col, source_col), id_col, text_col, source_col,
                         seed).select(id_col, "__size", "__source", "__hash"), "sizes")
    found = repeated(sizes, plan(sizes, id_col, weights, max_epochs), id_col)
    return found.select(id_col, F.col("__size").alias("size"), "source_size", "target", "repeats")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
               max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """The mix itself: every row as often as ``mixture`` repeats it, numbered by ``repetition``.

    A column of that name in ``docs`` gives way.
    """
    rows = sized(docs, id_col, text_col, source_col, seed).select(
        F.struct(*docs.columns).alias("__row"), F.col(id_col).alias("__id"), "__size", "__source",
        "__hash")
    sizes = stored(rows.drop("__row"), "sizes")
    found = repeated(rows, plan(sizes, "__id", weights, max_epochs), "__id")
    return found.where("repeats > 0").select(
        *(F.col("__row")[c].alias(c) for c in docs.columns if c != "repetition"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("repeats"))).alias("repetition"))
