"""Data checks that go with the reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import parse_date


def control_totals(df: DataFrame, key: str, amount: str) -> DataFrame:
    """Rows, distinct keys and total amount; rows above keys mean a join multiplied rows."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(key).alias("keys"),
        F.sum(amount).alias("total"),
    )


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def repeated_transitions(changes: DataFrame, key: str = "agreement_code") -> DataFrame:
    """Loans whose crystallisation sums mix several events."""
    return changes.filter((F.col("dups_check") > 1) | (F.col("dups_check2") > 1)).select(
        key, "dups_check", "dups_check2")


def key_counts(frames: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Per named frame and key column: rows, distinct keys, and rows whose key is NULL.

    A join may be left out, or made without multiplying rows, where the rows with a key are as
    many as the keys. NULL keys on both sides of a merge that matches them meet in all pairs.
    """
    parts = [
        df.groupBy(F.lit(name).alias("name"), F.col(key).alias("_key"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        for name, (df, key) in frames.items()
    ]
    keys = [part.withColumn("_key", F.col("_key").cast("string")) for part in parts]
    return reduce(DataFrame.unionByName, keys).groupBy("name").agg(
        F.sum("_rows").alias("rows"),
        F.count("_key").alias("keys"),
        F.coalesce(F.sum(F.when(F.col("_key").isNull(), F.col("_rows"))), F.lit(0)).alias("null_keys"),
    )


def unread_dates(df: DataFrame, column: str) -> DataFrame:
    """Rows whose date text is missing, and rows whose text is no date and would be read as NULL."""
    text = F.col(column)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when(text.isNull(), 1)).alias("missing"),
        F.count(F.when(text.isNotNull() & parse_date(text).isNull(), 1)).alias("unread"),
    )


@dataclass(frozen=True)
class Watch:
    """Counts that arrive with a report; asking for them waits for the job that writes it."""

    observation: Observation
    names: tuple[str, ...]

    def counts(self) -> dict:
        return {name: self.observation.get[name] for name in self.names}

    def frame(self, spark: SparkSession) -> DataFrame:
        """The counts as one row."""
        return spark.createDataFrame([self.counts()], ", ".join(
            f"`{name}` {'double' if name == 'total' else 'bigint'}" for name in self.names))


def watched(df: DataFrame, key: Sequence[str], amount: str | None = None,
            nulls_of: Sequence[str] = (), exact_keys: bool = True,
            parts: int | None = None) -> tuple[DataFrame, Watch]:
    """A report that counts itself while it is written, and the counts.

    The counts are ``rows``, ``keys`` (different keys without NULL), ``null_keys`` (rows with a NULL
    in the key), ``total`` of ``amount`` and ``null_<column>``. No table is read again. Exact keys
    need the rows of a key side by side: no exchange where a join on the key has just dealt them, and
    one otherwise; rows with a NULL key stay where they are. ``parts`` states the partitions of that
    exchange for large reports: adaptive execution would join them by their compressed size. Where one
    key may own a large share of the rows, ``exact_keys=False`` counts keys by a sketch, with an error
    of about 1 %. Watch a report as its last step: what stands before an exchange may be counted twice
    when an executor is lost.
    """
    keyless = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
    out, marks = df, []
    if exact_keys:
        own = Window.partitionBy(*key, "_apart").orderBy(*key)
        out = df.withColumn("_apart", F.when(keyless, F.monotonically_increasing_id())) \
            .transform(lambda rows: rows.repartition(parts, *key, "_apart") if parts else rows) \
            .withColumn("_first", F.row_number().over(own) == 1)
        keys, marks = F.count(F.when(F.col("_first") & ~keyless, 1)), ["_apart", "_first"]
    else:
        keys = F.approx_count_distinct(F.when(~keyless, F.struct(*key)), 0.01)
    measures = {"rows": F.count(F.lit(1)), "keys": keys, "null_keys": F.count(F.when(keyless, 1))}
    if amount is not None:
        measures["total"] = F.sum(F.col(amount).cast("double"))
    measures |= {f"null_{c}": F.count(F.when(F.col(c).isNull(), 1)) for c in nulls_of}
    observation = Observation()
    out = out.observe(observation, *[m.alias(name) for name, m in measures.items()]).drop(*marks)
    return out, Watch(observation, tuple(measures))
