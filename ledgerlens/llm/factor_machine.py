"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

The score adds a bias, a weight per feature, and for every pair of features the product of their
values and of low-rank vectors. The pairs cost linear time: the sum over pairs of <v_i, v_j> x_i x_j
is half of the squared sum of v_i x_i less the sum of their squares, per factor.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import NO_ALNUM, gram_hashes, hashed_words, held_out, over_arrow

BUCKETS = 1 << 13       # of hashed words
# Classes of bytes whose shares describe the structure of a text.
CLASSES = ("upper", "lower", "digit", "high", "space", "newline", "mark", "stop", "exclaim", "symbol")


def _classes() -> np.ndarray:
    out = np.full(256, CLASSES.index("mark"))
    for name, members in (("upper", range(65, 91)), ("lower", range(97, 123)),
                          ("digit", range(48, 58)), ("high", range(128, 256)),
                          ("space", (32, 9, 11, 12, 13)), ("newline", (10,)),
                          ("stop", b".,;:?"), ("exclaim", b"!"), ("symbol", b"#*$%&|<>@~^_=+")):
        out[list(members)] = CLASSES.index(name)
    return out


BYTE_CLASS = _classes()
N_STATS = len(CLASSES) + 8


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray        # of the dense features, to standardise them
    scale: np.ndarray


def word_features(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of hashed words: bucket, value, and where each row ends. Rows have norm 1."""
    n = len(bounds) - 1
    text = np.repeat(np.arange(n), np.diff(bounds))
    bucket = (hashes >> np.uint64(40)).astype(np.int64) % BUCKETS
    cells, counts = np.unique(text * BUCKETS + bucket, return_counts=True)
    rows, value = cells // BUCKETS, np.log1p(counts)
    norm = np.sqrt(np.bincount(rows, value * value, n))
    return cells % BUCKETS, value / norm[rows], np.searchsorted(rows, np.arange(n + 1))


def statistics(column: pa.Array, hashes: np.ndarray, bounds: np.ndarray,
               meta: list[np.ndarray]) -> np.ndarray:
    """Dense features: shares of byte classes, lengths, repetition, and metadata, unscaled."""
    column = column.cast(pa.large_binary())
    n = len(column)
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    size, words = np.diff(ends), np.diff(bounds)
    text = np.repeat(np.arange(n), size)
    shares = np.bincount(text * len(CLASSES) + BYTE_CLASS[raw], minlength=n * len(CLASSES)) \
        .reshape(n, -1) / np.maximum(size, 1)[:, None]
    distinct, top, runs = np.zeros(n), np.zeros(n), np.zeros(n)
    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
        if b > a:
            counts = np.unique(hashes[a:b], return_counts=True)[1]
            distinct[k], top[k] = len(counts) / (b - a), counts.max() / (b - a)
            grams = gram_hashes(hashes[a:b], 3)
            runs[k] = 1 - len(np.unique(grams)) / len(grams) if len(grams) else 0
    dense = [np.log1p(words), size / np.maximum(words, 1), distinct, top, runs,
             (words < 10).astype(float), (words == 0).astype(float)]
    return np.column_stack([shares, *dense, *meta]) if n else np.zeros((0, N_STATS - 1 + len(meta)))


def scores(machine: Machine, bucket: np.ndarray, value: np.ndarray, bounds: np.ndarray,
           dense: np.ndarray) -> np.ndarray:
    """Probability of label 1 of each row, in time linear in its features."""
    n, k = len(dense), machine.factors.shape[1]
    scaled = np.clip((dense - machine.mean) / machine.scale, -4, 4)
    linear, factors = machine.linear, machine.factors
    rows = np.repeat(np.arange(n), np.diff(bounds))
    out = machine.bias + np.bincount(rows, linear[bucket] * value, n) + scaled @ linear[BUCKETS:]
    for f in range(k):
        part = factors[bucket, f] * value
        wide = factors[BUCKETS:, f]
        total = np.bincount(rows, part, n) + scaled @ wide
        squares = np.bincount(rows, part * part, n) + (scaled ** 2) @ (wide ** 2)
        out += 0.5 * (total * total - squares)
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = 6,
          epochs: int = 8, batch: int = 64, rate: float = 0.02, decay: float = 1e-4,
          seed: int = 23) -> Machine:
    """Fit by Adagrad on log loss; both labels weigh alike. Rows: buckets, values, dense features."""
    rng = np.random.default_rng(seed)
    wide = len(rows[0][2]) if rows else N_STATS
    dense = np.array([r[2] for r in rows]) if rows else np.zeros((0, wide))
    machine = Machine(0.0, np.zeros(BUCKETS + wide), rng.normal(0, 0.02, (BUCKETS + wide, rank)),
                      dense.mean(axis=0) if rows else np.zeros(wide),
                      dense.std(axis=0) + 1e-6 if rows else np.ones(wide))
    if not rows or labels.min() == labels.max():
        machine.factors[:] = 0
        machine.bias = 0.0 if not rows else 4.0 * (2 * labels[0] - 1)
        return machine
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    scaled = np.clip((dense - machine.mean) / machine.scale, -4, 4)
    columns = np.arange(BUCKETS, BUCKETS + wide)
    g_bias, g_linear, g_factors = 1e-6, np.full(BUCKETS + wide, 1e-6), np.full(machine.factors.shape, 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            chosen = order[at:at + batch]
            index = np.concatenate([np.r_[rows[i][0], columns] for i in chosen])
            value = np.concatenate([np.r_[rows[i][1], scaled[i]] for i in chosen])
            row = np.repeat(np.arange(len(chosen)), [len(rows[i][0]) + wide for i in chosen])
            own = machine.factors[index]
            part = own * value[:, None]
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            total = np.add.reduceat(part, starts)
            z = (machine.bias + np.add.reduceat(machine.linear[index] * value, starts)
                 + 0.5 * (total ** 2 - np.add.reduceat(part ** 2, starts)).sum(axis=1))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[chosen]) * weight[chosen]
            error /= len(chosen)
            e = error[row] * value
            cells, where = np.unique(index, return_inverse=True)
            d_linear = np.bincount(where, e, len(cells)) + decay * machine.linear[cells]
            d_factors = np.stack([np.bincount(where, e * (total[row, f] - part[:, f]), len(cells))
                                  for f in range(rank)], axis=1) + decay * machine.factors[cells]
            g_bias += error.sum() ** 2
            g_linear[cells] += d_linear ** 2
            g_factors[cells] += d_factors ** 2
            machine.bias -= rate * error.sum() / np.sqrt(g_bias)
            machine.linear[cells] -= rate * d_linear / np.sqrt(g_linear[cells])
            machine.factors[cells] -= rate * d_factors / np.sqrt(g_factors[cells])
    return machine


def _meta(batch, names) -> list[np.ndarray]:
    """Metadata columns as log of one plus the value; null and negative count as 0."""
    out = []
    for name in names:
        column = batch.column(batch.schema.get_field_index(name)).cast(pa.float64())
        out.append(np.log1p(np.maximum(np.nan_to_num(column.to_numpy(zero_copy_only=False)), 0)))
    return out


def _features(batch, meta: tuple[str, ...]):
    column = batch.column(batch.schema.get_field_index("_text")).fill_null("")
    hashes, bounds = hashed_words(column, NO_ALNUM)
    whole, ends = hashed_words(column)
    return (*word_features(hashes, bounds), statistics(column, whole, ends, _meta(batch, meta)))


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
                  meta: tuple[str, ...], per_label: int) -> tuple[list, np.ndarray]:
    """Features of about ``per_label`` documents of each label, from rows that may be learned from.

    A hash of the id chooses them, so reruns agree. Ids with both labels take the more frequent,
    1 on a tie; null labels and ids without document do not count.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(
        F.col(id_col).alias("_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("_label")) \
        .where(~held_out("_id"))
    counts = {r[0]: r[1] for r in marked.groupBy("_label").count().collect()}
    if not counts:
        return [], np.zeros(0)
    pick = F.pmod(F.xxhash64("_id", F.lit(8)), F.lit(1_000_000))
    few = marked.where(reduce(lambda a, b: a | b, (
        (F.col("_label") == label) & (pick < int(min(1.0, per_label / n) * 1_000_000) + 1)
        for label, n in counts.items())))
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"), *meta).join(
        F.broadcast(few), F.col("_doc") == F.col("_id")).select("_doc", "_label", "_text", *meta)

    def run(batch):
        bucket, value, bounds, dense = _features(batch, meta)
        return (batch.column(0), batch.column(1),
                [bucket[a:b] for a, b in zip(bounds, bounds[1:])],
                [value[a:b] for a, b in zip(bounds, bounds[1:])], list(dense))

    kind = dict(docs.dtypes)[id_col]
    found = over_arrow(rows, f"_doc {kind}, _label int, bucket array<bigint>, "
                       "value array<double>, dense array<double>", run).collect()
    found.sort(key=lambda r: (r[0], len(r[2]), r[4]))
    return ([(np.array(r[2], np.int64), np.array(r[3]), np.array(r[4])) for r in found],
            np.array([r[1] for r in found], float))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                   text_col: str = "text", label_col: str = "quality",
                   meta: tuple[str, ...] = ("n_chars",), per_label: int = 1500,
                   machine: Machine | None = None) -> DataFrame:
    """One row per row of ``docs``: id and ``score``, the probability of label 1.

    Without a ``machine`` one is trained on about ``per_label`` documents of each label, never of
    held-out ids. Null texts count as empty and are scored like any other; without labels every
    score is 0.5. Repeated rows give repeated results.
    """
    if machine is None:
        machine = train(*labelled_rows(docs, labels, id_col, text_col, label_col, meta, per_label))
    sent = docs.sparkSession.sparkContext.broadcast(machine)    # half a megabyte, whatever the input

    def run(batch):
        return batch.column(0), scores(sent.value, *_features(batch, meta))

    return over_arrow(docs.select(id_col, F.col(text_col).alias("_text"), *meta),
                      f"`{id_col}` {dict(docs.dtypes)[id_col]}, score double", run)
