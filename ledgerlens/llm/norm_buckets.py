"""Ranked lexical search: the best documents for each query text, by norm buckets as in LEMP.

A document is a vector of impacts over the terms of the query texts, a query text a vector of
weights. Coordinates are scaled by the root of the term's weight, so that the inner product is the
score and rare terms make vectors long. Vectors are stored in order of their length:

* a bucket of vectors is skipped if its longest, times the length of the query, stays below the
  query's threshold (Cauchy-Schwarz); where that holds for all queries, files are not even read;
* inside a bucket, the products of the query's heaviest coordinates are added up; for the others
  the smaller of two bounds is taken: the lengths of what is left of both vectors, and the largest
  value of each coordinate in the bucket;
* survivors are scored in 64-bit integers.

Thresholds come from the longest sixteenth of the vectors first, then from each task's own best.
They are lower bounds of the k-th score, so nothing is lost. Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .text import NO_ALNUM, hashed_words, importable, over_arrow, stored

#: Characters of query texts that one pass over the documents takes; bounds what is broadcast.
BLOCK_CHARS = 4_000_000
BUCKET = 1024
FOCUS = 8
#: Bounds are computed in doubles; this much is added before they rule a vector out.
SLACK = 1 + 1e-9


class Queries:
    """Query texts of one block: their terms, numbered over the block, and their weights."""

    def __init__(self, texts: list[str]):
        hashes, bounds = hashed_words(pa.array(texts, pa.large_string()), NO_ALNUM)
        self.vocabulary, places = np.unique(hashes, return_inverse=True)
        self.terms = [np.unique(places[bounds[k]:bounds[k + 1]]) for k in range(len(texts))]

    def weigh(self, documents: int, frequency: np.ndarray) -> None:
        ratio = (2 * documents + 2) / (2 * frequency + 1)
        self.weights = np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)
        # heaviest coordinates first
        self.terms = [t[np.argsort(-self.weights[t], kind="stable")] for t in self.terms]
        self.lengths = np.sqrt([float(self.weights[t].sum()) for t in self.terms])


def _blocks(items: DataFrame) -> Iterator[list]:
    """Rows of ``items`` in blocks of at most ``BLOCK_CHARS`` characters (or one row)."""
    block, size = [], 0
    for row in items.toLocalIterator():             # holds one partition at a time
        if block and size + len(row.text) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append(row)
        size += len(row.text)
    if block:
        yield block


def _counts(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Per document with a term: its number of terms, and how often it holds those of the queries."""
    found = docs.schema["doc_id"].dataType.simpleString()

    def rows(batch: pa.RecordBatch):
        hashes, bounds = hashed_words(batch["text"], NO_ALNUM)
        n = np.diff(bounds)
        places = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
        known = vocabulary[places] == hashes
        owner = np.repeat(np.arange(len(n)), n)[known]
        keys, times = np.unique(owner * len(vocabulary) + places[known], return_counts=True)
        owner, terms = np.divmod(keys, len(vocabulary))
        ends = np.searchsorted(owner, np.arange(len(n) + 1))
        return [batch["doc_id"], n, _lists(ends, terms.astype(np.int32)),
                _lists(ends, times.astype(np.int64))]

    return over_arrow(docs, f"doc_id {found}, n bigint, terms array<int>, times array<bigint>",
                      rows).filter("n > 0")


def _lists(ends: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each list ends, and all their values."""
    ends = column.offsets.to_numpy()
    return ends - ends[0], column.flatten().to_numpy()


def _vectors(counts: DataFrame, queries: Queries, documents: int, length: int) -> DataFrame:
    """Impacts over the terms of the queries, and the length of the scaled vector."""
    weights = queries.weights
    kind = counts.schema["doc_id"].dataType.simpleString()

    def rows(batch: pa.RecordBatch):
        ends, terms = _flat(batch["terms"])
        times = _flat(batch["times"])[1]
        m = 10 + 90 * batch["n"].to_numpy() * documents // length
        impacts = 10**9 * times // (1000 * times + 8 * np.repeat(m, np.diff(ends)))
        squares = np.append(0.0, np.cumsum(weights[terms] * impacts.astype(float) ** 2))
        norm = np.sqrt(np.maximum(np.diff(squares[ends]), 0)) * SLACK
        return [batch["doc_id"], norm, _lists(ends, terms), _lists(ends, impacts)]

    return over_arrow(counts.filter(F.size("terms") > 0),
                      f"doc_id {kind}, norm double, terms array<int>, impacts array<bigint>", rows)


class _Best:
    """The k best documents so far of one query, and the score that a better one must reach."""

    def __init__(self, k: int, threshold: int):
        self.k, self.threshold, self.scores, self.ids = k, threshold, None, None

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        scores = pa.array(scores, pa.int64())
        if self.scores is not None:
            scores, ids = pa.concat_arrays([self.scores, scores]), pa.concat_arrays([self.ids, ids])
        order = pc.sort_indices(
            pa.table({"score": scores, "id": ids}), null_placement="at_start",
            sort_keys=[("score", "descending"), ("id", "ascending")])[:self.k]
        self.scores, self.ids = scores.take(order), ids.take(order)
        if len(order) == self.k:
            self.threshold = max(self.threshold, self.scores[-1].as_py())


def _search_bucket(bucket: pa.RecordBatch, queries: Queries, best: list[_Best]) -> None:
    norms = bucket["norm"].to_numpy()
    longest = norms.max() * SLACK
    wanted = [q for q, b in enumerate(best)
              if len(queries.terms[q]) and queries.lengths[q] * longest >= b.threshold]
    if not wanted:
        return
    ends, terms = _flat(bucket["terms"])
    impacts, rows = _flat(bucket["impacts"])[1], np.repeat(np.arange(len(norms)), np.diff(ends))
    order = np.argsort(terms, kind="stable")
    terms, impacts, rows = terms[order], impacts[order], rows[order]
    here, first = np.unique(terms, return_index=True)
    largest = np.maximum.reduceat(impacts, first)
    last = np.append(first[1:], len(terms))
    for q in wanted:
        at = np.searchsorted(here, queries.terms[q])
        inside = at < len(here)
        inside[inside] = here[at[inside]] == queries.terms[q][inside]
        weights, at = queries.weights[queries.terms[q][inside]], at[inside]
        if not len(at):
            continue
        focus = min(FOCUS, len(at))
        places = [slice(first[p], last[p]) for p in at]
        docs = np.concatenate([rows[p] for p in places[:focus]])
        parts = np.concatenate([w * impacts[p] for w, p in zip(weights[:focus], places[:focus])])
        known = np.bincount(docs, parts, len(norms))
        used = np.bincount(docs, parts * np.concatenate([impacts[p] for p in places[:focus]]).astype(float),
                           len(norms))
        rest = np.sqrt(np.maximum(norms ** 2 * SLACK - used, 0)) * math.sqrt(weights[focus:].sum())
        rest = np.minimum(rest, float((weights[focus:] * largest[at[focus:]]).sum()))
        bound = (known + rest) * SLACK
        alive = np.flatnonzero((bound >= best[q].threshold) & (bound > 0))
        if not len(alive):
            continue
        number = np.full(len(norms), -1)
        number[alive] = np.arange(len(alive))
        scores = np.zeros(len(alive), np.int64)
        for w, p in zip(weights, places):           # a document stands once at most under a term
            of = number[rows[p]]
            scores[of[of >= 0]] += w * impacts[p][of >= 0]
        good = (scores >= best[q].threshold) & (scores > 0)
        if good.any():
            best[q].add(scores[good], bucket["doc_id"].take(pa.array(alive[good])))


def _search(vectors: DataFrame, queries: Queries, k: int, thresholds: list[int]) -> DataFrame:
    """The k best documents of every query among those that one task has seen."""
    kind = vectors.schema["doc_id"].dataType
    out = f"item int, doc_id {kind.simpleString()}, score bigint"
    ids = to_arrow_schema(vectors.select("doc_id").schema).field(0).type
    importable(vectors.sparkSession)

    def run(batches):
        best = [_Best(k, t) for t in thresholds]
        for batch in batches:
            for start in range(0, batch.num_rows, BUCKET):
                _search_bucket(batch.slice(start, BUCKET), queries, best)
        for q, b in enumerate(best):
            if b.scores is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(b.scores), q), pa.int32()), b.ids.cast(ids), b.scores],
                    ["item", "doc_id", "score"])

    return vectors.mapInArrow(run, out)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best documents of every item: ``item_id, rank, doc_id, score``.

    ``docs`` has ``doc_id`` and ``text``, ``items`` has ``item_id`` and ``text``; other columns are
    not read. Documents and items without a term (null or empty texts, signs only) appear nowhere,
    nor do documents that share no term of weight with an item. Equal scores are ranked by
    ascending ``doc_id``, null first; rows that repeat an id are documents of their own, and repeated
    items each get the same documents. Empty tables give an empty result. Texts are read whole.
    Items are taken in blocks of ``BLOCK_CHARS``; each block is one pass over the documents.
    """
    spark = docs.sparkSession
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text")
    kinds = (items.schema["item_id"].dataType.simpleString(),
             docs.schema["doc_id"].dataType.simpleString())
    result = spark.createDataFrame(
        [], f"item_id {kinds[0]}, rank int, doc_id {kinds[1]}, score bigint")
    for block in _blocks(items.filter("text is not null")):
        texts = {text: n for n, text in enumerate(dict.fromkeys(row.text for row in block))}
        queries = Queries(list(texts))
        if not len(queries.vocabulary):
            continue
        counts = stored(_counts(docs, queries.vocabulary), "term_counts")
        documents, length = counts.agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not documents:
            continue
        frequency = np.zeros(len(queries.vocabulary), np.int64)
        # one row per term of the block
        for term, times in counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            frequency[term] = times
        queries.weigh(documents, frequency)
        vectors = stored(
            _vectors(counts, queries, documents, length)
            .repartitionByRange(F.col("norm").desc(), F.col("doc_id"))
            .sortWithinPartitions(F.col("norm").desc()), "impact_vectors")
        cut = vectors.agg(F.percentile_approx("norm", 15 / 16)).first()[0]
        if cut is None:
            continue
        head = stored(_top(_search(vectors.filter(F.col("norm") >= cut), queries, k,
                                   [0] * len(texts)), k), "longest")
        thresholds = [0] * len(texts)
        for row in head.filter(F.col("rank") == k).collect():     # one row per item of the block
            thresholds[row.item] = row.score
        shortest = min((t / n for t, n in zip(thresholds, queries.lengths) if n > 0), default=0.0)
        tail = vectors.filter((F.col("norm") < cut) & (F.col("norm") >= shortest / SLACK))
        best = _top(head.drop("rank").unionByName(_search(tail, queries, k, thresholds)), k)
        names = spark.createDataFrame([(texts[row.text], row.item_id) for row in block],
                                      f"item int, item_id {kinds[0]}")
        result = result.unionByName(
            best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return result
