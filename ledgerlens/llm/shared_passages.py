"""Removal of passages that stand in an earlier document, with suffix automata of reference shards.

1. *Seeds.* Of the runs of ``SEED`` words in a window, the one with the smallest hash (the leftmost
   of equals) is its seed, so equal windows have equal seeds, about one for 20 words of text. Only
   seeds that stand in two documents or more go on, with their context: the words of all windows
   that may have this seed.
2. *Reference shards.* Of equal contexts the one in the smallest document is the reference. They are
   dealt to shards by seed, so that texts which may share a window meet in one shard of bounded size.
3. *Automata.* Each shard becomes a suffix automaton over words, built in the order of documents;
   a state keeps the first document that reached it. Streaming a context through it gives, at each
   word, the longest match and so the first document that holds the window ending there. Maximal
   spans of such windows are looked up by every document that has the context.

An automaton meets the contexts of its own shard only: to send each to all documents would take
shards times documents. A seed with more than ``CONTEXTS`` different contexts (a common passage in
many surroundings) would not fit a shard; its windows are grouped by a hash of all their words
instead, which are alike within a group and need no automaton.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .text import (
    CASED, SPACE, by_size, importable, mixed, run_hashes, stored, word_hashes, word_places)

SEED = 12
#: Different contexts of a seed, and contexts of a shard on average; a shard's automaton takes about
#: 350 bytes for each of the 88 words of a context.
CONTEXTS, SHARD = 4000, 2000
_CHUNK = 1 << 14


class Automaton:
    """Suffix automaton over words of texts that are added in ascending order of their ``rank``."""

    def __init__(self):
        self.next, self.link, self.length, self.first = [{}], [-1], [0], [-1]

    def _state(self, following: dict, link: int, length: int, first: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.link) - 1

    def _split(self, before: int, word: int) -> int:
        """The state of the longest string of ``before`` and ``word``, split off where needed."""
        state = self.next[before][word]
        if self.length[state] == self.length[before] + 1:
            return state
        copy = self._state(dict(self.next[state]), self.link[state], self.length[before] + 1,
                           self.first[state])
        self.link[state] = copy
        while before >= 0 and self.next[before].get(word) == state:
            self.next[before][word] = copy
            before = self.link[before]
        return copy

    def add(self, words: list[int], rank: int) -> None:
        last = 0
        for word in words:
            if word in self.next[last]:
                last = self._split(last, word)
                continue
            state = self._state({}, 0, self.length[last] + 1, rank)
            while last >= 0 and word not in self.next[last]:
                self.next[last][word] = state
                last = self.link[last]
            if last >= 0:
                self.link[state] = self._split(last, word)
            last = state

    def first_ranks(self, words: list[int], length: int) -> list[int]:
        """For every window of ``length`` words: the smallest rank of a text that holds it, or -1."""
        following, link, longest, out = self.next, self.link, self.length, []
        state, match = 0, 0
        for at, word in enumerate(words):
            while state and word not in following[state]:
                state = link[state]
                match = longest[state]
            if word in following[state]:
                state, match = following[state][word], match + 1
            while longest[link[state]] >= length and state:
                state = link[state]                 # what matters is the window, not the whole match
                match = longest[state]
            if at >= length - 1:
                out.append(self.first[state] if match >= length else -1)
        return out


def _kind(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def _cased(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    raw, starts, stops, ends = word_places(batch["text"], SPACE)
    return word_hashes(raw, starts, stops, CASED), np.searchsorted(starts, ends)


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _raw(text: str | None) -> list[bytes]:
    return (text or "").encode().split()            # white space of ASCII, as bytes are split


def _choices(words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of the seed of every run of ``length`` words, and the hashes of all seeds by place."""
    size = min(SEED, length)
    width, n = length - size + 1, len(words) - size + 1
    if n < width:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    places = np.arange(n)
    hashes = run_hashes(words, places, places + size)
    windows = np.lib.stride_tricks.sliding_window_view(hashes, width)
    chosen = np.concatenate([windows[k:k + _CHUNK].argmin(1) + np.arange(k, min(k + _CHUNK, len(windows)))
                             for k in range(0, len(windows), _CHUNK)])
    return chosen, hashes


def _seeds(words: np.ndarray, bounds: np.ndarray, length: int) -> np.ndarray:
    """Places of the seeds of all windows of all texts."""
    chosen, _ = _choices(words, length)
    room = np.repeat(bounds[1:], np.diff(bounds))[:len(chosen)] - np.arange(len(chosen))
    return np.unique(chosen[room >= length])


def _seeded(docs: DataFrame, length: int) -> DataFrame:
    """Per row: words, digest of the text, and its seeds with their contexts."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch):
                words, bounds = _cased(part)
                at = _seeds(words, bounds, length)
                size = min(SEED, length)
                owner = np.searchsorted(bounds, at, "right") - 1
                low = np.maximum(at - (length - size), bounds[owner])
                high = np.minimum(at + length, bounds[owner + 1])
                seeds = run_hashes(words, at, at + size).view(np.int64)
                contexts = (run_hashes(words, low, high) ^ mixed((at - low).astype(np.uint64))).view(np.int64)
                ends = pa.array(np.searchsorted(owner, np.arange(part.num_rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (
                    seeds, contexts, (low - bounds[owner]).astype(np.int32),
                    (high - low).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["key"], pa.array(np.diff(bounds)),
                     pa.array([_digest(_raw(t)) for t in part["text"].to_pylist()], pa.string()),
                     *lists],
                    ["doc_id", "key", "n_words", "digest", "seed", "context", "start", "size"])

    importable(docs.sparkSession)
    return docs.mapInArrow(
        run, f"doc_id {_kind(docs)}, key bigint, n_words bigint, digest string, seed array<bigint>, "
             "context array<bigint>, start array<int>, size array<int>")


def _cut(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Words of the wanted contexts; for ``wide`` ones, the hash of each window with this seed."""
    kind = _kind(texts)
    id_type = to_arrow_schema(texts.select("doc_id").schema).field(0).type
    places = wanted.groupBy("key").agg(F.collect_set(
        F.struct("wide", "seed", "context", "start", "size", "last")).alias("places"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        done = set()                                # rows alike in id and text give the same
        for batch in batches:
            for part in by_size(batch, limit=1 << 20):
                out: list[tuple] = []
                words, bounds = _cased(part)
                for k, places in enumerate(part["places"].to_pylist()):
                    key, doc_id = part["key"][k].as_py(), part["doc_id"][k].as_py()
                    if key in done:
                        continue
                    done.add(key)
                    texts, own = _raw(part["text"][k].as_py()), words[bounds[k]:bounds[k + 1]]
                    if any(p["wide"] for p in places):
                        chosen, hashes = _choices(own, length)
                        seeds = hashes[chosen].view(np.int64)
                    for p in places:
                        start, stop = p["start"], p["start"] + p["size"]
                        same = (p["seed"], p["context"], doc_id, p["last"])
                        if not p["wide"]:
                            out.append((*same, None, None, b" ".join(texts[start:stop]).decode()))
                            continue
                        at = start + np.flatnonzero(seeds[start:stop - length + 1] == p["seed"])
                        windows = run_hashes(own, at, at + length).view(np.int64)
                        out += [(*same, h, s, None) for h, s in zip(windows.tolist(), (at - start).tolist())]
                types = [pa.int64(), pa.int64(), id_type, id_type, pa.int64(), pa.int32(), pa.string()]
                columns = list(zip(*out)) or [()] * len(types)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types)],
                    ["seed", "context", "doc_id", "last", "window", "low", "words"])

    importable(texts.sparkSession)
    return texts.join(places, "key").mapInArrow(
        run, f"seed bigint, context bigint, doc_id {kind}, last {kind}, window bigint, low int, words string")


def _spans(references: DataFrame, length: int, shards: int) -> DataFrame:
    """Of every context: spans of windows with the same first document, and this document."""
    kind = _kind(references)
    id_type = to_arrow_schema(references.select("doc_id").schema).field(0).type

    def run(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group["doc_id"]))
        ids = group["doc_id"].combine_chunks()
        numbers: dict[str, int] = {}
        texts = [[numbers.setdefault(w, len(numbers)) for w in t.split(" ")]
                 for t in group["words"].to_pylist()]
        automaton = Automaton()
        for rank, words in enumerate(texts):        # the order of ranks is that of documents
            automaton.add(words, rank)
        owner, low, high, first = [], [], [], []
        for rank, words in enumerate(texts):
            ranks = automaton.first_ranks(words, length)
            for at, r in enumerate(ranks):
                if at and ranks[at - 1] == r:
                    high[-1] = at + length
                else:
                    owner.append(rank)
                    low.append(at)
                    high.append(at + length)
                    first.append(r)
        at = pa.array(owner, pa.int64())
        return pa.table([group["seed"].take(at), group["context"].take(at), pa.array(low, pa.int32()),
                         pa.array(high, pa.int32()), ids.take(pa.array(first, pa.int64())).cast(id_type)],
                        ["seed", "context", "low", "high", "first"])

    importable(references.sparkSession)
    return references.withColumn("shard", F.pmod("seed", F.lit(shards))).groupBy("shard").applyInArrow(
        run, f"seed bigint, context bigint, low int, high int, first {kind}")


def _without(texts: DataFrame, removed: DataFrame) -> DataFrame:
    """Rows with their removed words taken out."""
    kind = _kind(texts)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, limit=1 << 20):
                counts, kept = [], []
                for text, spans in zip(part["text"].to_pylist(), part["spans"].to_pylist()):
                    words = _raw(text)
                    gone = np.zeros(len(words) + 1, np.int64)
                    for span in spans:
                        gone[span["low"]] += 1
                        gone[span["high"]] -= 1
                    stays = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
                    counts.append((len(words), len(words) - len(stays)))
                    kept.append(b" ".join([words[k] for k in stays]).decode())
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array([n for n, _ in counts], pa.int64()),
                     pa.array([n for _, n in counts], pa.int64()), pa.array(kept, pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept"])

    importable(texts.sparkSession)
    return texts.join(removed, "key").mapInArrow(
        run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")


def without_shared_passages(docs: DataFrame, length: int = 50) -> tuple[DataFrame, DataFrame]:
    """Documents without the passages of ``length`` words or more that an earlier document holds.

    Returns two frames that share no row: documents that keep all words (``doc_id, n_words,
    digest``, the sha256 of the words joined by one space), and the others (``doc_id, n_words,
    n_removed, kept``, the kept words joined by one space). A word goes if a window of ``length``
    words around it also stands in a document with a smaller ``doc_id``; windows are those of the
    input. ``docs`` has ``doc_id`` and ``text``; other columns are not read. Null and empty texts
    have no words. Rows with a null id lose nothing and take nothing from others. Rows that share an
    id are one document in this: they take nothing from one another. An empty table gives empty
    frames. Seeds and contexts are compared by 64-bit hashes, words in the automata as they are.
    """
    docs = docs.select("doc_id", "text").withColumn("key", F.xxhash64("doc_id", "text"))
    base = stored(_seeded(docs, length), "seeds")
    found = base.filter("doc_id is not null").select(
        "doc_id", "key", F.inline(F.arrays_zip("seed", "context", "start", "size")))
    known = stored(found.groupBy("seed").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
                   .filter("first < last").select("seed"), "known_seeds")
    met = stored(found.join(known, "seed"), "shared_seeds")
    # of equal contexts, the one in the first document; and the last document that has it
    contexts = stored(met.groupBy("seed", "context").agg(
        F.min(F.struct("doc_id", "key", "start", "size")).alias("at"), F.max("doc_id").alias("last")),
        "contexts")
    many = stored(contexts.groupBy("seed").count().filter(F.col("count") > CONTEXTS)
                  .select("seed", F.lit(True).alias("wide")), "wide_seeds")
    wanted = contexts.join(many, "seed", "left").select(
        F.coalesce("wide", F.lit(False)).alias("wide"), "seed", "context", "at.key", "at.start",
        "at.size", "last")
    texts = stored(docs.join(met.select("key").distinct(), "key", "left_semi"), "texts")
    cut = stored(_cut(texts, wanted, length), "cut")

    references = cut.filter("words is not null")
    shards = -(-references.count() // SHARD) or 1
    narrow = _spans(references.select("seed", "context", "doc_id", "words"), length, shards)
    windows = cut.filter("window is not null")
    # stored, so that a hot window is split in the join, not bound to the task of its group
    first_windows = stored(windows.groupBy("window").agg(
        F.min("doc_id").alias("first"), F.max("last").alias("last")).filter("first < last").drop("last"),
        "first_windows")
    wide = windows.join(first_windows, "window").select(
        "seed", "context", "low", (F.col("low") + length).alias("high"), "first")
    # no more spans than a context has windows, no more for a document than it has words
    spans = narrow.unionByName(wide).groupBy("seed", "context").agg(
        F.collect_list(F.struct("low", "high", "first")).alias("spans"))
    gone = F.transform(F.filter("spans", lambda s: s["first"] < F.col("doc_id")), lambda s: F.struct(
        (F.col("start") + s["low"]).alias("low"), (F.col("start") + s["high"]).alias("high")))
    removed = stored(
        met.join(spans, ["seed", "context"]).select("key", gone.alias("spans")).filter(F.size("spans") > 0)
        .groupBy("key").agg(F.flatten(F.collect_set("spans")).alias("spans")), "removed")
    whole = base.join(removed.select("key"), "key", "left_anti").select("doc_id", "n_words", "digest")
    return whole, _without(texts, removed)
