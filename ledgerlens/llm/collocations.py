"""Phrase collocations per language, from one count of the longest windows.

Every word of a text leads one window of ``size`` columns: itself and the words that follow it in
its piece, padded at the end of the piece. Only these windows are counted; ROLLUP over their columns
sums them for every shorter prefix, and a prefix of k words is a phrase of k words, so one shuffle
gives the counts of all orders.

Words are numbered per language before that. Those too rare for any phrase end a window like the
end of a piece does, as no phrase that counts holds them. The numbers are places in a dictionary of
the ``DICTIONARY`` most frequent words at most, which is broadcast; words beyond it keep their
64-bit hash instead, with the same results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import by_size, importable, mixed, stored, word_hashes, word_places

#: Words of the broadcast dictionary (8 bytes each); three of its numbers fit in 63 bits.
DICTIONARY = 2_000_000
#: Bytes of text that a task numbers at once, windows that it combines, and rows it hands on at once.
PART, COMBINED, HANDED = 2 << 20, 1 << 20, 1 << 16
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
UNKNOWN = "und"
PAD = 0

_ENDS = np.isin(np.arange(256), list(PIECE_ENDS))
_BLANK = _ENDS | np.isin(np.arange(256), (32, 9))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _words(batch: pa.RecordBatch):
    """Keys of all words of a batch (word and language), and whether the next one is in the piece."""
    raw, starts, stops, ends = word_places(batch["text"], _BLANK)
    bounds = np.searchsorted(starts, ends)
    owner = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
    langs = batch["lang"].fill_null(UNKNOWN).dictionary_encode()
    seeds = np.array([xxhash.xxh64_intdigest(x) for x in langs.dictionary.to_pylist()], np.uint64)
    lang = langs.indices.to_numpy()[owner] if len(owner) else owner
    keys = mixed(word_hashes(raw, starts, stops) + (seeds[lang] if len(owner) else np.uint64(0)))
    piece = np.searchsorted(np.flatnonzero(_ENDS[raw]), starts)
    together = np.append((piece[1:] == piece[:-1]) & (owner[1:] == owner[:-1]), False)[:len(starts)]
    return keys, together, lambda at: _texts(raw, starts[at], stops[at]), lambda at: langs.dictionary.take(
        pa.array(lang[at], pa.int32()))


def _texts(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.Array:
    """The words at the given places, A-Z as a-z, as one Arrow column."""
    sizes = stops - starts
    ends = np.append(0, np.cumsum(sizes))
    places = np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])
    return pa.LargeStringArray.from_buffers(
        len(starts), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(_LOWER[raw[places]]))


def _word_counts(docs: DataFrame) -> DataFrame:
    """How often each word occurs in each language: ``key, lang, word, f``."""
    importable(docs.sparkSession)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, limit=PART):
                keys, _, text, lang = _words(part)
                found, first, times = np.unique(keys, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.view(np.int64)), lang(first).cast(pa.string()),
                     text(first).cast(pa.string()), pa.array(times)], ["key", "lang", "word", "f"])

    counts = docs.mapInArrow(run, "key bigint, lang string, word string, f bigint")
    return counts.groupBy("key", "lang", "word").agg(F.sum("f").alias("f"))


class _Numbers:
    """From keys of words to small numbers, 0 for words that are too rare."""

    def __init__(self, keys: np.ndarray, complete: bool):
        self.order = np.argsort(keys, kind="stable")
        self.keys, self.complete = keys[self.order], complete

    def of(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        # words outside an incomplete dictionary: numbers that are no place in it
        rest = PAD if self.complete else (keys | np.uint64(1 << 62)).view(np.int64) & ((1 << 63) - 1)
        return np.where(self.keys[at] == keys, self.order[at] + 1, rest)


def _windows(docs: DataFrame, numbers: _Numbers, size: int) -> DataFrame:
    """Padded windows of ``size`` numbers, one per word that is not too rare: ``w1 .. n``."""
    names = [f"w{k + 1}" for k in range(size)]
    base = len(numbers.keys) + 1
    packs = numbers.complete and base ** size < 1 << 63

    def run(batches) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        for batch in batches:
            for part in by_size(batch, limit=PART):
                keys, together, *_ = _words(part)
                windows = [numbers.of(keys)]
                for _ in range(1, size):
                    # the window of the next word, one column less, cut where this word's window ends
                    last = np.append(windows[-1][1:], PAD)[:len(keys)]
                    windows.append(np.where(together & (windows[0] != PAD), last, PAD))
                for k in range(1, size):
                    windows[k][windows[k - 1] == PAD] = PAD
                kept = windows[0] != PAD
                windows = [w[kept] for w in windows]
                if not packs:
                    yield _rows(windows, np.ones(len(windows[0]), np.int64), names)
                    continue
                waiting.append(sum(w * base ** (size - 1 - k) for k, w in enumerate(windows)))
                held += len(waiting[-1])
                if held >= COMBINED:
                    yield from _unpacked(waiting, base, size, names)
                    waiting, held = [], 0
        if held:
            yield from _unpacked(waiting, base, size, names)

    importable(docs.sparkSession)
    return docs.mapInArrow(run, ", ".join(f"{c} bigint" for c in [*names, "n"]))


def _rows(windows, times, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in [*windows, times]], [*names, "n"])


def _unpacked(waiting: list[np.ndarray], base: int, size: int, names: list[str]
              ) -> Iterator[pa.RecordBatch]:
    packed, times = np.unique(np.concatenate(waiting), return_counts=True)
    for k in range(0, len(packed), HANDED):
        some = packed[k:k + HANDED]
        columns = [some // base ** (size - 1 - j) % base for j in range(size)]
        yield _rows(columns, times[k:k + HANDED], names)


def _gram_counts(windows: DataFrame, size: int, least: int) -> DataFrame:
    """Phrases of all orders that occur ``least`` times or more: ``gram, f``."""
    names = [f"w{k + 1}" for k in range(size)]
    rolled = windows.rollup(*names).agg(F.sum("n").alias("f"), F.grouping_id().alias("level"))
    # level 2^k - 1: the last k columns are summed up
    order = F.lit(size) - F.length(F.regexp_replace(F.bin("level"), "0", ""))
    gram = F.slice(F.array(*names), 1, order)
    return (
        rolled.filter((F.col("f") >= least) & (F.col("level") < 2 ** size - 1))
        .select(gram.alias("gram"), "f").filter(F.element_at("gram", -1) != PAD)
    )


def collocations(docs: DataFrame, size: int = 3, least: int = 10, share: int = 50,
                 top: int = 2000) -> DataFrame:
    """The ``top`` phrases of 2 to ``size`` words of each language, by how much they stick together.

    ``docs`` has ``text`` and ``lang``; other columns are not read. Returns ``lang, rank, phrase, a,
    l, r, n, score``: ``a`` occurrences, ``l`` and ``r`` those of the two parts at the cut with the
    lowest score, ``n`` words of the language, and the score, floor(1000000 a a / (l r)). A phrase
    counts with ``least`` occurrences; one inside a longer phrase that has ``share`` per cent of its
    occurrences is left out. A null language is ``und``; null and empty texts hold no words; repeated
    rows count as often as they stand there; ties are ordered by ``a`` and by the phrase's bytes. An
    empty table gives an empty result. Words are compared by 64-bit hashes.
    """
    docs = docs.select("text", F.col("lang").cast("string").alias("lang"))
    words = stored(_word_counts(docs), "words")
    lengths = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = words.filter(F.col("f") >= least)
    known = (frequent.orderBy(F.col("f").desc(), "key").limit(DICTIONARY).select("key")
             .toArrow()["key"].to_numpy().view(np.uint64))      # 16 MB at most
    numbers = _Numbers(known, frequent.count() <= DICTIONARY)
    grams = stored(_gram_counts(_windows(docs, numbers, size), size, least), "grams")

    cuts = grams.filter(F.size("gram") > 1).select(
        "gram", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("gram") - 1)).alias("k"))
    first, second = (grams.select(F.col("gram").alias(c), F.col("f").alias(f))
                     for c, f in (("first", "l"), ("second", "r")))
    exact = "decimal(38,0)"
    scored = (
        cuts.withColumns({"first": F.expr("slice(gram, 1, k)"),
                          "second": F.expr("slice(gram, k + 1, size(gram))")})
        .join(first, "first").join(second, "second")
        .withColumn("score", F.expr(
            f"cast(cast(1000000 as {exact}) * a * a div (cast(l as {exact}) * r) as bigint)"))
        .groupBy("gram", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    )
    longer = grams.filter(F.size("gram") > 2).select("f", F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), F.size("gram") - 1),
        lambda k: F.transform(F.sequence(F.lit(1), F.size("gram") - k + 1),
                              lambda at: F.slice("gram", at, k))))).alias("gram"))
    covered = longer.groupBy("gram").agg(F.max("f").alias("within"))
    left = scored.join(covered, "gram", "left").filter(
        F.col("within").isNull() | (100 * F.col("within") < share * F.col("a")))

    spelled = _numbered(frequent, numbers)
    for k in range(size):
        left = left.withColumn("id", F.get("gram", F.lit(k))).join(
            spelled.withColumnsRenamed({"word": f"word{k}", "lang": f"lang{k}"}), "id", "left").drop("id")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    named = left.select(
        F.col("lang0").alias("lang"), F.concat_ws(" ", *[f"word{k}" for k in range(size)]).alias("phrase"),
        "a", "cut.l", "cut.r", "cut.score")
    best = named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(lengths, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _numbered(words: DataFrame, numbers: _Numbers) -> DataFrame:
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = numbers.of(batch["key"].to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), batch["lang"], batch["word"]], ["id", "lang", "word"])

    importable(words.sparkSession)
    return words.select("key", "lang", "word").mapInArrow(run, "id bigint, lang string, word string")
