"""Benchmark decontamination by greedy string tiling over shared-token seeds.

Documents and test items are words of letters and digits, A-Z in lower case. Every run of
``seed_words`` words of an item is a seed; a document is compared with the items whose seeds it
holds. The comparison is greedy string tiling in the running Karp-Rabin form: starting from hash
hits, the longest unmarked common runs become tiles and are marked, then the next longest, down to
the seed length. The share of an item's words under tiles is its coverage; since tiles may come in
any order, a passage whose sentences were moved around is found as well.

Different item texts are read in blocks of a proven size, each sent to the executors whole, used
and released; documents are scanned once a block and never meet each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import NO_ALNUM, gram_hashes, hashed_words, over_arrow, stored, through_arrow

BLOCK_CHARS = 8_000_000      # characters of test items that are sent to the executors at a time
ITEM_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TABLE_BITS = 22              # bits of the table that rules out most words at one look


class Seeds:
    """Items of a block, their word hashes, and where each seed stands."""

    def __init__(self, items: list[tuple[tuple, str]], seed_words: int):
        hashes, bounds = hashed_words(pa.array([t for _, t in items], pa.string()), NO_ALNUM)
        self.ids = [k for k, _ in items]
        self.words = [hashes[a:b] for a, b in zip(bounds, bounds[1:])]
        self.seed_words = seed_words
        grams = [gram_hashes(w, seed_words) for w in self.words]
        flat = np.concatenate([*grams, np.empty(0, np.uint64)])
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([*(np.arange(len(g)) for g in grams), np.empty(0, np.int64)])
        order = np.argsort(flat, kind="stable")
        self.grams, self.item, self.place = flat[order], item[order], place[order].astype(np.int64)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self._slot(flat)] = True

    @staticmethod
    def _slot(grams: np.ndarray) -> np.ndarray:
        return (grams >> np.uint64(64 - TABLE_BITS)).astype(np.intp)

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """Places of a text at which some seed stands."""
        maybe = np.flatnonzero(self.table[self._slot(grams)])
        at = np.searchsorted(self.grams, grams[maybe])
        found = at < len(self.grams)
        found[found] = self.grams[at[found]] == grams[maybe][found]
        return maybe[found]


def common_runs(places: np.ndarray, found: list[np.ndarray], size: int
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal common runs of a text and an item: place in text less place in item, place in item, length.

    ``places`` are the places of the item at which seeds of ``size`` words stand that the text also
    holds, ascending; ``found`` has the ascending places in the text for each. Memory grows with the
    runs, not with the pairs of places.
    """
    shifts, starts, done = np.empty(0, np.int64), np.empty(0, np.int64), []
    last = -2
    for j, at in zip(places.tolist(), found):
        now = at - j
        begun = np.full(len(now), j)
        if j == last + 1 and len(shifts):
            near = np.minimum(np.searchsorted(shifts, now), len(shifts) - 1)
            goes_on = shifts[near] == now
            begun[goes_on] = starts[near[goes_on]]
            ends = np.ones(len(shifts), bool)
            ends[near[goes_on]] = False
        else:
            ends = np.ones(len(shifts), bool)
        done.append((shifts[ends], starts[ends], last + size - starts[ends]))
        shifts, starts, last = now, begun, j
    done.append((shifts, starts, last + size - starts))
    return tuple(np.concatenate(column) for column in zip(*done))


def _without(runs, low, high, least: int):
    """What is left of runs outside [low, high) of the item, in pieces of ``least`` words or more."""
    shift, start, n = runs
    after = np.maximum(start, high)
    before_n, after_n = np.minimum(n, low - start), start + n - after
    a, b = before_n >= least, after_n >= least
    return (np.concatenate([shift[a], shift[b]]), np.concatenate([start[a], after[b]]),
            np.concatenate([before_n[a], after_n[b]]))


def tiles(runs: tuple[np.ndarray, np.ndarray, np.ndarray], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in text, place in item, length) of each tile.

    ``runs`` are all maximal common runs of at least ``least`` words. Ties go to the earlier place
    in the item, then in the text.
    """
    found = []
    while len(runs[0]):
        shift, start, n = runs
        longest = int(n.max())
        at = np.flatnonzero(n == longest)
        j, i = start[at], start[at] + shift[at]
        order = np.lexsort((i, j))
        j, i = j[order], i[order]
        while len(j):
            tile_j, tile_i = int(j[0]), int(i[0])
            found.append((tile_i, tile_j, longest))
            apart = (np.abs(j - tile_j) >= longest) & (np.abs(i - tile_i) >= longest)
            j, i = j[apart], i[apart]
            runs = _without(runs, tile_j, tile_j + longest, least)
            low = tile_i - runs[0]
            runs = _without(runs, low, low + longest, least)
    return found


def _compared(seeds: Seeds, grams: np.ndarray, at: np.ndarray, coverage: float) -> list[tuple]:
    """Items whose words are covered enough by tiles in one text; ``at`` are its seeds' places."""
    order = np.argsort(grams[at], kind="stable")
    held, held_at = grams[at][order], at[order]
    distinct = np.unique(held)
    low = np.searchsorted(seeds.grams, distinct, "left")
    count = np.searchsorted(seeds.grams, distinct, "right") - low
    entry = np.arange(count.sum()) + np.repeat(low - (np.cumsum(count) - count), count)
    entry = entry[np.lexsort((seeds.place[entry], seeds.item[entry]))]
    item, first = np.unique(seeds.item[entry], return_index=True)
    size, out = seeds.seed_words, []
    for n, own in zip(item.tolist(), np.split(entry, first[1:])):
        words, places = len(seeds.words[n]), seeds.place[own]
        reach = np.minimum(np.diff(places), size).sum() + size
        if reach < coverage * words:            # no tiling covers more than all seeds do
            continue
        a = np.searchsorted(held, seeds.grams[own], "left").tolist()
        b = np.searchsorted(held, seeds.grams[own], "right").tolist()
        found = tiles(common_runs(places, [held_at[x:y] for x, y in zip(a, b)], size), size)
        covered = sum(length for _, _, length in found)
        if covered >= coverage * words:
            out.append((*seeds.ids[n], words, covered, covered / words, len(found),
                        max(length for _, _, length in found)))
    return out


def _items(bench: DataFrame, id_col: str, text_col: str, seed_words: int) -> DataFrame:
    """Rows of test items that have a seed: item_id and text."""
    return bench.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).alias("text")) \
        .where(F.regexp_count("text", F.lit(ITEM_WORD)) >= seed_words)


def _blocks(items: DataFrame, block_chars: int) -> Iterator[tuple[list, bool]]:
    """Different texts as ((item_id, key), text), at most ``block_chars`` characters at a time.

    A longer text is a block of its own. Texts of several rows carry a key in place of their id. The
    flag tells whether a block is the last. One partition is fetched at a time, so neither the
    driver nor a worker ever holds all items.
    """
    texts = stored(items.groupBy("text").agg(
        F.min("item_id").alias("item_id"), F.count("*").alias("n")), "items")
    rows = texts.select("item_id", F.when(F.col("n") > 1, F.md5("text")).alias("key"), "text")
    block, size = [], 0
    for item_id, key, text in rows.toLocalIterator():
        if block and size + len(text) > block_chars:
            yield block, False
            block, size = [], 0
        block.append(((item_id, key), text))
        size += len(text)
    yield block, True


def _found(seeds: Seeds, column: pa.Array, coverage: float) -> dict[int, list[tuple]]:
    """Items found in each text of a column, by the number of the text."""
    size = seeds.seed_words
    hashes, bounds = hashed_words(column, NO_ALNUM)
    grams = gram_hashes(hashes, size)
    at = seeds.hits(grams)
    text = np.searchsorted(bounds, at, "right") - 1
    inside = at + size <= bounds[text + 1]      # a run that crosses the end of a text is none
    at, text = at[inside], text[inside]
    out = {}
    for k in np.unique(text).tolist():
        out[k] = _compared(seeds, grams[bounds[k]:], at[text == k] - bounds[k], coverage)
    return out


def _in_blocks(docs: DataFrame, items: DataFrame, seed_words: int, block_chars: int,
               apply: Callable[[DataFrame, Broadcast], DataFrame], chained: bool) -> list[DataFrame]:
    """Results of ``apply`` for each block of items; with more than one, each is stored.

    A block is sent, used and released before the next. ``chained`` passes each result on.
    """
    out = []
    for block, last in _blocks(items, block_chars):
        sent = docs.sparkSession.sparkContext.broadcast(Seeds(block, seed_words))
        result = apply(out[-1] if chained and out else docs, sent)
        if last and not out:
            return [result]
        out.append(stored(result, "tiles"))
        sent.destroy()
    return out


def contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_id_col: str = "item_id", item_text_col: str = "text", seed_words: int = 5,
                 coverage: float = 0.6, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Pairs of document and test item whose ``coverage`` reaches the threshold.

    One row per row of ``docs`` and such item: id, item_id, item_words, matched_words, coverage,
    n_tiles, longest_tile. Null and empty texts match nothing, nor do items of fewer than
    ``seed_words`` words; repeated rows and items give repeated results. Items of one text are
    compared once, and their ids joined to the result. Item ids are whole numbers.
    """
    schema = (f"`{id_col}` {dict(docs.dtypes)[id_col]}, item_id bigint, item_key string, "
              "item_words bigint, matched_words bigint, coverage double, n_tiles bigint, "
              "longest_tile bigint")
    items = _items(bench, item_id_col, item_text_col, seed_words)

    def pairs(frame, sent):
        def run(batch):
            found = _found(sent.value, batch.column(1), coverage)
            rows = [k for k, v in found.items() for _ in v]
            columns = list(zip(*(r for v in found.values() for r in v))) or [[] for _ in range(7)]
            return [batch.column(0).take(pa.array(rows, pa.int64())), *columns]

        return over_arrow(frame, schema, run)

    found = reduce(DataFrame.union, _in_blocks(docs.select(id_col, F.col(text_col).alias("text")),
                                               items, seed_words, block_chars, pairs, False))
    repeated = stored(items.groupBy(F.md5("text").alias("item_key"), "item_id").agg(
        F.count("*").alias("n")), "item-ids")
    if not repeated.groupBy("item_key").agg(F.sum("n").alias("n")).where("n > 1").isEmpty():
        found = stored(found, "tiles")
        several = found.where("item_key is not null").drop("item_id").join(
            repeated.withColumn("again", F.explode(F.sequence(F.lit(1), "n"))), "item_key")
        found = found.where("item_key is null").union(several.select(found.columns))
    return found.drop("item_key")


def decontaminated(docs: DataFrame, bench: DataFrame, text_col: str = "text",
                   item_id_col: str = "item_id", item_text_col: str = "text", seed_words: int = 5,
                   coverage: float = 0.6, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that ``contaminated`` pairs with no item, with all their columns."""
    def without(frame, sent):
        def run(batch):
            column = batch.column(batch.schema.get_field_index(text_col))
            found = _found(sent.value, column, coverage)
            return batch.filter(pa.array([not found.get(k) for k in range(batch.num_rows)], pa.bool_()))

        return through_arrow(frame, run)

    items = _items(bench, item_id_col, item_text_col, seed_words)
    return _in_blocks(docs, items, seed_words, block_chars, without, True)[-1]
