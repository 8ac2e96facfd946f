"""Near-duplicate documents by MinHash with tensored banding, candidates verified on full sets.

Two small collections of ``bands`` keys, each made of ``rows`` minhashes, stand for ``bands**2``
tables: the key of table (i, j) combines key i of the first with key j of the second collection. Two
texts meet in some table exactly if they share a key of each collection, so ``2 * bands * rows``
minhashes do the work of ``2 * rows * bands**2``. With 18 bands of 3 rows, texts of similarity 0.8
miss every table with a chance of 5 in a million, and less the more alike they are.

Exact copies are one node from the start. Candidates come in two steps, so that no group is
expanded into all its pairs: first every text meets the smallest one of each key of the first
collection, if they share one of the second too; verified links are contracted to components; then
only texts at keys where several components still meet are compared further, between different
components alone, by an exact prefix filter on their sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .text import hashed_words, mixed, over_arrow, shingles, stored

BROADCAST_ROWS = 1_000_000      # ids of 8 bytes; beyond, joins shuffle
BLOCK = 4096                    # shingles that are hashed at a time
SEED = 20_240_229


def _odd_factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return (rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1),
            rng.integers(0, 1 << 32, n, dtype=np.uint32))


def minhashes(grams: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Smallest value of each hash function over a set of shingles."""
    short = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for start in range(0, len(short), BLOCK):
        part = short[start:start + BLOCK, None] * factors + shifts
        np.minimum(out, part.min(axis=0), out=out)
    return out


def _signatures(docs: DataFrame, id_col: str, text_col: str, size: int, bands: int,
                rows: int) -> DataFrame:
    factors, shifts = _odd_factors(2 * bands * rows)
    salts = np.arange(1, 2 * bands + 1, dtype=np.uint64)

    def run(batch):
        n, first, second = [], [], []
        d1, d2 = [], []
        hashes, bounds = hashed_words(batch.column(1))
        for low, high in zip(bounds, bounds[1:]):
            words = hashes[low:high]
            grams = shingles(words, size)
            n.append(len(grams))
            whole = xxhash.xxh3_128_digest(words.tobytes())
            d1.append(int.from_bytes(whole[:8], "big", signed=True))
            d2.append(int.from_bytes(whole[8:], "big", signed=True))
            if not len(grams):
                first.append([])
                second.append([])
                continue
            values = minhashes(grams, factors, shifts).reshape(2 * bands, rows).astype(np.uint64)
            keys = salts.copy()
            for k in range(rows):
                keys = mixed(keys + values[:, k])
            keys = keys.view(np.int64)
            first.append(keys[:bands])
            second.append(keys[bands:])
        return batch.column(0), n, d1, d2, first, second

    return over_arrow(
        docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_col),
        "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, a array<bigint>, b array<bigint>",
        run)


def _sets(docs: DataFrame, id_col: str, text_col: str, size: int, wanted: DataFrame) -> DataFrame:
    """Shingle sets of the wanted nodes, from their whole texts."""
    few = wanted.count() <= BROADCAST_ROWS
    rows = docs.select(F.col(id_col).cast("bigint").alias("node"), text_col).join(
        F.broadcast(wanted) if few else wanted, "node", "left_semi")

    def run(batch):
        hashes, bounds = hashed_words(batch.column(1))
        found = [shingles(hashes[low:high], size).view(np.int64)
                 for low, high in zip(bounds, bounds[1:])]
        ends = np.cumsum([0, *map(len, found)])
        values = pa.array(np.concatenate(found) if found else np.empty(0, np.int64), pa.int64())
        return batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    return over_arrow(rows, "node bigint, grams array<bigint>", run, step=64)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the similarity; ``sets`` may hold more nodes."""
    left = sets.select(F.col("node").alias("u"), F.col("grams").alias("gu"))
    right = sets.select(F.col("node").alias("v"), F.col("grams").alias("gv"))
    both = F.size(F.array_intersect("gu", "gv"))
    return pairs.join(right, "v").join(left, "u").where(
        100 * both >= percent * (F.size("gu") + F.size("gv") - both)).select("u", "v")


def _near_size(percent: int):
    """Sets whose sizes differ by more than this cannot be that similar."""
    return 100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv")


SALTS = 16              # parts into which the copies of one text are dealt for their last look-up
LENGTH_STEP = 1.03      # sets are compared between classes of sizes, each larger by this factor


def _across_parts(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs from different parts that may reach the similarity: an exact prefix filter.

    ``sets`` has ``node``, ``grams`` and ``part``. If two sets are that similar, they share one of
    their first few shingles in any common order; here the rarest come first, and how many count
    follows from both sizes. So a text that differs from all others in enough places meets none,
    however large the group whose other words it shares. At each meeting place the rows of the
    largest part are compared with those of other parts only.
    """
    share = percent / (100 + percent)       # of both sizes together that must be common

    def prefix(size, other):                # how many of the first shingles can be the first match
        return F.floor(size - F.ceil(share * (size + other) - 1e-6)) + 1

    rows = sets.select("node", "part", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    common = rows.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    ranked = rows.join(common, "gram").withColumn("place", F.row_number().over(
        Window.partitionBy("node").orderBy("df", "gram")))
    shared = Window.partitionBy("node")
    placed = ranked.withColumn("place", F.col("place") + F.col("n") - F.count("*").over(shared)) \
        .where(F.col("place") <= prefix(F.col("n"), F.col("n") * (percent / 100)))
    steps = math.ceil(math.log(100 / percent) / math.log(LENGTH_STEP)) + 1
    level = F.floor(F.log(F.col("n")) / math.log(LENGTH_STEP) + 1e-9).cast("int")

    def least(of):                          # smallest size in a class
        return F.greatest(F.pow(F.lit(LENGTH_STEP), of) - 1e-6, F.lit(1.0))

    # a text meets larger ones as the small side and smaller ones as the large side
    every = F.sequence(F.lit(0), F.lit(steps))

    def side(small):
        step = 1 if small else -1
        reached = F.filter(every, lambda k: F.col("place") <= prefix(
            F.col("n"), least(F.col("level") + step * k)))
        return F.transform(reached, lambda k: F.struct(
            F.lit(small).alias("small"), k.alias("step"),
            (F.col("level") if small else F.col("level") - k).alias("low")))

    roles = placed.withColumn("level", level).withColumn(
        "role", F.explode(F.concat(side(True), side(False)))).select(
        "gram", "role.low", "role.step", "role.small", "node", "part", "n", "place")
    at = ["gram", "low", "step"]
    per_part = roles.groupBy(*at, "part").agg(F.count("*").alias("c"))
    mixed_places = per_part.groupBy(*at).agg(
        F.max(F.struct("c", "part")).alias("most"), F.count("*").alias("parts")) \
        .where("parts > 1").select(*at, F.col("most.part").alias("main"))
    meet = roles.join(mixed_places, at)
    minor = meet.where("part <> main").select(
        *at, F.col("small").alias("su"), F.col("node").alias("u"), F.col("part").alias("pu"),
        F.col("n").alias("nu"), F.col("place").alias("iu"))
    other = meet.select(
        *at, F.col("small").alias("sv"), F.col("node").alias("v"), F.col("part").alias("pv"),
        F.col("n").alias("nv"), F.col("place").alias("iv"))
    needed = F.ceil(share * (F.col("nu") + F.col("nv")) - 1e-6)
    pairs = minor.join(other, at).where(
        (F.col("su") != F.col("sv")) & (F.col("pu") != F.col("pv")) & _near_size(percent)
        & (1 + F.least(F.col("nu") - F.col("iu"), F.col("nv") - F.col("iv")) >= needed))
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      size: int = 5, percent: int = 80, bands: int = 18,
                      rows: int = 3) -> DataFrame:
    """One row per row: ``doc_id``, ``n_shingles`` and ``component_id``.

    Words are separated by white space, A-Z in lower case; a text of fewer than ``size`` words is
    one shingle, one without words (or null) has none and is linked with nothing. Links join
    documents whose sets reach ``percent``; the component is the smallest id reachable. Rows that
    repeat an id are one document; if their texts differ, they tie these texts together. A row
    without id is not linked and its component is null. Ids are whole numbers.
    """
    signed = stored(_signatures(docs, id_col, text_col, size, bands, rows), "signatures")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    copies = full.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.count("*").alias("n"))
    nodes = full.join(copies.withColumnRenamed("node", "doc_id"), ["doc_id", "d1", "d2"],
                      "left_semi").select(F.col("doc_id").alias("node"), "n_shingles", "a", "b")

    # step one: the smallest text of each key of the first collection
    keyed = nodes.select("node", "n_shingles", "b", F.explode("a").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")) \
        .where("hub <> last").select("key", "hub")
    met = stored(keyed.select("node", "key").join(buckets, "key"), "met")
    side = nodes.select("node", "n_shingles", "b")
    pairs = met.where("node <> hub").select(F.col("hub").alias("u"), F.col("node").alias("v")) \
        .distinct()
    pairs = pairs.join(side.toDF("v", "nv", "bv"), "v").join(side.toDF("u", "nu", "bu"), "u") \
        .where(_near_size(percent) & F.arrays_overlap("bu", "bv")).select("u", "v").distinct()
    pairs = stored(pairs, "pairs")
    ids = pairs.select(F.col("u").alias("node")).union(
        pairs.select(F.col("v").alias("node"))).distinct()
    links = stored(_verified(pairs, _sets(docs, id_col, text_col, size, ids), percent), "links")
    joined = stored(components(links), "components")

    # step two: keys at which several components still meet
    part = F.coalesce("component", "node").alias("part")
    members = met.select("key", "node").join(joined, "node", "left").select("key", "node", part)
    open_keys = members.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")) \
        .where("p <> q").select("key")
    left = stored(members.join(open_keys, "key").select("node", "part").distinct(), "open")
    sets = stored(_sets(docs, id_col, text_col, size, left.select("node")), "sets")
    more = stored(_across_parts(sets.join(left, "node"), percent), "pairs")
    if not more.isEmpty():
        extra = _verified(more, sets, percent)
        joined = stored(components(links.union(extra)), "components")

    # only texts with copies or links need a look-up, which copies of one text share among salts
    classes = copies.join(joined, "node", "left").where("n > 1 or component is not null").select(
        "d1", "d2", F.coalesce("component", "node").alias("component_id"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    linked = full.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(
        classes, ["d1", "d2", "salt"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    alone = signed.where("n_shingles = 0 or doc_id is null").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone)


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       **parameters: int) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, or null.

    Of rows that repeat a kept id one stays.
    """
    classes = stored(duplicate_classes(docs, id_col, text_col, **parameters), "classes")
    dropped = classes.where("doc_id <> component_id").select("doc_id").distinct()
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    number = docs[id_col].cast("bigint")
    kept = docs.join(dropped, number == dropped["doc_id"], "left_anti")
    again = stored(classes.where("doc_id = component_id").groupBy("doc_id").count().where(
        "count > 1").select("doc_id"), "repeated")
    if again.isEmpty():
        return kept
    return kept.join(again, number == again["doc_id"], "left_anti").union(
        kept.join(again, number == again["doc_id"], "left_semi").dropDuplicates([id_col]))
