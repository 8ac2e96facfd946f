"""Operators that compare documents, the mix, and the pipeline: brute force and odd inputs."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlens.llm import backoff, mixing, near_duplicates, queries, string_tiling
from ledgerlens.llm.components import components
from ledgerlens.llm.text import NO_ALNUM, hashed_words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words_of(text):
    return (text or "").encode().lower().split()


def shingle_set(text, size):
    w = words_of(text)
    if len(w) >= size:
        return frozenset(tuple(w[k:k + size]) for k in range(len(w) - size + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def plain_components(rows, size, percent=80):
    sets = {k: shingle_set(t, size) for k, t in rows}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k)) for k in ids}


def test_components(spark):
    chain = [(k, k + 1) for k in range(1, 40)]
    rows = chain + [(2, 1), (100, 100), (200, 201), (203, 201), (None, 5)]
    links = spark.createDataFrame(rows, "u bigint, v bigint")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {200: 200, 201: 200, 203: 200}
    assert components(links.where("false")).count() == 0


def family(rng, base, edits):
    words = list(base)
    for k in rng.choice(len(words), edits, replace=False):
        words[k] = f"e{rng.integers(1 << 40)}"
    return " ".join(words)


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_against_all_pairs(spark, size):
    """Families edited at every rate around the threshold, shared passages, copies, short texts."""
    rng = np.random.default_rng(size)
    texts = []
    for f in range(6):
        base = [f"w{f}x{rng.integers(5000)}" for _ in range(60 + 40 * f)]
        texts += [family(rng, base, int(k)) for k in rng.integers(0, 14, 25)] + [" ".join(base).upper()] * 3
    passage = " ".join(f"p{k}" for k in range(50))
    texts += [passage + " " + " ".join(f"u{rng.integers(1 << 40)}" for _ in range(int(k)))
              for k in rng.integers(3, 40, 40)]
    texts += ["", None, "  ", "one two", "ONE  two", "one two three", "a b c d", "a b c d e"]
    rows = list(enumerate(texts, 1))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in near_duplicates.duplicate_classes(df, size=size).collect()}
    assert got == plain_components(rows, size)


def test_near_duplicates_on_documents(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in near_duplicates.duplicate_classes(docs, size=4).collect()}
    assert got == plain_components(rows, 4)


def test_duplicates_odd_rows(spark):
    text = "the very same words again and again here"
    rows = [(1, text, 9), (2, text, 9), (2, text, 9), (None, text, 9), (4, None, 9), (5, "", 9),
            (6, "other words altogether in this one", 9), (6, "other words altogether in this one", 8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, node bigint")
    kept = near_duplicates.without_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text is None) for r in kept.collect()) == [
        (0, False), (1, False), (4, True), (5, False), (6, False)]
    assert near_duplicates.without_duplicates(df.where("false")).count() == 0
    assert near_duplicates.duplicate_classes(df.where("false")).count() == 0


def test_near_duplicates_of_hot_and_empty_texts(spark):
    hot = " ".join(f"hot{n}" for n in range(30))
    rows = [(k, hot) for k in range(100, 700)] + [(k, None if k % 2 else " \n") for k in range(700, 1300)] + [
        (99, hot + " more"), (98, " ".join(f"own{n}" for n in range(30))), (None, hot), (None, None), (98, hot)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [(r.doc_id, r.n_shingles, r.component_id)
           for r in near_duplicates.duplicate_classes(df).collect()]
    want = [(k, 26, 98) for k in range(100, 700)] + [(k, 0, k) for k in range(700, 1300)] + [
        (99, 27, 98), (98, 26, 98), (98, 26, 98), (None, 26, None), (None, 0, None)]
    assert sorted(got, key=str) == sorted(want, key=str)


def plain_tiling(text, item, least):
    """Greedy string tiling as first described: compare everything in every round."""
    mt, mi, tiles = [False] * len(text), [False] * len(item), []
    while True:
        longest, best = least, []
        for j in range(len(item)):
            for i in range(len(text)):
                k = 0
                while (i + k < len(text) and j + k < len(item) and text[i + k] == item[j + k]
                       and not mt[i + k] and not mi[j + k]):
                    k += 1
                if k > longest:
                    longest, best = k, [(j, i)]
                elif k == longest:
                    best.append((j, i))
        if not best:
            return tiles
        for j, i in best:
            if not any(mt[i:i + longest]) and not any(mi[j:j + longest]):
                mt[i:i + longest] = [True] * longest
                mi[j:j + longest] = [True] * longest
                tiles.append((i, j, longest))


def test_tiling_against_plain():
    rng = np.random.default_rng(3)
    for _ in range(60):
        item = rng.integers(0, 6, int(rng.integers(3, 30))).astype(np.uint64)
        text = rng.integers(0, 6, int(rng.integers(3, 40))).astype(np.uint64)
        if rng.random() < 0.6:
            cut = len(item) // 2
            text = np.concatenate([text[:9], item[cut:], text[9:15], item[:cut]])
        starts = {j: np.array([i for i in range(len(text) - 2)
                               if (text[i:i + 3] == item[j:j + 3]).all()], np.int64)
                  for j in range(len(item) - 2)}
        starts = {j: at for j, at in starts.items() if len(at)}
        runs = string_tiling.common_runs(np.array(list(starts), np.int64), list(starts.values()), 3)
        assert string_tiling.tiles(runs, 3) == plain_tiling(
            text.tolist(), item.tolist(), 3)


def test_contamination(spark):
    rng = np.random.default_rng(5)
    items = [(k, " ".join(f"b{k}t{n}" for n in range(30))) for k in range(5)] + [
        (7, "too few words"), (8, None), (9, "")]

    def noise(n):
        return [f"n{rng.integers(1 << 40)}" for _ in range(n)]

    first, second = items[0][1].split(), items[1][1].split()
    rows = [
        (1, " ".join(noise(20) + first + noise(20))),
        (2, " ".join(noise(5) + second[15:] + noise(9) + second[:15]).upper()),   # moved around
        (3, " ".join(noise(10) + first[:10] + noise(10))),                        # a quotation
        (4, ", ".join(items[2][1].split())), (4, ", ".join(items[2][1].split())),
        (5, None), (6, ""), (None, items[3][1]), (8, "too few words"),
        (9, " ".join(noise(30_000) + items[4][1].split() + noise(10)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("item_id", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = [(1, 0), (2, 1), (4, 2), (4, 2), (9, 4), (None, 3)]
    for block_chars in (16_000_000, 200):       # in one block, and in several
        found = string_tiling.contaminated(docs, bench, block_chars=block_chars).collect()
        assert sorted(((r.doc_id, r.item_id) for r in found), key=str) == want
        kept = string_tiling.decontaminated(docs, bench, block_chars=block_chars)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == [3, 5, 6, 8]
    two = next(r for r in found if r.doc_id == 2)
    assert (two.coverage, two.n_tiles, two.longest_tile) == (1.0, 2, 15)
    assert string_tiling.contaminated(docs.where("false"), bench).count() == 0
    assert string_tiling.contaminated(docs, bench.where("false")).count() == 0
    assert string_tiling.decontaminated(docs, bench.where("false")).count() == len(rows)


def test_contamination_by_repeated_items_and_words(spark):
    passage = " ".join(f"p{n}" for n in range(12))
    rows = [(1, f"before {passage} after"), (2, "same " * 1_000_000), (3, "clean words " * 3), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.range(10_000).select(F.col("id").alias("item_id"), F.lit(passage).alias("text")).union(
        spark.createDataFrame([(20_000, "same " * 200), (20_001, "short"), (None, "same " * 100),
                               (None, "same " * 100)], "item_id bigint, text string"))
    for block_chars in (8_000_000, 300):
        found = string_tiling.contaminated(docs, bench, block_chars=block_chars).collect()
        assert sorted(r.item_id for r in found if r.doc_id == 1) == list(range(10_000))
        assert sorted(map(str, (r.item_id for r in found if r.doc_id != 1))) == ["20000", "None", "None"]
        assert {(r.item_words, r.matched_words, r.n_tiles) for r in found} == {
            (12, 12, 1), (200, 200, 1), (100, 100, 1)}
        kept = string_tiling.decontaminated(docs, bench, block_chars=block_chars)
        assert sorted(r.doc_id for r in kept.collect()) == [3, 4]


def test_blocks_of_items_are_bounded(spark):
    texts = [f"one two three four item{k} " * (k % 3 + 1) for k in range(40)]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] * 50, "item_id bigint, text string")
    blocks = list(string_tiling._blocks(string_tiling._items(bench, "item_id", "text", 5), 200))
    assert sorted(t for block, _ in blocks for _, t in block) == sorted(texts)
    assert all(sum(len(t) for _, t in block) <= 200 for block, _ in blocks)
    assert [last for _, last in blocks] == [False] * (len(blocks) - 1) + [True]


def test_contamination_against_plain(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    found = {(r.doc_id, r.item_id): r.matched_words
             for r in string_tiling.contaminated(docs, bench).collect()}

    def hashed(rows):
        h, b = hashed_words(pa.array([t for _, t in rows]), NO_ALNUM)
        return {k: h[x:y].tolist() for (k, _), x, y in zip(rows, b, b[1:])}

    items = hashed([(r.item_id, r.text) for r in bench.collect()])
    plain = {}
    for k, text in hashed([(r.doc_id, r.text) for r in docs.collect()]).items():
        grams = {tuple(text[i:i + 5]) for i in range(len(text) - 4)}
        for n, item in items.items():
            if any(tuple(item[j:j + 5]) in grams for j in range(len(item) - 4)):
                covered = sum(t[2] for t in plain_tiling(text, item, 5))
                if covered >= 0.6 * len(item):
                    plain[k, n] = covered
    assert found == plain


def plain_scores(rows, order, alpha=0.4):
    counts, out = Counter(), []
    grams = {}
    for n, (_, text) in enumerate(rows):
        w = words_of(text)
        grams[n] = Counter(tuple(w[i:i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1))
        counts.update(grams[n])
    total = sum(len(words_of(t)) for _, t in rows)
    for n, (key, text) in enumerate(rows):
        w = words_of(text)
        score = missed = 0

        def left(gram):
            return counts[gram] - grams[n][gram]

        for i in range(len(w)):
            p = (left((w[i],)) or 0.5) / max(total - len(w), 1)
            seen = left((w[i],)) > 0
            for k in range(2, min(order, i + 1) + 1):
                gram = tuple(w[i - k + 1:i + 1])
                seen = left(gram) > 0
                p = left(gram) / max(left(gram[:-1]), 1) if seen else alpha * p
            missed += not seen
            score += math.log(p)
        out.append((key, len(w), round(score, 6), missed))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_against_plain(spark, docs, order, monkeypatch):
    monkeypatch.setattr(backoff, "BLOCK_CHARS", 60_000)      # many blocks and table partitions
    monkeypatch.setattr(backoff, "TABLE_WORDS", 9_000)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [
        (9001, None), (9002, ""), (9003, "one"), (9004, "a b a b a b"), (9004, "a b a b a b"), (None, "a b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("block", F.lit(3))
    got = sorted(((r.doc_id, r.n_words, round(r.log_score, 6), r.n_backed_off)
                  for r in backoff.backoff_scores(df, order=order).collect()), key=str)
    want = sorted(plain_scores(rows, order), key=str)
    assert [(g[0], g[1], g[3]) for g in got] == [(w[0], w[1], w[3]) for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-4)
    if order == 2:
        assert backoff.backoff_scores(df.where("false")).count() == 0
        none = backoff.backoff_scores(df.where("doc_id = 9001")).first()
        assert (none.n_words, none.log_score, none.mean_log_score) == (0, 0.0, None)


@pytest.mark.parametrize("bits", [3, 13, 24, 61, 64])
def test_requests_carry_the_bits_that_the_table_does_not_know(bits):
    text = " ".join(str(k * k % 701) for k in range(3000))
    block = pa.table({"text": pa.array([text, "", "1 2 1 2"], pa.large_string())})
    announced = backoff._announced(5, block, 2, 3, bits)
    shared = [np.packbits(np.arange(len(backoff._sorted_numbers(x))) % 3 != 1).tobytes()
              for x in announced.column("leading").to_pylist()]
    told = announced.drop_columns(["leading"]).append_column("shared", pa.array(shared))
    asked = backoff._requests(block, told, 2, 3, bits)
    assert asked.num_rows == announced.num_rows
    grams = {}
    hashes = backoff.hashed_words(block.column("text").combine_chunks())
    for size in (1, 2):
        every, n = np.unique(backoff._grams(*hashes, size)[0], return_counts=True)
        grams[size] = dict(zip(every.tolist(), n.tolist()))
    for row, lead in zip(asked.to_pylist(), announced.column("leading").to_pylist()):
        kept = set(backoff._sorted_numbers(lead)[np.arange(len(backoff._sorted_numbers(lead))) % 3 != 1].tolist())
        wanted = {g: n for g, n in grams[row["size"]].items()
                  if g >> (64 - bits) in kept and backoff._part(np.array([g], np.uint64), 3)[0] == row["part"]}
        found = backoff._asked(lead, row["shared"], row["again"], row["rest"], bits)
        assert found.tolist() == sorted(wanted)
        assert backoff._count_numbers(row["counts"], len(found)).tolist() == [wanted[g] for g in found.tolist()]
        assert len(row["rest"]) <= len(found) * (64 - bits) / 8 + 1


def test_registered_backoff_counts_two_words_of_context(spark, docs):
    want = plain_scores([(r.doc_id, r.text) for r in docs.collect()], 3)
    got = {r.doc_id: (r.n_words, r.n_backed_off) for r in queries.op7(spark, SF).collect()}
    assert got == {k: (n, missed) for k, n, _, missed in want}


@pytest.mark.parametrize("count, below", [(1, 2), (3, 300), (1000, 1 << 20), (5000, (1 << 64) - 1)])
def test_sorted_hashes_travel_whole(count, below):
    x = np.unique(np.random.default_rng(7).integers(0, below, count, np.uint64))
    for some in (x, np.array([0, (1 << 64) - 1], np.uint64)):
        assert (backoff._sorted_numbers(backoff._sorted_bytes(some)) == some).all()


def test_mix_reaches_targets(spark):
    rng = np.random.default_rng(1)
    rows = [(k, "w " * int(rng.integers(1, 60)), "big" if k % 3 else f"s{k % 7}") for k in range(900)]
    rows += [(1000 + k, "x y", "tiny") for k in range(3)] + [(2000, None, None), (2001, "n u l l", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in mixing.mixture(df).collect()}
    assert len(got) == len(rows)
    source = {k: s for k, _, s in rows}
    sizes = {k: len((t or "").split()) for k, t, _ in rows}
    names = sorted({s for s in source.values() if s}) + [None]
    total = {n: sum(sizes[k] for k in sizes if source[k] == n) for n in names}
    weight = {n: k % 3 + 1 for k, n in enumerate(names)}
    clamped = set()
    while True:                                             # plain water-filling
        level = (sum(total.values()) - sum(3 * total[n] for n in clamped)) / sum(
            weight[n] for n in names if n not in clamped)
        more = {n for n in names if weight[n] * level > 3 * total[n]} - clamped
        if not more:
            break
        clamped |= more
    assert "tiny" in clamped
    for n in names:
        target = 3 * total[n] if n in clamped else weight[n] * level
        mine = [got[k] for k in got if source[k] == n]
        assert all(math.isclose(r.target, target) and r.source_size == total[n] for r in mine)
        taken = sum(r.size * r.repeats for r in mine)
        assert abs(taken - target) <= max(2, 0.02 * target)
        epochs = {r.repeats for r in mine}
        assert max(epochs) - min(epochs) <= 1 and max(epochs) <= 3
    again = {r.doc_id: r.repeats for r in mixing.mixture(df.repartition(7)).collect()}
    assert again == {k: r.repeats for k, r in got.items()}


def test_mix_odd_rows(spark):
    rows = [(None, "a b c", "s", 1), (None, None, "s", 2), (3, "", None, 3), (4, "a b", "t", 4),
            (4, "a b", "t", 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, target int")
    assert mixing.mixture(df).count() == len(rows)
    mix = mixing.mixed_rows(df)
    assert mix.columns == [*df.columns, "repetition"] and mix.count() > 0
    assert mixing.mixture(df.where("false")).count() == 0
    assert mixing.mixed_rows(df.where("false")).count() == 0
    empty = mixing.mixture(df.where("doc_id = 3")).first()
    assert (empty.size, empty.target, empty.repeats) == (0, 0.0, 0)


def test_pipeline(spark, docs):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "near_dedup", "decontamination", "secret_scan", "source_mix"]
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF).cache()
        assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    classes = plain_components([(k, t) for k, t in rows if any(c.isalpha() for c in t or "")], 5)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    dirty = {r.doc_id for r in string_tiling.contaminated(docs, bench).collect()}
    assert ids == {k for k, (_, root) in classes.items() if k == root} - dirty
    assert not kept.where("text rlike '[0-9a-f]{24}'").count()
    mix = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in mix} <= ids and len(mix) > 0
    assert len({(r.doc_id, r.repetition) for r in mix}) == len(mix)


def test_language_stage_drops_texts_of_no_learned_language(spark, docs):
    rows = docs.collect()
    known = [r.doc_id for r in rows if any(c.isalpha() for c in r.text or "")]
    planted = ["\u65e5\u672c\u8a9e\u306e\u6587\u7ae0\u3067\u3059\u3002\u4eca\u65e5\u306f\u5bd2\u3044 " * 5,
               "\u03b5\u03bb\u03bb\u03b7\u03bd\u03b9\u03ba\u03cc \u03ba\u03b5\u03af\u03bc\u03b5\u03bd\u03bf " * 5,
               "{}[]()<>;; =+ 12 " * 30 + "a", "zzqx kkvq xwzk " * 9]
    more = spark.createDataFrame([(10_000 + k, t, None, "s", len(t)) for k, t in enumerate(planted)],
                                 docs.schema)
    kept = corpus_pipeline.language_id(spark, docs.union(more), SF)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(known)


def test_language_stage_without_labels_keeps_texts_with_letters(spark, docs):
    none = docs.withColumn("lang", F.lit(None).cast("string")).limit(20)
    with_letters = sum(any(c.isalpha() for c in r.text or "") for r in none.collect())
    assert corpus_pipeline.language_id(spark, none, SF).count() == with_letters > 0
