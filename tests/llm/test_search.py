"""Ranked search, shared passages and collocations against plain versions on small texts."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import collocations, norm_buckets, shared_passages

ROW = "doc_id bigint, text string, lang string, n int, score string, word string, key string"
WORDS = [f"{a}{b}" for a in ("ka", "Lo", "mi", "é", "su") for b in ("n", "r", "T", "na", "x9")]


def documents(spark, texts, langs=None):
    """Texts with ids from 0 and columns whose names the operators use themselves."""
    langs = langs or ["en"] * len(texts)
    return spark.createDataFrame(
        [(k, t, lang, 7, "x", "y", "z") for k, (t, lang) in enumerate(zip(texts, langs))], ROW)


def some_texts(seed, n, words=40):
    draw = random.Random(seed)
    texts = [" ".join(draw.choices(WORDS, k=draw.randrange(1, words))) for _ in range(n)]
    return [*texts, None, "", " \n\t", "... !?", "KAN kan. Kan, kan", texts[0], texts[0]]


# ---------------------------------------------------------------- ranked search


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain_ranks(rows, items, k):
    bags = [(i, Counter(terms(t))) for i, t in rows]
    n_docs, length = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, bag in bags:
            score = 0
            for t in set(terms(text)) & set(bag):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 10 + 90 * sum(bag.values()) * n_docs // length
                score += w * (10**9 * bag[t] // (1000 * bag[t] + 8 * m))
            if score > 0:
                scored.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("bucket, block", [(1024, 4_000_000), (3, 60)])
def test_ranks_equal_plain_scores(spark, monkeypatch, bucket, block):
    monkeypatch.setattr(norm_buckets, "BUCKET", bucket)
    monkeypatch.setattr(norm_buckets, "BLOCK_CHARS", block)
    monkeypatch.setattr(norm_buckets, "FOCUS", 2)
    texts = some_texts(1, 60)
    items = [(1, "kan LOR mina"), (2, texts[3]), (3, ""), (4, None), (5, "unheard"), (6, "kan LOR mina"),
             (6, "sux9 sux9 én")]
    found = norm_buckets.ranked(documents(spark, texts),
                                spark.createDataFrame(items, "item_id bigint, text string"), k=5)
    assert sorted(map(tuple, found.collect())) == plain_ranks(enumerate(texts), items, 5)


def test_ranks_of_repeated_and_text_ids(spark):
    docs = spark.createDataFrame([("b", "x1 y"), ("a", "x1 y"), (None, "x1 y"), ("b", "x1 y"), ("c", "z")],
                                 "doc_id string, text string")
    items = spark.createDataFrame([(1, "x1")], "item_id int, text string")
    rows = norm_buckets.ranked(docs, items, k=3).orderBy("rank").collect()
    assert [r.doc_id for r in rows] == [None, "a", "b"] and len({r.score for r in rows}) == 1


def test_ranks_of_empty_tables(spark):
    docs, items = documents(spark, ["a b"]), spark.createDataFrame([(1, "a")], "item_id int, text string")
    assert norm_buckets.ranked(docs.limit(0), items).count() == 0
    assert norm_buckets.ranked(docs, items.limit(0)).count() == 0


def test_bounds_rule_out_short_vectors(spark):
    """A bucket whose longest vector cannot reach the threshold is not looked into."""
    import pyarrow as pa

    queries = norm_buckets.Queries(["aa bb"])
    queries.weigh(10, queries.vocabulary.astype("int64") * 0 + 1)
    best = norm_buckets._Best(1, 10**12)
    bucket = pa.RecordBatch.from_arrays(
        [pa.array([1]), pa.array([10.0]), pa.array([[0]], pa.list_(pa.int32())), pa.array([[1]])],
        ["doc_id", "norm", "terms", "impacts"])
    norm_buckets._search_bucket(bucket, queries, [best])
    assert best.scores is None


# ---------------------------------------------------------------- shared passages


def plain_passages(rows, length):
    windows = {}
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - length + 1):
            if i is not None:
                at = tuple(w[k:k + length])
                windows[at] = min(i, windows.get(at, i))
    out = []
    for i, w in split:
        gone = {j for k in range(len(w) - length + 1) if i is not None
                and windows[tuple(w[k:k + length])] < i for j in range(k, k + length)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def passages_of(docs, length):
    whole, changed = shared_passages.without_shared_passages(docs, length)
    rows = [(r.doc_id, r.n_words, 0, r.digest) for r in whole.collect()]
    rows += [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest())
             for r in changed.collect()]
    return sorted(rows, key=str)


def passage_texts(seed):
    draw = random.Random(seed)
    fresh = lambda n: " ".join(f"w{draw.randrange(10**6)}" for _ in range(n))
    common, other = fresh(30), fresh(25)
    texts = [f"{fresh(draw.randrange(20))} {common} {fresh(draw.randrange(20))}" for _ in range(12)]
    texts += [f"{fresh(5)} {other} {common}", f"{common} {other}", other, f"{other}\n{other}", common.upper()]
    # a long repeat of one word, near copies, texts at the edge of the length
    long = fresh(200).split()
    texts += ["same " * 70, "same " * 60, " ".join(long), " ".join(long[:90] + ["new"] + long[90:])]
    texts += [" ".join(long[:19]), " ".join(long[:20]), " ".join(long[1:21]), None, "", "  "]
    return texts


@pytest.mark.parametrize("contexts, shard", [(500, 2000), (1, 3)])
def test_passages_equal_plain_version(spark, monkeypatch, contexts, shard):
    monkeypatch.setattr(shared_passages, "CONTEXTS", contexts)
    monkeypatch.setattr(shared_passages, "SHARD", shard)
    texts = passage_texts(3)
    assert passages_of(documents(spark, texts), 20) == plain_passages(list(enumerate(texts)), 20)


def test_passages_of_repeated_and_null_ids(spark):
    text = " ".join(f"v{k}" for k in range(30))
    rows = [(5, text), (5, text), (5, text + " more"), (None, text), (9, "x " + text), (2, "short")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert passages_of(docs, 20) == plain_passages(rows, 20)
    assert passages_of(docs.limit(0), 20) == []


def test_automaton_finds_first_text_of_every_window():
    draw = random.Random(4)
    texts = [[draw.randrange(3) for _ in range(40)] for _ in range(12)]
    automaton = shared_passages.Automaton()
    for rank, words in enumerate(texts):
        automaton.add(words, rank)
    for words in [*texts, [draw.randrange(4) for _ in range(60)]]:
        for at, rank in enumerate(automaton.first_ranks(words, 5)):
            window = words[at:at + 5]
            holders = [r for r, t in enumerate(texts)
                       if any(t[k:k + 5] == window for k in range(len(t) - 4))]
            assert rank == min(holders, default=-1)


# ---------------------------------------------------------------- collocations


def plain_collocations(rows, least, share, top, size=3):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for k in range(1, size + 1):
                counts.update((lang or "und", *words[i:i + k]) for i in range(len(words) - k + 1))
    found = {}
    for gram, a in counts.items():
        if a >= least and len(gram) > 2:
            lang, words = gram[0], gram[1:]
            cuts = []
            for k in range(1, len(words)):
                left, right = counts[lang, *words[:k]], counts[lang, *words[k:]]
                cuts.append((10**6 * a * a // (left * right), k, left, right))
            found[gram] = (a, *min(cuts))
    out = []
    for lang in totals:
        named = []
        for gram, (a, score, _, left, right) in found.items():
            inside = [other for other in found if other[0] == lang and len(other) > len(gram)
                      and any(other[i:i + len(gram) - 1] == gram[1:] for i in range(1, len(other)))
                      and 100 * found[other][0] >= share * a]
            if gram[0] == lang and not inside:
                named.append((-score, -a, " ".join(gram[1:]).encode(), left, right))
        out += [(lang, r + 1, p.decode(), -a, x, y, totals[lang], -s)
                for r, (s, a, p, x, y) in enumerate(sorted(named)[:top])]
    return sorted(out)


@pytest.mark.parametrize("size, dictionary", [(3, 2_000_000), (3, 5), (4, 2_000_000), (2, 2_000_000)])
def test_collocations_equal_plain_counts(spark, monkeypatch, size, dictionary):
    monkeypatch.setattr(collocations, "DICTIONARY", dictionary)
    texts = some_texts(7, 120) + ["Open the-gate now, open the-gate now. OPEN the-gate\x0bnow open"] * 5
    langs = [("en", "fr", None)[k % 3] for k in range(len(texts))]
    found = collocations.collocations(documents(spark, texts, langs), size=size, least=4, top=30)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    expected = plain_collocations(list(zip(texts, langs)), 4, 50, 30, size)
    assert sorted(map(tuple, found.collect())) == expected and expected


def test_collocations_of_empty_tables_and_rare_words(spark):
    assert collocations.collocations(documents(spark, ["a b c", None])).count() == 0
    assert collocations.collocations(documents(spark, ["a"]).limit(0)).count() == 0


def test_collocations_do_not_depend_on_partitions(spark):
    texts = some_texts(9, 80) * 2
    docs = documents(spark, texts)
    few, many = (sorted(map(tuple, collocations.collocations(d, least=5).collect()))
                 for d in (docs.coalesce(1), docs.repartition(7, F.rand(1))))
    assert few == many and few
