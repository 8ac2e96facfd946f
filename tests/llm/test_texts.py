"""Operators on single texts: plain versions, odd inputs, empty tables."""

from __future__ import annotations

import hashlib
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import (
    byte_network, factor_machine, license_scan, main_text, quality_rules, queries, secret_spans)
from ledgerlens.llm.text import gram_hashes, hashed_words

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None, "a", 1), (2, "", "b", 2), (3, " \n\t ", None, 3), (4, "Ünïcode wörds: ß!", "a", 4),
    (5, "word " * 60_000, "a", 5), (6, "same text here", "b", 6), (6, "same text here", "b", 6),
    (None, "no id, but secret = 'hunter2hunter2'", "a", 7), (8, "12345 !!! ###", "a", 8),
]
SCHEMA = "doc_id bigint, text string, source string, spans bigint"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, long and repeated texts; a column named as an output; languages unknown."""
    return spark.createDataFrame(ODD, SCHEMA).withColumn("lang", F.lit(None).cast("string")) \
        .withColumn("score", F.lit("mine")).withColumn("n_chars", F.lit(None).cast("bigint"))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_word_hashes_agree_with_splitting():
    texts = ["a B  c\n", None, "", "  x\x0by ", "ünï a", "a", "b\ta\r\nA"] * 3
    hashes, bounds = hashed_words(pa.array(texts)[2:])
    names: dict[bytes, int] = {}
    for text, a, b in zip(texts[2:], bounds, bounds[1:]):
        words = (text or "").encode().lower().split()
        assert len(words) == b - a
        for word, value in zip(words, hashes[a:b].tolist()):
            assert names.setdefault(word, value) == value
    assert len(set(names.values())) == len(names)
    assert len(gram_hashes(hashes[:2], 3)) == 0


def test_licenses_against_plain_words(docs):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = by_id(license_scan.license_scan(docs))
    base = {("mit", "license"): "mit", ("apache", "license"): "apache",
            ("general", "public", "license"): "gpl"}
    for row in docs.collect():
        text = re.sub("[A-Z]", lambda m: m[0].lower(), row.text or "")
        words = word.findall(text)
        places = sorted((k, label) for k in range(len(words)) for phrase, label in base.items()
                        if tuple(words[k:k + len(phrase)]) == phrase)
        assert got[row.doc_id].n_words == len(words)
        assert sorted((p.word, p.label) for p in got[row.doc_id].places) == places


def plain_detections(text):
    """All rules on the whole text, without keywords; suppression by comparing all pairs."""
    found = sorted(((m.start(), m.end(), r) for r in license_scan.rules()
                    for m in r.pattern.finditer(text)),
                   key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].label))
    kept = []
    for d in found:
        if not any(k[0] <= d[0] and d[1] <= k[1] for k in kept):
            kept.append(d)
    return sorted(((s, e, r.label) for s, e, r in kept))


@pytest.mark.parametrize("text", [
    "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: MIT",
    "the GNU General Public License, version 3 or the MIT License", "CC BY-NC-SA 4.0 and CC0",
    "https://creativecommons.org/licenses/by/4.0/ all rights reserved", "mit der Apache", "",
    "Permission is hereby granted, free of charge,\nto any person obtaining a copy",
    "licensed under the mozilla public license 2.0, boost software license - version 1.0",
])
def test_license_rules_against_plain(text):
    text = text.lower()
    assert [(s, e, r.label) for s, e, r in license_scan.detections(text)] == plain_detections(text)


def test_license_rule_examples():
    def labels(text):
        return {r.label for _, _, r in license_scan.detections(text.lower())}

    assert len(license_scan.rules()) > 300
    assert labels("Licensed under the Apache License, Version 2.0.") == {"Apache-2.0"}
    assert labels("This work is licensed under CC BY-NC 4.0.") == {"CC-BY-NC-4.0"}
    assert labels("Released under the MIT License.") == {"MIT"}
    assert labels("a limited edition of the day") == set()


def test_quality_cascade_does_not_depend_on_order(docs):
    names = [r.name for r in quality_rules.RULES]
    one = by_id(quality_rules.quality_cascade(docs, order=names))
    two = by_id(quality_rules.quality_cascade(docs, order=names[::-1]))
    assert {k: v.kept for k, v in one.items()} == {k: v.kept for k, v in two.items()}
    for row in docs.collect():
        features = quality_rules.Features(row.text)
        assert one[row.doc_id].kept == (not any(r.rejects(features) for r in quality_rules.RULES))


def test_quality_counts():
    f = quality_rules.Features("a b c d e x a b c d e\nsame\n \nsame\n|*")
    assert (f.n_words, f.n_repeat_words, f.n_dup_lines, f.n_symbols) == (14, 10, 1, 2)
    assert quality_rules.Features("a a a a a a").n_repeat_words == 6
    assert quality_rules.Features("a a a a a").n_repeat_words == 0
    assert quality_rules.Features(None).n_words == 0
    # a no-break space does not end a word; signs below U+00C0 are no letters, letters above are
    assert quality_rules.Features("a\xa0b \xb2\xbf\x85 \xe9 \u4e2d 1").n_letter_words == 3


def test_cascade_order_puts_cheap_rejections_first():
    sample = ["!! " * 50] * 20 + ["fine words in a row " * 5]
    order = quality_rules.cascade_order(sample)
    assert sorted(order) == sorted(r.name for r in quality_rules.RULES)
    rejecting = {r.name for r in quality_rules.RULES if r.rejects(quality_rules.Features(sample[0]))}
    assert order[0] in rejecting
    assert quality_rules.cascade_order([]) is not None


def test_language_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = by_id(byte_network.identify(docs))
    held = [r for r in docs.collect() if r.lang and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = sum(got[r.doc_id].lang_pred == r.lang for r in held)
    assert right / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


@pytest.mark.parametrize("text, letters", [
    ("12 \u00b2 \u2164 \u0664 !_", False), ("1 \u00e9", True), ("\u6f22", True), ("42x", True), ("", False)])
def test_letters_of_any_script_count_and_numerals_do_not(text, letters):
    assert byte_network.has_letter(text) == letters


def test_network_tables_agree_with_network():
    net = byte_network.train([b"aaa bbb " * 20, b"xyz zyx " * 20], ["a", "z"], steps=30, window=32)
    raw = "aaa xyz über 42 " * 7
    x = byte_network.windows_of(raw.encode(), 32)
    embedded, pooled = net.embedding[x], []
    for w, kernel in net.filters.items():
        span = x.shape[1] - w + 1
        pooled.append(sum(embedded[:, t:t + span] @ kernel[t] for t in range(w)).max(axis=1)
                      + net.biases[w])
    plain = byte_network._softmax(
        np.maximum(np.concatenate(pooled, axis=1), 0) @ net.dense + net.dense_bias)
    assert np.allclose(byte_network.Scorer(net).probabilities(x), plain, atol=1e-4)
    langs, _ = byte_network.Scorer(net).predict([b"aaa bbb aaa", b"zyx xyz"])
    assert langs.tolist() == [0, 1]


def test_classifier_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = by_id(factor_machine.quality_scores(docs, labels))
    held = [r for r in labels.collect()
            if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = sum((got[r.doc_id].score >= 0.3) == bool(r.quality) for r in held if r.doc_id in got)
    assert right / len(held) > 0.9


def test_factor_identity():
    rng = np.random.default_rng(0)
    n = factor_machine.BUCKETS + 3
    m = factor_machine.Machine(0.1, rng.normal(size=n), rng.normal(size=(n, 4)), np.zeros(3), np.ones(3))
    bucket, value = np.array([5, 9, 5, 77]), rng.normal(size=4)
    bounds, dense = np.array([0, 2, 4, 4]), rng.normal(size=(3, 3))
    got = factor_machine.scores(m, bucket, value, bounds, dense)
    for k in range(3):
        index = [*bucket[bounds[k]:bounds[k + 1]], *range(factor_machine.BUCKETS, n)]
        x = [*value[bounds[k]:bounds[k + 1]], *dense[k]]
        z = m.bias + sum(m.linear[i] * v for i, v in zip(index, x)) + sum(
            m.factors[index[a]] @ m.factors[index[b]] * x[a] * x[b]
            for a in range(len(x)) for b in range(a + 1, len(x)))
        assert np.isclose(got[k], 1 / (1 + np.exp(-z)))


def test_base_secrets_against_plain(spark, docs):
    got = by_id(queries.op9(spark, SF))
    patterns = (
        ("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"""
         r"""[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
        ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+"))
    for row in docs.collect():
        spans = []
        for n, (kind, pattern) in enumerate(patterns):
            for m in re.finditer(pattern, row.text or ""):
                if len(m[2] if kind == "assign" else m[0]) >= (6, 20, 24)[n]:
                    spans.append((m.start(), n, f"{kind}:{m.start()}:{m.end()}"))
        line = ",".join(s for _, _, s in sorted(spans))
        assert got[row.doc_id].base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert got[row.doc_id].n_assign == line.count("assign")
        assert set(line.split(",")) - {""} <= set(got[row.doc_id].spans.split(","))


def plain_bits(value):
    """Cheapest segmentation by trying every way to cut a short value."""
    from functools import lru_cache
    from math import log2

    per = log2(secret_spans.alphabet(value))
    lower = value.lower()
    plain = lower.translate(secret_spans.PLAIN)

    def segment(i, j):
        part, options = value[i:j], [per * (j - i)]
        for form, extra in ((lower, 0), (plain, 1)):
            if j - i >= 3 and form[i:j] in secret_spans.RANK:
                options.append(log2(secret_spans.RANK[form[i:j]]) + extra
                               + (0 if part == lower[i:j] else 1))
        date = secret_spans.DATE.match(value, i)
        if date and date.end() == j:
            options.append(log2(365 * 120) if j - i > 4 else log2(120))
        if j - i >= 3 and all(lower[k:k + 2] in secret_spans.WALK_STEPS for k in range(i, j - 1)):
            options.append(secret_spans.WALK_BITS + log2(j - i))
        for unit in range(1, min(16, (j - i) // 2) + 1):
            if j - i >= 3 and (j - i) % unit == 0 and part == part[:unit] * ((j - i) // unit):
                options.append(unit * per + log2((j - i) // unit))
        return options

    @lru_cache(None)
    def best(i):
        if i == len(value):
            return 0.0
        found = []
        for j in range(i + 1, len(value) + 1):
            brute, *others = segment(i, j)
            joint = secret_spans.SEGMENT_BITS if i else 0.0
            found += [o + joint + best(j) for o in others]
            if j == i + 1:
                found.append(brute + best(j))
        return min(found)

    return best(0)


@pytest.mark.parametrize("value", [
    "password1", "Passw0rd2020", "qwertyuiop", "aaaaaaaa", "abcabcabc", "x9$Kq!27Lm", "19991231",
    "changeme", "admin:letmein", "zxcvbn12345", "deadbeef42", "ß1Ñ"])
def test_guess_bits_against_all_cuts(value):
    assert secret_spans.guess_bits(value) == pytest.approx(plain_bits(value))


def test_guess_bits_of_long_values():
    bits, rng = secret_spans.guess_bits, np.random.default_rng(9)
    assert bits("x" * 800) == pytest.approx(np.log2(26) + np.log2(800))
    assert bits("xy7" * 4000) == pytest.approx(3 * np.log2(36) + np.log2(4000))
    assert bits("ab" * 500) == pytest.approx(secret_spans.WALK_BITS + np.log2(1000))
    assert secret_spans.all_spans("password is " + "x" * 800, 36) == []
    for _ in range(150):
        value = "".join(rng.choice(list("aab1q"), int(rng.integers(1, 40))))
        assert bits(value) == pytest.approx(plain_bits(value))


@pytest.mark.parametrize("text", [
    "credentials: passphrase: Xk9#qL2!vT8z", "auth: passcode: Xk9#qL2!vT8z",
    "secret: token= auth: passphrase: Xk9#qL2!vT8z", "password = default_token: Xk9#qL2!vT8z"])
def test_labels_as_values_hide_no_secret(text):
    spans = [s for s in secret_spans.all_spans(text, 36) if s[2] == "guess"]
    assert text[spans[-1][0]:spans[-1][1]] == "Xk9#qL2!vT8z"


@pytest.mark.parametrize("label", ["auth:", "key=", "pass:", "auth:key=pass:", "secret=", "api_key=token:"])
def test_unspaced_labels_take_linear_time(label):
    start = time.perf_counter()
    secret_spans.guessed_spans(label * (100_000 // len(label)), 36)
    assert time.perf_counter() - start < 6          # quadratic: half an hour


def test_label_at_the_end_of_a_long_value_is_found():
    text = "token: " + "ab" * 40 + "/auth: Xk9#qL2!vT8z"
    spans = secret_spans.guessed_spans(text, 36)
    assert text[spans[-1][0]:spans[-1][1]] == "Xk9#qL2!vT8z"


def test_labels_as_values_end():
    assert secret_spans.guessed_spans("token: " * 2000 + "=" * 3000, 36) == []


def test_guess_cost_orders_values():
    bits = secret_spans.guess_bits
    assert bits("password") < bits("qwerty2020") < bits("kX9#vQ2pLw7z")
    assert bits("") == 0
    assert bits("a" * 10_000) < bits("0b7e" + "f" * 10) * 200
    spans = secret_spans.all_spans('passphrase: "kX9#vQ2pLw7z" and password is changeme', 36)
    assert [s[2] for s in spans] == ["guess"]
    assert secret_spans.redacted("a token=abcdef12 b", [(2, 16, "assign")], "[x]") == "a [x] b"


def test_main_text_rules():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body>
      <nav><ul><li><a href=/x>Home page of the site</a></li></ul></nav><div class="ad">Buy the best!</div>
      <article><h1>Title &amp; more</h1><p>One <b>bold</b>
      line.<br><p>Sh.<p>It&nbsp;is the end &lt;of&gt; it.</p>
      <aside>By the way</aside><div class="comment-list"><p>I agree with the author of this.</p></div>
      </article><footer>&copy; me</footer></body></html>"""
    assert main_text.extract(page) == "Title & more\nOne bold line.\nSh.\nIt is the end <of> it."
    assert main_text.extract(None) == main_text.extract("") == main_text.extract("<p>") == ""
    loose = ("<div>" + "The cat is on the mat and it was there for a long time with the dog. " * 3
             + "</div><div>Short.</div><ul><li><a href=x>" + "link to a page " * 9 + "</a></li></ul>")
    assert main_text.extract(loose).endswith("Short.")
    assert "link" not in main_text.extract(loose)
    assert main_text.extract("<article><p>cut off &am") == "cut off &am"


@pytest.mark.parametrize("wrapper", [
    'style="overflow:hidden"', 'title="the hidden door"', 'data-hidden="false"', 'class="overflow-hidden"',
    "data-x='class=nav hidden' id=a", 'class="hidden-xs"'])
def test_attributes_that_hide_nothing(wrapper):
    text = "The cat is on the mat and it was there for a long time with the dog."
    assert main_text.extract(f"<div {wrapper}><article><p>{text}</p></article></div>") == text


@pytest.mark.parametrize("attribute", [
    "hidden", "HIDDEN=''", 'style="color:red; display : none"', "class='a visually-hidden'", "class=hidden"])
def test_attributes_that_hide(attribute):
    page = f"<article><p>Shown is the first one.</p><div {attribute}><p>Not this.</p></div></article>"
    assert main_text.extract(page) == "Shown is the first one."


@pytest.mark.parametrize("raw", [
    "<svg class=i />", "<math/>", "<svg><use href='#a'/></svg>", "<svg><svg>x</svg>y</svg>",
    "<object><object>x</object>y</object>", "<svg><svg/>y</svg>", "<svg><style>a</svg>b</style>y</svg>",
    "<canvas>", "<object data=x>", "<svg>", "<template>y<template>x</template>z</template>",
    "<script>var a = '<svg>'</script>", "</svg>", "<iframe/>x</iframe>"])
def test_raw_elements_leave_the_text_around_them(raw):
    page = f"<p>{raw}</p><article><p>One is the first {raw}of all.</p><p>Two is last.</p></article>"
    assert main_text.extract(page) == "One is the first of all.\nTwo is last."


@pytest.mark.parametrize("raw", ["<script>", "<template>", "<style>"])
def test_unclosed_elements_that_are_never_shown(raw):
    assert main_text.extract(f"<article><p>One is the first.</p>{raw}<p>x</p></article>") == "One is the first."


LONG = "The cat is on the mat and it was there for a long time with the dog."


@pytest.mark.parametrize("name, cut", [
    ("ad", True), ("post-comments", True), ("entry-comments", True), ("content-sidebar", True),
    ("main-nav", True), ("mainNav", True), ("post-comments-area", True), ("comment-body", True),
    ("site_header", True), ("comment-count", True), ("sidebar left", True), ("story-promo-box", True),
    ("no-sidebar", False), ("with-comments", False), ("article-header", False),
    ("entry-header-wrapper", False), ("post-content", False), ("main", False), ("mainContent", False),
    ("list-group", False), ("top", False), ("shadow", False), ("h-entry", False)])
def test_names_of_furniture(name, cut):
    page = f"<article><p>{LONG}</p><div class='{name}'><p>{LONG} Again.</p></div></article>"
    assert main_text.extract(page) == LONG + ("" if cut else f"\n{LONG} Again.")


@pytest.mark.parametrize("before, kept", [
    ("<header><h1>Site</h1><p>{0}</p></header>", False),
    ("<div id=page><header class=top><p>{0}</p></header></div>", False),
    ("<header class=entry-header><p>{0}</p></header>", True),
    ("<div class='blog-post'><header><p>{0}</p></header></div>", True),
    ("<section><header><p>{0}</p></header></section>", True)])
def test_site_headers_go_and_headings_of_articles_stay(before, kept):
    title = "It is a heading that says what the text below is about, and how."
    page = f"<body>{before.format(title)}<div><p>{LONG}</p><p>{LONG}</p></div></body>"
    assert main_text.extract(page) == "\n".join([title] * kept + [LONG] * 2)
    inside = f"<article><header><h1>{title}</h1></header><p>{LONG}</p></article>"
    assert main_text.extract(inside) == f"{title}\n{LONG}"


def test_a_card_does_not_stand_for_the_text_around_it():
    body = "".join(f"<p>{LONG} {k}.</p>" for k in range(5))
    card = "<article><h3>More</h3><p>This is the start of the other story, which you can read on.</p></article>"
    plain = "\n".join(f"{LONG} {k}." for k in range(5))
    assert main_text.extract(f"<div>{body}</div>{card}") == plain
    assert main_text.extract(f"{card}<div>{body}</div>{card}") == plain
    assert main_text.extract(f"<article>{body}</article><div><p>{LONG}</p></div>") == plain
    # what stands in <main> is the page's text, however short
    assert main_text.extract(f"<main><p>{LONG}</p></main><div>{body}</div>") == LONG
    assert main_text.extract(f"<main class=sidebar-left><p>{LONG}</p></main>") == LONG


def plain_main_text(blocks):
    """Two passes as the docstring says them, by looking at every pair of blocks."""
    def first(b):
        words = b.text.lower().split()
        stops = [w for w in words if w.strip(".,;:!?()\"'") in main_text.STOP_WORDS]
        if b.cut:
            return "cut"
        if 2 * b.linked > len(b.text):
            return "short" if b.main else "bad"
        if len(b.text) < 60:
            return "short"
        return "good" if b.main or 20 * len(stops) >= len(words) else "bad"

    labels, out = [first(b) for b in blocks], []
    for k, b in enumerate(blocks):
        own = [j for j, o in enumerate(blocks) if o.main == b.main and labels[j] != "cut"]
        near = [(abs(own.index(j) - own.index(k)), j) for j in own if labels[j] != "short"] \
            if labels[k] == "short" else []
        out.append(labels[k] if labels[k] != "short" else labels[min(near)[1]] if near
                   else "good" if b.main else "bad")
    size = {side: sum(len(b.text) for b, x in zip(blocks, out) if x == "good" and b.main == side)
            for side in (True, False)}
    sole = any(b.sole and x == "good" for b, x in zip(blocks, out))
    side = size[True] > 0 and (sole or size[True] >= size[False])
    return "\n".join(b.text for b, x in zip(blocks, out) if x == "good" and b.main == side)


def test_both_passes_against_all_pairs(spark):
    draw = np.random.default_rng(7)
    pieces = ["Short.", LONG, "Zxq vbn mkl " * 8, "<a href=x>" + "read of it and on " * 5 + "</a>",
              "See <a href=x>it</a>", ""]
    tags = ["p", "p", "p", "div class=ad", "article", "article", "section", "main"]
    pages = []
    for n in range(300):
        page = ""
        for _ in range(draw.integers(1, 9)):
            tag = tags[draw.integers(len(tags) - (n % 2))]
            body = "".join(f"<p>{pieces[draw.integers(len(pieces))]}</p>" for _ in range(draw.integers(1, 5)))
            page += f"<{tag}>{body}</{tag.split()[0]}>"
        pages.append((n, "u", page))
    pages += [(None, None, None), (5, "again", ""), (7, "u", pages[7][2]), (7, "u", pages[7][2])]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("text", F.lit("mine"))
    got = main_text.main_text(df).collect()
    assert sorted((str(r.page_id), str(r.url), r.text) for r in got) == sorted(
        (str(i), str(u), plain_main_text(main_text.blocks_of(h or ""))) for i, u, h in pages)
    assert len({r.text for r in got}) > 100


def test_main_text_keeps_whole_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in main_text.main_text(pages).collect()}
    import html
    for row in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|$)", row.html or "", re.S)
        blocks = re.split(r"</?(?:p|h1)>", article[1] if article else "")
        plain = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*(>|$)", " ", b))).strip() for b in blocks)
        assert got[row.page_id] == "\n".join(b for b in plain if b)


def test_odd_texts(spark, odd):
    scan = license_scan.license_scan(odd).collect()
    assert len(scan) == len(ODD) and next(r for r in scan if r.doc_id == 1).n_words == 0
    cascade = quality_rules.quality_cascade(odd, counts=True).collect()
    assert sum(r.doc_id == 6 for r in cascade) == 2
    assert not next(r for r in cascade if r.doc_id == 1).kept
    lang = byte_network.identify(odd).collect()
    assert {r.lang_pred for r in lang} == {"und"}          # no labels to learn from
    assert byte_network.recognised(odd).count() == 0
    spans = secret_spans.secret_spans(odd).collect()
    assert [s.kind for s in next(r for r in spans if r.doc_id is None).spans] == ["assign", "guess"]
    clean = secret_spans.redact(odd)
    assert clean.columns == odd.columns and clean.count() == len(ODD)
    assert next(r for r in clean.collect() if r.doc_id is None).text == "no id, but [secret]'"
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1)], "doc_id bigint, quality int")
    scored = factor_machine.quality_scores(odd, labels).collect()
    assert len(scored) == len(ODD) and all(0 <= r.score <= 1 for r in scored)


def test_empty_tables(spark, odd):
    none = odd.where("false")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    for df in (license_scan.license_scan(none), quality_rules.quality_cascade(none),
               byte_network.identify(none), byte_network.recognised(none),
               secret_spans.secret_spans(none), secret_spans.redact(none),
               factor_machine.quality_scores(none, labels), main_text.main_text(pages)):
        assert df.count() == 0
