"""Quality rules as a short-circuit cascade, ordered by what a sample says of cost and selectivity.

A rule looks at lazily computed features of a text and says whether it rejects the text. The first
rejection ends the cascade, so the order sets the cost and never the verdict. The order is greedy:
next comes the rule with the most rejections of what is left of the sample for its measured time.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame

from .text import gram_hashes, over_arrow

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]")
# letters of ASCII, and the first bytes in UTF-8 of all characters from U+00C0 on
LETTERS = re.compile(rb"[A-Za-z\xC3-\xF4]")
WINDOW = 5


class Features:
    """What rules look at; each is computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode().split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [line for line in self.text.split("\n") if line.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in five-word windows that stand in the text twice or more."""
        if self.n_words <= WINDOW:
            return 0
        hashes = np.fromiter(map(hash, self.words), np.int64, self.n_words)
        grams = gram_hashes(hashes.view(np.uint64), WINDOW)
        ordered = np.sort(grams)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(twice):
            return 0
        # equal windows have equal hashes; the windows themselves decide
        at = np.flatnonzero(np.isin(grams, twice)).tolist()
        windows = [tuple(self.words[p:p + WINDOW]) for p in at]
        counts, covered = Counter(windows), np.zeros(self.n_words, bool)
        for p, window in zip(at, windows):
            if counts[window] > 1:
                covered[p:p + WINDOW] = True
        return int(covered.sum())

    @cached_property
    def n_capitals(self) -> int:
        return len(CAPITALS.findall(self.text))

    @cached_property
    def n_shouts(self) -> int:
        return sum(b"!!" in w for w in self.words) if "!!" in self.text else 0

    @cached_property
    def n_letter_words(self) -> int:
        return sum(LETTERS.search(w) is not None for w in self.words)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Features], bool]


#: The two rules that always apply.
BASE_RULES = (
    Rule("few_words", lambda f: f.n_words < 10),
    Rule("repetition", lambda f: 100 * f.n_repeat_words > 20 * f.n_words),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", lambda f: 10 * f.n_symbols > f.n_words),
    Rule("duplicate_lines", lambda f: 100 * f.n_dup_lines > 30 * len(f.lines)),
    Rule("word_length", lambda f: not 2 * f.n_words <= f.word_chars <= 15 * f.n_words),
    Rule("capitals", lambda f: 100 * f.n_capitals > 30 * f.word_chars),
    Rule("shouting", lambda f: 10 * f.n_shouts > f.n_words),
    Rule("letters", lambda f: 100 * f.n_letter_words < 70 * f.n_words),
)


def cascade_order(sample: Sequence[str | None], rules: Sequence[Rule] = RULES) -> list[str]:
    """Names of the rules, by rejections of what is left of the sample for the time they take."""
    cost, rejected = {}, {}
    for rule in rules:
        start = time.perf_counter()
        rejected[rule.name] = {k for k, text in enumerate(sample) if rule.rejects(Features(text))}
        cost[rule.name] = max(time.perf_counter() - start, 1e-9)
    order, left, todo = [], set(range(len(sample))), [r.name for r in rules]
    while todo:
        best = max(todo, key=lambda name: (len(rejected[name] & left) / cost[name], -cost[name]))
        order.append(best)
        left -= rejected[best]
        todo.remove(best)
    return order


def sample_texts(docs: DataFrame, text_col: str, size: int, seed: int = 7) -> list[str | None]:
    """At most ``size`` texts, thinly from as few files as give that many."""
    return [r[0] for r in docs.select(text_col).sample(fraction=0.2, seed=seed).head(size)]


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_cascade(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    sample_size: int = 400, counts: bool = False,
                    order: Sequence[str] | None = None) -> DataFrame:
    """One row per row: id, ``kept`` and ``rejected_by`` (the first rule that rejects, else null).

    ``order`` names the rules in the order to run; without it a sample of at most ``sample_size``
    texts decides. ``rejected_by`` depends on the order, ``kept`` does not. With ``counts`` the
    counts that the base rules use are worked out for every row, and ``base_failed``. A null or
    empty text has no words and is rejected; repeated rows give repeated results.
    """
    order = list(order or cascade_order(sample_texts(docs, text_col, sample_size)))
    rules = [next(r for r in RULES if r.name == name) for name in order]
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, kept boolean, rejected_by string"
    if counts:
        schema += "".join(f", {c} bigint" for c in COUNTS) + ", base_failed boolean"

    def run(batch):
        verdicts, measured = [], []
        for text in batch.column(1).to_pylist():
            features = Features(text)
            verdicts.append(next((r.name for r in rules if r.rejects(features)), None))
            if counts:
                measured.append((*(getattr(features, c) for c in COUNTS),
                                 any(r.rejects(features) for r in BASE_RULES)))
        out = [batch.column(0), [v is None for v in verdicts], verdicts]
        if counts:
            out += [[m[k] for m in measured] for k in range(len(COUNTS) + 1)]
        return out

    return over_arrow(docs.select(id_col, text_col), schema, run)
