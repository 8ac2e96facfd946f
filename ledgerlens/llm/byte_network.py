"""Language identification by a byte convolutional network, trained and applied in numpy.

A text is a string of UTF-8 bytes, folded to a small alphabet and cut into windows of fixed length.
Filters of several widths slide over embedded bytes; each filter's largest response in a window,
rectified, feeds a softmax over the languages. A text's prediction is the mean over its windows.

To apply the network, embedding and filters are merged into one table per filter tap, and pairs of
taps into tables over pairs of symbols, so a response is a sum of a few looked-up rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import held_out, over_arrow, through_arrow

UNKNOWN = "und"
# Code points of texts of no language; letters of most scripts, then of a-z, then signs.
SCRIPTS = ((0x0370, 0x03FF), (0x0400, 0x045F), (0x0530, 0x1FFF), (0x3040, 0x30FF), (0x4E00, 0x9FFF),
           (0xAC00, 0xD7A3), (0x61, 0x7A), (0x21, 0x40))


def has_letter(text: str) -> bool:
    """Is there a letter of any script? Other numerals and signs such as a raised two are none."""
    return any(map(str.isalpha, text))


def _fold() -> np.ndarray:
    """Byte to symbol: letters without case, white space, digits and other ASCII as one each."""
    out = np.full(256, 3, np.int64)
    out[[32, 9, 10, 11, 12, 13]] = 1
    out[48:58] = 2
    for k in range(26):
        out[65 + k] = out[97 + k] = 4 + k
    out[0x80:0xC0] = 30 + np.arange(0x40)                       # continuation bytes
    out[0xC0:] = 94 + np.minimum(np.arange(0x40), 33)           # lead bytes
    return out


FOLD = _fold()
SYMBOLS = 128          # symbol 0 fills windows that a text does not


@dataclass
class Network:
    langs: list[str]
    embedding: np.ndarray                  # SYMBOLS x dim
    filters: dict[int, np.ndarray]         # width -> width x dim x filters
    biases: dict[int, np.ndarray]
    dense: np.ndarray
    dense_bias: np.ndarray
    window: int

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters.values(), *self.biases.values(), self.dense,
                self.dense_bias]


def windows_of(raw: bytes, length: int) -> np.ndarray:
    """All bytes of a text as windows of symbols; the last one is filled up."""
    symbols = FOLD[np.frombuffer(raw, np.uint8)]
    n = max(1, -(-len(symbols) // length))
    out = np.zeros(n * length, np.int64)
    out[:len(symbols)] = symbols
    return out.reshape(n, length)


def train(texts: list[bytes], labels: list[str], window: int = 192, dim: int = 8,
          filters: int = 12, widths: tuple[int, ...] = (2, 3, 4), steps: int = 500,
          batch: int = 64, rate: float = 0.01, seed: int = 11) -> Network:
    """Fit the network to labelled texts by Adam on cross-entropy."""
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))
    net = Network(
        langs, rng.normal(0, 0.3, (SYMBOLS, dim)),
        {w: rng.normal(0, 1 / np.sqrt(w * dim), (w, dim, filters)) for w in widths},
        {w: np.zeros(filters) for w in widths},
        rng.normal(0, 0.1, (filters * len(widths), max(1, len(langs)))),
        np.zeros(max(1, len(langs))), window)
    if len(langs) < 2:
        return net
    code = {lang: k for k, lang in enumerate(langs)}
    rows = [(w, code[lang]) for raw, lang in zip(texts, labels) for w in windows_of(raw, window)]
    x, y = np.stack([r[0] for r in rows]), np.array([r[1] for r in rows])
    by_lang = [np.flatnonzero(y == k) for k in range(len(langs))]
    mean = [np.zeros_like(p) for p in net.parameters()]
    square = [np.zeros_like(p) for p in net.parameters()]
    for step in range(1, steps + 1):
        # every language as often, whatever its share
        chosen = np.array([rng.choice(by_lang[k]) for k in rng.integers(0, len(langs), batch)])
        for p, g, m, s in zip(net.parameters(), _gradients(net, x[chosen], y[chosen]), mean, square):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-8)
    return net


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _gradients(net: Network, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    embedded, n = net.embedding[x], len(x)
    pooled, where = [], {}
    for w, kernel in net.filters.items():
        span = x.shape[1] - w + 1
        response = sum(embedded[:, t:t + span] @ kernel[t] for t in range(w))
        where[w] = response.argmax(axis=1)
        pooled.append(np.take_along_axis(response, where[w][:, None], 1)[:, 0] + net.biases[w])
    features = np.maximum(np.concatenate(pooled, axis=1), 0)
    error = _softmax(features @ net.dense + net.dense_bias)
    error[np.arange(n), y] -= 1
    error /= n
    back = (error @ net.dense.T) * (features > 0)
    g_embedding, g_filters, g_biases = np.zeros_like(net.embedding), [], []
    at = 0
    for w, kernel in net.filters.items():
        k = kernel.shape[2]
        part, at = back[:, at:at + k], at + k
        g_biases.append(part.sum(axis=0))
        g = np.zeros_like(kernel)
        for t in range(w):
            place = where[w] + t                                          # n x k
            taken = embedded[np.arange(n)[:, None], place]                # n x k x dim
            g[t] = np.einsum("nk,nkd->dk", part, taken)
            np.add.at(g_embedding, x[np.arange(n)[:, None], place],
                      part[:, :, None] * kernel[t].T[None])
        g_filters.append(g)
    return [g_embedding, *g_filters, *g_biases, features.T @ error, error.sum(axis=0)]


class Scorer:
    """A trained network as lookup tables."""

    ROWS = 128      # windows at a time, which bounds memory and stays in cache

    def __init__(self, net: Network):
        self.net, self.tables = net, {}
        for w, kernel in net.filters.items():
            taps = [(net.embedding @ kernel[t]).astype(np.float32) for t in range(w)]
            pairs = [(taps[t][:, None] + taps[t + 1][None]).reshape(SYMBOLS * SYMBOLS, -1)
                     for t in range(0, w - 1, 2)]
            self.tables[w] = pairs, taps[-1] if w % 2 else None

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Softmax of each window."""
        out = []
        for start in range(0, len(x), self.ROWS):
            part = x[start:start + self.ROWS]
            pair = part[:, :-1] * SYMBOLS + part[:, 1:]
            pooled = []
            for w, (pairs, single) in self.tables.items():
                span = part.shape[1] - w + 1
                pieces = [table.take(pair[:, 2 * k:2 * k + span], axis=0)
                          for k, table in enumerate(pairs)]
                if single is not None:
                    pieces.append(single.take(part[:, w - 1:w - 1 + span], axis=0))
                pooled.append(reduce(np.add, pieces).max(axis=1) + self.net.biases[w])
            features = np.maximum(np.concatenate(pooled, axis=1), 0)
            out.append(_softmax(features @ self.net.dense + self.net.dense_bias))
        return np.concatenate(out) if out else np.zeros((0, len(self.net.langs)))

    def shares(self, raws: list[bytes]) -> np.ndarray:
        """Mean softmax of each text over its windows, which are batched."""
        cut = [windows_of(raw, self.net.window) for raw in raws]
        weight = np.concatenate([(c > 0).sum(axis=1) for c in cut]).astype(float)
        p = self.probabilities(np.concatenate(cut)) * weight[:, None]
        ends = np.cumsum([len(c) for c in cut])
        total = np.add.reduceat(p, np.r_[0, ends[:-1]], axis=0)
        return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-12)

    def predict(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Language number and score of each text."""
        total = self.shares(raws)
        return total.argmax(axis=1), total.max(axis=1)


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str,
                    per_lang: int, chars: int) -> list[tuple[str, str]]:
    """Pieces of about ``per_lang`` texts of every language, from rows that may be learned from.

    A hash of the id chooses the rows, so reruns agree; the counts that set its threshold come from
    a pass over two narrow columns. A piece starts at a hashed place of its text.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & ~held_out(id_col) & F.col(id_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not counts:
        return []
    pick = F.pmod(F.xxhash64(id_col, F.lit(5)), F.lit(1_000_000))
    wanted = reduce(lambda a, b: a | b, (
        (F.col(lang_col) == lang) & (pick < int(min(1.0, per_lang / n) * 1_000_000) + 1)
        for lang, n in counts.items()))
    start = F.pmod(F.xxhash64(id_col, F.lit(6)), F.greatest(F.length(text_col) - chars, F.lit(1))) + 1
    chosen = rows.where(wanted & F.col(text_col).isNotNull()).select(
        F.substring(F.col(text_col), start.cast("int"), F.lit(chars)).alias("piece"), lang_col)
    return sorted((r[0], r[1]) for r in chosen.collect() if has_letter(r[0]))


def background(n: int, chars: int, seed: int = 5) -> list[str]:
    """Texts of no language: random words in parts of several scripts, of letters or of signs."""
    rng, out = np.random.default_rng(seed), []
    for k in range(n):
        low, high = SCRIPTS[k % len(SCRIPTS)]
        width = int(rng.integers(1, min(high - low, 200) + 1)) if high - low > 100 else high - low
        start, length = int(rng.integers(low, high - width + 1)), int(rng.integers(8, chars // 2))
        codes = rng.integers(start, start + width + 1, length)
        codes[rng.random(length) < rng.choice([0.02, 0.15, 0.3])] = 32
        out.append("".join(map(chr, codes.tolist())))
    return out


def _strangeness(scorer: Scorer, raws: list[bytes]) -> np.ndarray:
    """Share of each text that the network gives to no language."""
    langs = scorer.net.langs
    return scorer.shares(raws)[:, langs.index(UNKNOWN)] if UNKNOWN in langs else np.zeros(len(raws))


def _judge(docs: DataFrame, network: Network, verdict: Callable[[Scorer, list[bytes]], list], other):
    """A function from a column of texts to verdicts; ``other`` for those without a letter."""
    # a few tens of kilobytes, whatever the input
    sent = docs.sparkSession.sparkContext.broadcast(network)
    scorers: dict[int, Scorer] = {}

    def judge(column: list[str | None]) -> list:
        if not scorers:
            scorers[0] = Scorer(sent.value)
        out = [other] * len(column)
        known = [k for k, text in enumerate(column)
                 if scorers[0].net.langs and text and has_letter(text)]
        at = 0
        while at < len(known):      # a bounded number of characters at a time, or one long text
            stop, size = at, 0
            while stop < len(known) and (stop == at or size + len(column[known[stop]]) < 1 << 20):
                size += len(column[known[stop]])
                stop += 1
            found = verdict(scorers[0], [column[k].encode() for k in known[at:stop]])
            for k, one in zip(known[at:stop], found, strict=True):
                out[k] = one
            at = stop
        return out

    return judge


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", per_lang: int = 500, chars: int = 768,
             network: Network | None = None) -> DataFrame:
    """One row per row: id, ``lang_pred`` and ``score``.

    Without a ``network`` one is trained on pieces of about ``per_lang`` labelled texts of each
    language, never of held-out ids. Every byte of a text counts. A null text, one without a
    letter, and every text if no labels could be learned, is ``und`` with score 0. Repeated rows
    give repeated results.
    """
    if network is None:
        sample = labelled_sample(docs, id_col, text_col, lang_col, per_lang, chars)
        network = train([t.encode() for t, _ in sample], [lang for _, lang in sample])

    def verdict(scorer, raws):
        code, score = scorer.predict(raws)
        return [(scorer.net.langs[c], min(1.0, p)) for c, p in zip(code.tolist(), score.tolist())]

    predict = _judge(docs, network, verdict, (UNKNOWN, 0.0))

    def run(batch):
        found = predict(batch.column(1).to_pylist())
        return batch.column(0), [lang for lang, _ in found], [score for _, score in found]

    return over_arrow(docs.select(id_col, text_col),
                      f"`{id_col}` {dict(docs.dtypes)[id_col]}, lang_pred string, score double", run)


def recognised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               lang_col: str = "lang", per_lang: int = 500, chars: int = 768,
               network: Network | None = None, keep_unlearned: bool = False) -> DataFrame:
    """The rows of ``docs`` in a language that the network can tell, with all their columns.

    Without a ``network`` one is trained as for ``identify``, with ``background`` as one class more.
    A text goes if it has no letter, or if the network gives more of it to the background than a
    limit: one half, or what all but one in 200 of the learned pieces stay below, if that is more.
    If no labels could be learned, all rows go, or with ``keep_unlearned`` only those without a letter.
    """
    limit, learned = 1.0, True
    if network is None:
        sample = labelled_sample(docs, id_col, text_col, lang_col, per_lang, chars)
        learned, pieces = bool(sample), background(per_lang, chars) if sample else []
        network = train([t.encode() for t in [t for t, _ in sample] + pieces],
                        [lang for _, lang in sample] + [UNKNOWN] * len(pieces))
        if learned:
            own = _strangeness(Scorer(network), [t.encode() for t, _ in sample])
            limit = max(0.5, float(np.quantile(own, 0.995, method="higher")))

    def verdict(scorer, raws):
        return (_strangeness(scorer, raws) <= limit).tolist()

    judge = _judge(docs, network, verdict, False)

    def known(batch):
        column = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
        found = judge(column) if learned or not keep_unlearned else [
            bool(text) and has_letter(text) for text in column]
        return batch.filter(pa.array(found, pa.bool_()))

    return through_arrow(docs, known)
