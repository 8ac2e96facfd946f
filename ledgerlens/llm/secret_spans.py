"""Secret scan: fixed patterns, and the guess cost of values in credential context.

The cost of a value is that of its cheapest segmentation (a shortest path over its positions) into
known words, dates, repeats, keyboard walks and brute-force stretches, in bits (log2 of guesses).
A value in credential context whose cost reaches ``min_bits`` is taken for a secret; ``password:
changeme2020`` is cheap to guess and is left alone by the method (the fixed patterns may take it).
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import over_arrow, through_arrow

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Order of kinds at the same start.
KINDS = ("assign", "access", "hex", "guess")

#: Wider credential context than the fixed pattern's: more names, quoted values, bearer headers.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth(?:orization)?|bearer"""
    r"""|(?:api|access|private|secret|encryption|signing)[_\x20-]?key(?:[_\x20-]?id)?)"""
    r"""["']?\x20*(?:[:=]|=>|\x20is\x20)\x20*(?:bearer\x20+|basic\x20+)?"""
    r"""(?:"([^"\s]{6,})"|'([^'\s]{6,})'|([^\s"'<>,;]{6,}))""", re.IGNORECASE | re.ASCII)
#: Every match of the pattern above contains one of these; looked for before the regex runs.
HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer")

# Common words in order of their guess rank.
WORDS = (
    "password 123456 qwerty admin welcome login letmein monkey dragon master hello freedom "
    "whatever trustno1 shadow sunshine princess football baseball superman batman iloveyou test "
    "guest root user default changeme secret token access key value none null true false example "
    "sample dummy placeholder your my the this that name string text here insert enter api db "
    "database server service account public private pass word summer winter spring autumn love "
    "money orange apple banana computer internet system support office company temp demo dev prod "
    "staging local host home work family friend mother father angel tiger soccer hockey killer "
    "george jordan michael jennifer thomas charlie andrew daniel joshua maggie robert ginger "
    "pepper cheese coffee chocolate silver golden purple yellow green black white blue red").split()
# Rows of a keyboard.
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")

RANK = {word: rank for rank, word in reversed(list(enumerate(WORDS, 1)))}
LONGEST_WORD = max(map(len, WORDS))
SHORTEST_WORD = 3      # shorter ones are no cheaper than their characters
WORD_STARTS = {word[:SHORTEST_WORD] for word in WORDS if len(word) >= SHORTEST_WORD}
PLAIN = str.maketrans("@$013457!", "asoleasti")
WALK_STEPS = {a + b for row in KEY_ROWS for r in (row, row[::-1]) for a, b in zip(r, r[1:])}
DATE = re.compile(
    r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?"
    r"|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:(?:19|20)\d\d|\d\d)", re.ASCII)

SEGMENT_BITS = 1.0     # choosing where a segment ends
WALK_BITS = 4.0        # start and direction of a keyboard walk
LONGEST_UNIT = 16      # characters of a repeated unit
CACHED_VALUE = 256     # costs of longer values are not remembered
#: Characters at the end of a value in which a label of what follows may start: longer than any
#: label with its separators and "bearer".
LABEL_REACH = 48


def alphabet(value: str) -> int:
    """Size of the smallest usual alphabet that spells ``value``."""
    if re.fullmatch(r"[0-9]+", value):
        return 10
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
        return 16
    size = sum(n for n, pattern in ((26, "[a-z]"), (26, "[A-Z]"), (10, "[0-9]"),
                                    (33, r"[\x20-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]"),
                                    (100, r"[^\x00-\x7f]")) if re.search(pattern, value))
    return max(size, 10)


def guess_bits(value: str) -> float:
    """log2 of the guesses the cheapest segmentation of ``value`` needs; 0 for an empty value."""
    return _remembered_bits(value) if len(value) <= CACHED_VALUE else _cheapest_bits(value)


def _best_start(starts: list[tuple[int, float]], end: int, added: tuple[int, float]) -> float:
    """Least cost of a start plus log2 of the length up to ``end``, over all starts of a run.

    The gap between two starts only shrinks as the run grows: one that an earlier start beats, or
    that a later one undercuts, never wins again and is dropped, so few stay.
    """
    while starts and starts[-1][1] >= added[1]:
        starts.pop()
    starts.append(added)
    if len(starts) == 1:
        return added[1] + log2(end - added[0])
    least, kept = float("inf"), []
    for start, cost in starts:
        bits = cost + log2(end - start)
        if bits < least:
            least = bits
            kept.append((start, cost))
    starts[:] = kept
    return least


def _repeats(value: str) -> dict[int, list[tuple[int, bool]]]:
    """Where repeats of units of up to ``LONGEST_UNIT`` characters may end.

    By end: the units, and whether the stretch that repeats them begins to be long enough there.
    """
    codes, found = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32), {}
    for unit in range(1, min(LONGEST_UNIT, len(codes) - 1) + 1):
        ends = np.arange(unit + 1, len(codes) + 1)
        same = codes[unit:] == codes[:-unit]
        # characters up to each end that equal the one a unit before
        run = ends - np.maximum.accumulate(np.where(same, unit, ends))
        need = max(3, 2 * unit) - unit
        for at in np.flatnonzero(run >= need).tolist():
            found.setdefault(at + unit + 1, []).append((unit, bool(run[at] == need)))
    return found


def _cheapest_bits(value: str) -> float:
    n, lower = len(value), value.lower()
    plain = lower.translate(PLAIN) if len(lower) == n else lower
    if len(lower) != n:
        lower = plain = value
    forms = ((lower, 0.0), (plain, 1.0)) if plain != lower else ((lower, 0.0),)
    per_char = log2(alphabet(value)) if n else 0.0
    best = [0.0] + [float("inf")] * n
    walk, walk_starts = 0, []                       # steps up to here; starts of the walk
    repeats = _repeats(value)
    starts: list[dict[int, list]] = [{} for _ in range(LONGEST_UNIT + 1)]   # of repeats, by remainder

    def begun(i: int) -> tuple[int, float]:
        return i, best[i] + (SEGMENT_BITS if i else 0.0)

    for i in range(n + 1):
        # runs that end here
        if i > 1 and lower[i - 2:i] in WALK_STEPS:
            walk += 1
            if walk > 1:
                best[i] = min(best[i], _best_start(walk_starts, i, begun(i - 3)) + WALK_BITS)
        elif walk:
            walk, walk_starts = 0, []
        for unit, begins in repeats.get(i, ()):
            if begins:
                starts[unit] = {}
            run = starts[unit].setdefault(i % unit, [])
            best[i] = min(best[i], _best_start(run, i, begun(i - max(3, 2 * unit)))
                          + unit * per_char - log2(unit))
        if i == n:
            break
        here = begun(i)[1]
        # a brute-force span of any length is a chain of single characters
        best[i + 1] = min(best[i + 1], best[i] + per_char)
        for form, extra in forms:
            if form[i:i + SHORTEST_WORD] not in WORD_STARTS:
                continue
            for end in range(i + SHORTEST_WORD, min(n, i + LONGEST_WORD) + 1):
                rank = RANK.get(form[i:end])
                if rank:
                    case = 0.0 if value[i:end] == lower[i:end] else 1.0
                    best[end] = min(best[end], here + log2(rank) + extra + case)
        date = DATE.match(value, i) if value[i] in "0123456789" else None
        if date:
            bits = log2(365 * 120) if date.end() - i > 4 else log2(120)
            best[date.end()] = min(best[date.end()], here + bits)
    return best[n]


_remembered_bits = lru_cache(maxsize=20_000)(_cheapest_bits)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Matches of the fixed patterns as (start, end, kind), in code points."""
    spans = []
    if ":" in text or "=" in text:
        spans = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return spans + [(*m.span(), "hex") for m in HEX.finditer(text)]


def guessed_spans(text: str, min_bits: float) -> list[tuple[int, int, str]]:
    """Values in credential context that cost at least ``min_bits`` to guess.

    A value that is cheap to guess, or that ends as a label does, may end in the label of the next
    one, so the search goes on from its last ``LABEL_REACH`` characters. What lies before them in a
    cheap value is cheaper still and is not looked at again, so the time is linear in the text.
    """
    lower = text.lower()
    if not any(hint in lower for hint in HINTS):
        return []
    spans, at = [], 0
    while match := CONTEXT.search(text, at):
        start, end = match.span(match.lastindex)
        value = match[match.lastindex]
        secret = guess_bits(value) >= min_bits
        if secret:
            spans.append((start, end, "guess"))
        at = end if secret and value[-1] not in ":=" else max(start, end - LABEL_REACH)
    return spans


def in_order(spans) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in in_order(spans))


def redacted(text: str, spans, mark: str) -> str:
    """Replace the union of the spans by ``mark``, once for each stretch."""
    if not spans:
        return text
    parts, at = [], 0
    merged: list[list[int]] = []
    for start, end, _ in in_order(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    for start, end in merged:
        parts += [text[at:start], mark]
        at = end
    return "".join([*parts, text[at:]])


SPANS = "array<struct<start:bigint,end:bigint,kind:string>>"


def all_spans(text: str | None, min_bits: float) -> list[tuple[int, int, str]]:
    return in_order(base_spans(text) + guessed_spans(text, min_bits)) if text else []


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 min_bits: float = 36.0) -> DataFrame:
    """One row per row: id and ``spans`` (start, end, kind), in code points, end exclusive.

    A null or empty text has no spans; very long texts, repeated rows and null ids need no special
    case. Only the two named columns are read.
    """
    def scan(batch):
        return batch.column(0), [
            [{"start": s, "end": e, "kind": k} for s, e, k in all_spans(text, min_bits)]
            for text in batch.column(1).to_pylist()]

    return over_arrow(docs.select(id_col, text_col),
                      f"`{id_col}` {dict(docs.dtypes)[id_col]}, spans {SPANS}", scan)


def redact(docs: DataFrame, text_col: str = "text", min_bits: float = 36.0,
           mark: str = "[secret]") -> DataFrame:
    """The rows of ``docs`` with every stretch of secret spans in the text replaced by ``mark``."""
    def clean(batch):
        at = batch.schema.get_field_index(text_col)
        texts = [redacted(text, all_spans(text, min_bits), mark) if text else text
                 for text in batch.column(at).to_pylist()]
        return batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.types[at]))

    return through_arrow(docs, clean)


def digest(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
