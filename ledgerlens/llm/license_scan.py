"""Licence scan: ordered signature rules behind a keyword prefilter, overlaps resolved by priority.

Each rule is a regex over the text in lower case, with the plain words that any match must contain.
One Aho-Corasick pass finds which keywords a text has; only rules with all of theirs present run.
Detections are taken by falling priority, then length: one that lies inside a detection already
taken is suppressed; others, also partly overlapping ones, stay.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame

from .license_names import ADDRESSES, CC_PARTS, CC_VERSIONS, NAMES, PHRASES
from .text import over_arrow

#: The plain phrases, whose words must stand consecutively, and their labels.
BASE = {(b"mit", b"license"): "mit", (b"apache", b"license"): "apache",
        (b"general", b"public", b"license"): "gpl"}
# Bytes that end a word: ASCII but letters in lower case and digits.
TO_WORDS = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

LEAD = r"(?:licen[cs]ed|released|distributed|available|published|covered|provided|dual-licensed) under (?:the )?(?:terms of )?(?:the )?(?:a )?"


@dataclass(frozen=True)
class Rule:
    label: str
    kind: str
    pattern: re.Pattern
    keywords: frozenset[str]
    priority: int
    score: float


def _keywords(pattern: str) -> frozenset[str]:
    """Plain words that every match has: those outside groups, classes and optional characters."""
    plain = re.sub(r"\[[^\]]*\]", "~", pattern)
    while "(" in plain:
        plain, n = re.subn(r"\\?\((?:[^()\\]|\\.)*\)[?*+]?(?:\{[^}]*\})?\??", "~", plain)
        if not n:
            break
    plain = re.sub(r"[a-z0-9]\?|\\.|\{[^}]*\}", "~", plain)
    words = sorted(re.findall(r"[a-z0-9]{2,}", plain), key=len, reverse=True)
    return frozenset(words[:2])


def _rule(label: str, kind: str, pattern: str, priority: int, score: float) -> Rule:
    spaced = pattern.replace(" ", r"\s+").replace(r"\s+?", r"\s*").replace(r"[-\s+]", r"[-\s]") \
        .replace(r"[\s+-]", r"[-\s]")
    return Rule(label, kind, re.compile(rf"(?<![a-z0-9]){spaced}(?![a-z0-9])", re.DOTALL),
                _keywords(pattern), priority, score)


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules: identifier tags, addresses, phrases of the texts, named grants, bare names."""
    found = []
    names = {label: list(patterns) for label, patterns in NAMES.items()}
    for part, words in CC_PARTS.items():
        short = part.lower().replace("-", "[- ]")
        for version in CC_VERSIONS:
            dotted = re.escape(version)
            names[f"CC-{part}-{version}"] = [
                f"cc[- ]{short}[- ]{dotted}",
                f"creative commons {words}(?: licen[cs]e)?,? (?:version |v)?{dotted}"]
            found.append(_rule(f"CC-{part}-{version}", "address",
                               f"creativecommons\\.org/licenses/{part.lower()}/{dotted}", 90, 1.0))
        names[f"CC-{part}"] = [f"cc[- ]{short}", f"creative commons {words}"]
    for label, patterns in names.items():
        found.append(_rule(label, "tag", f"spdx-license-identifier: ?{re.escape(label.lower())}"
                           "(?:-only|-or-later|\\+)?", 100, 1.0))
        for pattern in patterns:
            # a name with a version is a longer match than one without, and so comes first
            found.append(_rule(label, "grant", f"{LEAD}{pattern}", 60, 0.95))
            found.append(_rule(label, "name", pattern, 40, 0.8))
    found += [_rule(label, "address", pattern, 90, 1.0) for label, pattern in ADDRESSES.items()]
    found += [_rule(label, "phrase", pattern, 30 if label in ("proprietary", "warranty-disclaimer",
                                                              "public-domain") else 70,
                    0.5 if label in ("proprietary", "warranty-disclaimer") else 0.9)
              for label, patterns in PHRASES.items() for pattern in patterns]
    return tuple(sorted(found, key=lambda r: (-r.priority, r.label, r.pattern.pattern)))


@lru_cache(maxsize=1)
def prefilter() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word in sorted(set().union(*(r.keywords for r in rules()))):
        found.add_word(word, word)
    found.make_automaton()
    return found


@lru_cache(maxsize=4096)
def _gated(present: frozenset[str]) -> tuple[Rule, ...]:
    return tuple(r for r in rules() if r.keywords <= present)


def detections(text: str) -> list[tuple[int, int, Rule]]:
    """What the rules find in a text in lower case, overlaps resolved, by start."""
    present = frozenset(word for _, word in prefilter().iter(text))
    if not present:
        return []
    found = sorted(((m.start(), m.end(), r) for r in _gated(present)
                    for m in r.pattern.finditer(text)),
                   key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].label))
    kept, starts, ends = [], [], []   # intervals that lie in no other: both lists ascend
    for start, end, rule in found:
        k = bisect_right(starts, start)
        if k and ends[k - 1] >= end:
            continue
        kept.append((start, end, rule))
        stop = k
        while stop < len(ends) and ends[stop] <= end:
            stop += 1
        if k and starts[k - 1] == start:
            k -= 1
        starts[k:stop], ends[k:stop] = [start], [end]
    return sorted(kept, key=lambda d: (d[0], d[1], d[2].label))


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """Word number and label of every place where a plain phrase stands."""
    found, at = [], -1
    while True:
        try:
            at = words.index(b"license", at + 1)
        except ValueError:
            return found
        for phrase, label in BASE.items():
            start = at + 1 - len(phrase)
            if start >= 0 and tuple(words[start:at + 1]) == phrase:
                found.append((start, label))


SCHEMA = ("n_words bigint, places array<struct<word:bigint,label:string>>, "
          "detections array<struct<start:bigint,end:bigint,label:string,rule:string,"
          "priority:int,score:double>>")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, number of words, places of the plain phrases, detections of the rules.

    A null text counts as empty: no words, no places, no detections. Offsets of detections are
    code points of the text. Repeated rows give repeated results; only the named columns are read.
    """
    kind = dict(docs.dtypes)[id_col]

    def scan(batch):
        counts, places, hits = [], [], []
        for text in batch.column(1).to_pylist():
            raw = (text or "").encode().lower()
            words = raw.translate(TO_WORDS).split()
            counts.append(len(words))
            places.append([{"word": w, "label": label} for w, label in base_places(words)]
                          if b"license" in raw else [])
            hits.append([{"start": s, "end": e, "label": r.label, "rule": f"{r.kind}:{r.label}",
                          "priority": r.priority, "score": r.score}
                         for s, e, r in detections(raw.decode())])
        return batch.column(0), counts, places, hits

    return over_arrow(docs.select(id_col, text_col), f"`{id_col}` {kind}, {SCHEMA}", scan)
