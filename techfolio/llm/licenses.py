"""License scan: short notices found with a bounded number of edits.

Texts are normalised to lower-cased words joined by one space. A notice with at most k edits keeps two of its k + 2
pieces unchanged (pigeonhole), so exact seeds, found together in one pass of an Aho-Corasick automaton, locate every
candidate: a stretch with two different pieces of one notice at fitting places. The regex library's bounded-error matching then verifies
the edits there and gives the span. The words that tell licenses apart (names and versions) take no edits, and where
matches of two labels lie over each other the one with fewer edits holds.

Defined results: null or empty text has no words and no labels, null positions and score 0; equal spans of one label
are reported once; repeated rows give a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from . import common

# Phrases that must stand word by word, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Short notices as words, by label. The words in brackets tell licenses apart: they must stand as they are.
NOTICES = {
    "apache": ("licensed under the [apache] license version [2 0]", "[apache] software license", "licensed under the [apache] license", "released under the [apache] license"),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that",
        "licensed under the [bsd] license",
        "released under the [bsd] license",
    ),
    "cc-by": ("licensed under [cc by 4 0]", "creative commons [attribution 4 0] international license"),
    "cc-by-nc": ("licensed under [cc by nc 4 0]", "creative commons [attribution noncommercial 4 0] international license"),
    "cc-by-nd": ("licensed under [cc by nd 4 0]", "creative commons [attribution noderivatives 4 0] international license"),
    "cc-by-sa": ("licensed under [cc by sa 4 0]", "creative commons [attribution sharealike 4 0] international license"),
    "epl": ("licensed under the [eclipse] public license", "licensed under the [epl] license", "released under the [epl] license"),
    "gpl": (
        "this work is licensed under the [gnu general public license] version [3]",
        "under the terms of the [gnu general public license]",
        "licensed under the [gpl] license",
        "released under the [gpl] license",
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "licensed under the [isc] license",
        "released under the [isc] license",
    ),
    "agpl": ("[gnu affero] general public license",),
    "lgpl": ("[gnu lesser] general public license",),
    "mit": (
        "released under the [mit] license",
        "licensed under the [mit] license",
        "permission is hereby granted free of charge to any person obtaining a copy",
    ),
    "mpl": ("this source code form is subject to the terms of the [mozilla] public license", "licensed under the [mpl] license", "released under the [mpl] license"),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
}

# Short identifiers, by label. Each makes a notice of its own.
IDENTIFIERS = {
    "agpl": ("agpl 3 0",), "apache": ("apache 2 0",), "bsd": ("bsd 2 clause", "bsd 3 clause"), "cc-by": ("cc by 4 0",), "cc-by-nc": ("cc by nc 4 0",),
    "cc-by-nd": ("cc by nd 4 0",), "cc-by-sa": ("cc by sa 4 0",), "epl": ("epl 1 0", "epl 2 0"), "gpl": ("gpl 2 0", "gpl 3 0"), "isc": ("isc",),
    "lgpl": ("lgpl 2 1", "lgpl 3 0"), "mit": ("mit",), "mpl": ("mpl 1 1", "mpl 2 0"), "unlicense": ("unlicense",),
}
for _label, _names in IDENTIFIERS.items():
    NOTICES[_label] += tuple(f"spdx license identifier [{name}]" for name in _names)

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def plain(notice: str) -> str:
    return notice.replace("[", "").replace("]", "")


def allowed_edits(notice: str) -> int:
    """One edit for every twelve characters outside the brackets, so that a seed has about seven characters or more."""
    return max(1, len(regex.sub(r"\[.*?\]", "", notice)) // 12)


def _pattern(notice: str, k: int) -> regex.Pattern:
    parts = regex.split(r"[\[\]]", notice)
    fuzzy = lambda text: f"(?:{regex.escape(text, literal_spaces=True)}){{e<={k}}}" if text else ""
    inner = "".join(rf"\b{regex.escape(x, literal_spaces=True)}\b" if i % 2 else fuzzy(x) for i, x in enumerate(parts))
    return regex.compile(rf"(?e)\b{inner}\b")


class Scanner:
    """The automaton of all seeds and the bounded-error pattern of every notice."""

    def __init__(self, notices: dict[str, tuple[str, ...]]):
        listed = [(label, text, allowed_edits(text)) for label, texts in sorted(notices.items()) for text in texts]
        self.notices = [(label, plain(text), k) for label, text, k in listed]
        self.patterns = [_pattern(text, k) for _, text, k in listed]
        seeds: dict[str, list[tuple[int, int, int]]] = {}
        for number, (_, text, k) in enumerate(self.notices):
            cuts = [len(text) * j // (k + 2) for j in range(k + 3)]
            for piece, (low, high) in enumerate(zip(cuts, cuts[1:])):
                seeds.setdefault(text[low:high], []).append((number, piece, low))
        self.automaton = ahocorasick.Automaton()
        for seed, uses in seeds.items():
            self.automaton.add_word(seed, (len(seed), uses))
        self.automaton.make_automaton()

    def windows(self, norm: str) -> dict[int, list[list[int]]]:
        """Stretches [low, high] of ``norm`` by notice in which a match can lie: two different pieces stand there whose places
        agree on the start of the notice, but for the edits."""
        hits: dict[int, list[tuple[int, int]]] = {}
        for end, (size, uses) in self.automaton.iter(norm):
            for number, piece, offset in uses:
                hits.setdefault(number, []).append((end + 1 - size - offset, piece))
        found: dict[int, list[list[int]]] = {}
        for number, starts in hits.items():
            _, text, k = self.notices[number]
            starts.sort()
            last: dict[int, int] = {}  # the last start of each piece, those too far back left out
            for start, piece in starts:
                last = {p: at for p, at in last.items() if start - at <= k}
                if any(p != piece for p in last):
                    low, high = max(0, min(last.values()) - k), min(len(norm), start + len(text) + k)
                    spans = found.setdefault(number, [])
                    if spans and low <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], high)
                    else:
                        spans.append([low, high])
                last[piece] = start
        return found

    def find(self, norm: str) -> list[tuple[str, int, int, int, float]]:
        """(label, start, end, edits, similarity) of each verified match, in order, offsets in ``norm``."""
        out = set()
        for number, spans in self.windows(norm).items():
            label, text, k = self.notices[number]
            for low, high in spans:
                # widen to whole words, so that word edges are judged as in the whole text
                at, high = max(norm.rfind(" ", 0, low + 1), 0), high if (edge := norm.find(" ", high)) < 0 else edge
                while at < high:
                    # a long stretch goes in steps that overlap by the longest match, so the work follows its length
                    stop = high if (edge := norm.find(" ", at + 4 * len(text))) < 0 else min(high, edge)
                    m = self.patterns[number].search(norm, at, stop)
                    if m:
                        edits = sum(m.fuzzy_counts)
                        if edits <= k:
                            out.add((m.start(), m.end(), label, edits, 1 - edits / len(text)))
                        at = m.end() if edits <= k and m.end() > at else m.start() + 1
                    elif stop == high:
                        break
                    else:
                        at = max(at + 1, norm.rfind(" ", at, stop - len(text) - k))
        return [(label, start, end, edits, near) for start, end, label, edits, near in nearest(sorted(out))]


def nearest(found: list[tuple]) -> list[tuple]:
    """Of (start, end, label, edits, ...) in order, those without another label's match over more than half of theirs that
    has fewer edits. One sweep: only what can still overlap is kept at hand."""
    longest = max((x[1] - x[0] for x in found), default=0)
    kept, low = [], 0
    for x in found:
        while found[low][0] + longest <= x[0]:
            low += 1
        rival, at = False, low
        while not rival and at < len(found) and found[at][0] < x[1]:
            y = found[at]
            rival = y[2] != x[2] and y[3] < x[3] and 2 * (min(x[1], y[1]) - max(x[0], y[0])) > x[1] - x[0]
            at += 1
        if not rival:
            kept.append(x)
    return kept


@lru_cache(4)
def _scanner(key: tuple) -> Scanner:
    return Scanner(dict(key))


def normalised(text: str) -> str:
    """Words of the text, A-Z lower-cased, with one space before, between and after them; empty without words."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    word = _WORD[data]
    if not word.any():
        return ""
    keep = word.copy()
    keep[1:] |= word[:-1]
    kept = np.where(word, data, 32)[keep]
    return (b" " * int(kept[0] != 32) + kept.astype(np.uint8).tobytes() + b" " * int(kept[-1] != 32)).decode("utf-8", "surrogatepass")


def _scan(scanner: Scanner, doc_id, text):
    norm = normalised(text or "")
    # a word's number is the number of spaces before it, the first of which begins the text
    spaces = np.flatnonzero(np.frombuffer(norm.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
    before = lambda at: int(np.searchsorted(spaces, at))
    n_words = max(len(spaces) - 1, 0)
    places = []
    for phrase, label in PHRASES.items():
        needle, at = f" {phrase} ", norm.find(f" {phrase} ")
        while at >= 0:
            places.append((before(at), label))
            at = norm.find(needle, at + 1)
    found = scanner.find(norm)
    spans = [{"label": x[0], "first_word": before(x[1]) - 1, "last_word": before(x[2]) - 1, "edits": x[3], "similarity": x[4], "text": norm[x[1] : x[2]]} for x in found]
    starts = [p for p, _ in places]
    base = sorted({label for _, label in places})
    score = 1.0 if places else max((x[4] for x in found), default=0.0)
    yield doc_id, n_words, len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted({*base, *(x[0] for x in found)})), score, spans


def scan(docs: DataFrame, notices: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words; n_base, first_word, last_word and base_labels of the exact phrases;
    labels and score with the fuzzy matches; ``found``, their spans by word, edits and matched text. A narrow map."""
    key = tuple(sorted((notices or NOTICES).items()))
    schema = (
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "found array<struct<label: string, first_word: long, last_word: long, edits: int, similarity: double, text: string>>"
    )
    return common.map_rows(docs, _scan, ["doc_id", "text"], schema, setup=lambda: _scanner(key))
