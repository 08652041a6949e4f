"""Quality rules: text statistics and learned decision lists.

``statistics`` counts words, symbols, repeats and case over every whole text. ``learn`` grows an ordered list of
threshold conjunctions by sequential covering on labelled statistics; ``verdict`` turns the list into one nested Spark
``CASE`` expression.

Defined results: null or empty text has zero words and all counts zero; null and repeated ids give a row each; an empty
table gives no rows; columns beside ``doc_id`` and ``text`` are ignored. Without usable labels the list is empty and only
the base rule decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOPS = np.zeros(256, bool)
_STOPS[list(b"!?")] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_distinct_words")

#: Statistics that the learner may test, as Spark expressions over the counts; all lie in a fixed range or are lengths.
FEATURES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "repeated_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
}


def _count(text):
    data = text.encode("utf-8", "surrogatepass")
    b = np.frombuffer(data, np.uint8)
    words = common.word_hashes(data)
    n = len(words)
    # code points in words: bytes that start a code point and are no white space
    chars = int(np.count_nonzero((b & 0xC0) != 0x80) - np.count_nonzero(common._SPACE[b]))
    repeated = 0
    if n >= 3:
        windows = common.window_hashes(words, 3)
        order = np.argsort(windows, kind="stable")
        same = windows[order][1:] == windows[order][:-1]
        often = np.zeros(n - 2, bool)
        often[order[1:][same]] = True
        often[order[:-1][same]] = True
        cover = np.zeros(n, bool)
        for k in range(3):
            cover[k : k + n - 2] |= often
        repeated = int(cover.sum())
    seen: set[bytes] = set()
    lines = copies = 0
    for line in data.split(b"\n"):
        if line.strip():
            lines += 1
            seen.add(line)
    copies = lines - len(seen)
    return n, chars, int(_SYMBOLS[b].sum()), copies, repeated, int(_UPPER[b].sum()), int(_STOPS[b].sum()), len(np.unique(words))


RESULT = ", ".join(f"{c} long" for c in COUNTS)


def statistics(docs: DataFrame) -> DataFrame:
    """One row (doc_id, the counts of COUNTS) per row of ``docs`` (doc_id, text). A narrow map: no shuffle."""
    return common.map_rows(docs, lambda i, text: [(i, *_count(text or ""))], ["doc_id", "text"], f"doc_id long, {RESULT}")


def with_features(stats: DataFrame) -> DataFrame:
    return stats.withColumns({name: F.expr(f"CAST({e} AS DOUBLE)") for name, e in FEATURES.items()})


@dataclass(frozen=True)
class Rule:
    """Reject where every (feature, sign, threshold) holds; sign is ``>=`` or ``<``. ``precision`` was met when learned."""

    tests: tuple[tuple[str, str, float], ...]
    precision: float


def _hits(x: np.ndarray, test) -> np.ndarray:
    k, sign, cut = test
    return x[:, k] >= cut if sign == ">=" else x[:, k] < cut


def cover(x: np.ndarray, bad: np.ndarray, names: list[str], *, min_precision=0.95, min_covered=10, max_rules=12, max_tests=3, cuts=64) -> list[Rule]:
    """Sequential covering: grow a conjunction by information gain on two thirds, prune it on the rest, remove what it
    covers, and go on while a rule keeps ``min_precision`` and ``min_covered`` bad rows on all rows that are left."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    third = np.arange(len(bad)) % 3 == 2
    for _ in range(max_rules):
        grow, prune = left & ~third, left & third
        if not (grow & bad).sum():
            break
        tests: list[tuple[int, str, float]] = []
        inside = grow.copy()
        while len(tests) < max_tests:
            p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
            if not n0 or not p0:
                break
            best, best_gain = None, 1e-9
            for k in range(x.shape[1]):
                for cut in np.unique(np.quantile(x[inside, k], np.linspace(0, 1, cuts))):
                    for sign in (">=", "<"):
                        hit = inside & _hits(x, (k, sign, cut))
                        p, n = (hit & bad).sum(), (hit & ~bad).sum()
                        if p < 3:
                            continue
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if gain > best_gain:
                            best, best_gain = (k, sign, float(cut)), gain
            if best is None:
                break
            tests.append(best)
            inside &= _hits(x, best)

        def worth(some) -> float:
            hit = prune.copy()
            for t in some:
                hit &= _hits(x, t)
            p, n = (hit & bad).sum(), (hit & ~bad).sum()
            return (p - n) / (p + n) if p + n else -1.0

        while len(tests) > 1 and worth(tests[:-1]) >= worth(tests):
            tests.pop()
        if not tests:
            break
        hit = left.copy()
        for t in tests:
            hit &= _hits(x, t)
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        if p < min_covered or p / (p + n) < min_precision:
            break
        rules.append(Rule(tuple((names[k], sign, cut) for k, sign, cut in tests), p / (p + n)))
        left &= ~hit
    return rules


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, label) with one row per id: 0 if any label of it is 0. Rows without id or with other values are ignored."""
    rows = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)")
    return rows.groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))


def learn(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 20000, **limits) -> list[Rule]:
    """Decision list learned from at most ``sample_rows`` labelled documents, those with the smallest hash of their id.

    The bound is on the fit alone: counting and judging cover every row. Base failures are left out, since they are
    decided before the list is asked.
    """
    sample = labelled(labels).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(sample_rows)
    # at most sample_rows pairs of two numbers: their size is bounded by the parameter
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label")
    counted = statistics(rows.select("doc_id", "text")).join(F.broadcast(sample), "doc_id")
    names = list(FEATURES)
    got = with_features(counted).filter(~base_failed()).orderBy("h", "doc_id", *names).limit(sample_rows).select("label", *names).toPandas()
    if got.empty:
        return []
    return cover(got[names].to_numpy(float), got["label"].to_numpy() == 0, names, **limits)


def base_failed() -> Column:
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that holds (from 1), else 0, as one ordered CASE expression."""
    out = None
    for number, rule in enumerate(rules, 1):
        test = F.lit(True)
        for name, sign, cut in rule.tests:
            test = test & ((F.col(name) >= cut) if sign == ">=" else (F.col(name) < cut))
        out = F.when(test, number) if out is None else out.when(test, number)
    return F.lit(0) if out is None else out.otherwise(0)


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """``stats`` with base_failed, rule (0: none) and kept."""
    out = with_features(stats).withColumns({"base_failed": base_failed(), "rule": verdict(rules)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep_passing(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``docs`` that neither the base rule nor a learned rule rejects. Columns and their order stay."""
    names = docs.columns
    judged = judge(common.with_results(docs, lambda text: [_count(text or "")], ["text"], RESULT), rules)
    return common.unpacked(judged.filter("kept"), names)
