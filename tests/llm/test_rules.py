"""Statistics against a plain count; learned lists on separable data; the emitted expression."""

from __future__ import annotations

import random
import re
from collections import Counter

from conftest_llm import WORDS, by_id

from techfolio.llm import rules_learn as R


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark, docs_of):
    rng = random.Random(2)
    parts = ["a", "b", "cé", " ", " ", "\n", "\n \n", "#x", "|", "日", " ", "\x1c", "\r", "  "]
    texts = {k: "".join(rng.choice(parts) for _ in range(rng.randint(0, 80))) for k in range(300)} | {900: None, 901: "", None: "a b c a b c", 902: "x y " * 30000}
    got = by_id(R.statistics(docs_of(texts)))
    for key, text in texts.items():
        r = got[key]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain(text), repr(text)
    assert R.statistics(docs_of({})).count() == 0


def test_learned_list_rejects_bad_and_keeps_good(spark, docs_of):
    rng = random.Random(5)
    long = lambda f: " ".join(f(rng.choice(WORDS)) + str(rng.randint(0, 99)) for _ in range(90))
    good = {k: long(lambda w: w) for k in range(300)}
    bad = {1000 + k: long(lambda w: w.upper() + "!!") if k % 2 else long(lambda w: w + "$$$") for k in range(120)}
    docs = docs_of(good | bad)
    labels = spark.createDataFrame([(k, 1) for k in good] + [(k, 0) for k in bad] + [(None, 0), (1, None)], "doc_id long, quality int")
    rules = R.learn(docs, labels)
    assert rules and all(rule.precision >= 0.95 for rule in rules)
    judged = R.judge(R.statistics(docs), rules)
    kept = {r["doc_id"] for r in judged.filter("kept").collect()}
    assert len(kept & set(good)) == len(good) and len(kept & set(bad)) < 6
    passing = R.keep_passing(docs, rules)
    assert {r["doc_id"] for r in passing.collect()} == kept and passing.columns == docs.columns


def test_without_labels_only_the_base_rule(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = docs_of({1: "few words", 2: " ".join(f"w{k}" for k in range(60)), 3: None})
    rules = R.learn(docs, none)
    assert rules == []
    got = by_id(R.judge(R.statistics(docs), rules))
    assert [got[k]["kept"] for k in (1, 2, 3)] == [False, True, False]
