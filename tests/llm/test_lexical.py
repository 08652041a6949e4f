"""Best positions against a plain scoring of every document, and how much of the lists they leave unread."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest_llm import WORDS

from techfolio.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, items, k=50):
    held = [(i, Counter(TERM.findall(lowered(t)))) for i, t in docs]
    held = [(i, tf, sum(tf.values())) for i, tf in held if tf]
    n, total = len(held), sum(x for _, _, x in held)
    df = Counter(t for _, tf, _ in held for t in tf)
    rows = []
    for item, text in items:
        scored = []
        for i, tf, size in held:
            m = 100 - 50 + (50 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in set(TERM.findall(lowered(text))) if t in tf)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        rows += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k])]
    return rows


def items_of(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS score")


def rows_of(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("postings", [1_000_000, 300])
def test_equals_brute_force(spark, docs_of, monkeypatch, postings):
    rng = random.Random(8)
    words = [*WORDS, "Ä", "ä", "日本", "x1", "İ"]
    pick = lambda n: " ".join(rng.choices(words, [1 / (r + 1) for r in range(len(words))], k=n))
    docs = [(i, pick(rng.randint(1, 60))) for i in range(400)] + [(900, None), (901, ""), (902, "-- !"), (None, "stone river"), (5, "stone river stone")]
    docs += [(1000 + i, "Stone, RIVER_window") for i in range(70)]  # many equal scores at the edge
    items = [(1, "stone river window"), (2, pick(30)), (3, None), (4, "absent words only"), (5, "thunder Thunder THUNDER"), (6, "ä日本 Ä"), (7, pick(200))]
    monkeypatch.setattr(lexical, "POSTINGS", postings)
    monkeypatch.setattr(lexical, "TEXT_BLOCK", 40)
    got = lexical.search(docs_of(docs).repartition(3), items_of(spark, items))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows_of(got) == brute(docs, items)
    assert rows_of(lexical.search(docs_of(docs), items_of(spark, items), k=3, item_block=2)) == brute(docs, items, 3)


def test_blocks_stop_early_and_keep_ties():
    rng = np.random.default_rng(2)
    scored = total = 0
    for k in (1, 5, 50):
        for _ in range(60):
            n_docs, n_terms = int(rng.integers(1, 3000)), int(rng.integers(1, 8))
            doc, term = np.nonzero(rng.random((n_docs, n_terms)) < 0.4)
            impact = (rng.pareto(1.5, len(doc)) * 10).astype(np.int64) + 1
            block = lexical.Block(doc, term, impact, n_docs, n_terms)
            slots = np.full(n_terms, -1, np.int64)
            query = np.flatnonzero(rng.random(n_terms) < 0.8)
            found, scores, n = block.search(query, k, 1, slots)
            inside = np.isin(term, query)
            want = np.bincount(doc[inside], impact[inside], n_docs).astype(np.int64)
            assert (scores == want[found]).all() and (slots == -1).all()
            kth = np.sort(want)[-k] if n_docs >= k else 0
            assert set(np.flatnonzero((want >= max(kth, 1)))) <= set(found.tolist())
            scored, total = scored + n, total + n_docs
    assert scored < 0.7 * total


def test_repeats_and_empty_tables(spark, docs_of):
    docs = [(1, "stone river"), (1, "stone river"), (2, "garden")]
    items = [(7, "stone"), (7, "stone"), (None, "garden")]
    got = lexical.search(docs_of(docs), items_of(spark, items)).collect()
    assert sorted((str(r["item_id"]), r["rank"], r["doc_id"]) for r in got) == [("7", 1, 1), ("7", 1, 1), ("7", 2, 1), ("7", 2, 1), ("None", 1, 2)]
    assert lexical.search(docs_of({}), items_of(spark, items)).count() == 0
    assert lexical.search(docs_of(docs), items_of(spark, [(1, "x")]).limit(0)).count() == 0


def test_very_long_text(spark, docs_of):
    docs = [(1, "stone river " * 400_000), (2, "stone"), (3, "garden")]
    assert rows_of(lexical.search(docs_of(docs), items_of(spark, [(1, "stone")]))) == brute(docs, [(1, "stone")])
