"""The join against all pairs; the guarantee of the segments; trees and groups against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
from conftest_llm import WORDS, by_id

from techfolio.llm import ngram_join as N


def roots(n, links):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in links:
        p[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(n)]


def linked(a, b, num=85, den=100):
    both = len(np.intersect1d(a, b))
    return den * both >= num * (len(a) + len(b) - both)


def test_segments_and_tree():
    rng = np.random.default_rng(3)
    for _ in range(1500):
        a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(5, 400)), dtype=np.uint64) * np.uint64(2))
        gone = min(int(rng.integers(0, max(2, len(a) // 8))), len(a) - 1)
        b = np.unique(np.concatenate((np.delete(a, rng.choice(len(a), gone, replace=False)), rng.integers(0, 1 << 63, int(rng.integers(0, max(2, len(a) // 8))), dtype=np.uint64))))
        tree = N.Tree(85, 100)
        tree.add(a, 7)
        assert (tree.first_link(b) == 7) == linked(a, b)
        if linked(a, b) and not np.array_equal(a, b):
            s = N.Segments(85, 100)
            one, two = s.keys(a), s.keys(b)
            for mine, other in ((one, two), (two, one)):
                every = np.concatenate([k for k, _ in other])
                assert any(len(np.intersect1d(k, every)) >= least for k, least in mine)


def test_groups():
    rng = np.random.default_rng(4)
    for _ in range(40):
        base = [np.unique(rng.integers(0, 1 << 20, int(rng.integers(10, 60)), dtype=np.uint64)) for _ in range(4)]
        sets = []
        for _ in range(30):
            x = base[int(rng.integers(4))]
            sets.append(np.unique(np.concatenate((np.delete(x, rng.choice(len(x), int(rng.integers(0, 4)), replace=False)), rng.integers(0, 1 << 20, int(rng.integers(0, 4)), dtype=np.uint64)))))
        true = roots(30, [(i, j) for i in range(30) for j in range(i) if linked(sets[i], sets[j])])
        assert roots(30, N.link_group(list(range(30)), sets, list(range(30)), 85, 100)) == true


def shingle_sets(texts, size):
    out = {}
    for key, text in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out[key] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}
    return out


def brute(texts, size, num, den):
    sets = shingle_sets(texts, size)
    keys = sorted(sets)
    links = [(i, j) for i in range(len(keys)) for j in range(i) if sets[keys[i]] and sets[keys[j]] and den * len(sets[keys[i]] & sets[keys[j]]) >= num * len(sets[keys[i]] | sets[keys[j]])]
    return {k: (len(sets[k]), keys[r]) for k, r in zip(keys, roots(len(keys), links), strict=True)}


def corpus(seed=7):
    rng = random.Random(seed)
    prose = lambda n: [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)]
    texts, hot, passage = {1: None, 2: "", 3: " \n\t ", 4: "one", 5: "One", 6: "two words", 7: "TWO\twords"}, prose(12), prose(70)
    for k in range(60):
        texts[100 + k] = " ".join(hot + prose(rng.randint(5, 200)) + (passage if k % 2 else []))
    source = prose(120)
    for k in range(80):  # a large group of near copies, in chains
        copy = list(source)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(len(copy))] = rng.choice(WORDS)
        texts[300 + k] = " ".join(copy)
        if k % 10 == 9:
            source = copy
    for k in range(20):
        texts[500 + k] = texts[300 + k].upper() if k % 2 else texts[100 + k]
    return texts


def test_join_equals_all_pairs(spark, docs_of):
    texts = corpus()
    # whole groups, and groups split into shards
    for size, num, den, elements in ((4, 85, 100, 2_000_000), (5, 80, 100, 900)):
        got = by_id(N.join(docs_of(texts), size=size, num=num, den=den, group_elements=elements))
        assert {k: (r["n_shingles"], r["component_id"]) for k, r in got.items()} == brute(texts, size, num, den)


def test_odd_rows_and_one_of_each_group(spark, docs_of):
    same = "a b c d e f g h"
    rows = [(5, same), (5, same), (4, same), (None, same), (None, None), (9, "z " * 5)]
    got = N.join(docs_of(rows)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"]) == [(4, 4), (5, 4), (5, 4), (9, 9)] and len(got) == 6
    kept = N.keep_one(docs_of(rows), size=4)
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 0, 4, 9] and kept.columns == docs_of(rows).columns
    assert N.join(docs_of({})).count() == 0 and N.keep_one(docs_of({})).count() == 0
