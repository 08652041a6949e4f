"""Held-out separation, calibration and odd texts of the compression classifier."""

from __future__ import annotations

import random

from conftest_llm import WORDS, by_id

from techfolio.llm import common, quality_zstd


def test_separates_and_calibrates(spark, docs_of):
    rng = random.Random(2)
    good = {k: " ".join(rng.choice(WORDS) for _ in range(80)) for k in range(0, 400, 2)}
    bad = {k: " ".join(rng.choice(["$$$", "###win", "click!!", "%%%"]) + rng.choice(WORDS) for _ in range(60)) for k in range(1, 201, 2)}
    docs = docs_of(good | bad)
    labels = spark.createDataFrame([(k, 1, 0) for k in good] + [(k, 0, 0) for k in bad] + [(None, 1, 0), (3, None, 0), (5, 7, 0)], "doc_id long, quality int, toxic int")
    model = quality_zstd.learn(docs, labels, common.crc_remainder("doc_id", 5) != 0, per_class=40)
    got = by_id(quality_zstd.score(docs, model))
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == 300
    right = [(got[k]["score"] >= 0.3) == (k in good) for k in got]
    assert sum(right) / len(right) > 0.97
    odd = by_id(quality_zstd.score(docs_of({1: None, 2: "", 3: "x", None: "y", 4: "stone river " * 20000}), model))
    assert odd[1]["score"] == odd[2]["score"] == model.base_rate and len(odd) == 5 and odd[4]["score"] > 0.3
    assert quality_zstd.score(docs_of({}), model).count() == 0


def test_without_labels(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality_zstd.learn(docs_of({1: "a"}), none)
    assert by_id(quality_zstd.score(docs_of({1: "a"}), model))[1]["score"] == 0.5
    only = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality_zstd.learn(docs_of({1: "a"}), only).base_rate == 1.0


def test_blocks_are_spread_over_the_whole_text():
    text = "".join(f"{k:08d}" for k in range(100_000))
    got = quality_zstd.spread_blocks(text, 8)
    data = text.encode()
    assert len(got) == 8 and got[0] == data[:2048] and data.endswith(got[-1])
    assert [data.index(b) // 2048 for b in got] == sorted({data.index(b) // 2048 for b in got})
    short = "abc" * 1000
    assert b"".join(quality_zstd.spread_blocks(short, 8)) == short.encode() and quality_zstd.spread_blocks("", 8) == []


def test_long_texts_train_and_repeated_rows_stay(spark, docs_of):
    rng = random.Random(5)
    text = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    texts = {k: text(WORDS if k % 2 else ["$$$", "###win", "%%%"], 4000) for k in range(60)}
    docs = docs_of(texts)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in texts], "doc_id long, quality int, toxic int")
    assert min(len(t) for t in texts.values()) > 14000 and max(len(t) for t in texts.values()) > 16384
    model = quality_zstd.learn(docs, labels, per_class=15)
    assert model.good is not None and model.bad is not None
    out = quality_zstd.score(docs.union(docs), model).collect()
    assert len(out) == 120 and all((r["score"] >= 0.3) == (r["doc_id"] % 2 == 1) for r in out)
