"""Held-out accuracy on the documents, mixtures, and odd texts."""

from __future__ import annotations

import re

import numpy as np
from conftest_llm import by_id
from pyspark.sql import functions as F

from techfolio.llm import common, langid

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_mixtures(spark, docs_of):
    docs = common.table(spark, SF, "documents")
    held = common.crc_remainder("doc_id", 3) == 1
    model = langid.learn(docs, ~held)
    out = langid.predict(docs.filter(held), model).join(docs.select("doc_id", "lang"), "doc_id")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    first = {lang: docs.filter(held & (F.col("lang") == lang)).orderBy("doc_id").first()["text"] for lang in model.langs}
    mixed = (first["de"] * 9)[:1500] + " " + (first["fr"] * 9)[:1500]
    texts = {1: None, 2: "", 3: "123 !? 456", 4: mixed, None: first["es"], 5: first["en"] * 400}
    got = by_id(langid.predict(docs_of(texts), model))
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (1, 2, 3))
    assert {x.split(":")[0] for x in got[4]["mixture"].split(",")} == {"de", "fr"} and 0.3 < got[4]["score"] < 0.7
    assert got[None]["lang_pred"] == "es" and got[5]["lang_pred"] == "en"
    kept = langid.keep_identified(docs_of(texts, lang=None), model, least_share=0.4)
    assert {r["doc_id"]: r["lang"] for r in kept.collect()} == {4: got[4]["lang_pred"], None: "es", 5: "en"}
    assert kept.columns == docs_of(texts).columns


def test_nothing_to_learn(spark, docs_of):
    model = langid.learn(docs_of({1: "some text"}, lang=None), F.lit(True))
    assert model.langs == ()
    assert by_id(langid.predict(docs_of({1: "some text"}), model))[1]["lang_pred"] == "und"
    assert langid.predict(docs_of({}), model).count() == 0


def test_pieces_count_every_trigram_once(monkeypatch):
    text = "Überall, wo 42 Füße -- gehen; straße " * 40 + "ΟΔΟΣ ende"
    flat = " " + re.sub(r"[^\W\d_]+|.", lambda m: m[0] if m[0][0].isalpha() else " ", text.lower(), flags=re.S) + " "
    flat = re.sub(" +", " ", flat)
    plain = np.zeros(langid.CELLS, np.int64)
    for k in range(len(flat) - 2):
        plain[langid.trigram_cells(np.array([ord(c) for c in flat[k : k + 3]], np.uint32))] += 1
    for piece in (1, 2, 7, 1 << 20):
        monkeypatch.setattr(langid, "PIECE", piece)
        assert (langid.cell_counts(text) == plain).all()
    assert langid.cell_counts("").sum() == langid.cell_counts("1 2 3").sum() == 0 and langid.cell_counts("a").sum() == 1


def test_repeated_rows_and_ties(spark, docs_of):
    one = [(k, "alpha beta gamma delta", lang) for k, lang in ((1, "b"), (2, "a"))]
    docs = spark.createDataFrame(one, "doc_id long, text string, lang string")
    model = langid.learn(docs, F.lit(True))
    out = langid.predict(docs.union(docs.filter("doc_id = 2")), model).collect()
    assert len(out) == 3 and {r["lang_pred"] for r in out} == {"a"}
