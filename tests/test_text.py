from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from techfolio.functions import text as tx
from techfolio.operators import relevance, rules
from techfolio.sources.rules import Rules, rules_from_json


def one(spark, text, *cols):
    return spark.createDataFrame([(text,)], "t string").select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


SOLICITATION = """Phase I awards: $100,000 - $300,000
Phase II awards: $500,000 - $1,000,000
Proposal submission deadline: June 15, 2024
Award notification: September 1, 2024
Performance start date: October 1, 2024
TECHNICAL REQUIREMENTS:
Build a <b>Sensor</b>
with care
EVALUATION CRITERIA: merit   first"""


def test_funding_and_deadlines(spark):
    t = F.col("t")
    r = one(spark, SOLICITATION, *tx.funding_range(t, "I"), *tx.funding_range(t, "II"), *[tx.labelled_date(t, x) for x in ("proposal_deadline", "award_notification", "performance_start")])
    assert list(r) == [100000, 300000, 500000, 1000000, dt.date(2024, 6, 15), dt.date(2024, 9, 1), dt.date(2024, 10, 1)]


def test_sections(spark):
    t = F.col("t")
    r = one(spark, SOLICITATION, tx.technical_requirements(t), tx.evaluation_criteria(t))
    assert list(r) == ["build a sensor with care", "merit first"]


def test_keywords_and_phrases(spark):
    text = "Deep Neural Networks, convolutional architectures, and reinforcement learning algorithms. semiconductor fabrication techniques and quantum error correction methods."
    words = [k for ks in tx.area_keywords().values() for k in ks]
    t = F.col("t")
    r = one(spark, text, tx.technical_phrases(t), tx.found_keywords(t, words))
    assert {"deep neural networks", "convolutional architectures", "reinforcement learning", "semiconductor fabrication", "quantum error correction"} <= set(r.c0)
    assert "semiconductor fabrication" in r.c1 and r.c1 == sorted(set(r.c1))


def test_ranked_keywords(spark):
    terms = F.array(F.lit("plain"), F.lit("sensor network design"), F.lit("quantum computing"), F.lit("other"))
    assert one(spark, "", tx.ranked_keywords(terms, ["quantum computing"])).c0 == ["quantum computing", "sensor network design", "plain", "other"]


def test_evidence(spark):
    t = F.col("t")
    text = "First one. The Quantum sensor works! Last?"
    r = one(spark, text, tx.evidence_excerpt(t, ["quantum"]), tx.evidence_excerpt(t, ["zzz"], "fallback"), tx.evidence_excerpt(t, ["zzz"]))
    assert list(r) == ["The Quantum sensor works!", "fallback", text]
    assert len(one(spark, "w " * 80, tx.evidence_excerpt(t, ["w"])).c0.split()) == 50


@pytest.mark.parametrize("score, band, closed", [(85.0, "High", "High"), (55.0, "Medium", "Medium"), (10.0, "Low", "Low"), (69.5, "Medium", "Low")])
def test_bands(spark, score, band, closed):
    assert list(one(spark, "", tx.band(F.lit(score)), tx.band(F.lit(score), closed=True))) == [band, closed]


def test_text_building(spark):
    kw = F.array(F.lit("AI"), F.lit("robots"))
    none = F.lit(None).cast("string")
    r = one(spark, " abc ", tx.classification_text(F.col("t"), kw), tx.classification_text(none, kw), tx.weighted_text({"a": F.col("t"), "b": F.lit("x")}, {"a": 0.2, "b": 0.04}))
    assert list(r) == ["abc AI robots", "AI robots", "abc abc x"]


RULE_CASES = [
    ("", "Department of Defense", None, "hypersonics", 15.0),
    ("", "DOD", None, "hypersonics", 15.0),
    ("", None, "Air Force", "hypersonics", 20.0),
    ("This project develops quantum computing and a novel quantum algorithm.", None, None, "quantum_computing", 12.0),
    ("An ai-powered diagnostic platform for process optimization.", None, None, "artificial_intelligence", 0.0),
    ("This AI diagnostic platform improves clinical workflows.", None, None, "medical_devices", 20.0),
    ("We propose quantum computing techniques for simulation.", "Department of Energy", None, "quantum_computing", 21.0),
    ("", "National Science Foundation", None, "hypersonics", 5.0),
]


def test_rule_scores(spark):
    df = spark.createDataFrame([(i, t, a, b) for i, (t, a, b, _, _) in enumerate(RULE_CASES)], "key int, text string, agency string, branch string")
    got = {(r.key, r.cet_id): r.score for r in rules.score(df).collect()}
    assert [got[i, c[3]] for i, c in enumerate(RULE_CASES)] == [c[4] for c in RULE_CASES]
    assert len(got) == len(RULE_CASES) * len(Rules().areas())


def test_rule_word_boundary_option(spark):
    df = spark.createDataFrame([(1, "We maintain a medical archive", None, None)], "key int, text string, agency string, branch string")
    pick = lambda **o: {r.cet_id: r.score for r in rules.score(df, **o).collect()}["medical_devices"]
    assert (pick(), pick(whole_words=True)) == (20.0, 0.0)


def test_rules_from_json(spark):
    r = rules_from_json('{"cet_keywords": {"a": {"core": ["X y"]}}, "agency_priors": {"NASA": {"_all_cets": 4}}, "context_rules": {"b": [[["x", "z"], 9]]}}')
    df = spark.createDataFrame([(1, "x  Y z", "nasa", None)], "key int, text string, agency string, branch string")
    assert {x.cet_id: x.score for x in rules.score(df, r).collect()} == {"a": 10.0, "b": 13.0}


def test_hybrid_weight_is_clamped(spark):
    one_row = spark.createDataFrame([("k", "a", 80.0)], "key string, cet_id string, score double")
    rule = spark.createDataFrame([("k", "a", 20.0)], "key string, cet_id string, score double")
    assert [rules.hybrid(one_row, rule, w).first().hybrid_score for w in (0.25, 2, -1)] == [65.0, 20.0, 80.0]


def python_relevance(text, areas):
    """Plain restatement of the relevance formula for one text, to compare with."""
    import math
    import re
    from collections import Counter

    t, out = text.lower(), {}
    words = t.split()
    idf, weights = areas.weights()
    toks = [w for w in re.findall(r"\b\w\w+\b", t) if w not in set(areas.stop_words)]
    tf = {g: n * idf[g] for g, n in Counter(relevance.grams(toks)).items() if g in idf}
    norm = math.sqrt(sum(v * v for v in tf.values()))
    for area, keys in areas.keywords.items():
        kw = ph = 0.0
        for k in keys:
            exact = sum(t.count(v) for v in relevance.phrase_variants(k))
            loose = sum(sum(1 for w in words if tok in w and w != tok) for tok in k.split())
            kw += min(0.30, (5 * exact + loose) / max(1, len(words)))
            if " " in k:
                ph += 0.25 if any(v in t for v in relevance.phrase_variants(k)) else 0.0
                ph += 0.15 if sum(w in words for w in k.split()) >= 0.7 * len(k.split()) else 0.0
        sem = sum(v * weights[area].get(g, 0.0) for g, v in tf.items()) / norm if norm else 0.0
        here = [k for k in keys if k in t]
        many = [k for k in here if " " in k]
        base = 0.65 * min(1.0, kw) + 0.2 * sem + 0.15 * min(1.0, ph) + (0.25 if len(here) >= 2 else 0) + (0.10 if many else 0)
        out[area] = min(1.0, max(base, 0.80 if many else 0.72 if here else 0.0))
    return out


def test_relevance_of_technical_texts(spark):
    texts = [
        "Quantum computing and quantum algorithms for quantum computing.",
        "Machine learning and deep learning with neural networks; batteries for lithium-ion storage of AI chips",
        "Satellite launch vehicles and orbital robots, gene therapies and gene therapy gene therapy gene",
        "nothing to see", "", "   ",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "key int, text string")
    areas = relevance.Areas()
    got = {(r.key, r.cet_id): r.score for r in relevance.score(df, areas).collect()}
    for i, text in enumerate(texts):
        want = python_relevance(text, areas)
        assert {a: got[i, a] for a in want} == pytest.approx(want), text
    assert got[0, "quantum_computing"] >= 0.8
    scaled = relevance.normalized(df, areas).groupBy("key").agg(F.sum("score").alias("s")).collect()
    assert all(r.s == pytest.approx(1.0) or r.s == 0.0 for r in scaled)


def test_keywords_are_looked_for_once_a_text(spark):
    """m11: not again for each area, above the operator that makes a row of every area."""
    from techfolio.plans import all as _all  # noqa: F401
    from techfolio.plans.registry import QUERIES

    plan = QUERIES["m11_parsed_solicitations"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate explode", 1)
    assert "lambdafunction" not in above and "lambdafunction" in below
