"""Feature, classifier and re-assessment queries over documents and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning as cl
from ..functions import text as tx
from ..operators import classifier as cf
from ..operators import evaluation as ev
from ..operators import features as ft
from ..operators import rules
from ..operators import solver
from ..operators import taxonomy as tax
from .ingest import taxonomy_versions
from .prose import PROSE_RULES
from .registry import query
from .text import _DOC, _rule_sql, q

#: The reference settings: 50,000 features, 20,000 selected, its stop words, 500 iterations. They belong to the models.
CFG = ft.TextConfig()
#: The long form keeps every term within the document-frequency bounds.
LONG = ft.TextConfig(max_features=None, select=None)
_STOPS = ", ".join(q(s) for s in CFG.stop_words)


def examples(t, label: str = "quality"):
    labels = t.raw("labels").select("doc_id", F.when(F.col(label) == 1, "good").otherwise("poor").alias("label"))
    return t.documents.join(labels, "doc_id").select(F.col("doc_id").cast("string").alias("key"), "text", "label")


_FEATURES = rf"""WITH d AS (SELECT {_DOC} AS key, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: NOT list_contains([{_STOPS}], w)) AS w
  FROM documents),
g AS (SELECT key, array_to_string(w[i : i + n - 1], ' ') AS term FROM (SELECT key, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (VALUES (1), (2), (3)) v(n))),
c AS (SELECT key, term, count(*) AS n FROM g GROUP BY 1, 2),
docs AS (SELECT count(*) AS n_docs FROM documents),
stats AS (SELECT term, sum(n)::BIGINT AS tf, count(*) AS df FROM c GROUP BY 1),
vocab AS (SELECT term, tf, df, ln((1.0::DOUBLE + n_docs) / (df + 1.0::DOUBLE)) + 1 AS idf FROM stats, docs WHERE df >= 2 AND df <= 0.95::DOUBLE * n_docs),
x AS (SELECT key, term, n * idf AS x FROM c JOIN vocab USING (term)),
nrm AS (SELECT key, sqrt(sum(x * x)) AS norm FROM x GROUP BY 1),
tfidf AS (SELECT key, term, x / norm AS weight FROM x JOIN nrm USING (key)),
lab AS (SELECT {_DOC} AS key, lang AS label FROM documents),
share AS (SELECT label, count(*)::DOUBLE / (SELECT n_docs FROM docs) AS share FROM lab GROUP BY 1),
obs AS (SELECT term, label, sum(weight) AS o FROM tfidf JOIN lab USING (key) GROUP BY 1, 2),
tot AS (SELECT term, sum(o) AS total FROM obs GROUP BY 1),
chi AS (SELECT t.term, sum((coalesce(o, 0) - share * total) ** 2 / (share * total)) AS chi2 FROM tot t CROSS JOIN share LEFT JOIN obs ON obs.term = t.term AND obs.label = share.label GROUP BY 1)
"""


def _vocab(t):
    n = t.texts.count()
    cfg = LONG.for_corpus(n)
    return ft.vocabulary(ft.term_statistics(t.texts, cfg), n, cfg)


def _weights(t, each: str | None = None):
    n = t.texts.count()
    return ft.weighted_rows(t.texts, LONG.for_corpus(n), n, each)


@query("m12_term_statistics", _FEATURES + "SELECT term, tf, df FROM stats")
def m12s(t):
    return ft.term_statistics(t.texts, LONG)


@query("m12_tfidf_vocabulary", _FEATURES + "SELECT term, tf, df, round(idf, 9) AS idf FROM vocab")
def m12v(t):
    return _vocab(t).withColumn("idf", F.round("idf", 9))


@query("m12_tfidf_weights", _FEATURES + "SELECT key, term, round(weight, 9) AS weight FROM tfidf")
def m12(t):
    return _weights(t).withColumn("weight", F.round("weight", 9))


@query("m13_chi2_scores", _FEATURES + "SELECT term, round(chi2, 6) AS chi2 FROM chi")
def m13(t):
    labels = t.texts.select("key", F.col("agency").alias("label"))
    return ft.chi2_labelled(_weights(t, "agency").withColumnRenamed("agency", "label"), labels).withColumn("chi2", F.round("chi2", 6))


@query("m14_class_weights", "SELECT lang AS label, count(*) AS n, (SELECT count(*) FROM documents)::DOUBLE / (4 * count(*)) AS weight FROM documents GROUP BY 1")
def m14(t):
    return ft.balanced_weights(t.raw("documents").select(F.col("lang").alias("label")))


@query("m15_logistic_probabilities")
def m15(t):
    model = cf.fit(examples(t), cf.ModelConfig(text=CFG, calibrate=False))
    return model.probabilities(t.texts).select("key", "probabilities")


@query("m16_m17_calibrated_predictions")
def m17(t):
    model = cf.fit(examples(t), cf.ModelConfig(text=CFG))
    return model.predict(t.texts)


@query("m16_fits", "SELECT 3 AS fits, 2 AS classes, count(*) AS training_rows, true AS converged FROM labels JOIN documents USING (doc_id)")
def m16f(t):
    """Facts of the calibrated fit: every fold's regression ends by its gradient, not by the number of steps."""
    rows = examples(t)
    model = cf.fit(rows, cf.ModelConfig(text=CFG))
    converged = all(f.gradient <= solver.TOLERANCE for f in model.fits)
    return rows.agg(F.lit(len(model.fits)).alias("fits"), F.lit(len(model.labels)).alias("classes"), F.count(F.lit(1)).alias("training_rows"), F.lit(converged).alias("converged"))


@query("w8_primary_and_supporting")
def w8(t):
    labelled = t.texts.select("key", "text", F.col("agency").alias("label"))
    model = cf.fit(labelled, cf.ModelConfig(text=CFG, calibrate=False))
    return model.predict(t.texts)


def _sources(t):
    docs = t.documents.select("doc_id", F.col("text").alias("abstract"), F.concat_ws(" ", "source", "lang").alias("keywords"))
    labels = t.raw("labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("poor").alias("label"))
    bench = t.raw("benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("solicitation"))
    return docs.join(labels, "doc_id", "left").join(bench, "doc_id", "left").withColumn("key", F.col("doc_id").cast("string"))


def _labelled(rows):
    return rows.where("label IS NOT NULL")


def _source_terms(name: str, text: str, budget: int) -> str:
    """The terms of one source: of the labelled documents the most frequent, and whether a document has one of them."""
    return rf"""{name}_w AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS fitted, regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]{{2,}}') AS w FROM src),
{name}_g AS (SELECT doc_id, fitted, array_to_string(w[i : i + n - 1], ' ') AS term FROM (SELECT doc_id, fitted, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM {name}_w CROSS JOIN (VALUES (1), (2)) v(n))),
{name}_v AS (SELECT term FROM {name}_g WHERE fitted GROUP BY 1 ORDER BY count(*) DESC, term LIMIT {budget}),
{name}_d AS (SELECT DISTINCT doc_id FROM {name}_g WHERE term IN (SELECT term FROM {name}_v))"""


_MULTI = cf.SOURCE_WEIGHTS
_BUDGET = cf.split_budget(10_000, list(_MULTI))


@query("m18_multi_source_features", "WITH src AS (SELECT doc_id, d.text AS abstract, concat_ws(' ', source, lang) AS keywords, coalesce(b.text, '') AS solicitation FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id),\n"
       + ",\n".join(_source_terms(s, s, _BUDGET[s]) for s in _MULTI)
       + "\nSELECT CAST(src.doc_id AS VARCHAR) AS key, CAST(" + " + ".join(f"(SELECT count(*) FROM {s}_v)" for s in _MULTI) + " AS INT) AS n_features, round(sqrt("
       + " + ".join(f"CASE WHEN {s}_d.doc_id IS NULL THEN 0 ELSE {w}::DOUBLE * {w}::DOUBLE END" for s, w in _MULTI.items()) + "), 9) AS norm FROM src "
       + " ".join(f"LEFT JOIN {s}_d ON {s}_d.doc_id = src.doc_id" for s in _MULTI))
def m18(t):
    rows = _sources(t)
    vectors = cf.fit_multi_source(_labelled(rows)).transform(rows).withColumn("v", F.unwrap_udt("features"))
    square = F.aggregate("v.values", F.lit(0.0), lambda acc, x: acc + x * x)
    # the size of a sparse vector stands in it, that of a dense one is its length
    size = F.coalesce(F.col("v.size"), F.size("v.values"))
    return vectors.select("key", size.alias("n_features"), F.round(F.sqrt(square), 9).alias("norm"))


@query("m19_multi_source_top_areas")
def m19(t):
    rows = _sources(t)
    return cf.fit_multi_source_model(_labelled(rows)).top(rows, 2)


@query("m20_feature_importance")
def m20(t):
    return cf.fit_multi_source_model(_labelled(_sources(t))).importance(t.spark)


_BOOST = "CASE WHEN contains(term, 'th') OR contains(term, 'eaux') THEN 2.0 WHEN contains(term, 'er') THEN 1.5 ELSE 1.0 END::DOUBLE"


@query("m24_boosted_features", _FEATURES + f"SELECT term, {_BOOST} AS boost FROM vocab")
def m24(t):
    return _vocab(t).select("term", ft.boost_factor(F.col("term"), ["th", "eaux"], ["er"]).alias("boost"))


@query("m24_boosted_weights", _FEATURES + f"SELECT key, term, round(weight * {_BOOST}, 9) AS weight FROM tfidf")
def m24w(t):
    return ft.boosted_rows(_weights(t), ["th", "eaux"], ["er"]).withColumn("weight", F.round("weight", 9))


@query("m23_enrichment_experiment")
def m23(t):
    c = F.col("doc_id")
    topic = F.element_at(F.array(*[F.lit(x) for x in ("AI", "BT", "LC", "ZZ")]), (c % 4 + 1).cast("int"))
    description, words = cl.fallback_context(topic, F.lit("NSF"), F.lit(None).cast("string"))
    rows = t.documents.select(
        c.cast("string").alias("key"), F.col("lang").alias("label"), F.col("text").alias("baseline_text"),
        tx.enriched_text(F.col("text"), description, words).alias("enriched_text"),
    )
    small = cf.ModelConfig(text=CFG, calibrate=False)
    return ev.experiment_summary(cf.run_experiment(rows, small))


_BEST = _rule_sql(PROSE_RULES) + """, ranked AS (SELECT key, cet_id, score, row_number() OVER (PARTITION BY key ORDER BY score DESC, cet_id) AS rn FROM scores)
"""


@query("m27_reassessment", _BEST + """
SELECT sha256('v2|' || key) AS assessment_id, key AS award_id, 'v2' AS taxonomy_version, score, CASE WHEN score >= 70 THEN 'High' WHEN score >= 40 THEN 'Medium' ELSE 'Low' END AS classification,
  cet_id AS primary_cet_id, coalesce((SELECT list(r2.cet_id ORDER BY r2.rn) FROM ranked r2 WHERE r2.key = r.key AND rn BETWEEN 2 AND 4 AND r2.score > 0), []::VARCHAR[]) AS supporting_cet_ids,
  'automated' AS generation_method FROM ranked r WHERE rn = 1""")
def m27(t):
    return _reassessed(t).drop("assessed_at")


def _reassessed(t):
    awards = t.texts.withColumn("award_id", F.col("key"))
    scorer = lambda df: rules.classify(df, PROSE_RULES).withColumnRenamed("key", "award_id")
    return tax.reassess(awards, "v2", scorer, F.lit("2025-01-01").cast("timestamp_ntz"))


@query("m27_reassessment_manifest", _BEST + """, prev AS (SELECT CAST(doc_id AS VARCHAR) AS key, CASE lang WHEN 'en' THEN 'english' ELSE 'french' END AS before FROM documents)
SELECT count(*) AS awards_processed, count(*) AS awards_affected, count(*) FILTER (cet_id <> before) AS primary_changed, 1 AS areas_added, 1 AS areas_removed, 1 AS areas_modified
FROM ranked JOIN prev USING (key) WHERE rn = 1""")
def m27m(t):
    before = t.texts.select(F.col("key").alias("award_id"), F.when(F.col("agency") == "en", "english").otherwise("french").alias("primary_cet_id"))
    v = taxonomy_versions(t)
    return tax.reassessment_manifest(before, _reassessed(t), tax.diff(v.where("version = 'v1'"), v.where("version = 'v2'")))
