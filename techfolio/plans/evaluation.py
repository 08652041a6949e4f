"""Evaluation and export queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import export as ex
from ..session import scratch_path
from .adapters import ALL_YEARS, AREAS, FILTERS, ctes
from .registry import query

_PAIRS = ctes("reviewer", "predictions") + ", pairs AS (SELECT award_id, enhanced AS predicted, baseline, enhanced, label AS actual FROM predictions JOIN reviewer USING (award_id))\n"
_F1 = "coalesce(2 * precision * recall / nullif(precision + recall, 0), 0)"


def _pairs(t):
    return ev.paired(t.predictions, t.reviewer, "enhanced")


@query("j11_predictions_and_labels", _PAIRS + "SELECT award_id, predicted, actual FROM pairs")
def j11(t):
    return ev.paired(t.predictions, ev.last_label(t.reviewer), "enhanced")


@query("a14_agreement", _PAIRS + "SELECT count(*) AS total_samples, count(*) FILTER (predicted = actual) AS agreement_count, CAST(count(*) FILTER (predicted = actual) AS DOUBLE) / count(*) AS agreement_rate FROM pairs")
def a14(t):
    return ev.agreement(_pairs(t))


# labels of all predictions and of all reviewer rows, in the overlap or not
_UNIVERSE = ", universe AS (SELECT enhanced AS label FROM predictions UNION SELECT label FROM reviewer)\n"


def _universe(t):
    return ev.label_universe(t.predictions.select(F.col("enhanced").alias("label")), t.reviewer.select("label"))


def _per_label(pred: str, labels: str) -> str:
    return f"""SELECT label, count(*) FILTER (actual = label) AS support,
  coalesce(CAST(count(*) FILTER (actual = label AND {pred} = label) AS DOUBLE) / nullif(count(*) FILTER ({pred} = label), 0), 0) AS precision,
  coalesce(CAST(count(*) FILTER (actual = label AND {pred} = label) AS DOUBLE) / nullif(count(*) FILTER (actual = label), 0), 0) AS recall
  FROM pairs CROSS JOIN ({labels}) GROUP BY label"""


@query("a14_label_metrics", _PAIRS + _UNIVERSE + f", m AS ({_per_label('predicted', 'SELECT label FROM universe')}) SELECT *, {_F1} AS f1 FROM m")
def a14m(t):
    return ev.label_metrics(_pairs(t), _universe(t))


# the reviewed sources only: predictions of the others carry a label that no pair has
_SOME = _PAIRS.replace("predictions JOIN reviewer USING (award_id)", "predictions JOIN reviewer USING (award_id) WHERE enhanced <> 'other'") + _UNIVERSE


@query("a14_label_metrics_outside_overlap", _SOME + f", m AS ({_per_label('predicted', 'SELECT label FROM universe')}) SELECT *, {_F1} AS f1 FROM m")
def a14o(t):
    return ev.label_metrics(_pairs(t).filter("predicted <> 'other'"), _universe(t))


@query("a15_confusion", _SOME + """
SELECT a.label AS actual, b.label AS predicted, count(p.award_id) AS n FROM universe a CROSS JOIN universe b LEFT JOIN pairs p ON p.actual = a.label AND p.predicted = b.label GROUP BY 1, 2""")
def a15(t):
    return ev.confusion(_pairs(t).filter("predicted <> 'other'"), _universe(t))


@query("a15_a16_confusion_by_variant", _PAIRS + """, l AS (SELECT DISTINCT actual AS label FROM pairs), v AS (SELECT 'baseline' AS variant, actual, baseline AS predicted FROM pairs UNION ALL SELECT 'enhanced', actual, enhanced FROM pairs), n AS (SELECT DISTINCT variant FROM v)
SELECT n.variant, a.label AS actual, b.label AS predicted, count(v.actual) AS n FROM n CROSS JOIN l a CROSS JOIN l b LEFT JOIN v ON v.variant = n.variant AND v.actual = a.label AND v.predicted = b.label GROUP BY 1, 2, 3""")
def a15v(t):
    return ev.ab_confusions(t.predictions, t.reviewer)


@query("a16_ab_comparison", _PAIRS + """, r AS (SELECT count(*) AS n, CAST(count(*) FILTER (baseline = actual) AS DOUBLE) / count(*) AS b, CAST(count(*) FILTER (enhanced = actual) AS DOUBLE) / count(*) AS e FROM pairs)
SELECT n AS sample_size, b AS baseline_accuracy, e AS enhanced_accuracy, e - b AS improvement FROM r""")
def a16(t):
    return ev.ab_compare(t.predictions, t.reviewer)


_AB = _PAIRS + f""", m AS (SELECT 'baseline' AS variant, * FROM ({_per_label('baseline', 'SELECT DISTINCT actual AS label FROM pairs')}) UNION ALL SELECT 'enhanced', * FROM ({_per_label('enhanced', 'SELECT DISTINCT actual AS label FROM pairs')})), ab AS (SELECT *, {_F1} AS f1 FROM m)
"""


@query("a16_label_metrics", _AB + "SELECT * FROM ab")
def a16m(t):
    return ev.ab_label_metrics(t.predictions, t.reviewer)


@query("a16_weighted_metrics", _AB + """
SELECT variant, round(sum(precision * support) / sum(support), 9) AS precision, round(sum(recall * support) / sum(support), 9) AS recall, round(sum(f1 * support) / sum(support), 9) AS f1 FROM ab GROUP BY 1""")
def a16w(t):
    df = ev.weighted_metrics(ev.ab_label_metrics(t.predictions, t.reviewer))
    return df.select("variant", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("a16_improvements", _AB + """, w AS (SELECT variant, sum(precision * support) / sum(support) AS p, sum(recall * support) / sum(support) AS r, sum(f1 * support) / sum(support) AS f FROM ab GROUP BY 1)
SELECT round(e.p - b.p, 9) AS precision_improvement, round(e.r - b.r, 9) AS recall_improvement, round(e.f - b.f, 9) AS f1_improvement FROM w e JOIN w b ON e.variant = 'enhanced' AND b.variant = 'baseline'""")
def a16i(t):
    df = ev.ab_improvements(ev.weighted_metrics(ev.ab_label_metrics(t.predictions, t.reviewer)))
    return df.select(*[F.round(c, 9).alias(c) for c in df.columns])


# The p-value needs erfc, which the SQL engine lacks; the counts and the statistic are compared.
@query("a17_mcnemar", _PAIRS + """, d AS (SELECT count(*) FILTER (baseline = actual AND enhanced <> actual) AS b, count(*) FILTER (baseline <> actual AND enhanced = actual) AS c FROM pairs)
SELECT b, c, coalesce(CAST(CASE WHEN b + c < 25 THEN (abs(b - c) - 1) ** 2 ELSE (b - c) ** 2 END AS DOUBLE) / nullif(b + c, 0), 0) AS statistic FROM d""")
def a17(t):
    return ev.mcnemar(t.predictions, t.reviewer).drop("p_value")


@query("a17_mcnemar_p_value")
def a17p(t):
    return ev.mcnemar(t.predictions, t.reviewer)


@query("a18_category_improvement", _AB + """
SELECT label, b AS baseline_f1, e AS enhanced_f1, e - b AS improvement, CASE WHEN b > 0 THEN (e - b) / b ELSE 0 END AS relative_improvement
FROM (SELECT label, max(f1) FILTER (variant = 'baseline') AS b, max(f1) FILTER (variant = 'enhanced') AS e, max(support) AS s FROM ab GROUP BY 1) WHERE s > 0""")
def a18(t):
    return ev.category_improvement(ev.ab_label_metrics(t.predictions, t.reviewer))


_PVALUES = "pv AS (SELECT event_type AS test, (count(*) FILTER (value > 50) % 97) / 1000.0::DOUBLE AS p_value FROM events GROUP BY 1)"


def _p_values(t):
    n = F.count_if(F.col("value") > 50)
    return t.raw("events").groupBy(F.col("event_type").alias("test")).agg(((n % 97) / F.lit(1000.0)).alias("p_value"))


@query("a19_bonferroni", f"WITH {_PVALUES}\nSELECT test, p_value, least(1.0, p_value * count(*) OVER ()) AS corrected FROM pv")
def a19(t):
    return ev.correct_p_values(_p_values(t))


@query("a19_w11_holm", f"""WITH {_PVALUES}, r AS (SELECT *, row_number() OVER (ORDER BY p_value, test) AS i, count(*) OVER () AS n FROM pv)
SELECT test, p_value, max(least(1.0, p_value * (n - i + 1))) OVER (ORDER BY i) AS corrected FROM r""")
def a19h(t):
    return ev.correct_p_values(_p_values(t), "holm")


_RUNS = """runs AS (SELECT 'baseline' AS variant, CAST(n_chars % 101 AS DOUBLE) AS score, n_chars AS text_length FROM documents
  UNION ALL SELECT 'enriched', CAST((n_chars * 7) % 101 AS DOUBLE), n_chars + 40 FROM documents),
r AS (SELECT *, CASE WHEN score >= 70 THEN 'High' WHEN score >= 40 THEN 'Medium' ELSE 'Low' END AS c FROM runs),
summary AS (SELECT variant, count(*) AS awards, CAST(sum(CAST(score AS DECIMAL(28,6))) AS DOUBLE) / count(*) AS mean_score, """ + ", ".join(
    f"count(*) FILTER (c = '{b}') AS {b.lower()}_count, CAST(count(*) FILTER (c = '{b}') AS DOUBLE) / count(*) * 100 AS {b.lower()}_percent" for b in ("High", "Medium", "Low")
) + ", CAST(sum(CAST(text_length AS DECIMAL(28,6))) AS DOUBLE) / count(*) AS mean_text_length FROM r GROUP BY 1)"


def _runs(t):
    from ..functions.text import band

    n = F.col("n_chars")
    one = lambda name, score, length: t.raw("documents").select(
        F.lit(name).alias("variant"), score.cast("double").alias("score"), length.alias("text_length")
    )
    both = one("baseline", n % 101, n).unionByName(one("enriched", (n * 7) % 101, n + 40))
    return both.withColumn("classification", band(F.col("score")))


@query("a24_experiment_summary", f"WITH {_RUNS}\nSELECT * FROM summary")
def a24(t):
    return ev.experiment_summary(_runs(t))


@query("a24_experiment_deltas", f"""WITH {_RUNS}
SELECT e.mean_score - b.mean_score AS score_improvement, e.high_count - b.high_count AS high_conf_improvement, e.mean_text_length - b.mean_text_length AS text_increase
FROM summary e, summary b WHERE e.variant = 'enriched' AND b.variant = 'baseline'""")
def a24d(t):
    return ev.experiment_deltas(ev.experiment_summary(_runs(t)))


@query("w14_latest_report", _PAIRS + """
SELECT TIMESTAMP '2024-02-01 00:00:00' AS reported_at, count(*) AS total_samples, count(*) FILTER (enhanced = actual) AS agreement_count, CAST(count(*) FILTER (enhanced = actual) AS DOUBLE) / count(*) AS agreement_rate FROM pairs""")
def w14(t):
    path = scratch_path(t.spark, "agreement-reports")
    for day, column in (("2024-02-01", "enhanced"), ("2024-01-01", "baseline")):
        report = ev.agreement(ev.paired(t.predictions, t.reviewer, column)).withColumn("reported_at", F.lit(day).cast("timestamp_ntz"))
        report.write.mode("append").parquet(path)
    return ev.latest_report(t.spark.read.parquet(path))


# --- export ----------------------------------------------------------------------------------
_WEIGHTS = ", ".join(
    f"CASE WHEN list_contains(supporting_cet_ids, '{a}') THEN 0.4::DOUBLE / len(supporting_cet_ids) WHEN primary_cet_id = '{a}' THEN CASE WHEN len(supporting_cet_ids) > 0 THEN 0.6 ELSE 1.0 END ELSE 0.0 END::DOUBLE AS \"weight_{a}\""
    for a in AREAS
)
_EXPORT = f"SELECT award_id, agency, award_amount, primary_cet_id, score, {_WEIGHTS} FROM classified WHERE NOT is_export_controlled"
_EXPORT_COLS = ["award_id", "agency", "award_amount", "primary_cet_id", "score", *[f"weight_{a}" for a in AREAS]]


@query("f9_export_control", ctes("classified") + "SELECT award_id, agency, award_amount FROM classified WHERE NOT is_export_controlled")
def f9(t):
    from ..operators.portfolio import classified

    return ex.without_controlled(classified(t.awards, t.assessments, FILTERS)).select("award_id", "agency", "award_amount")


@query("f9_controlled_count", ctes("awards") + "SELECT count(*) FILTER (is_export_controlled) AS controlled_awards_excluded FROM awards")
def f9c(t):
    return ex.controlled_count(t.awards)


@query("m28_export_weights", ctes("classified") + _EXPORT.replace(" WHERE NOT is_export_controlled", ""))
def m28(t):
    from ..operators.portfolio import classified

    return ex.weights(classified(t.awards, t.assessments, FILTERS), AREAS).select(*_EXPORT_COLS)


@query("m29_export", ctes("classified") + _EXPORT)
def m29(t):
    return ex.build(t.awards, t.assessments, AREAS, FILTERS)[0].select(*_EXPORT_COLS)


_META = """SELECT count(*) FILTER (is_export_controlled) AS controlled_awards_excluded, count(*) FILTER (NOT is_export_controlled) AS exported_awards,
  (SELECT taxonomy_version FROM (SELECT taxonomy_version, count(*) AS n FROM classified WHERE NOT is_export_controlled AND taxonomy_version IS NOT NULL GROUP BY 1) ORDER BY n DESC, taxonomy_version LIMIT 1) AS taxonomy_version,
  'USD' AS currency FROM classified"""


@query("m29_export_metadata", ctes("classified") + _META)
def m29m(t):
    return ex.build(t.awards, t.assessments, AREAS, FILTERS)[1]


@query("s8_export_csv", ctes("classified") + "SELECT award_id, agency, CAST(award_amount AS DOUBLE) AS award_amount, primary_cet_id FROM classified WHERE NOT is_export_controlled")
def s8(t):
    rows, record = ex.build(t.awards, t.assessments, AREAS, FILTERS)
    path = scratch_path(t.spark, "export")
    ex.write(rows, record, path, "csv")
    back = t.spark.read.csv(f"{path}/rows", header=True, quote='"', escape='"')
    return back.select("award_id", "agency", F.col("award_amount").cast("double").alias("award_amount"), "primary_cet_id")


@query("s8_export_parquet_metadata", ctes("classified") + _META)
def s8m(t):
    rows, record = ex.build(t.awards, t.assessments, AREAS, FILTERS)
    path = scratch_path(t.spark, "export")
    ex.write(rows, record, path)
    return t.spark.read.schema(record.schema).json(f"{path}/metadata")


@query("s8_export_parquet", ctes("classified") + _EXPORT)
def s8p(t):
    rows, record = ex.build(t.awards, t.assessments, AREAS, FILTERS)
    path = scratch_path(t.spark, "export")
    ex.write(rows, record, path)
    return t.spark.read.parquet(f"{path}/rows").select(*_EXPORT_COLS)


_MANIFEST = ctes("classified_all") + "SELECT count(*) AS row_count, count(score) AS score_count, count(primary_cet_id) AS primary_cet_id_count, '0.3' AS hybrid_weight FROM classified_all"


@query("s9_run_manifest", _MANIFEST)
def s9(t):
    from ..operators.portfolio import classified

    rows = classified(t.awards, t.assessments, ALL_YEARS)
    path = scratch_path(t.spark, "manifests")
    record = ex.run_manifest(rows, ["score", "primary_cet_id"], {"hybrid_weight": "0.3"})
    ex.append_manifest(record, path)
    return t.spark.read.schema(record.schema).json(path)


@query("s9_observed_manifest", _MANIFEST)
def s9o(t):
    from ..operators.portfolio import classified

    path = scratch_path(t.spark, "observed")
    record = ex.write_observed(classified(t.awards, t.assessments, ALL_YEARS), path, ["score", "primary_cet_id"], {"hybrid_weight": "0.3"})
    return t.spark.read.schema(record.schema).json(f"{path}/manifests")
