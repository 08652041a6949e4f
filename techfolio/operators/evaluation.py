"""Evaluation: reviewer agreement, confusion, A/B comparison, McNemar, p-value correction, experiments."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .portfolio import percent, ratio
from .ranking import top_per_key


def label_universe(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out.distinct()


def last_label(labels: DataFrame, order: Sequence[Column] = ()) -> DataFrame:
    """One label per award; ``order`` (descending) decides which of several is the last."""
    return top_per_key(labels, ["award_id"], list(order) or [F.desc("label")])


def paired(predictions: DataFrame, labels: DataFrame, prediction: str = "prediction") -> DataFrame:
    """(award_id, predicted, actual) of the awards both sides know; each side unique per award."""
    return predictions.select("award_id", F.col(prediction).alias("predicted")).join(
        labels.select("award_id", F.col("label").alias("actual")), "award_id"
    )


def confusion(pairs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Long confusion table, dense over ``labels`` (label), with zeros; by default over the labels in ``pairs``.

    Pass the labels of both full tables (:func:`label_universe`) to have those outside the overlap as well. The labels
    are those of a taxonomy: they fit one array, from which the grid unfolds.
    """
    counts = pairs.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    if labels is None:
        labels = label_universe(counts.select(F.col("actual").alias("label")), counts.select(F.col("predicted").alias("label")))
    every = labels.agg(F.collect_set("label").alias("every"))
    grid = every.select(F.explode("every").alias("actual"), "every").select("actual", F.explode("every").alias("predicted"))
    return grid.join(counts, ["actual", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(p * r * 2.0, p + r), F.lit(0.0))


def _label_counts(pairs: DataFrame) -> DataFrame:
    """(label, tp, predicted_n, actual_n): every pair gives one row per side, no join."""
    cells = pairs.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    same = F.col("actual") == F.col("predicted")
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("actual").alias("label"), F.when(same, F.col("n")).otherwise(zero).alias("tp"), zero.alias("p"), F.col("n").alias("a")),
        F.struct(F.col("predicted").alias("label"), zero.alias("tp"), F.col("n").alias("p"), zero.alias("a")),
    )
    return cells.select(F.inline(sides)).groupBy("label").agg(
        F.sum("tp").alias("tp"), F.sum("p").alias("predicted_n"), F.sum("a").alias("actual_n")
    )


def label_metrics(pairs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Precision, recall and F1 per label of ``labels`` (label), zeros for those outside the overlap; by default per
    label in ``pairs``."""
    p = ratio(F.col("tp"), F.col("predicted_n"))
    r = ratio(F.col("tp"), F.col("actual_n"))
    counts = _label_counts(pairs)
    if labels is not None:
        counts = labels.select("label").distinct().join(counts, "label", "left").na.fill(0, ["tp", "predicted_n", "actual_n"])
    return counts.select(
        "label", F.col("actual_n").alias("support"), p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1")
    )


def agreement(pairs: DataFrame) -> DataFrame:
    same = F.count_if(F.col("predicted") == F.col("actual"))
    return pairs.agg(
        F.count(F.lit(1)).alias("total_samples"), same.alias("agreement_count"), ratio(same, F.count(F.lit(1))).alias("agreement_rate")
    )


def _both(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    return predictions.select("award_id", "baseline", "enhanced").join(labels.select("award_id", "label"), "award_id")


def chi2_upper_tail(stat: Column) -> Column:
    """P(X > stat) for one degree of freedom, = erfc(sqrt(stat / 2)), by column arithmetic.

    A series where the argument is small, a continued fraction where it is large; both to double precision.
    """
    x = F.sqrt(stat / 2.0)
    x2 = x * x
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        F.struct(x.alias("term"), x.alias("sum")),
        lambda acc, n: F.struct(
            (-acc["term"] * x2 / n).alias("term"),
            (acc["sum"] + (-acc["term"] * x2 / n) / (n * 2 + 1)).alias("sum"),
        ),
        lambda acc: F.lit(1.0) - acc["sum"] * (2.0 / math.sqrt(math.pi)),
    )
    fraction = F.aggregate(
        F.sequence(F.lit(60), F.lit(1)), F.lit(0.0), lambda acc, n: (n / F.lit(2.0)) / (x + acc),
        lambda acc: F.exp(-x2) / ((x + acc) * math.sqrt(math.pi)),
    )
    return F.when(x < 2.0, series).otherwise(fraction)


def mcnemar(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Discordant counts b and c, statistic (continuity-corrected below 25), p-value; 1 without discord."""
    base_ok, enh_ok = F.col("baseline") == F.col("label"), F.col("enhanced") == F.col("label")
    counts = _both(predictions, labels).agg(
        F.count_if(base_ok & ~enh_ok).alias("b"), F.count_if(~base_ok & enh_ok).alias("c")
    )
    n = F.col("b") + F.col("c")
    gap = F.abs(F.col("b") - F.col("c"))
    shift = F.when(n < 25, gap - 1).otherwise(gap)
    stat = F.coalesce(F.try_divide((shift * shift).cast("double"), n.cast("double")), F.lit(0.0))
    return counts.withColumn("statistic", stat).withColumn(
        "p_value", F.when(n == 0, F.lit(1.0)).otherwise(chi2_upper_tail(F.col("statistic")))
    )


def ab_compare(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: both accuracies and their difference."""
    n = F.count(F.lit(1))
    base, enh = (ratio(F.count_if(F.col(c) == F.col("label")), n) for c in ("baseline", "enhanced"))
    return _both(predictions, labels).agg(
        n.alias("sample_size"), base.alias("baseline_accuracy"), enh.alias("enhanced_accuracy"), (enh - base).alias("improvement")
    )


def ab_label_metrics(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Per true label and variant: support, precision, recall, F1. Both variants share one pass over the rows.

    A label that is only predicted has no support and no row; it still counts against the precision of others.
    """
    rows = _both(predictions, labels)
    variants = F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("predicted")) for v in ("baseline", "enhanced")])
    cells = rows.groupBy("label", "baseline", "enhanced").agg(F.count(F.lit(1)).alias("n"))
    long = cells.select(F.col("label").alias("actual"), "n", F.inline(variants))
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(F.col("actual").alias("label"), hit.alias("tp"), zero.alias("p"), F.col("n").alias("a")),
        F.struct(F.col("predicted").alias("label"), zero.alias("tp"), F.col("n").alias("p"), zero.alias("a")),
    )
    sums = long.select("variant", F.inline(sides)).groupBy("variant", "label").agg(
        F.sum("tp").alias("tp"), F.sum("p").alias("p"), F.sum("a").alias("support")
    )
    precision, recall = ratio(F.col("tp"), F.col("p")), ratio(F.col("tp"), F.col("support"))
    true = sums.groupBy("label").agg(F.max("support").alias("s")).filter("s > 0").select("label", F.explode(F.array(F.lit("baseline"), F.lit("enhanced"))).alias("variant"))
    sums = true.join(sums, ["variant", "label"], "left").na.fill(0, ["tp", "p", "support"])
    return sums.select("variant", "label", "support", precision.alias("precision"), recall.alias("recall"), _f1(precision, recall).alias("f1"))


def weighted_metrics(per_label: DataFrame) -> DataFrame:
    """Support-weighted precision, recall and F1 per variant."""
    weight = F.col("support")
    return per_label.groupBy("variant").agg(
        *[(F.sum(F.col(m) * weight) / F.sum(weight)).alias(m) for m in ("precision", "recall", "f1")]
    )


def ab_improvements(weighted: DataFrame) -> DataFrame:
    """One row: weighted precision, recall and F1 of ``enhanced`` less those of ``baseline``."""
    of = lambda variant, m: F.max(F.when(F.col("variant") == variant, F.col(m)))
    return weighted.agg(*[(of("enhanced", m) - of("baseline", m)).alias(f"{m}_improvement") for m in ("precision", "recall", "f1")])


def ab_confusions(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """One confusion table per variant, long and dense over the true labels: (variant, actual, predicted, n)."""
    both = _both(predictions, labels)
    true = both.select("label").distinct()
    parts = [confusion(both.select(F.col(v).alias("predicted"), F.col("label").alias("actual")), true).select(F.lit(v).alias("variant"), "actual", "predicted", "n") for v in ("baseline", "enhanced")]
    return parts[0].unionByName(parts[1])


def category_improvement(per_label: DataFrame) -> DataFrame:
    """F1 of both variants per true label, with absolute and relative change."""
    pick = lambda v: F.max(F.when(F.col("variant") == v, F.col("f1")))
    rows = per_label.groupBy("label").agg(
        F.max("support").alias("support"), pick("baseline").alias("baseline_f1"), pick("enhanced").alias("enhanced_f1")
    )
    change = F.col("enhanced_f1") - F.col("baseline_f1")
    return rows.where(F.col("support") > 0).select(
        "label", "baseline_f1", "enhanced_f1", change.alias("improvement"), ratio(change, F.col("baseline_f1")).alias("relative_improvement")
    )


def correct_p_values(p_values: DataFrame, method: str = "bonferroni", key: str = "test") -> DataFrame:
    """Bonferroni or Holm over a table of (test, p_value). The table holds one row per comparison made."""
    whole = Window.partitionBy()
    n = F.count(F.lit(1)).over(whole)
    p = F.col("p_value")
    if method == "bonferroni":
        return p_values.withColumn("corrected", F.least(p * n, F.lit(1.0)))
    if method != "holm":
        raise ValueError(f"unknown correction: {method}")
    rank = F.row_number().over(Window.partitionBy().orderBy("p_value", key))
    stepped = p_values.withColumn("__r", rank).withColumn("__c", F.least(p * (n - F.col("__r") + 1), F.lit(1.0)))
    running = Window.partitionBy().orderBy("__r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return stepped.withColumn("corrected", F.max("__c").over(running)).drop("__r", "__c")


def experiment_summary(runs: DataFrame) -> DataFrame:
    """Per variant of (variant, score, classification, text_length): mean score, bands, mean text length."""
    n = F.count(F.lit(1))
    mean = lambda c: F.sum(F.col(c).cast("decimal(28,6)")).cast("double") / n
    bands = []
    for b in ("High", "Medium", "Low"):
        hits = F.count_if(F.col("classification") == b)
        bands += [hits.alias(f"{b.lower()}_count"), percent(hits, n).alias(f"{b.lower()}_percent")]
    return runs.groupBy("variant").agg(n.alias("awards"), mean("score").alias("mean_score"), *bands, mean("text_length").alias("mean_text_length"))


def experiment_deltas(summary: DataFrame) -> DataFrame:
    """One row: enriched minus baseline."""
    v = lambda name, c: F.max(F.when(F.col("variant") == name, F.col(c)))
    return summary.agg(
        *[
            (v("enriched", c) - v("baseline", c)).alias(alias)
            for c, alias in (("mean_score", "score_improvement"), ("high_count", "high_conf_improvement"), ("mean_text_length", "text_increase"))
        ]
    )


def latest_report(reports: DataFrame) -> DataFrame:
    """Newest row of an appended report table."""
    return reports.agg(F.max_by(F.struct(*reports.columns), "reported_at").alias("r")).select("r.*")
