from __future__ import annotations

import datetime as dt
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from techfolio.operators import awardees as aw
from techfolio.operators import classifier as cf
from techfolio.operators import evaluation as ev
from techfolio.operators import features as ft
from techfolio.operators import taxonomy as tax

D = dt.date


@pytest.fixture(scope="module")
def history(spark):
    return spark.createDataFrame(
        [("U", 250000.0, D(2020, 1, 1), "NSF", "Completed"), ("U", 500000.0, D(2022, 1, 1), "DOD", "Active"), ("U", 150000.0, D(2019, 1, 1), "NIH", "Terminated")],
        "uei string, award_amount double, start_date date, funding_agency string, award_status string",
    )


def test_awardee_metrics(history):
    r = aw.metrics(history).first()
    assert (r.total_awards, r.total_funding, r.avg_award_amount, r.primary_agencies) == (3, 900000.0, 300000.0, ["DOD", "NIH", "NSF"])
    assert r.success_rate == pytest.approx(2 / 3)
    assert (r.small_awards, r.medium_awards, r.large_awards, r.first_award_date, r.last_award_date) == (0, 3, 0, D(2019, 1, 1), D(2022, 1, 1))


def test_trend_and_diversity(spark):
    df = spark.createDataFrame([("U", 100000.0, D(2020, 1, 1), "NSF"), ("U", 200000.0, D(2021, 1, 1), "NSF"), ("U", 300000.0, D(2022, 1, 1), "DOD"), ("U", 1.0, None, "NIH")],
                               "uei string, award_amount double, start_date date, funding_agency string")
    r = aw.trend(df).first()
    assert (r.trend, r.total_growth, round(r.years_span, 4)) == ("increasing", 200000.0, 2.0014)
    d = aw.diversity(df).first()
    assert (d.unique_agencies, d.diversity_score, d.agency_distribution["NSF"]) == (3, 0.75, 2)


def test_risk(spark, history):
    r = {x.uei: x for x in aw.risk(history, F.lit(D(2025, 1, 1)), spark.createDataFrame([("U",), ("V",)], "uei string")).collect()}
    assert r["U"].risk_score == pytest.approx(1 / 3 * 0.5 + 0.3) and len(r["U"].recommendations) == 2
    assert r["U"].risk_factors[0] == "Award termination rate: 33.3%"
    assert (r["V"].risk_score, r["V"].risk_factors) == (1.0, ["No award history"])


def test_profile_findings(spark):
    df = spark.createDataFrame(
        [("ABC-23", "Test", 60, 100.0, 0.99, 50.0, D(1970, 1, 1), D(1969, 1, 1), ["ZZZ"], [])],
        "uei string, legal_name string, total_awards long, total_funding double, success_rate double, avg_award_amount double, first_award_date date, last_award_date date, primary_agencies array<string>, technology_areas array<string>",
    )
    r = aw.validate_profiles(df, F.lit(D(2025, 1, 1))).first()
    messages = {f.message for f in r.findings}
    assert not r.is_valid
    assert {"UEI must be 12 characters long", "UEI must contain only alphanumeric characters", "Business name appears to be a placeholder",
            "First award date cannot be after last award date", "First award date is unusually old", "Unknown agency code: ZZZ",
            "No technology areas specified", "Very high success rate with many awards is unusual"} <= messages


CASES = {
    "sample": ("AAABABAAAB", "ABABABABAB", "AAABABAAAB", 0.8, 1.0, 0, 2, 0.479500),
    "improvement": ("ABBAABBAAB", "AABBAABBAA", "ABBAABBAAB", 0.5, 1.0, 0, 5, 0.073638),
    "no change": ("ABAB", "ABBB", "ABBB", 0.75, 0.75, 0, 0, 1.0),
}


@pytest.mark.parametrize("case", CASES)
def test_ab_cases(spark, case):
    label, base, enh, acc0, acc1, b, c, p = CASES[case]
    rows = [(str(i), *x) for i, x in enumerate(zip(label, base, enh))]
    labels = spark.createDataFrame([(i, y) for i, y, _, _ in rows], "award_id string, label string")
    preds = spark.createDataFrame([(i, x, z) for i, _, x, z in rows], "award_id string, baseline string, enhanced string")
    r = ev.ab_compare(preds, labels).first()
    assert (r.baseline_accuracy, r.enhanced_accuracy) == pytest.approx((acc0, acc1))
    m = ev.mcnemar(preds, labels).first()
    assert (m.b, m.c) == (b, c) and m.p_value == pytest.approx(p, abs=1e-6)


def test_chi2_tail_equals_erfc(spark):
    stats = [0.0, 1e-6, 0.5, 3.2, 7.9, 8.1, 20.0, 100.0]
    df = spark.createDataFrame([(s,) for s in stats], "s double").select("s", ev.chi2_upper_tail(F.col("s")).alias("p"))
    for r in df.collect():
        assert r.p == pytest.approx(math.erfc(math.sqrt(r.s / 2)), rel=1e-9, abs=1e-15)


def test_p_value_corrections(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "test string, p_value double")
    get = lambda m: {r.test: r.corrected for r in ev.correct_p_values(df, m).collect()}
    assert get("bonferroni") == pytest.approx({"a": 0.03, "b": 0.12, "c": 0.09})
    assert get("holm") == pytest.approx({"a": 0.03, "b": 0.06, "c": 0.06})


def test_taxonomy_diff(spark):
    df = lambda rows: spark.createDataFrame(rows, "cet_id string, name string, definition string")
    old, new = df([("a", "A", "x"), ("b", "B", None), ("c", "C", "z")]), df([("a", "A", "x"), ("b", "B", "y"), ("d", "D", "w")])
    assert {r.cet_id: r.change for r in tax.diff(old, new).collect()} == {"b": "modified", "c": "removed", "d": "added"}


@pytest.fixture(scope="module")
def examples(spark):
    words = {"quantum": "qubit gate entangled photon", "energy": "battery solar grid charge", "bio": "gene protein cell enzyme"}
    rows = []
    for i in range(90):
        label = ("quantum", "energy", "bio")[i % 3]
        w = words[label].split()
        rows.append((f"k{i:03d}", f"the {w[i % 4]} {w[(i // 3) % 4]} research {w[(i + 1) % 4]} study{i % 5}", label))
    return spark.createDataFrame(rows, "key string, text string, label string")


def test_tfidf_vectors_equal_the_long_form(spark, examples):
    cfg = ft.TextConfig(ngrams=(1, 2), max_features=100)
    vec = ft.fit_vectoriser(examples, cfg)
    vocab = ft.vocabulary(ft.term_statistics(examples, cfg), 90, cfg)
    long = {(r.key, r.term): r.weight for r in ft.tfidf_rows(ft.term_counts(examples, cfg), vocab).collect()}
    for r in vec.transform(examples).select("key", "features").collect():
        got = {(r.key, vec.names[i]): v for i, v in zip(r.features.indices.tolist(), r.features.values.tolist())}
        assert got == pytest.approx({k: v for k, v in long.items() if k[0] == r.key})
    assert not any("research" in n for n in vec.names)
    chi = {r.term: r.chi2 for r in ft.chi2_rows(ft.tfidf_rows(ft.term_counts(examples, cfg), vocab), examples).collect()}
    labelled = vec.transform(examples)
    assert dict(zip(vec.names, ft.chi2_vector(labelled).tolist())) == pytest.approx(chi)


def test_calibrated_classifier_separates_classes(spark, examples):
    cfg = cf.ModelConfig(text=ft.TextConfig(ngrams=(1, 2), max_features=100, select=30), max_iter=50)
    model = cf.fit(examples, cfg)
    assert model.calibrated and len(model.vectoriser.feature_names()) == 30
    out = {r.key: r for r in model.predict(examples).collect()}
    labels = {r.key: r.label for r in examples.collect()}
    assert sum(out[k].primary_cet_id == labels[k] for k in labels) >= 86
    assert all(len(r.supporting_cet_ids) == 2 and r.primary_cet_id not in r.supporting_cet_ids for r in out.values())
    sums = model.probabilities(examples).select(F.aggregate("probabilities", F.lit(0.0), lambda a, x: a + x).alias("s")).collect()
    assert all(r.s == pytest.approx(1.0) for r in sums)


def test_multi_source_names_and_budget(spark, examples):
    rows = examples.select("key", "label", F.col("text").alias("abstract"), F.col("label").alias("keywords"), F.lit("").alias("solicitation"))
    assert cf.split_budget(10, ["a", "b", "c"]) == {"a": 4, "b": 3, "c": 3}
    with pytest.raises(ValueError, match="sum to 1"):
        cf.fit_multi_source(rows, {"abstract": 0.5, "keywords": 0.2})
    model = cf.fit_multi_source_model(rows, {"abstract": 0.6, "keywords": 0.4}, max_features=60, max_iter=30)
    assert {n.split("_")[0] for n in model.sources.feature_names()} == {"abstract", "keywords"}
    top = {r.key: r.cet_id for r in model.top(rows, 1).collect()}
    assert top == {r.key: r.label for r in examples.collect()}
    best = model.importance(spark).orderBy(F.desc("importance")).first()
    assert best.feature.startswith("keywords_")


def test_experiment_splits_in_order(spark, examples):
    train, test = cf.ordered_split(examples, "key", 50)
    assert (train.count(), test.count()) == (45, 45)
    assert train.agg(F.max("key")).first()[0] < test.agg(F.min("key")).first()[0]


def test_every_class_of_three_is_in_every_training_part(spark):
    rows = [(f"{s}-{label}-{k}", float(label), s) for s in range(60) for label, n in ((0, 11), (1, 7), (2, 3)) for k in range(n)]
    df = spark.createDataFrame(rows, "key string, label_index double, s int")
    for s in range(0, 60, 12):
        part = cf.stratified_folds(df.where(f"s = {s}"), 3).collect()
        for label, n in ((0, 11), (1, 7), (2, 3)):
            sizes = sorted(sum(r["fold"] == f and r["label_index"] == label for r in part) for f in range(3))
            assert sum(sizes) == n and sizes[-1] - sizes[0] <= 1


def test_calibration_equals_a_separate_fit(spark):
    import math
    import random

    rng = random.Random(4)
    rows = [(f, float(c), [rng.gauss(1.5 if c == k else -1.0, 1.0) for k in range(3)]) for f in range(2) for c in range(3) for _ in range(40)]
    df = spark.createDataFrame(rows, "fold int, label_index double, margins array<double>")
    sizes = {(f, p): (40, 80) for f in range(2) for p in range(3)}
    got = cf._platt(df, [(p, p) for p in range(3)], sizes)
    for (f, p), (slope, offset) in got.items():
        high, low = 41 / 42, 1 / 82
        g1 = g0 = 0.0
        for fold, c, m in rows:
            if fold == f:
                q = 1 / (1 + math.exp(-(slope * m[p] + offset)))
                t = high if c == p else low
                g1 += (q - t) * m[p]
                g0 += q - t
        assert abs(g1) < 1e-6 and abs(g0) < 1e-6 and slope > 0


def test_terms_are_counted_inside_their_text(spark):
    rows = spark.createDataFrame([("1", "beta alpha beta alpha beta"), ("2", ""), ("3", None), ("4", "x"), ("5", "alpha")], "key string, text string")
    cfg = ft.TextConfig(ngrams=(1, 2), stop_words=(), max_features=None)
    counts = ft.term_counts(rows, cfg)
    assert {(r.key, r.term): r.n for r in counts.collect()} == {
        ("1", "alpha"): 2, ("1", "beta"): 3, ("1", "alpha beta"): 2, ("1", "beta alpha"): 2, ("5", "alpha"): 1}
    assert {r.term: (r.tf, r.df) for r in ft.term_statistics(rows, cfg).collect()} == {"alpha": (3, 2), "beta": (3, 1), "alpha beta": (2, 1), "beta alpha": (2, 1)}
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert exchanges(counts) == 0
    # the statistics, the counts to their term, the weights back to their key
    vocab = ft.vocabulary(ft.statistics_of(counts), 5, cfg).hint("merge")
    assert exchanges(ft.tfidf_rows(counts, vocab)) <= 3


def _written(spark, df):
    """Records that the stages of a run write for shuffles."""
    context, gateway = spark.sparkContext, spark.sparkContext._gateway
    group = f"written-{id(df)}"
    context.setJobGroup(group, group)
    rows = df.collect()
    context.setLocalProperty("spark.jobGroup.id", None)
    tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
    context._jsc.sc().listenerBus().waitUntilEmpty()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    none = gateway.new_array(gateway.jvm.double, 0)
    found = [store.stageData(s, False, gateway.jvm.java.util.ArrayList(), False, none) for s in stages]
    return rows, sum(x.apply(i).shuffleWriteRecords() for x in found for i in range(x.size()))


def test_only_the_longest_terms_of_a_text_travel(spark):
    text = " ".join(f"w{i}" for i in range(1000))
    rows, written = _written(spark, ft.term_statistics(spark.createDataFrame([("1", text), ("2", "")], "key string, text string"), ft.TextConfig(max_features=None)))
    assert len(rows) == 2997 and all((r.tf, r.df) == (1, 1) for r in rows)
    # one for each word, and each word once more
    assert written <= 2000


@pytest.mark.parametrize("ngrams", [(1, 1), (1, 2), (1, 3), (2, 3), (2, 2), (1, 4), (3, 4)])
def test_term_statistics_equal_brute_force(spark, ngrams):
    texts = ["a1 a1 a1 a1", "a1 a1b a1 a1b", "a1b", "", None, "a1 a1b", "b2 a1 a1b c3 a1 a1b", "_a a1 _a a1 _a", "é1 zz é1 zz é1 zz", "A1 A1B", "x small b2 a1"]
    cfg = ft.TextConfig(ngrams=ngrams, stop_words=("small",), max_features=None)
    tf, df = Counter(), Counter()
    for text in texts:
        words = [w for w in (text or "").lower().split() if w not in cfg.stop_words and len(w) > 1]
        found = Counter(" ".join(words[i : i + n]) for n in range(ngrams[0], ngrams[1] + 1) for i in range(len(words) - n + 1))
        tf.update(found)
        df.update(found.keys())
    rows = ft.term_statistics(spark.createDataFrame(list(enumerate(texts)), "key int, text string"), cfg).collect()
    assert len(rows) == len(tf) and {r.term: (r.tf, r.df) for r in rows} == {t: (tf[t], df[t]) for t in tf}


def test_risk_keeps_the_history_beside_the_named(spark, history):
    rows = history.unionByName(history.limit(1).withColumn("uei", F.lit(None).cast("string")))
    named = spark.createDataFrame([("U",), ("V",)], "uei string")
    extra = spark.createDataFrame([("V",), ("V",)], "uei string")
    at = F.lit(D(2025, 1, 1))
    want = sorted(aw.risk(rows, at, named).collect())
    assert sorted(aw.risk(rows, at, extra, keep_history=True).collect()) == want
    assert [r.uei for r in aw.risk(rows, at, extra).collect()] == ["V"]


def test_risk_reads_the_history_once_and_sorts_no_lines(spark):
    from techfolio.plans import all as _all  # noqa: F401
    from techfolio.plans.adapters import Tables
    from techfolio.plans.registry import QUERIES

    query = QUERIES["a13_risk"](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    assert query.optimizedPlan().toString().count("Relation [l_orderkey") == 1
    plan = Tables(spark, "/root/testdata/sf0.001").history.select("uei", "funding_agency")._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [l_orderkey" in plan and "ShuffledHashJoin [l_partkey" in plan and "SortMergeJoin" not in plan


def test_experiment_finds_its_training_rows_once(spark):
    rows = [(f"k{i:03}", "ab"[i % 2], f"{'alpha beam' if i % 2 else 'gamma cell'} text{i % 5} report") for i in range(20)]
    rows += [("k900", "a", "gamma cell report"), ("k900", "b", "alpha beam report, a longer one")]
    df = spark.createDataFrame(rows, "key string, label string, baseline_text string").withColumn("enriched_text", F.concat("baseline_text", F.lit(" more")))
    train, test = cf.ordered_split(df, "key", 10)
    assert "Sort" not in train._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.key for r in train.collect()) == [f"k{i:03}" for i in range(10)] and test.count() == 12
    small = cf.ModelConfig(text=ft.TextConfig(select=None), calibrate=False)
    runs = cf.run_experiment(df, small, 10)
    # a repeated key keeps one row each, with its own length
    lengths = sorted((r.variant, r.text_length) for r in runs.where("key = 'k900'").collect())
    assert lengths == [("baseline", 17), ("baseline", 31), ("enriched", 22), ("enriched", 36)]


def test_weights_need_no_vocabulary_and_no_term_travels(spark):
    rows = [("1", "beta alpha beta gamma", "x"), ("2", "alpha beta", "y"), ("2", "gamma delta alpha", "x"), ("2", "alpha beta", None), (None, "alpha beta gamma", "x"), (None, None, "y"),
            ("3", "", "x"), ("4", "zeta", "y"), ("5", "Alpha ALPHA beta", "y"), ("5", "delta alpha", "y")]
    texts = spark.createDataFrame(rows, "key string, text string, label string")
    cfg = ft.TextConfig(ngrams=(1, 3), stop_words=(), max_features=None)
    old = ft.tfidf_rows(ft.term_counts(texts, cfg), ft.vocabulary(ft.term_statistics(texts, cfg), len(rows), cfg))
    plain = lambda df: sorted((str(r.key), r.term, round(r.weight, 9)) for r in df.collect())
    got = ft.weighted_rows(texts, cfg, len(rows))
    assert plain(got) == plain(old) and len(plain(got)) > 20
    chi = lambda df: {r.term: round(r.chi2, 9) for r in df.collect()}
    assert chi(ft.chi2_labelled(ft.weighted_rows(texts, cfg, len(rows), "label"), texts)) == chi(ft.chi2_rows(old, texts))
    # the rows of a text and the answers of a task to it: no row travels for each of its terms but the question
    many = spark.createDataFrame([(str(k), " ".join(f"w{i}" for i in range(300))) for k in range(4)], "key string, text string")
    wide = ft.TextConfig(ngrams=(1, 1), stop_words=(), max_features=None, max_df=1.0)
    rows, written = _written(spark, ft.weighted_rows(many, wide, 4))
    # a question each, four texts, and to each text one answer of every task that counts (twice the four of the session)
    assert len(rows) == 1200 and written <= 1200 + 4 + 4 * 8


def test_few_terms_reach_the_driver_whatever_the_tasks(spark):
    rows = [(f"t{i:05}", 1 + (i % 3 if i % 50 else 900 + i % 7), 2) for i in range(6000)]
    stats = spark.createDataFrame(rows, "term string, tf bigint, df bigint").repartition(24)
    for k in (1, 25, 121, 3000, 9000):
        cfg = ft.TextConfig(max_features=k, max_df=1.0)
        want = sorted(rows, key=lambda r: (-r[1], r[0]))[:k]
        assert ft.frequent_candidates(stats, k).count() <= 4 * k
        assert sorted((r.term, r.tf, r.df) for r in ft.vocabulary(stats, 100, cfg).collect()) == sorted(want)
    assert ft.vocabulary(stats.where("df > 2"), 100, cfg).count() == 0


def test_the_points_of_past_steps_are_given_back(spark, monkeypatch):
    from pyspark.core.broadcast import Broadcast

    gone, destroy = [], Broadcast.destroy
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a, **b: (gone.append(1), destroy(self, *a, **b)))
    rows = spark.createDataFrame([(f"k{i}", "alpha beam" if i % 2 else "gamma cell", "ab"[i % 2]) for i in range(12)], "key string, text string, label string")
    model = cf.fit(rows, cf.ModelConfig(text=ft.TextConfig(select=None), calibrate=False))
    assert len(gone) >= model.fits[0].steps > 0


def test_experiment_trains_on_the_whole_first_half(spark):
    rows = [(f"k{i:03}", "ab"[i % 2], f"{'alpha beam' if i % 2 else 'gamma cell'} text{i % 5} report") for i in range(200)]
    rows += [("k099", "a", "gamma cell report, the last of the half"), (None, "b", "alpha beam")]
    df = spark.createDataFrame(rows, "key string, label string, baseline_text string").repartition(7).withColumn("enriched_text", F.concat("baseline_text", F.lit(" more")))
    train, test = cf.ordered_split(df)
    # both rows of k099 stay together, no row is lost
    assert sorted(str(r.key) for r in train.collect()) == sorted(["None", "k099", *[f"k{i:03}" for i in range(100)]])
    assert sorted(r.key for r in test.collect()) == [f"k{i:03}" for i in range(100, 200)]
    for place in (1, 2, 50, 101, 202):
        assert cf.value_at(df, "key", place).first()[0] == sorted([r[0] for r in rows], key=lambda x: x or "")[place - 1]
    runs = cf.run_experiment(df, cf.ModelConfig(text=ft.TextConfig(select=None), calibrate=False))
    assert {r.variant: r.n for r in runs.groupBy("variant").agg(F.count("*").alias("n")).collect()} == {"baseline": 100, "enriched": 100}
    one = spark.createDataFrame(rows[:1], "key string, label string, baseline_text string")
    assert [x.count() for x in cf.ordered_split(one)] == [0, 1]
