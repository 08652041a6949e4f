from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from techfolio.operators import export, ingest
from techfolio.operators import portfolio as pf
from techfolio.operators.ranking import exact_percentiles, top_per_key

D = dt.date
TS = dt.datetime
AWARDS = "award_id string, agency string, phase string, firm_state string, award_amount double, award_date date, fiscal_year int, abstract string, keywords array<string>, is_export_controlled boolean"
ASSESS = "assessment_id string, award_id string, taxonomy_version string, score double, classification string, primary_cet_id string, supporting_cet_ids array<string>, generation_method string, assessed_at timestamp"


@pytest.fixture(scope="module")
def awards(spark):
    return spark.createDataFrame(
        [
            ("AF123", "AF", "I", "OH", 150000.0, D(2023, 6, 1), 2023, "Propulsion advances.", ["hypersonic"], False),
            ("NAV456", "NAVY", "II", "CA", 900000.0, D(2023, 9, 15), 2023, None, [], False),
            ("AF789", "AF", "II", "OH", 350000.0, D(2024, 1, 10), 2024, "Advanced TPS materials.", ["thermal"], True),
        ],
        AWARDS,
    )


@pytest.fixture(scope="module")
def assessments(spark):
    return spark.createDataFrame(
        [
            ("0", "AF123", "NSTC-2025Q1", 10.0, "Low", "quantum_sensing", [], "automated", TS(2023, 1, 2)),
            ("9", "AF123", "NSTC-2025Q1", 99.0, "High", "quantum_sensing", [], "automated", None),
            ("1", "AF123", "NSTC-2025Q1", 88.0, "High", "hypersonics", ["thermal"], "automated", TS(2024, 1, 2)),
            ("2", "NAV456", "NSTC-2025Q1", 62.0, "Medium", "quantum_sensing", [], "manual_review", TS(2024, 1, 3)),
        ],
        ASSESS,
    )


@pytest.fixture(scope="module")
def taxonomy(spark):
    return spark.createDataFrame([("hypersonics", "Hypersonics"), ("quantum_sensing", "Quantum Sensing")], "cet_id string, name string")


@pytest.fixture(scope="module")
def queue(spark):
    return spark.createDataFrame(
        [("q1", "NAV456", "missing_text", "pending", TS(2024, 2, 5), D(2026, 3, 31))],
        "queue_id string, award_id string, reason string, status string, opened_at timestamp, due_by date",
    )


def test_summary_of_filtered_awards(awards, assessments, taxonomy):
    f = pf.Filters(2023, 2023, agencies=("AF", "NAVY"))
    total = pf.totals(awards, assessments, f).first()
    assert (total.awards, total.percent_classified) == (2, 100.0)
    rows = {r.cet_id: r for r in pf.cet_summary(awards, assessments, taxonomy, f).collect()}
    h = rows["hypersonics"]
    assert (h.awards, h.high, h.share_of_awards, h.top_award_id, h.name) == (1, 1, 50.0, "AF123", "Hypersonics")


def test_summary_counts_unclassified_in_shares(awards, assessments, taxonomy):
    f = pf.Filters(2023, 2024)
    assert pf.totals(awards, assessments, f).first().percent_classified == pytest.approx(66.67, abs=0.01)
    assert all(r.share_of_awards == pytest.approx(33.33, abs=0.01) for r in pf.cet_summary(awards, assessments, taxonomy, f).collect())


def test_summary_of_nothing(awards, assessments, taxonomy):
    f = pf.Filters(2025, 2025)
    t = pf.totals(awards, assessments, f).first()
    assert (t.awards, t.obligated_usd, t.percent_classified) == (0, 0.0, 0.0)
    assert pf.cet_summary(awards, assessments, taxonomy, f).count() == 0


def test_null_assessment_time_loses(assessments):
    assert {r.award_id: r.assessment_id for r in pf.latest_assessments(assessments).collect()} == {"AF123": "1", "NAV456": "2"}


def test_ranked_list_and_queue(awards, assessments, taxonomy, queue):
    m = pf.merged(awards, assessments, taxonomy, queue, pf.Filters(2023, 2024), F.lit(D(2025, 1, 1)))
    rows = pf.award_page(m, 1, 10).collect()
    assert [r.award_id for r in rows] == ["AF123", "NAV456", "AF789"]
    assert {r.award_id: r.data_incomplete for r in rows} == {"AF123": False, "NAV456": True, "AF789": False}
    assert [r.award_id for r in pf.award_page(m, 2, 2).collect()] == ["AF789"]
    info = pf.page_info(m, 2, 2).first()
    assert (info.total_pages, info.total_records) == (2, 3)


@pytest.mark.parametrize("as_of, status", [(D(2026, 3, 31), "pending"), (D(2026, 4, 1), "escalated")])
def test_queue_escalates_after_due_date(queue, as_of, status):
    assert pf.open_queue(queue, F.lit(as_of)).first().status == status


def test_gaps(awards, assessments, taxonomy, queue):
    m = pf.merged(awards, assessments, taxonomy, queue, pf.Filters(2023, 2024), F.lit(D(2025, 1, 1)))
    rows = {(r.cet_id, r.metric): r for r in pf.gaps(pf.cet_detail(m), {"hypersonics": 0.8}).collect()}
    g = rows["hypersonics", "share_vs_target"]
    assert (round(g.current_value, 2), g.target_value) == (33.33, 80.0)
    assert "trails the 80% target by 46.67 percentage points" in g.narrative
    assert ("hypersonics", "pending_manual_reviews") not in rows
    assert rows["quantum_sensing", "pending_manual_reviews"].narrative.startswith("1 award in Quantum Sensing require")


def test_queue_events_fold_to_state(spark):
    events = spark.createDataFrame(
        [
            ("q", "A", "conflict", "pending", None, TS(2024, 1, 1), D(2024, 2, 1), TS(2024, 1, 1), None),
            ("q", "A", "conflict", "in_review", "kim", TS(2024, 1, 1), D(2024, 2, 1), TS(2024, 1, 5), "seen"),
            ("q", "A", "conflict", "resolved", None, TS(2024, 1, 1), D(2024, 2, 1), TS(2024, 1, 9), None),
        ],
        "queue_id string, award_id string, reason string, status string, assigned_to string, opened_at timestamp, due_by date, changed_at timestamp, resolution_notes string",
    )
    r = pf.queue_state(events).first()
    assert (r.status, r.resolution_notes, r.resolved_at, r.assigned_to) == ("resolved", "seen", TS(2024, 1, 9), "kim")


def test_export_leaves_controlled_awards_out(awards, assessments):
    areas = ["hypersonics", "thermal", "quantum_sensing"]
    rows, record = export.build(awards, assessments, areas, pf.Filters(2023, 2024))
    by_id = {r.award_id: r for r in rows.collect()}
    assert set(by_id) == {"AF123", "NAV456"}
    assert (by_id["AF123"].weight_hypersonics, by_id["AF123"].weight_thermal) == (0.6, 0.4)
    assert by_id["NAV456"].weight_quantum_sensing == 1.0
    m = record.first()
    assert (m.controlled_awards_excluded, m.exported_awards, m.taxonomy_version) == (1, 2, "NSTC-2025Q1")


def test_export_weights_split_over_supporting(spark):
    df = spark.createDataFrame([("ai", ["quantum", "biotech"]), ("energy", [])], "primary_cet_id string, supporting_cet_ids array<string>")
    ai, energy = export.weights(df, ["ai", "quantum", "biotech", "energy"], lone_primary=0.6).collect()
    assert (ai.weight_ai, ai.weight_quantum, ai.weight_biotech, ai.weight_energy) == (0.6, 0.2, 0.2, 0.0)
    assert energy.weight_energy == 0.6


def test_assessment_rules(spark):
    df = spark.createDataFrame(
        [(101.0, "High", "ai", ["ai", "x", "x", "y"], [("word " * 51,)], "automated"), (5.0, "Low", "ai", ["x"], [("short",)], "automated")],
        "score double, classification string, primary_cet_id string, supporting_cet_ids array<string>, evidence_statements array<struct<excerpt:string>>, generation_method string",
    )
    bad, good = (r.failed_rules for r in ingest.validate(df, ingest.assessment_rules()).collect())
    assert bad == ["score_range", "supporting_excludes_primary", "supporting_unique", "supporting_at_most_three", "evidence_short"]
    assert good == []


def test_percentiles_equal_the_exact_built_in_with_a_hot_key(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("k"),
        F.when(F.col("id") % 11 == 0, None).otherwise((F.col("id") * 37 % 1009) / 10).alias("v"),
    )
    got = {r.k: (r.a, r.b) for r in exact_percentiles(df, ["k"], "v", {"a": 0.5, "b": 0.95}, buckets=16).collect()}
    want = {r.k: tuple(r.p) for r in df.groupBy("k").agg(F.percentile("v", [0.5, 0.95]).alias("p")).collect()}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_percentiles_over_all_rows_and_null_keys(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 7.0)], "k string, v double")
    assert exact_percentiles(df, [], "v", {"m": 0.5}).first().m == 3.0
    assert {r.k: r.m for r in exact_percentiles(df, ["k"], "v", {"m": 0.5}).collect()} == {None: 2.0, "a": 7.0}


def test_top_per_key_cuts_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    plan = top_per_key(df, ["k"], [F.desc("id")], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
