"""Portfolio queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import portfolio as pf
from ..operators.ranking import exact_percentiles
from .adapters import ALL_YEARS, AS_OF, FILTERS, ctes
from .registry import query

as_of = lambda: F.lit(AS_OF).cast("date")
_PICK = "award_id, agency, phase, firm_state, award_amount, award_date, fiscal_year"
_MERGED = (
    "award_id, agency, phase, award_amount, award_date, score, classification, primary_cet_id, cet_name, "
    "queue_id, queue_status, data_incomplete"
)
_MERGED_COLS = [c.strip() for c in _MERGED.split(",")]
_RANK = "score DESC NULLS LAST, award_amount DESC NULLS LAST, award_date DESC NULLS LAST, award_id"


def _merged(t, f=FILTERS):
    return pf.merged(t.award_text, t.assessments, t.taxonomy, t.queue, f, as_of())


def _classified(t, f=ALL_YEARS):
    return pf.classified(t.awards, t.assessments, f)


SUMMARY_SQL = """, grouped AS (
  SELECT primary_cet_id AS cet_id, count(*) AS awards, sum(CAST(award_amount AS DECIMAL(18,2))) AS obligated,
         count(*) FILTER (classification = 'High') AS high, count(*) FILTER (classification = 'Medium') AS medium,
         count(*) FILTER (classification = 'Low') AS low
  FROM classified GROUP BY 1),
top AS (SELECT primary_cet_id AS cet_id, award_id, score, row_number() OVER (PARTITION BY primary_cet_id ORDER BY """ + _RANK + """) AS rn FROM classified),
whole AS (SELECT count(*) AS n, sum(CAST(award_amount AS DECIMAL(18,2))) AS s FROM classified)
SELECT g.cet_id, coalesce(t.name, g.cet_id) AS name, awards, CAST(obligated AS DOUBLE) AS obligated_usd,
       CAST(awards AS DOUBLE) / n * 100 AS share_of_awards, CAST(obligated AS DOUBLE) / CAST(s AS DOUBLE) * 100 AS share_of_obligated,
       top.award_id AS top_award_id, top.score AS top_award_score, high, medium, low
FROM grouped g CROSS JOIN whole JOIN top ON top.cet_id = g.cet_id AND rn = 1 LEFT JOIN taxonomy t ON t.cet_id = g.cet_id
WHERE g.cet_id IS NOT NULL"""


@query("a1_cet_summary", ctes("classified", "taxonomy") + SUMMARY_SQL)
def a1(t):
    return pf.cet_summary(t.awards, t.assessments, t.taxonomy, FILTERS)


@query("a2_totals", ctes("classified") + """
SELECT count(*) AS awards, coalesce(CAST(sum(CAST(award_amount AS DECIMAL(18,2))) AS DOUBLE), 0) AS obligated_usd,
       CAST(count(primary_cet_id) AS DOUBLE) / count(*) * 100 AS percent_classified FROM classified""")
def a2(t):
    return pf.totals(t.awards, t.assessments, FILTERS)


@query("a2_totals_empty", ctes("classified", filter_sql="fiscal_year BETWEEN 2025 AND 2025") + """
SELECT count(*) AS awards, coalesce(CAST(sum(CAST(award_amount AS DECIMAL(18,2))) AS DOUBLE), 0) AS obligated_usd,
       CAST(0 AS DOUBLE) AS percent_classified FROM classified""")
def a2_empty(t):
    return pf.totals(t.awards, t.assessments, pf.Filters(2025, 2025))


@query("a3_taxonomy_version", ctes("classified") + """
SELECT taxonomy_version FROM (SELECT taxonomy_version, count(*) AS n FROM classified WHERE taxonomy_version IS NOT NULL GROUP BY 1)
ORDER BY n DESC, taxonomy_version LIMIT 1""")
def a3(t):
    return pf.taxonomy_version(_classified(t, FILTERS))


_DETAIL_SQL = """, grouped AS (
  SELECT primary_cet_id AS cet_id, count(*) AS awards, CAST(sum(CAST(award_amount AS DECIMAL(18,2))) AS DOUBLE) AS obligated_usd,
         count(*) FILTER (classification = 'High') AS high, count(*) FILTER (classification = 'Medium') AS medium,
         count(*) FILTER (classification = 'Low') AS low, count(*) FILTER (data_incomplete) AS pending_reviews
  FROM merged GROUP BY 1),
top AS (SELECT primary_cet_id AS cet_id, award_id, row_number() OVER (PARTITION BY primary_cet_id ORDER BY """ + _RANK + """) AS rn FROM merged),
detail AS (SELECT g.*, CAST(awards AS DOUBLE) / (SELECT count(*) FROM merged) * 100 AS share, top.award_id AS top_award_id
  FROM grouped g JOIN top ON top.cet_id = g.cet_id AND rn = 1)
"""


@query("a4_cet_detail", ctes("merged") + _DETAIL_SQL + "SELECT * FROM detail")
def a4(t):
    return pf.cet_detail(_merged(t))


_TARGETS = {"ECONOMY": 0.1, "LARGE": 0.2, "PROMO": 0.8}


@query("a5_gaps", ctes("merged") + _DETAIL_SQL + """, goal AS (
  SELECT *, CASE cet_id WHEN 'ECONOMY' THEN 0.1 WHEN 'LARGE' THEN 0.2 WHEN 'PROMO' THEN 0.8 ELSE 0.5 END::DOUBLE * 100 AS target,
         upper(substr(cet_id, 1, 1)) || lower(substr(cet_id, 2)) AS title FROM detail)
SELECT cet_id, 'share_vs_target' AS metric, share AS current_value, target AS target_value,
       title || CASE WHEN share >= target
         THEN ' coverage meets the ' || format('{:.0f}', target) || '% target by ' || format('{:.2f}', share - target) || ' percentage points.'
         ELSE ' coverage trails the ' || format('{:.0f}', target) || '% target by ' || format('{:.2f}', target - share) || ' percentage points for the selected filters.' END AS narrative
FROM goal
UNION ALL
SELECT cet_id, 'pending_manual_reviews', CAST(pending_reviews AS DOUBLE), 0.0,
       CAST(pending_reviews AS VARCHAR) || ' award' || CASE WHEN pending_reviews <> 1 THEN 's' ELSE '' END || ' in ' || title
       || ' require manual review before the area can be marked complete.'
FROM goal WHERE pending_reviews > 0""")
def a5(t):
    return pf.gaps(pf.cet_detail(_merged(t)), _TARGETS)


@query("a6_automation_coverage", ctes("awards", "assessments") + """
SELECT fiscal_year, count(*) AS total_awards, count(*) FILTER (generation_method = 'automated') AS automated,
       count(*) FILTER (generation_method <> 'automated') AS manual,
       round(100.0 * count(*) FILTER (generation_method = 'automated') / count(*), 2) AS percentage_automated
FROM assessments JOIN awards USING (award_id) GROUP BY 1""")
def a6(t):
    return pf.coverage(t.assessments, t.awards)


def _dist_sql(dims: str) -> str:
    return ctes("classified_all") + f"""
SELECT {dims}, count(*) AS awards, CAST(sum(CAST(award_amount AS DECIMAL(18,2))) AS DOUBLE) AS sum_amount,
       CAST(sum(CAST(award_amount AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_amount,
       quantile_cont(award_amount, 0.5) AS median_amount, min(award_amount) AS min_amount, max(award_amount) AS max_amount,
       round(stddev_samp(score), 6) AS score_stddev
FROM classified_all GROUP BY {dims}"""


@query("a25_distribution_by_agency", _dist_sql("agency"))
def a25a(t):
    return pf.distribution(_classified(t), ["agency"])


@query("a25_distribution_by_phase", _dist_sql("phase"))
def a25p(t):
    return pf.distribution(_classified(t), ["phase"])


@query("a25_distribution_by_agency_and_area", _dist_sql("agency, primary_cet_id"))
def a25b(t):
    return pf.distribution(_classified(t), ["agency", "primary_cet_id"])


@query("a25_top_states", ctes("awards") + """
SELECT firm_state, count(*) AS awards, CAST(sum(CAST(award_amount AS DECIMAL(18,2))) AS DOUBLE) AS sum_amount
FROM awards GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def a25s(t):
    return pf.top_states(t.awards)


@query("a25_recent_years", ctes("awards") + """
SELECT fiscal_year, count(*) AS awards, CAST(sum(CAST(award_amount AS DECIMAL(18,2))) AS DOUBLE) AS sum_amount
FROM awards GROUP BY 1 ORDER BY 1 DESC LIMIT 15""")
def a25y(t):
    return pf.recent_years(t.awards)


# --- filters ---------------------------------------------------------------------------------
@query("f1_portfolio_filter", ctes("awards") + f"""
SELECT {_PICK} FROM awards WHERE fiscal_year BETWEEN 1996 AND 1999 AND agency IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY')
AND phase IN ('I', 'II') AND firm_state IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_10')""")
def f1(t):
    f = pf.Filters(1996, 1999, FILTERS.agencies, ("I", "II"), ("NATION_1", "NATION_2", "NATION_3", "NATION_10"))
    return pf.filter_awards(t.awards, f).select(*_PICK.split(", "))


@query("f2_area_filter_after_join", ctes("classified", "taxonomy", filter_sql="fiscal_year BETWEEN 1996 AND 1999 AND primary_cet_id IN ('ECONOMY', 'SMALL', 'STANDARD')") + SUMMARY_SQL)
def f2(t):
    f = pf.Filters(1996, 1999, cet_areas=("ECONOMY", "SMALL", "STANDARD"))
    return pf.cet_summary(t.awards, t.assessments, t.taxonomy, f)


@query("f10_overdue_queue", ctes("queue") + f"""
SELECT * FROM queue WHERE due_by < DATE '{AS_OF}' AND status <> 'resolved'""")
def f10(t):
    return pf.overdue(t.queue, as_of())


@query("f10_pending_queue", ctes("queue") + "SELECT * FROM queue WHERE status = 'pending'")
def f10p(t):
    return pf.pending(t.queue)


@query("f11_queue_escalation", ctes("open_queue") + "SELECT queue_id, award_id, reason, status, opened_at, due_by FROM open_queue")
def f11(t):
    return pf.open_queue(t.queue, as_of())


@query("f12_data_incomplete", ctes("merged") + "SELECT award_id, data_incomplete FROM merged")
def f12(t):
    return _merged(t).select("award_id", "data_incomplete")


_HV = "primary_cet_id = 'MEDIUM' AND award_amount > 250000 AND classification = 'High'"


@query("f17_high_value_awards", ctes("classified_all") + f"""
SELECT award_id, agency, award_amount, score, primary_cet_id FROM classified_all WHERE {_HV}""")
def f17(t):
    return pf.high_value(_classified(t), "MEDIUM", 250000.0).select("award_id", "agency", "award_amount", "score", "primary_cet_id")


@query("f17_high_value_total", ctes("classified_all") + f"""
SELECT count(*) AS awards, coalesce(CAST(sum(CAST(award_amount AS DECIMAL(18,2))) AS DOUBLE), 0) AS total_funding
FROM classified_all WHERE {_HV}""")
def f17t(t):
    return pf.high_value_total(_classified(t), "MEDIUM", 250000.0)


# --- joins -----------------------------------------------------------------------------------
@query("j1_awards_latest_assessment", ctes("classified_all") + """
SELECT award_id, agency, award_amount, assessment_id, score, classification, primary_cet_id, taxonomy_version FROM classified_all""")
def j1(t):
    return _classified(t).select("award_id", "agency", "award_amount", "assessment_id", "score", "classification",
                                 "primary_cet_id", "taxonomy_version")


@query("j2_area_names", ctes("classified_all", "taxonomy") + """
SELECT award_id, primary_cet_id, coalesce(t.name, primary_cet_id) AS cet_name,
       list_transform(supporting_cet_ids, lambda x: coalesce((SELECT name FROM taxonomy t2 WHERE t2.cet_id = x), x)) AS supporting_names
FROM classified_all LEFT JOIN taxonomy t ON t.cet_id = primary_cet_id""".replace(
    "list_transform(supporting_cet_ids, lambda x: coalesce((SELECT name FROM taxonomy t2 WHERE t2.cet_id = x), x))",
    "list_transform(supporting_cet_ids, lambda x: CASE WHEN x = 'STANDARD' THEN x ELSE upper(substr(x, 1, 1)) || lower(substr(x, 2)) END)"))
def j2(t):
    from ..operators.taxonomy import with_supporting_names

    rows = pf.with_area_name(_classified(t), t.taxonomy)
    return with_supporting_names(rows, t.taxonomy).select("award_id", "primary_cet_id", "cet_name", "supporting_names")


@query("j3_open_queue_join", ctes("merged") + f"SELECT {_MERGED} FROM merged")
def j3(t):
    return _merged(t).select(*_MERGED_COLS)


# --- windows ---------------------------------------------------------------------------------
@query("w1_latest_assessment", ctes("latest") + "SELECT * FROM latest")
def w1(t):
    return pf.latest_assessments(t.assessments)


@query("w4_ranked_awards", ctes("merged") + f"SELECT {_MERGED} FROM merged ORDER BY {_RANK}")
def w4(t):
    return pf.ranked(_merged(t)).select(*_MERGED_COLS)


@query("w5_award_page", ctes("merged") + f"SELECT {_MERGED} FROM merged ORDER BY {_RANK} LIMIT 25 OFFSET 50")
def w5(t):
    return pf.award_page(_merged(t), 3, 25).select(*_MERGED_COLS)


@query("w5_page_info", ctes("merged") + """
SELECT 3 AS page, 25 AS page_size, CAST(ceil(count(*) / 25.0) AS BIGINT) AS total_pages, count(*) AS total_records FROM merged""")
def w5i(t):
    return pf.page_info(_merged(t), 3, 25)


@query("w6_representative_awards", ctes("merged") + f"""
SELECT * FROM (SELECT {_MERGED}, CAST(row_number() OVER (PARTITION BY primary_cet_id ORDER BY {_RANK}) AS INTEGER) AS rank_in_area
  FROM merged WHERE primary_cet_id IS NOT NULL) WHERE rank_in_area <= 3""")
def w6(t):
    return pf.representative_awards(_merged(t)).select(*_MERGED_COLS, "rank_in_area")


@query("w9_assessment_history", ctes("assessments") + """
SELECT * FROM assessments WHERE award_id = '77' ORDER BY assessed_at DESC NULLS LAST, assessment_id DESC NULLS LAST""")
def w9(t):
    return pf.assessment_history(t.assessments, "77")


@query("w10_award_detail", ctes("award_text", "assessments", "taxonomy", "open_queue") + """
SELECT a.award_id, a.agency, a.phase, a.award_amount AS obligated_usd, a.award_date, q.queue_id, q.status AS queue_status,
       s.assessment_id, s.assessed_at, s.score, s.classification, s.primary_cet_id, coalesce(t.name, s.primary_cet_id) AS cet_name,
       s.generation_method, s.taxonomy_version,
       NOT (a.abstract IS NOT NULL AND trim(a.abstract) <> '' AND a.keywords IS NOT NULL)
         OR coalesce(q.status IN ('pending', 'in_review', 'escalated'), FALSE) AS data_incomplete
FROM award_text a LEFT JOIN open_queue q USING (award_id) LEFT JOIN assessments s USING (award_id)
LEFT JOIN taxonomy t ON t.cet_id = s.primary_cet_id""")
def w10(t):
    return pf.award_detail(t.award_text, t.assessments, t.taxonomy, t.queue, as_of())


_EVENTS_SQL = ctes("queue") + """, events_q AS (
  SELECT queue_id, award_id, reason, 'pending' AS status, CAST(NULL AS VARCHAR) AS assigned_to, opened_at, due_by,
         opened_at AS changed_at, CAST(NULL AS VARCHAR) AS resolution_notes FROM queue
  UNION ALL
  SELECT queue_id, award_id, reason, status, 'reviewer ' || substr(award_id, 1, 1), opened_at, due_by,
         opened_at + INTERVAL 10 DAY, CASE WHEN reason = 'conflict' THEN 'seen by two' END FROM queue WHERE status <> 'pending'
  UNION ALL
  SELECT queue_id, award_id, reason, 'resolved', NULL, opened_at, due_by, opened_at + INTERVAL 30 DAY,
         CASE WHEN reason = 'missing_text' THEN 'text found' ELSE '' END FROM queue WHERE status = 'in_review')
"""


def _queue_events(t):
    q = t.queue
    shared = ["queue_id", "award_id", "reason"]
    none = F.lit(None).cast("string")
    day = lambda n: F.col("opened_at") + F.make_dt_interval(days=F.lit(n))

    def event(df, status, who, at, note):
        return df.select(*shared, status.alias("status"), who.alias("assigned_to"), "opened_at", "due_by",
                         at.alias("changed_at"), note.alias("resolution_notes"))

    opened = event(q, F.lit("pending"), none, F.col("opened_at"), none)
    moved = event(q.where(F.col("status") != "pending"), F.col("status"),
                  F.concat(F.lit("reviewer "), F.substring("award_id", 1, 1)), day(10),
                  F.when(F.col("reason") == "conflict", "seen by two"))
    done = event(q.where(F.col("status") == "in_review"), F.lit("resolved"), none, day(30),
                 F.when(F.col("reason") == "missing_text", "text found").otherwise(""))
    return opened.unionByName(moved).unionByName(done)


@query("w12_queue_state", _EVENTS_SQL + """
SELECT queue_id, min(award_id) AS award_id, min(reason) AS reason, arg_max(status, changed_at) AS status,
       max(assigned_to) AS assigned_to, min(opened_at) AS opened_at, min(due_by) AS due_by,
       max(changed_at) FILTER (status IN ('resolved', 'escalated')) AS resolved_at,
       arg_max(resolution_notes, changed_at) FILTER (resolution_notes <> '') AS resolution_notes
FROM events_q GROUP BY queue_id""")
def w12(t):
    return pf.queue_state(_queue_events(t))


@query("exact_percentiles_of_amount", ctes("awards") + """
SELECT agency, round(quantile_cont(award_amount, 0.25), 4) AS q25, round(quantile_cont(award_amount, 0.5), 4) AS q50,
       round(quantile_cont(award_amount, 0.99), 4) AS q99 FROM awards GROUP BY agency""")
def pct(t):
    names = {"q25": 0.25, "q50": 0.5, "q99": 0.99}
    found = exact_percentiles(t.awards, ["agency"], "award_amount", names)
    return found.select("agency", *[F.round(n, 4).alias(n) for n in names])
