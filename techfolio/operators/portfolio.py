"""Portfolio questions: filters, latest assessment, summaries, ranked lists, drill-downs, queue."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fx
from ..functions.cleaning import blank_to_null, lookup
from .ranking import exact_percentiles, top_per_key


@dataclass(frozen=True)
class Filters:
    """Inclusive fiscal-year range and IN-lists; an empty list means all."""

    fiscal_year_start: int
    fiscal_year_end: int
    agencies: Sequence[str] = field(default_factory=tuple)
    phases: Sequence[str] = field(default_factory=tuple)
    location_states: Sequence[str] = field(default_factory=tuple)
    cet_areas: Sequence[str] = field(default_factory=tuple)


def money(c: Column) -> Column:
    """Cents-exact decimal, so that sums do not depend on row order."""
    return c.cast("decimal(18,2)")


def money_sum(c: Column) -> Column:
    return F.sum(money(c)).cast("double")


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 for an empty whole."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")) * 100.0, F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def filter_awards(awards: DataFrame, f: Filters) -> DataFrame:
    df = awards.where(F.col("fiscal_year").between(f.fiscal_year_start, f.fiscal_year_end))
    for column, values in (("agency", f.agencies), ("phase", f.phases), ("firm_state", f.location_states)):
        if values:
            df = df.where(F.col(column).isin(*values))
    return df


LATEST_ORDER = ("assessed_at", "assessment_id")


def latest_assessments(assessments: DataFrame) -> DataFrame:
    """Newest row per award; null times lose, ties go to the larger id."""
    return top_per_key(assessments, ["award_id"], [F.desc_nulls_last(c) for c in LATEST_ORDER])


def classified(awards: DataFrame, assessments: DataFrame, f: Filters) -> DataFrame:
    """Filtered awards with their latest assessment. The area filter runs after the join, so shares are
    of the filtered set."""
    merged = filter_awards(awards, f).join(latest_assessments(assessments), "award_id", "left")
    return merged.where(F.col("primary_cet_id").isin(*f.cet_areas)) if f.cet_areas else merged


def with_area_name(df: DataFrame, taxonomy: DataFrame, id_column: str = "primary_cet_id", name: str = "cet_name") -> DataFrame:
    """Area name, defaulting to the id. The taxonomy's own size decides whether Spark broadcasts it."""
    names = taxonomy.select(F.col("cet_id").alias(id_column), F.col("name").alias("__name"))
    return df.join(names, id_column, "left").withColumn(name, F.coalesce("__name", id_column)).drop("__name")


# --- review queue ----------------------------------------------------------------------------
def queue_state(events: DataFrame) -> DataFrame:
    """Current queue from its events (queue_id, award_id, reason, status, assigned_to, opened_at, due_by,
    changed_at, resolution_notes): newest status, last note that isn't empty, resolution time once resolved or
    escalated. Equal times are ordered by ``event_no`` where the events have it.

    Aggregated per queue id with map-side combine; nothing is collected per key.
    """
    when = ["changed_at", *(["event_no"] if "event_no" in events.columns else [])]
    seen = F.struct(*when, "status")
    note = F.nullif(F.col("resolution_notes"), F.lit(""))
    closed = F.col("status").isin("resolved", "escalated")
    folded = events.groupBy("queue_id").agg(
        F.min("award_id").alias("award_id"),
        F.min("reason").alias("reason"),
        F.max("assigned_to").alias("assigned_to"),
        F.min("opened_at").alias("opened_at"),
        F.min("due_by").alias("due_by"),
        F.max(seen).alias("last"),
        F.max(F.when(closed, F.col("changed_at"))).alias("resolved_at"),
        F.max(F.when(note.isNotNull(), F.struct(*when, "resolution_notes"))).alias("note"),
    )
    return folded.select(
        "queue_id", "award_id", "reason", F.col("last.status").alias("status"), "assigned_to", "opened_at", "due_by",
        "resolved_at", F.col("note.resolution_notes").alias("resolution_notes"),
    )


def overdue(queue: DataFrame, as_of: Column) -> DataFrame:
    return queue.where((F.col("due_by") < as_of) & (F.col("status") != "resolved"))


def pending(queue: DataFrame) -> DataFrame:
    return queue.where(F.col("status") == "pending")


def open_queue(queue: DataFrame, as_of: Column) -> DataFrame:
    """Unresolved items, past-due ones escalated, the latest opened per award."""
    late = F.col("status").isin("pending", "in_review") & (F.col("due_by") < as_of)
    items = queue.where(F.col("status") != "resolved").withColumn("status", F.when(late, "escalated").otherwise(F.col("status")))
    return top_per_key(items, ["award_id"], [F.desc_nulls_last("opened_at"), F.desc_nulls_last("queue_id")])


def merged(
    awards: DataFrame, assessments: DataFrame, taxonomy: DataFrame, queue: DataFrame, f: Filters, as_of: Column
) -> DataFrame:
    """Awards with latest assessment, area name, open queue item and the incompleteness flag."""
    base = with_area_name(classified(awards, assessments, f), taxonomy)
    q = open_queue(queue, as_of).select(
        "award_id", F.col("queue_id"), F.col("reason").alias("queue_reason"), F.col("status").alias("queue_status"),
        F.col("due_by").alias("queue_due_by"),
    )
    has_text = blank_to_null(F.col("abstract")).isNotNull() & F.col("keywords").isNotNull()
    waiting = F.coalesce(F.col("queue_status").isin(*fx.QUEUE_OPEN), F.lit(False))
    return (
        base.join(q, "award_id", "left")
        .withColumn("score", F.coalesce(F.col("score"), F.lit(-1.0)))
        .withColumn("data_incomplete", ~has_text | waiting)
    )


# --- summary ---------------------------------------------------------------------------------
def _best_first() -> Column:
    """Sort key of ranked awards for ``min_by``: score, amount, date descending, nulls last, then id."""
    last = F.lit(float("inf"))
    return F.struct(
        F.coalesce(-F.col("score"), last).alias("s"),
        F.coalesce(-F.col("award_amount"), last).alias("a"),
        F.coalesce(-F.unix_date(F.col("award_date").cast("date")), F.lit(2147483647)).alias("d"),
        F.col("award_id").alias("i"),
    )


def cet_summary(awards: DataFrame, assessments: DataFrame, taxonomy: DataFrame, f: Filters) -> DataFrame:
    """Per area: awards, obligated sum, both shares, top award and its score, band counts.

    One aggregation over the joined rows; unclassified awards stay as the null group until the totals,
    which are summed over the few grouped rows, are known.
    """
    grouped = (
        classified(awards, assessments, f)
        .groupBy("primary_cet_id")
        .agg(
            F.count(F.lit(1)).alias("awards"),
            F.sum(money(F.col("award_amount"))).alias("obligated"),
            F.min(F.struct(_best_first().alias("k"), F.col("score").alias("score"))).alias("top"),
            *[F.count_if(F.col("classification") == b).alias(b.lower()) for b in fx.BANDS],
        )
    )
    everything = Window.partitionBy()
    totals = grouped.withColumn("all_awards", F.sum("awards").over(everything)).withColumn(
        "all_obligated", F.sum("obligated").over(everything)
    )
    named = with_area_name(totals.where(F.col("primary_cet_id").isNotNull()), taxonomy)
    return named.select(
        F.col("primary_cet_id").alias("cet_id"),
        F.col("cet_name").alias("name"),
        "awards",
        F.col("obligated").cast("double").alias("obligated_usd"),
        percent(F.col("awards"), F.col("all_awards")).alias("share_of_awards"),
        percent(F.col("obligated"), F.col("all_obligated")).alias("share_of_obligated"),
        F.col("top.k.i").alias("top_award_id"),
        F.col("top.score").alias("top_award_score"),
        "high",
        "medium",
        "low",
    ).orderBy(F.desc("awards"), "cet_id")


def totals(awards: DataFrame, assessments: DataFrame, f: Filters) -> DataFrame:
    """One row; zeros when nothing passes the filters."""
    return classified(awards, assessments, f).agg(
        F.count(F.lit(1)).alias("awards"),
        F.coalesce(money_sum(F.col("award_amount")), F.lit(0.0)).alias("obligated_usd"),
        percent(F.count("primary_cet_id"), F.count(F.lit(1))).alias("percent_classified"),
    )


def taxonomy_version(rows: DataFrame) -> DataFrame:
    """Most frequent taxonomy version of the classified rows, the lowest on a tie."""
    counts = rows.where(F.col("taxonomy_version").isNotNull()).groupBy("taxonomy_version").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min_by("taxonomy_version", F.struct(-F.col("n"), "taxonomy_version")).alias("taxonomy_version"))


# --- lists and details -----------------------------------------------------------------------
RANKING = ("score", "award_amount", "award_date")


def ranked(merged_rows: DataFrame) -> DataFrame:
    return merged_rows.orderBy(*[F.desc_nulls_last(c) for c in RANKING], F.asc("award_id"))


def award_page(merged_rows: DataFrame, page: int, page_size: int) -> DataFrame:
    """One page of the ranked list: a top-(page * size) per task, never a full sort."""
    return ranked(merged_rows).offset((page - 1) * page_size).limit(page_size)


def page_info(merged_rows: DataFrame, page: int, page_size: int) -> DataFrame:
    n = F.count(F.lit(1))
    pages = F.when(n == 0, F.lit(0)).otherwise(F.ceil(n / F.lit(page_size)))
    return merged_rows.agg(
        F.lit(page).alias("page"), F.lit(page_size).alias("page_size"), pages.cast("bigint").alias("total_pages"),
        n.alias("total_records"),
    )


def assessment_history(assessments: DataFrame, award_id: str) -> DataFrame:
    return assessments.where(F.col("award_id") == award_id).orderBy(
        F.desc_nulls_last("assessed_at"), F.desc_nulls_last("assessment_id")
    )


def award_detail(awards: DataFrame, assessments: DataFrame, taxonomy: DataFrame, queue: DataFrame, as_of: Column,
                 award_id: str | None = None) -> DataFrame:
    """Award fields and open queue item on every row of its history, newest first within an award.

    The history stays as rows: an award may have any number of assessments, so none are gathered into one value.
    """
    pick = (lambda df: df.where(F.col("award_id") == award_id)) if award_id is not None else (lambda df: df)
    q = open_queue(pick(queue), as_of).select("award_id", "queue_id", F.col("status").alias("queue_status"))
    history = with_area_name(pick(assessments), taxonomy).select(
        "award_id", "assessment_id", "assessed_at", "score", "classification", "primary_cet_id", "cet_name",
        "generation_method", "taxonomy_version",
    )
    has_text = blank_to_null(F.col("abstract")).isNotNull() & F.col("keywords").isNotNull()
    return (
        pick(awards)
        .select("award_id", "agency", "phase", F.col("award_amount").alias("obligated_usd"), "award_date",
                has_text.alias("has_text"))
        .join(q, "award_id", "left")
        .join(history, "award_id", "left")
        .withColumn("data_incomplete", ~F.col("has_text") | F.coalesce(F.col("queue_status").isin(*fx.QUEUE_OPEN), F.lit(False)))
        .drop("has_text")
    )


def cet_detail(merged_rows: DataFrame) -> DataFrame:
    """Per area: counts, obligated sum, share, top award, bands, awards that need review."""
    grouped = merged_rows.groupBy("primary_cet_id").agg(
        F.count(F.lit(1)).alias("awards"),
        money_sum(F.col("award_amount")).alias("obligated_usd"),
        F.min(_best_first()).alias("top"),
        *[F.count_if(F.col("classification") == b).alias(b.lower()) for b in fx.BANDS],
        F.count_if("data_incomplete").alias("pending_reviews"),
    )
    total = F.sum("awards").over(Window.partitionBy())
    return (
        grouped.withColumn("share", percent(F.col("awards"), total))
        .where(F.col("primary_cet_id").isNotNull())
        .select(F.col("primary_cet_id").alias("cet_id"), "awards", "obligated_usd", "share",
                F.col("top.i").alias("top_award_id"), "high", "medium", "low", "pending_reviews")
    )


def representative_awards(merged_rows: DataFrame, k: int = 3) -> DataFrame:
    """The k best awards per area, with their rank."""
    rows = merged_rows.where(F.col("primary_cet_id").isNotNull())
    order = [*[F.desc_nulls_last(c) for c in RANKING], F.asc("award_id")]
    return top_per_key(rows, ["primary_cet_id"], order, k, rank="rank_in_area")


def gaps(detail: DataFrame, targets: Mapping[str, float] | None = None, default: float = 0.5) -> DataFrame:
    """Share-versus-target row per area, and a pending-review row where reviews wait."""
    share_target = F.coalesce(lookup(F.col("cet_id"), {k: str(v) for k, v in targets.items()}).cast("double"), F.lit(default)) if targets else F.lit(default)
    target = share_target * 100.0
    diff = F.col("share") - target
    title = F.initcap(F.replace(F.col("cet_id"), F.lit("_"), F.lit(" ")))
    meets = F.format_string("%s coverage meets the %.0f%% target by %.2f percentage points.", title, target, diff)
    trails = F.format_string(
        "%s coverage trails the %.0f%% target by %.2f percentage points for the selected filters.", title, target, F.abs(diff)
    )
    n = F.col("pending_reviews")
    waiting = F.format_string(
        "%d award%s in %s require manual review before the area can be marked complete.",
        n, F.when(n != 1, "s").otherwise(""), title,
    )

    def entry(metric: str, current: Column, goal: Column, text: Column) -> Column:
        return F.struct(F.lit(metric).alias("metric"), current.alias("current_value"), goal.alias("target_value"),
                        text.alias("narrative"))

    share = entry("share_vs_target", F.col("share"), target, F.when(diff >= 0, meets).otherwise(trails))
    review = entry("pending_manual_reviews", n.cast("double"), F.lit(0.0), waiting)
    entries = F.when(n > 0, F.array(share, review)).otherwise(F.array(share))
    return detail.select("cet_id", F.inline(entries))


# --- coverage and distributions --------------------------------------------------------------
def coverage(assessments: DataFrame, awards: DataFrame) -> DataFrame:
    """Automation share per fiscal year of the award."""
    years = awards.select("award_id", "fiscal_year")
    return (
        assessments.select("award_id", "generation_method")
        .join(years, "award_id")
        .groupBy("fiscal_year")
        .agg(
            F.count(F.lit(1)).alias("total_awards"),
            F.count_if(F.col("generation_method") == "automated").alias("automated"),
        )
        .withColumn("manual", F.col("total_awards") - F.col("automated"))
        .withColumn("percentage_automated", F.round(percent(F.col("automated"), F.col("total_awards")), 2))
    )


def distribution(rows: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Count, sum, mean, median, min and max of the amount and spread of the score, per ``dims``."""
    base = rows.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("awards"),
        F.sum(money(F.col("award_amount"))).alias("sum_amount"),
        F.min("award_amount").alias("min_amount"),
        F.max("award_amount").alias("max_amount"),
        F.round(F.stddev("score"), 6).alias("score_stddev"),
    )
    medians = exact_percentiles(rows, dims, "award_amount", {"median_amount": 0.5})
    keep = reduce(lambda a, b: a & b, [base[d].eqNullSafe(medians[d]) for d in dims])
    joined = base.join(medians, keep, "left").drop(*[medians[d] for d in dims])
    return joined.withColumn("avg_amount", F.col("sum_amount").cast("double") / F.col("awards")).withColumn(
        "sum_amount", F.col("sum_amount").cast("double")
    )


def top_states(awards: DataFrame, k: int = 10) -> DataFrame:
    return (
        awards.groupBy("firm_state")
        .agg(F.count(F.lit(1)).alias("awards"), money_sum(F.col("award_amount")).alias("sum_amount"))
        .orderBy(F.desc("awards"), "firm_state")
        .limit(k)
    )


def recent_years(awards: DataFrame, k: int = 15) -> DataFrame:
    return (
        awards.groupBy("fiscal_year")
        .agg(F.count(F.lit(1)).alias("awards"), money_sum(F.col("award_amount")).alias("sum_amount"))
        .orderBy(F.desc("fiscal_year"))
        .limit(k)
    )


def high_value(classified_rows: DataFrame, cet_id: str, min_amount: float, band: str = "High") -> DataFrame:
    return classified_rows.where(
        (F.col("primary_cet_id") == cet_id) & (F.col("award_amount") > min_amount) & (F.col("classification") == band)
    )


def high_value_total(classified_rows: DataFrame, cet_id: str, min_amount: float, band: str = "High") -> DataFrame:
    return high_value(classified_rows, cet_id, min_amount, band).agg(
        F.count(F.lit(1)).alias("awards"), F.coalesce(money_sum(F.col("award_amount")), F.lit(0.0)).alias("total_funding")
    )
