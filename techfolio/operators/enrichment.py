"""Enrichment joins and the reports over enrichment runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning as cl
from .portfolio import percent, ratio
from .ranking import exact_percentiles

REQUEST_KEY = ["api_source", "solicitation_id"]


def with_request_key(awards: DataFrame, default_source: str | None = None) -> DataFrame:
    """Add the (api_source, solicitation_id) an award's solicitation is asked for under."""
    number = F.col("solicitation_id") if "solicitation_id" in awards.columns else F.lit(None).cast("string")
    year = F.col("solicitation_year") if "solicitation_year" in awards.columns else F.lit(None).cast("int")
    key = cl.solicitation_key(F.col("topic_code"), number, F.col("program"), year)
    return awards.withColumn("solicitation_id", key).withColumn("api_source", cl.api_source(F.col("agency"), default_source))


def attach_solicitations(awards: DataFrame, cache: DataFrame, default_source: str | None = None) -> DataFrame:
    """Awards with cached solicitation text, keywords and status. The cache is unique per key, so the
    awards pass one join whatever share of them names the same solicitation."""
    keyed = with_request_key(awards, default_source)
    found = cache.select(*REQUEST_KEY, "description", "technical_keywords", "retrieved_at")
    status = (
        F.when(F.col("api_source").isNull() | F.col("solicitation_id").isNull(), "not_attempted")
        .when(F.col("retrieved_at").isNotNull(), "enriched")
        .otherwise("enrichment_failed")
    )
    return keyed.join(found, REQUEST_KEY, "left").withColumn("enrichment_status", status)


def missing_requests(awards: DataFrame, cache: DataFrame, default_source: str | None = None) -> DataFrame:
    """Distinct keys the cache does not hold: the work list for a fetcher."""
    keys = with_request_key(awards, default_source).select(*REQUEST_KEY).na.drop().distinct()
    return keys.join(cache.select(*REQUEST_KEY), REQUEST_KEY, "left_anti")


def request_statistics(attached: DataFrame) -> DataFrame:
    """One row: awards, unique keys (an award without one counts as its own), saved share, outcome counts."""
    status = F.col("enrichment_status")
    # Per key first: the hot key shrinks on the map side and no distinct set is built.
    per_key = attached.groupBy(
        *REQUEST_KEY, F.when(status == "not_attempted", F.col("award_id")).alias("lone")
    ).agg(F.count(F.lit(1)).alias("n"), F.count_if(status == "enriched").alias("hit"))
    out = per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_awards"),
        F.count(F.lit(1)).alias("unique_solicitations"),
        F.coalesce(F.sum("hit"), F.lit(0)).alias("enriched_count"),
    )
    saved = F.lit(1.0) - ratio(F.col("unique_solicitations"), F.col("total_awards"))
    return out.withColumn("failed_count", F.col("total_awards") - F.col("enriched_count")).withColumn(
        "deduplication_ratio", F.when(F.col("total_awards") > 0, saved).otherwise(0.0)
    )


def batch_summary(attached: DataFrame) -> DataFrame:
    status = F.col("enrichment_status")
    return attached.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == "enriched").alias("successful"),
        F.count_if(status == "enrichment_failed").alias("failed"),
        F.count_if(status == "not_attempted").alias("skipped"),
        ratio(F.count_if(status == "enriched"), F.count(F.lit(1))).alias("success_rate"),
    )


def attach_solicitation_scores(awards: DataFrame, solicitations: DataFrame) -> DataFrame:
    """Full text and relevance scores by solicitation id; empty text and map where there is none."""
    side = solicitations.select("solicitation_id", F.col("full_text").alias("__t"), F.col("cet_relevance_scores").alias("__s"))
    return (
        awards.join(side, "solicitation_id", "left")
        .withColumn("solicitation_text", F.coalesce("__t", F.lit("")))
        .withColumn("solicitation_cet_scores", F.coalesce("__s", F.create_map().cast("map<string,double>")))
        .drop("__t", "__s")
    )


# --- telemetry and status --------------------------------------------------------------------
def telemetry(calls: DataFrame, exact: bool = True) -> DataFrame:
    """Per source: cache hits and misses, call outcomes, latency p50 / p95 / p99.

    ``exact`` interpolates like numpy over all values; otherwise Spark's sketch answers within its error.
    """
    hit, ok = F.col("cache_hit"), F.col("success")
    probs = {"latency_p50": 0.5, "latency_p95": 0.95, "latency_p99": 0.99}
    aggs = [
        F.count_if(hit).alias("cache_hits"),
        F.count_if(~hit).alias("cache_misses"),
        percent(F.count_if(hit), F.count("cache_hit")).alias("cache_hit_rate"),
        F.count_if(ok).alias("calls_ok"),
        F.count_if(~ok).alias("calls_failed"),
        percent(F.count_if(ok), F.count("success")).alias("success_rate"),
        F.count("latency_ms").alias("latency_count"),
    ]
    if not exact:
        sketch = F.percentile_approx("latency_ms", list(probs.values()), 10000)
        return calls.groupBy("api_source").agg(
            *aggs, *[F.get(sketch, F.lit(i)).alias(n) for i, n in enumerate(probs)]
        )
    found = exact_percentiles(calls, ["api_source"], "latency_ms", probs)
    return calls.groupBy("api_source").agg(*aggs).join(found, "api_source", "left")


_STATES = ("completed", "failed", "pending", "in_progress")


def _state_counts() -> list[Column]:
    counts = [F.count_if(F.col("status") == s).alias(s) for s in _STATES]
    done = F.count_if(F.col("status") == "completed")
    return [F.count(F.lit(1)).alias("total"), *counts,
            ratio(done, F.count_if(F.col("status").isin("completed", "failed"))).alias("success_rate")]


def status_summary(status: DataFrame) -> DataFrame:
    return status.agg(*_state_counts())


def status_progress(status: DataFrame) -> DataFrame:
    """Per enrichment type; the mean confidence is of the completed ones."""
    rows = status.withColumn("enrichment_type", F.explode("enrichment_types"))
    done = F.when(F.col("status") == "completed", F.col("confidence_score").cast("decimal(18,6)"))
    mean = F.coalesce(F.try_divide(F.sum(done).cast("double"), F.count(done).cast("double")), F.lit(0.0))
    return rows.groupBy("enrichment_type").agg(*_state_counts(), mean.alias("avg_confidence"))


def list_statuses(status: DataFrame, state: str | None = None, kind: str | None = None, limit: int | None = None) -> DataFrame:
    """Newest first; a limit makes it a top-k."""
    if state is not None:
        status = status.where(F.col("status") == state)
    if kind is not None:
        status = status.where(F.array_contains("enrichment_types", kind))
    status = status.orderBy(F.desc("last_updated"), "award_id")
    return status.limit(limit) if limit is not None else status


def failed_awards(status: DataFrame, kind: str | None = None) -> DataFrame:
    rows = status.where(F.col("status") == "failed")
    if kind is not None:
        rows = rows.where(F.array_contains("enrichment_types", kind))
    return rows.select("award_id", "enrichment_types", "error_message", "last_updated")


def drop_older(status: DataFrame, cutoff: Column) -> DataFrame:
    return status.where(F.coalesce(F.col("last_updated") >= cutoff, F.lit(True)))


def apply_changes(status: DataFrame, changes: DataFrame, at: Column, columns: Sequence[str] = ("status", "confidence_score", "error_message")) -> DataFrame:
    """Given fields of the change table replace the current ones; unknown award ids change nothing."""
    side = changes.select("award_id", F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in columns])
    out = status.join(side, "award_id", "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.col(f"__{c}"), F.col(c)))
    out = out.withColumn("last_updated", F.when(F.col("__hit"), at).otherwise(F.col("last_updated")))
    return out.drop("__hit", *[f"__{c}" for c in columns])


def reset_failed(status: DataFrame, at: Column, award_ids: DataFrame | None = None) -> DataFrame:
    """Failed rows (all, or those of an id table) go back to pending without their message."""
    hit = F.col("status") == "failed"
    if award_ids is not None:
        picked = award_ids.select("award_id").distinct().withColumn("__in", F.lit(True))
        status = status.join(picked, "award_id", "left")
        hit = hit & F.col("__in").isNotNull()
    out = status.withColumn("__hit", hit)
    out = (
        out.withColumn("status", F.when(F.col("__hit"), "pending").otherwise(F.col("status")))
        .withColumn("error_message", F.when(~F.col("__hit"), F.col("error_message")))
        .withColumn("last_updated", F.when(F.col("__hit"), at).otherwise(F.col("last_updated")))
    )
    return out.drop("__hit", "__in")


def confident(matches: DataFrame, threshold: float = 0.7, column: str = "confidence_score") -> DataFrame:
    return matches.where(F.col(column) >= threshold)


def cache_statistics(cache: DataFrame) -> DataFrame:
    """Entries, oldest and newest per source, and over all (null source)."""
    return cache.rollup("api_source").agg(
        F.count(F.lit(1)).alias("entries"), F.min("retrieved_at").alias("oldest"), F.max("retrieved_at").alias("newest")
    )


# --- score combination -----------------------------------------------------------------------
def boost_scores(base: DataFrame, solicitation: DataFrame, boost: float = 0.3) -> DataFrame:
    """(key, cet_id, score): base + boost x solicitation, at most 1; only boosted where base has none."""
    b = base.select("key", "cet_id", F.col("score").alias("b"))
    s = solicitation.select("key", "cet_id", F.col("score").alias("s"))
    raised = F.least(F.lit(1.0), F.col("b") + F.col("s") * boost)
    score = F.when(F.col("s").isNull(), F.col("b")).when(F.col("b").isNull(), F.col("s") * boost).otherwise(raised)
    return b.join(s, ["key", "cet_id"], "full_outer").select("key", "cet_id", score.alias("score"))
