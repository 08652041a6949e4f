"""Awardee analytics over award history (uei, award_amount, start_date, funding_agency, award_status, ...)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fx
from ..functions.cleaning import let
from ..functions.literals import constant
from ..functions.text import string_array
from .portfolio import money, ratio


def _success(statuses: Sequence[str]) -> Column:
    return F.count_if(F.col("award_status").isin(*statuses))


def success_rate(history: DataFrame, statuses: Sequence[str] = fx.SUCCESS_STATUSES) -> DataFrame:
    return history.groupBy("uei").agg(ratio(_success(statuses), F.count(F.lit(1))).alias("success_rate"))


def metrics(history: DataFrame, statuses: Sequence[str] = fx.SUCCESS_STATUSES) -> DataFrame:
    """Per awardee: counts, funding, success rate, dates, agencies, size histogram.

    Aggregated per (awardee, agency) first, so an awardee with a third of all rows spreads over its agencies
    and the agency list is gathered from one row per agency.
    """
    amount = F.coalesce(money(F.col("award_amount")), F.lit(0).cast("decimal(18,2)"))
    by_agency = history.groupBy("uei", "funding_agency").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(amount).alias("funding"),
        _success(statuses).alias("ok"),
        F.min("start_date").alias("first"),
        F.max("start_date").alias("last"),
        F.count_if(amount < 100000).alias("small"),
        F.count_if(amount.between(100000, 500000)).alias("medium"),
        F.count_if(amount > 500000).alias("large"),
    )
    agency = F.nullif(F.col("funding_agency"), F.lit(""))
    out = by_agency.groupBy("uei").agg(
        F.sum("n").alias("total_awards"),
        F.sum("funding").alias("funding"),
        F.sum("ok").alias("ok"),
        F.min("first").alias("first_award_date"),
        F.max("last").alias("last_award_date"),
        F.array_sort(F.collect_set(agency)).alias("primary_agencies"),
        F.sum("small").alias("small_awards"),
        F.sum("medium").alias("medium_awards"),
        F.sum("large").alias("large_awards"),
    )
    total = F.col("funding").cast("double")
    return out.select(
        "uei", "total_awards", total.alias("total_funding"), ratio(F.col("ok"), F.col("total_awards")).alias("success_rate"),
        (total / F.col("total_awards")).alias("avg_award_amount"), "first_award_date", "last_award_date", "primary_agencies",
        "small_awards", "medium_awards", "large_awards",
    )


def matched_areas(text: Column, areas: Mapping[str, Sequence[str]] = fx.EXPERTISE_KEYWORDS) -> Column:
    """Names of the areas with at least one keyword in the text."""
    table = constant([{"area": a, "words": list(k)} for a, k in areas.items()])
    return let(
        F.lower(text),
        lambda t: F.transform(F.filter(table, lambda e: F.exists(e["words"], lambda w: F.contains(t, w))), lambda e: e["area"]),
    )


def history_text() -> Column:
    return F.concat_ws(" ", F.coalesce(F.col("title"), F.lit("")), F.coalesce(F.col("abstract"), F.lit("")),
                       F.array_join(F.coalesce(F.col("keywords"), F.array().cast("array<string>")), " "))


def tech_areas(history: DataFrame, text: Column | None = None, areas: Mapping[str, Sequence[str]] = fx.EXPERTISE_KEYWORDS) -> DataFrame:
    """(uei, area, awards, area_rank): areas of an awardee by number of awards, name on ties."""
    hits = history.select("uei", F.explode_outer(matched_areas(history_text() if text is None else text, areas)).alias("area"))
    hits = hits.where(F.col("area").isNotNull())
    counted = hits.groupBy("uei", "area").agg(F.count(F.lit(1)).alias("awards"))
    from pyspark.sql import Window

    by_count = Window.partitionBy("uei").orderBy(F.desc("awards"), "area")
    return counted.withColumn("area_rank", F.row_number().over(by_count))


def agency_counts(history: DataFrame) -> DataFrame:
    named = history.where(F.coalesce(F.col("funding_agency"), F.lit("")) != "")
    return named.groupBy("uei", "funding_agency").agg(F.count(F.lit(1)).alias("n"))


def diversity(history: DataFrame) -> DataFrame:
    """Distinct agencies, distinct / awards with an agency, and the count per agency."""
    return agency_counts(history).groupBy("uei").agg(
        F.count(F.lit(1)).alias("unique_agencies"),
        ratio(F.count(F.lit(1)), F.sum("n")).alias("diversity_score"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("funding_agency", "n")))).alias("agency_distribution"),
    )


def trend(history: DataFrame, tie: Sequence[str] = ("award_amount",)) -> DataFrame:
    """First against last dated award: growth, growth per year, label. ``tie`` orders equal dates."""
    dated = history.where(F.col("start_date").isNotNull())
    key = F.struct("start_date", *tie)
    rows = dated.groupBy("uei").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct(key.alias("k"), "award_amount")).alias("first"),
        F.max(F.struct(key.alias("k"), "award_amount")).alias("last"),
    )
    enough = F.col("n") >= 2
    growth = F.col("last.award_amount") - F.col("first.award_amount")
    years = F.date_diff(F.col("last.k.start_date"), F.col("first.k.start_date")) / F.lit(365.25)
    label = F.when(~enough, "insufficient_data").when(growth > 0, "increasing").when(growth < 0, "decreasing").otherwise("stable")
    return rows.select(
        "uei", label.alias("trend"),
        F.when(enough, growth).otherwise(0.0).alias("total_growth"),
        F.when(enough & (years > 0), growth / years).otherwise(0.0).alias("avg_annual_growth"),
        F.when(enough, years).otherwise(0.0).alias("years_span"),
    )


def benchmark(awardee_metrics: DataFrame) -> DataFrame:
    """Success percentile, funding category and experience level of each awardee."""
    rate, funding = F.col("success_rate"), F.col("total_funding")
    percentile, category, level = F, F, F
    for floor, value in fx.SUCCESS_PERCENTILES:
        percentile = percentile.when(rate >= floor, F.lit(value))
    for name, ceiling in fx.FUNDING_CATEGORIES:
        category = category.when(funding < ceiling, F.lit(name))
    years = F.date_diff("last_award_date", "first_award_date") / F.lit(365.25)
    for name, floor in fx.EXPERIENCE_LEVELS:
        level = level.when(years >= floor, F.lit(name))
    return awardee_metrics.select(
        "uei", percentile.otherwise(0).alias("success_rate_percentile"), category.otherwise("large").alias("funding_level_category"),
        level.otherwise("new").alias("experience_level"), years.alias("years_active"),
    )


def risk(history: DataFrame, as_of: Column, awardees: DataFrame | None = None, keep_history: bool = False) -> DataFrame:
    """Risk score with factors and advice. Awardees of ``awardees`` without history score 1. The others of the history are left
    out, unless ``keep_history`` asks for them too; naming them in ``awardees`` would read the history twice.

    Two-level aggregation: per agency, then per awardee with the largest agency share.
    """
    agency = F.nullif(F.col("funding_agency"), F.lit(""))
    recent = F.col("start_date") >= F.date_sub(as_of, 730)
    by_agency = history.groupBy("uei", agency.alias("agency")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("award_status") == "Terminated").alias("terminated"),
        F.count_if(recent).alias("recent"),
    )
    named = F.when(F.col("agency").isNotNull(), F.col("n"))
    rows = by_agency.groupBy("uei").agg(
        F.sum("n").alias("n"), F.sum("terminated").alias("terminated"), F.sum("recent").alias("recent"),
        ratio(F.max(named), F.sum(named)).alias("top_share"),
    )
    if awardees is not None:
        named_rows = rows.where(F.col("uei").isNotNull())
        rows = awardees.select("uei").distinct().join(named_rows, "uei", "full" if keep_history else "left")
    none = F.col("n").isNull()
    rate = ratio(F.col("terminated"), F.col("n"))
    checks = [
        (F.col("terminated") > 0, rate * 0.5, F.format_string("Award termination rate: %.1f%%", rate * 100.0),
         "Improve project management and delivery capabilities"),
        (F.col("recent") == 0, F.lit(0.3), F.lit("No recent award activity (past 2 years)"),
         "Pursue new funding opportunities to maintain active status"),
        (F.col("top_share") > 0.8, F.lit(0.2), F.format_string("High agency concentration: %.1f%%", F.col("top_share") * 100.0),
         "Diversify funding sources across multiple agencies"),
    ]
    score = reduce(lambda a, b: a + b, [F.when(c, points).otherwise(0.0) for c, points, _, _ in checks])
    keep = lambda items: F.filter(F.array(*items), lambda x: x.isNotNull())
    factors = keep([F.when(c, text) for c, _, text, _ in checks])
    advice = keep([F.when(c, F.lit(a)) for c, _, _, a in checks])
    return rows.select(
        "uei",
        F.when(none, 1.0).otherwise(F.least(score, F.lit(1.0))).alias("risk_score"),
        F.when(none, string_array(["No award history"])).otherwise(factors).alias("risk_factors"),
        F.when(none, string_array(["Establish track record with smaller awards"])).otherwise(advice).alias("recommendations"),
    )


def profile(entities: DataFrame, history: DataFrame, areas: DataFrame | None = None) -> DataFrame:
    """Entity with its history metrics; entities without history give no row."""
    numbers = metrics(history, fx.PROFILE_SUCCESS_STATUSES).drop("small_awards", "medium_awards", "large_awards")
    out = entities.select("uei", "legal_name").join(numbers, "uei")
    if areas is not None:
        listed = areas.groupBy("uei").agg(F.array_sort(F.collect_set("area")).alias("technology_areas"))
        out = out.join(listed, "uei", "left").withColumn(
            "technology_areas", F.coalesce("technology_areas", F.array().cast("array<string>"))
        )
    return out


def validate_profiles(profiles: DataFrame, as_of: Column) -> DataFrame:
    """Add ``findings``: (field, severity, message) per problem, and ``is_valid`` (no error among them)."""
    c = F.col
    uei, name = F.coalesce(c("uei"), F.lit("")), F.coalesce(c("legal_name"), F.lit(""))
    agencies = F.coalesce(c("primary_agencies"), F.array().cast("array<string>"))
    areas = F.coalesce(c("technology_areas"), F.array().cast("array<string>"))
    expected = F.try_divide(c("total_funding"), c("total_awards"))

    def when(cond: Column, where: str, severity: str, message: str | Column) -> Column:
        text = F.lit(message) if isinstance(message, str) else message
        return F.when(cond, F.struct(F.lit(where).alias("field"), F.lit(severity).alias("severity"), text.alias("message")))

    e, w, say = "error", "warning", fx.FINDINGS
    single = [
        when(uei == "", "uei", e, say["uei_missing"]),
        when((uei != "") & ~uei.rlike(r"^[\p{L}\p{N}]+$"), "uei", e, say["uei_symbols"]),
        when((uei != "") & (F.length(uei) != 12), "uei", e, say["uei_length"]),
        when(name == "", "legal_name", e, say["name_missing"]),
        when((name != "") & (F.length(name) < 2), "legal_name", e, say["name_short"]),
        when(F.length(name) > 150, "legal_name", e, say["name_long"]),
        when(F.lower(name).isin(*fx.PLACEHOLDER_NAMES), "legal_name", w, say["name_placeholder"]),
        when((c("total_awards") > 0) & (F.abs(expected - c("avg_award_amount")) > 1.0), "avg_award_amount", w,
             F.format_string(fx.AVERAGE_MISMATCH, c("avg_award_amount").cast("string"), expected.cast("string"))),
        when(c("total_funding") > 1_000_000_000, "total_funding", w, say["funding_high"]),
        when(c("avg_award_amount") > 50_000_000, "avg_award_amount", w, say["average_high"]),
        when(c("first_award_date") > c("last_award_date"), "first_award_date", e, say["dates_crossed"]),
        when(c("first_award_date") > as_of, "first_award_date", w, say["first_in_future"]),
        when(c("last_award_date") > as_of, "last_award_date", w, say["last_in_future"]),
        when(F.year("first_award_date") < 1980, "first_award_date", w, say["first_old"]),
        when(F.size(areas) > 15, "technology_areas", e, say["many_areas"]),
        when((c("success_rate") > 0.9) & (c("avg_award_amount") < 10000), "success_rate", w,
             say["success_low_funding"]),
        when((c("total_awards") > 50) & (c("success_rate") > 0.95), "success_rate", w,
             say["success_many_awards"]),
        when((F.size(agencies) == 1) & (c("total_awards") > 10), "primary_agencies", w,
             say["one_agency"]),
        when(F.size(agencies) == 0, "primary_agencies", w, say["no_agencies"]),
        when(F.size(areas) == 0, "technology_areas", w, say["no_areas"]),
        when(c("total_awards") == 0, "total_awards", w, say["no_awards"]),
    ]

    def unknown(values: Column, known: Sequence[str], where: str, label: str) -> Column:
        odd = F.array_except(values, string_array(known))
        return F.transform(odd, lambda v: F.struct(F.lit(where).alias("field"), F.lit(w).alias("severity"),
                                                   F.concat(F.lit(f"Unknown {label}: "), v).alias("message")))

    findings = F.concat(
        F.filter(F.array(*single), lambda f: f.isNotNull()),
        unknown(agencies, fx.VALID_AGENCIES, "primary_agencies", "agency code"),
        unknown(areas, list(fx.EXPERTISE_KEYWORDS), "technology_areas", "technology area"),
    )
    out = profiles.withColumn("findings", findings)
    return out.withColumn("is_valid", ~F.exists("findings", lambda f: f["severity"] == "error"))


def finding_report(validated: DataFrame) -> DataFrame:
    return (
        validated.select(F.inline_outer("findings"))
        .where(F.col("field").isNotNull())
        .groupBy("field", "severity", "message")
        .agg(F.count(F.lit(1)).alias("profiles"))
    )


def modification_rollup(modifications: DataFrame) -> DataFrame:
    """Per award: number of modifications, net funding change, latest end date."""
    return modifications.groupBy("award_id").agg(
        F.count(F.lit(1)).alias("modifications"),
        F.sum(money(F.col("funding_change"))).cast("double").alias("total_funding_change"),
        F.max("new_end_date").alias("latest_end_date"),
    )


def history_between(history: DataFrame, uei: str, start: Column, end: Column) -> DataFrame:
    return history.where((F.col("uei") == uei) & F.col("start_date").between(start, end))
