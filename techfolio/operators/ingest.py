"""Award ingestion: cleaning, validation with quarantine, deduplication, load reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning as cl
from ..functions import fixed_values as fx
from .ranking import top_per_key


def _optional(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`").cast("string") if name in df.columns else F.lit(None).cast("string")


def clean_awards(
    raw: DataFrame,
    ingested_at: datetime | Column,
    kw_sep: str = ",",
    year_only: str = "07-01",
    phase_prefix: bool = True,
    source_version: str = "bootstrap_csv",
    fy_start_month: int = 1,
) -> DataFrame:
    """Text columns to canonical award columns; columns outside the award schema pass through."""
    at = ingested_at if isinstance(ingested_at, Column) else F.lit(ingested_at)

    def col(name: str) -> Column:
        return _optional(raw, name)

    on = cl.award_date(col("award_date"), col("award year"), col("solicitation_year"), at.cast("date"), year_only)
    abstract = cl.blank_to_null(col("abstract"))
    canonical = {
        "award_id": F.trim(col("award_id")),
        "agency": cl.normalize_agency(col("agency")),
        "sub_agency": cl.blank_to_null(col("sub_agency")),
        "topic_code": cl.or_placeholder(col("topic_code"), "UNKNOWN"),
        "abstract": abstract,
        "keywords": cl.split_keywords(col("keywords"), kw_sep),
        "phase": cl.normalize_phase(col("phase"), phase_prefix),
        "firm_name": cl.or_placeholder(col("firm_name"), "UNKNOWN"),
        "firm_city": cl.or_placeholder(col("firm_city"), "Unknown"),
        "firm_state": cl.normalize_state(col("firm_state")),
        "award_amount": cl.parse_amount(col("award_amount")),
        "award_date": on,
        "is_export_controlled": F.coalesce(col("is_export_controlled").try_cast("boolean"), F.lit(False)),
        "source_version": F.lit(source_version),
        "ingested_at": at,
        "program": cl.blank_to_null(col("program")),
        "solicitation_id": cl.blank_to_null(col("solicitation_id")),
        "solicitation_year": F.trim(col("solicitation_year")).try_cast("double").cast("int"),
        "fiscal_year": cl.fiscal_year(on, fy_start_month),
    }
    extra = [F.col(f"`{c}`") for c in raw.columns if c not in canonical and c != "award year"]
    return raw.select(*[c.alias(n) for n, c in canonical.items()], *extra)


def _failed(rules: Mapping[str, Column]) -> Column:
    """Names of the rules that do not hold; a null test counts as failed."""
    checks = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return F.filter(F.array(*checks), lambda r: r.isNotNull())


def award_rules() -> dict[str, Column]:
    c = F.col
    blank = cl.blank_to_null
    return {
        "has_text": blank(c("abstract")).isNotNull() | (F.size(F.coalesce(c("keywords"), F.array())) > 0),
        "amount_positive": c("award_amount") > 0,
        "date_present": c("award_date").isNotNull(),
        "id_present": blank(c("award_id")).isNotNull(),
        "agency_present": blank(c("agency")).isNotNull(),
        "agency_length": F.length("agency").between(1, 32),
        "sub_agency_length": c("sub_agency").isNull() | (F.length("sub_agency") <= 64),
        "topic_length": F.length("topic_code").between(1, 64),
        "phase_known": c("phase").isin(*fx.PHASES),
        "firm_present": F.length("firm_name") >= 1,
        "city_present": F.length("firm_city") >= 1,
        "state_length": F.length("firm_state") == 2,
    }


def prevalidation_rules() -> dict[str, Column]:
    names = ("has_text", "amount_positive", "date_present", "id_present", "agency_present")
    rules = award_rules()
    return {n: rules[n] for n in names}


def assessment_rules() -> dict[str, Column]:
    c = F.col
    supporting = F.coalesce(c("supporting_cet_ids"), F.array().cast("array<string>"))
    return {
        "score_range": c("score").between(0, 100),
        "band_known": c("classification").isin(*fx.BANDS),
        "supporting_excludes_primary": ~F.array_contains(supporting, c("primary_cet_id")),
        "supporting_unique": F.size(F.array_distinct(supporting)) == F.size(supporting),
        "supporting_at_most_three": F.size(supporting) <= fx.MAX_SUPPORTING,
        "evidence_at_most_three": F.coalesce(F.size("evidence_statements") <= 3, F.lit(True)),
        "evidence_short": F.coalesce(
            F.forall("evidence_statements", lambda e: F.size(F.split(F.trim(e["excerpt"]), r"\s+")) <= 50), F.lit(True)
        ),
        "method_known": c("generation_method").isin("automated", "manual_review"),
    }


def taxonomy_rules() -> dict[str, Column]:
    return {
        "retired_after_effective": F.col("retired_date").isNull() | (F.col("retired_date") >= F.col("effective_date")),
        "status_known": F.col("status").isin("active", "retired"),
    }


def queue_rules() -> dict[str, Column]:
    return {
        "resolved_after_opened": F.col("resolved_at").isNull()
        | (F.col("resolved_at").cast("date") >= F.col("opened_at").cast("date")),
        "reason_known": F.col("reason").isin(*fx.QUEUE_REASONS),
        "status_known": F.col("status").isin(*fx.QUEUE_STATUSES),
    }


def solicitation_rules() -> dict[str, Column]:
    c = F.col
    return {
        "funding_min_not_negative": c("funding_range_min") >= 0,
        "funding_order": c("funding_range_max") >= c("funding_range_min"),
        "period_positive": c("performance_period") > 0,
        "scores_in_unit": F.coalesce(
            F.forall(F.map_values("cet_relevance_scores"), lambda s: s.between(0.0, 1.0)), F.lit(True)
        ),
    }


def modification_rules(as_of: Column) -> dict[str, Column]:
    return {"date_not_future": F.col("modification_date") <= as_of}


def office_rules() -> dict[str, Column]:
    c = F.col
    return {
        "email_format": F.coalesce(c("contact_email").rlike(fx.EMAIL_PATTERN), F.lit(True)),
        "url_format": F.coalesce(c("website_url").rlike(fx.URL_PATTERN), F.lit(True)),
        "budget_not_negative": F.coalesce(c("annual_budget") >= 0, F.lit(True)),
        "counts_not_negative": (c("active_solicitations_count") >= 0) & (c("total_awards_managed") >= 0),
    }


def validate(df: DataFrame, rules: Mapping[str, Column] | None = None) -> DataFrame:
    """Add ``failed_rules``: the names of the rules a row breaks. One narrow pass."""
    return df.withColumn("failed_rules", _failed(rules if rules is not None else award_rules()))


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantine). Valid rows lose the rule column."""
    clean = F.size("failed_rules") == 0
    return validated.where(clean).drop("failed_rules"), validated.where(~clean)


def dedup_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep the row that ``order`` puts last per key (pass descending columns)."""
    return top_per_key(df, keys, order)


def dedup_first_synthetic(df: DataFrame, parts: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Give blank ids a synthetic id, then keep the first row per id."""
    with_id = df.withColumn("award_id", cl.synthetic_id(F.col("award_id"), [F.col(p) for p in parts]))
    return top_per_key(with_id, ["award_id"], order)


def load_report(validated: DataFrame) -> DataFrame:
    """One row: total, loaded and skipped rows."""
    ok = F.size("failed_rules") == 0
    return validated.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(ok).alias("loaded_rows"),
        F.count_if(~ok).alias("skipped_rows"),
    )


def failure_reasons(validated: DataFrame) -> DataFrame:
    return (
        validated.select(F.explode_outer("failed_rules").alias("rule"))
        .where(F.col("rule").isNotNull())
        .groupBy("rule")
        .agg(F.count(F.lit(1)).alias("failures"))
    )


def duplicate_report(df: DataFrame, key: str = "award_id", min_count: int = 2) -> DataFrame:
    """Ids that occur at least ``min_count`` times."""
    return (
        df.where(cl.blank_to_null(F.col(key)).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .where(F.col("occurrences") >= min_count)
    )


def missing_id_report(df: DataFrame, key: str = "award_id", by: str = "agency") -> DataFrame:
    return df.groupBy(by).agg(
        F.count_if(cl.blank_to_null(F.col(key)).isNull()).alias("missing_ids"), F.count(F.lit(1)).alias("row_count")
    )
