"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T


_TEXTS = T.ArrayType(T.StringType())
_EVIDENCE = T.ArrayType(
    T.StructType([T.StructField(n, T.StringType()) for n in ("excerpt", "source_location", "rationale_tag")])
)
_TYPES = {
    "string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "bigint": T.LongType(),
    "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType(),
    "timestamp_ntz": T.TimestampNTZType(), "texts": _TEXTS, "evidence": _EVIDENCE,
}


def _schema(spec: str) -> T.StructType:
    """Schema from ``name type`` pairs; built without a session."""
    pairs = (part.split() for part in spec.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


AWARDS = _schema(
    "award_id string, agency string, sub_agency string, topic_code string, abstract string,"
    " keywords texts, phase string, firm_name string, firm_city string, firm_state string,"
    " award_amount double, award_date date, is_export_controlled boolean, source_version string,"
    " ingested_at timestamp, program string, solicitation_id string, solicitation_year int, fiscal_year int"
)
TAXONOMY = _schema(
    "cet_id string, name string, definition string, parent_cet_id string, version string,"
    " effective_date date, retired_date date, status string"
)
ASSESSMENTS = _schema(
    "assessment_id string, award_id string, taxonomy_version string, score double, classification string,"
    " primary_cet_id string, supporting_cet_ids texts,"
    " evidence_statements evidence,"
    " generation_method string, assessed_at timestamp, reviewer_notes string"
)
REVIEW_QUEUE = _schema(
    "queue_id string, award_id string, reason string, status string, assigned_to string,"
    " opened_at timestamp, due_by date, resolved_at timestamp, resolution_notes string"
)
SOLICITATIONS = _schema(
    "solicitation_id string, solicitation_number string, title string, agency_code string,"
    " program_office_id string, solicitation_type string, topic_number string, full_text string,"
    " technical_requirements string, evaluation_criteria string, funding_range_min double,"
    " funding_range_max double, proposal_deadline date, award_start_date date, performance_period bigint,"
    " keywords texts, cet_relevance_scores string, created_at timestamp_ntz, updated_at timestamp_ntz"
)
AWARDEE_PROFILES = _schema(
    "uei string, legal_name string, total_awards bigint, total_funding double, success_rate double,"
    " avg_award_amount double, first_award_date timestamp_ntz, last_award_date timestamp_ntz,"
    " primary_agencies texts, technology_areas texts"
)
PROGRAM_OFFICES = _schema(
    "office_id string, agency_code string, agency_name string, office_name string, office_description string,"
    " contact_email string, contact_phone string, website_url string, strategic_focus_areas texts,"
    " annual_budget double, active_solicitations_count bigint, total_awards_managed bigint,"
    " created_at timestamp_ntz, updated_at timestamp_ntz"
)
AWARD_MODIFICATIONS = _schema(
    "modification_id string, award_id string, modification_number string, modification_type string,"
    " modification_date date, description string, funding_change double, new_end_date date,"
    " scope_changes string, justification string, approving_official string, created_at timestamp_ntz"
)

STORED = {
    "awardee_profiles": AWARDEE_PROFILES,
    "program_offices": PROGRAM_OFFICES,
    "solicitations": SOLICITATIONS,
    "award_modifications": AWARD_MODIFICATIONS,
}
KEYS = {
    "awardee_profiles": "uei",
    "program_offices": "office_id",
    "solicitations": "solicitation_id",
    "award_modifications": "modification_id",
}
