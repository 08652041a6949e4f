"""Match-confidence formulas."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fx


def _flag(c: Column, weight: float) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), F.lit(weight)).otherwise(F.lit(0.0))


def match_components(
    uei_exact: Column,
    name_exact: Column,
    name_similarity: Column,
    award_number_exact: Column,
    address_similarity: Column,
    weights: Mapping[str, float] | None = None,
) -> Column:
    """Struct with the points each factor gives."""
    w = {**fx.MATCH_WEIGHTS, **(weights or {})}
    if any(not 0.0 <= v <= 1.0 for v in w.values()):
        raise ValueError("weights must lie between 0 and 1")
    return F.struct(
        _flag(uei_exact, w["uei_exact"]).alias("uei_exact"),
        _flag(name_exact, w["name_exact"]).alias("name_exact"),
        (F.coalesce(name_similarity, F.lit(0.0)) * w["name_similarity"]).alias("name_similarity"),
        _flag(award_number_exact, w["award_number_exact"]).alias("award_number_exact"),
        (F.coalesce(address_similarity, F.lit(0.0)) * w["address_similarity"]).alias("address_similarity"),
    )


def match_score(components: Column) -> Column:
    total = sum((components[name] for name in fx.MATCH_WEIGHTS), F.lit(0.0))
    return F.least(total, F.lit(1.0))


def confidence_level(score: Column, high: float | None = None, medium: float | None = None) -> Column:
    high = fx.CONFIDENCE_LEVELS["high"] if high is None else high
    medium = fx.CONFIDENCE_LEVELS["medium"] if medium is None else medium
    if not 0.0 <= medium <= high <= 1.0:
        raise ValueError("thresholds must ascend within 0..1")
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def comprehensive_confidence(uei: Column, name_match: Column, similarity: Column, number: Column) -> Column:
    """.5 UEI, .3 name match or .2 x similarity, .2 award number, at most 1."""
    sim = F.coalesce(similarity, F.lit(0.0))
    name = F.when(F.coalesce(name_match, F.lit(False)), F.lit(0.3)).otherwise(sim * 0.2)
    return F.least(_flag(uei, 0.5) + name + _flag(number, 0.2), F.lit(1.0))


def simple_confidence(uei: Column, similarity: Column, number: Column) -> Column:
    """.5 UEI, .65 x similarity, .2 award number, at most 1."""
    sim = F.coalesce(similarity, F.lit(0.0))
    return F.least(_flag(uei, 0.5) + sim * 0.65 + _flag(number, 0.2), F.lit(1.0))
