"""Rule configuration: one object on the driver, and its tables."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions import fixed_values as fx


@dataclass(frozen=True)
class Rules:
    """Keywords per area and bucket, priors per agency and branch, context rules per area."""

    keywords: Mapping[str, Mapping[str, Sequence[str]]] = field(default_factory=lambda: fx.AREA_KEYWORDS)
    agency_priors: Mapping[str, Mapping[str, float]] = field(default_factory=lambda: fx.AGENCY_PRIORS)
    branch_priors: Mapping[str, Mapping[str, float]] = field(default_factory=lambda: fx.BRANCH_PRIORS)
    context: Mapping[str, Sequence[tuple[Sequence[str], float]]] = field(default_factory=lambda: fx.CONTEXT_RULES)

    def areas(self) -> list[str]:
        """Every area id named anywhere, without the wildcard."""
        ids = set(self.keywords) | set(self.context)
        for table in (self.agency_priors, self.branch_priors):
            for points in table.values():
                ids |= set(points)
        return sorted(ids - {fx.ALL_AREAS})

    def agency_keys(self) -> dict[str, Mapping[str, float]]:
        """Agency priors by lower-cased name and, where the name has one, by its code."""
        out: dict[str, Mapping[str, float]] = {}
        for name, points in self.agency_priors.items():
            out.setdefault(name.lower(), points)
            code = fx.AGENCY_CODES.get(name)
            if code:
                out.setdefault(code.lower(), points)
        return out

    def branch_keys(self) -> dict[str, Mapping[str, float]]:
        out: dict[str, Mapping[str, float]] = {}
        for name, points in self.branch_priors.items():
            out.setdefault(name.lower(), points)
            code = fx.AGENCY_CODES.get(name)
            if code:
                out.setdefault(code.lower(), points)
        return out


def rules_from_json(text: str) -> Rules:
    """Rules from a JSON document with the same four sections."""
    doc = json.loads(text)
    return Rules(
        keywords={
            area: {b: tuple(buckets.get(b, ())) for b in ("core", "related", "negative")}
            for area, buckets in doc.get("cet_keywords", {}).items()
        },
        agency_priors=doc.get("agency_priors", {}),
        branch_priors=doc.get("branch_priors", {}),
        context={a: tuple((tuple(r[0]), r[1]) for r in rs) for a, rs in doc.get("context_rules", {}).items()},
    )


def keyword_rows(rules: Rules) -> list[tuple[str, str, str]]:
    return [
        (area, bucket, phrase.strip().lower())
        for area, buckets in rules.keywords.items()
        for bucket in ("core", "related", "negative")
        for phrase in buckets.get(bucket, ())
        if phrase.strip()
    ]


def prior_rows(rules: Rules) -> list[tuple[str, str, str, float]]:
    scopes = (("agency", rules.agency_keys()), ("branch", rules.branch_keys()))
    return [
        (scope, key, area, float(points))
        for scope, table in scopes
        for key, by_area in table.items()
        for area, points in by_area.items()
    ]


def context_rows(rules: Rules) -> list[tuple[str, list[str], float]]:
    return [
        (area, [w.strip().lower() for w in required], float(boost))
        for area, entries in rules.context.items()
        for required, boost in entries
        if required
    ]


def rule_tables(spark: SparkSession, rules: Rules) -> dict[str, DataFrame]:
    """Rules as dimension tables; their size is fixed by the rule document."""
    bands = [(label, low, high) for label, low, high in fx.CLOSED_BANDS]
    domains = [(k, name, list(words)) for k, (name, words) in fx.TOPIC_DOMAINS.items()]
    return {
        "keywords": spark.createDataFrame(keyword_rows(rules), "cet_id string, bucket string, phrase string"),
        "priors": spark.createDataFrame(prior_rows(rules), "scope string, key string, cet_id string, points double"),
        "context": spark.createDataFrame(context_rows(rules), "cet_id string, required array<string>, boost double"),
        "bands": spark.createDataFrame(bands, "label string, low double, high double"),
        "topic_domains": spark.createDataFrame(domains, "prefix string, name string, keywords array<string>"),
        "agency_focus": spark.createDataFrame(list(fx.AGENCY_FOCUS.items()), "agency string, focus string"),
    }
