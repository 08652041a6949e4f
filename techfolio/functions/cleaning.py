"""Column expressions that clean award fields (names, codes, amounts, dates, keywords)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fx
from .literals import sql_text

DATE_FORMATS = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "M/d/yyyy",
    "MMMM d, yyyy",
    "MMM d, yyyy",
    "d-MMM-yyyy",
    "yyyyMMdd",
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Without it the optimizer may inline the expression into a lambda and evaluate it per element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def lookup(key: Column, table: Mapping[str, str]) -> Column:
    """Value of a small fixed map for ``key``, null when absent."""
    pairs = ", ".join(f"{sql_text(k)}, {sql_text(v)}" for k, v in table.items())
    return F.try_element_at(F.expr(f"map({pairs})"), key)


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def normalize_agency(name: Column) -> Column:
    """Exact or case-insensitive name to code; short names pass; the rest is ``UNKNOWN``."""
    upper = {k.upper(): v for k, v in fx.AGENCY_CODES.items()}
    return (
        F.when(name.isNull() | (name == ""), F.lit("UNKNOWN"))
        .otherwise(
            F.coalesce(
                lookup(F.upper(name), upper),
                F.when(F.length(name) <= 32, name),
                F.lit("UNKNOWN"),
            )
        )
    )


def normalize_state(state: Column) -> Column:
    s = F.trim(state)
    return F.coalesce(
        lookup(F.lower(s), fx.STATE_CODES),
        F.when(F.length(s) == 2, F.upper(s)),
        F.lit("XX"),
    )


def normalize_phase(phase: Column, accept_prefix: bool = True) -> Column:
    p = F.upper(F.trim(phase))
    if accept_prefix:
        p = F.regexp_replace(p, r"^PHASE\s+", "")
    out = F
    for code, tokens in fx.PHASE_TOKENS.items():
        out = out.when(p.isin(*tokens), F.lit(code))
    return out.otherwise(F.lit("Other"))


def parse_amount(amount: Column) -> Column:
    return F.regexp_replace(amount, r"[$,\s]", "").try_cast("double")


def parse_date(text: Column, year_only: str = "07-01", formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Year-only text becomes ``year_only`` of that year; otherwise the first format that fits."""
    t = F.trim(text)
    month, day = (int(x) for x in year_only.split("-"))
    year = F.when(t.rlike(r"^\d{4}$"), F.make_date(t.try_cast("int"), F.lit(month), F.lit(day)))
    tries = [F.try_to_timestamp(t, F.lit(f)).cast("date") for f in formats]
    return F.coalesce(year, *tries)


def award_date(
    date_text: Column, award_year: Column, solicitation_year: Column, ingested_on: Column, year_only: str = "07-01"
) -> Column:
    """Date with its fallback chain. A text that no format fits falls to the ingest date at once."""
    month, day = (int(x) for x in year_only.split("-"))

    def from_year(y: Column) -> Column:
        n = F.trim(y).try_cast("double").cast("int")
        return F.when(n.between(1, 9999), F.make_date(n, F.lit(month), F.lit(day)))

    return (
        F.when(blank_to_null(date_text).isNotNull(), F.coalesce(parse_date(date_text, year_only), ingested_on))
        .otherwise(F.coalesce(from_year(award_year), from_year(solicitation_year), ingested_on))
    )


def split_keywords(text: Column, sep: str = ";") -> Column:
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "\\Q" + sep + "\\E"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def or_placeholder(c: Column, placeholder: str) -> Column:
    return F.coalesce(blank_to_null(c), F.lit(placeholder))


def fiscal_year(date: Column, start_month: int = 1) -> Column:
    """Year of the date; with ``start_month`` > 1 the year in which that fiscal year ends."""
    if start_month == 1:
        return F.year(date)
    return F.year(date) + F.when(F.month(date) >= start_month, 1).otherwise(0)


def synthetic_id(award_id: Column, parts: Sequence[Column]) -> Column:
    """Keep a present id; else ``SYNTH-`` and 16 hex digits over the descriptive fields."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.coalesce(blank_to_null(award_id), F.concat(F.lit("SYNTH-"), F.substring(F.md5(text), 1, 16)))


def solicitation_key(topic_code: Column, solicitation_id: Column, program: Column, year: Column) -> Column:
    topic = F.when(topic_code != "UNKNOWN", F.nullif(topic_code, F.lit("")))
    by_program = F.when(
        (F.length(program) > 0) & (year != 0), F.concat(program, F.lit("-"), year.cast("string"))
    )
    return F.coalesce(topic, F.nullif(solicitation_id, F.lit("")), by_program)


def api_source(agency: Column, default: str | None = None) -> Column:
    """Source by agency code: containment either way, else ``default``."""
    a = F.upper(F.trim(agency))
    options = [
        F.when(a.contains(code) | F.contains(F.lit(code), a), F.lit(source))
        for code, source in fx.AGENCY_API_SOURCES.items()
    ]
    return F.coalesce(*options, F.lit(default).cast("string"))


def valid_uei(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z0-9]{12}$"), F.lit(False))


def valid_duns(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[0-9]{9}$"), F.lit(False))


def valid_award_number(c: Column) -> Column:
    return F.coalesce(F.length(c) >= 5, F.lit(False))


def fallback_context(topic_code: Column, agency: Column, program: Column) -> tuple[Column, Column]:
    """(description, keywords) made from topic prefix, agency and program phase."""
    prefix = F.upper(F.substring(topic_code, 1, 2))
    name = F.coalesce(lookup(prefix, {k: v[0] for k, v in fx.TOPIC_DOMAINS.items()}), F.lit(fx.DEFAULT_DOMAIN[0]))
    words = F.coalesce(
        F.split(lookup(prefix, {k: "|".join(v[1]) for k, v in fx.TOPIC_DOMAINS.items()}), "\\|"),
        F.array(*[F.lit(w) for w in fx.DEFAULT_DOMAIN[1]]),
    )
    focus = F.coalesce(lookup(agency, fx.AGENCY_FOCUS), F.lit(fx.DEFAULT_FOCUS))
    p = F.lower(program)
    extra = (
        F.when(p.contains("phase ii"), F.array(*[F.lit(w) for w in fx.PHASE_KEYWORDS["II"]]))
        .when(p.contains("phase i"), F.array(*[F.lit(w) for w in fx.PHASE_KEYWORDS["I"]]))
        .otherwise(F.array().cast("array<string>"))
    )
    return F.concat_ws(" research for ", name, focus), F.concat(words, extra)


def enrichment_confidence(uei: Column, name: Column, amount: Column, has_history: Column) -> Column:
    def points(cond: Column, w: int) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), w).otherwise(0)

    total = (
        points(F.length(uei) > 0, 4)
        + points(F.length(name) > 0, 3)
        + points(amount > 0, 2)
        + points(has_history, 1)
    )
    return total.cast("double") / F.lit(10.0)


def enrichment_valid(name: Column, amount: Column) -> Column:
    return blank_to_null(name).isNotNull() & F.coalesce(amount >= 0, F.lit(True))
