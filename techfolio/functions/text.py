"""Column expressions over award and solicitation text. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fx
from .cleaning import blank_to_null, let
from .literals import constant


def string_array(values: Sequence[str]) -> Column:
    return constant(list(values))


def classification_text(abstract: Column, keywords: Column) -> Column:
    return F.concat_ws(" ", blank_to_null(abstract), F.nullif(F.array_join(keywords, " "), F.lit("")))


def enriched_text(award_text: Column, description: Column, keywords: Column) -> Column:
    return F.concat_ws(
        " ", award_text, blank_to_null(description), F.nullif(F.array_join(keywords, " "), F.lit(""))
    )


def weighted_text(sources: Mapping[str, Column], weights: Mapping[str, float], normalize: bool = False) -> Column:
    """Each source repeated ``max(1, round(10 * weight))`` times, blanks and weight <= 0 left out."""
    total = sum(weights.values())
    parts = []
    for name, weight in weights.items():
        w = weight / total if normalize and total > 0 else weight
        if w <= 0:
            continue
        text = blank_to_null(sources[name])
        parts.append(F.array_join(F.array_repeat(text, max(1, round(w * 10))), " "))
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def squeeze(text: Column) -> Column:
    """Lower case, whitespace runs to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def clean_text(text: Column) -> Column:
    no_tags = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", "")
    return F.trim(F.regexp_replace(no_tags, r"\s+", " "))


def first_words(text: Column, limit: int = 50) -> Column:
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    words = F.split(t, r"\s+")
    return F.when(F.size(words) <= limit, t).otherwise(F.array_join(F.slice(words, 1, limit), " "))


def _section(text: Column, headers: Sequence[str], any_case_stop: bool) -> Column:
    # The stop is an upper-case header line; the literal variant lets any all-letter line stop it.
    letters = r"[A-Za-z][A-Za-z ]+" if any_case_stop else r"[A-Z][A-Z ]+"
    stop = rf"(?=^\s*{letters}(?::|$)|\z)"
    found = [
        F.nullif(F.regexp_extract(text, rf"(?ms)(?i:{h})\s*:?\s*(.*?){stop}", 1), F.lit("")) for h in headers
    ]
    return F.coalesce(*found, F.lit(""))


def technical_requirements(text: Column, any_case_stop: bool = False) -> Column:
    return F.lower(clean_text(_section(text, fx.REQUIREMENT_HEADERS, any_case_stop)))


def evaluation_criteria(text: Column, any_case_stop: bool = False) -> Column:
    return clean_text(_section(text, fx.CRITERIA_HEADERS, any_case_stop))


def funding_range(text: Column, phase: str) -> tuple[Column, Column]:
    """(min, max) of the funding line of phase ``I`` or ``II``."""
    amount = fx.AMOUNT_PATTERN
    patterns = (
        rf"(?i)Phase\s+{phase}\s+awards?:?\s*{amount}\s*-\s*{amount}",
        rf"(?i)Phase\s+{phase}:?\s*{amount}\s*to\s*{amount}",
    )

    def bound(group: int) -> Column:
        found = [F.nullif(F.regexp_extract(text, p, group), F.lit("")) for p in patterns]
        return F.replace(F.coalesce(*found), F.lit(","), F.lit("")).try_cast("bigint")

    return bound(1), bound(2)


def labelled_date(text: Column, label: str) -> Column:
    """First labelled deadline that holds a readable date."""
    tries = []
    for pattern in fx.DEADLINE_LABELS[label]:
        line = F.regexp_extract(text, rf"(?i){pattern}:?\s*([^.\n]+)", 1)
        for shape, fmt in fx.DATE_SHAPES:
            tries.append(F.try_to_timestamp(F.nullif(F.regexp_extract(line, shape, 1), F.lit("")), F.lit(fmt)))
    return F.coalesce(*tries).cast("date")


def area_keywords(rules: Mapping[str, Mapping[str, Sequence[str]]] | None = None) -> dict[str, list[str]]:
    """Keyword list per area for extraction: core and related, plus the base lists."""
    rules = rules if rules is not None else fx.AREA_KEYWORDS
    out = {a: [k.lower() for k in (*b["core"], *b["related"])] for a, b in rules.items()}
    if rules is fx.AREA_KEYWORDS:
        for area in fx.EXTRACTION_BASE_AREAS:
            out[area] = sorted(set(out.get(area, [])) | set(fx.RELEVANCE_KEYWORDS[area]))
    return out


def found_keywords(text: Column, keywords: Sequence[str]) -> Column:
    """Distinct keywords contained in the lower-cased text, sorted."""
    words = string_array(sorted({k.lower() for k in keywords}))
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda t: F.filter(words, lambda k: F.contains(t, k)))


def technical_phrases(text: Column) -> Column:
    """Distinct 2-4 word phrases that end in a technical head or suffix, sorted."""
    stops, tails, heads = (string_array(v) for v in (fx.LEADING_STOPS, fx.TRAILING_TAILS, fx.TECH_HEADS))
    lowered = F.lower(F.coalesce(text, F.lit("")))

    def grams(tokens: Column) -> Column:
        def of_length(n: int) -> Column:
            starts = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
            none = F.array().cast("array<array<string>>")
            return F.when(F.size(tokens) >= n, F.transform(starts, lambda i: F.slice(tokens, i, n))).otherwise(none)

        return F.concat(*[of_length(n) for n in (2, 3, 4)])

    def drop_lead(words: Column) -> Column:
        # Up to four leading stop words; each step leaves the list alone once it is short or clean.
        for _ in range(4):
            words = let(
                words,
                lambda w: F.when(
                    (F.size(w) > 0) & F.array_contains(stops, F.get(w, 0)), F.slice(w, 2, 4)
                ).otherwise(w),
            )
        return words

    def drop_tail(w: Column) -> Column:
        last = F.get(w, F.size(w) - 1)
        return F.when((F.size(w) >= 3) & F.array_contains(tails, last), F.slice(w, F.lit(1), F.size(w) - 1)).otherwise(w)

    def keep(w: Column) -> Column:
        last = F.get(w, F.size(w) - 1)
        return F.array_contains(heads, last) | last.rlike(r"(ing|tion|s)$")

    def phrases(tokens: Column) -> Column:
        trimmed = F.filter(F.transform(grams(tokens), drop_lead), lambda w: F.size(w) >= 2)
        return F.transform(F.filter(F.transform(trimmed, drop_tail), keep), lambda w: F.array_join(w, " "))

    by_window = let(F.regexp_extract_all(lowered, F.lit("([a-z]+)"), F.lit(1)), phrases)
    by_head = [F.regexp_extract_all(lowered, F.lit(rf"\b([a-z]+\s+{h})\b"), F.lit(1)) for h in fx.TECH_HEADS]
    return F.array_sort(F.array_distinct(F.concat(by_window, *by_head)))


def drop_non_technical(terms: Column) -> Column:
    bad = string_array(fx.NON_TECHNICAL_TERMS)
    return F.filter(terms, lambda t: ~F.array_contains(bad, F.lower(t)))


def keyword_relevance(term: Column, keywords: Sequence[str]) -> Column:
    """+10 for an area keyword, +5 for a technical term inside, + word count."""
    known = string_array(sorted({k.lower() for k in keywords}))
    tech = string_array(fx.TECHNICAL_TERMS)
    low = F.lower(term)
    return (
        F.when(F.array_contains(known, low), 10).otherwise(0)
        + F.when(F.exists(tech, lambda k: F.contains(low, k)), 5).otherwise(0)
        + F.size(F.filter(F.split(term, r"\s+"), lambda w: w != ""))
    )


def ranked_keywords(terms: Column, keywords: Sequence[str]) -> Column:
    """Terms by relevance, ties in input order."""
    scored = F.transform(
        terms, lambda t, i: F.struct((-keyword_relevance(t, keywords)).alias("k"), i.alias("i"), t.alias("t"))
    )
    return F.transform(F.array_sort(scored), lambda s: s["t"])


def sentences(text: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` and white space."""
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


def evidence_sentences(text: Column, keywords: Sequence[str]) -> Column:
    words = string_array([k.lower() for k in keywords])
    return F.filter(
        sentences(F.coalesce(text, F.lit(""))),
        lambda s: let(F.lower(s), lambda low: F.exists(words, lambda k: F.contains(low, k))),
    )


def evidence_excerpt(text: Column, keywords: Sequence[str], fallback: str = "") -> Column:
    """First matching sentence, else the fallback, else the first 280 characters; at most 50 words."""
    rest = F.lit(fallback) if fallback else F.substring(F.coalesce(text, F.lit("")), 1, 280)
    pick = F.coalesce(F.get(evidence_sentences(text, keywords), 0), rest)
    return first_words(pick, 50)


def band(score: Column, closed: bool = False) -> Column:
    """High / Medium / Low. ``closed`` uses the integer-closed table, where 69.5 falls to Low."""
    out = F
    if closed:
        for label, low, high in fx.CLOSED_BANDS:
            out = out.when(score.between(low, high), F.lit(label))
    else:
        for label, floor in fx.BAND_FLOORS:
            out = out.when(score >= floor, F.lit(label))
    return out.otherwise(F.lit("Low"))
