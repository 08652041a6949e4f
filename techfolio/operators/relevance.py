"""Relevance scorer: keyword density, TF-IDF similarity and phrases per area, combined to 0..1.

Like the rules, the area keywords are a fixed document and travel as literals, so a text is scored in one
narrow projection. The TF-IDF weights of the areas are computed from that document when the plan is built.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import top_of

from ..functions import fixed_values as fx
from ..functions.cleaning import let
from ..functions.literals import constant
from ..functions.text import string_array

# Common English function words; left out of texts and areas before n-grams are built.
STOP_WORDS = (
    "a", "about", "above", "after", "again", "against", "all", "also", "am", "an", "and", "any", "are", "as", "at",
    "be", "because", "been", "before", "being", "below", "between", "both", "but", "by", "can", "could", "did", "do",
    "does", "down", "during", "each", "few", "for", "from", "further", "had", "has", "have", "he", "her", "here", "hers",
    "him", "his", "how", "i", "if", "in", "into", "is", "it", "its", "me", "more", "most", "my", "no", "nor", "not", "now",
    "of", "off", "on", "once", "only", "or", "other", "our", "out", "over", "own", "same", "she", "should", "so", "some",
    "such", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "those", "through", "to",
    "too", "under", "until", "up", "very", "was", "we", "were", "what", "when", "where", "which", "while", "who", "whom",
    "why", "will", "with", "would", "you", "your",
)
TOKEN = r"[\p{L}\p{N}_]{2,}"


def shipped_areas() -> dict[str, list[str]]:
    """Ten areas with the rule keywords (core, related) and the base keywords, lower-cased and sorted."""
    out = {}
    for area, base in fx.RELEVANCE_KEYWORDS.items():
        buckets = fx.AREA_KEYWORDS.get(area, {"core": (), "related": ()})
        out[area] = sorted({k.lower() for k in (*buckets["core"], *buckets["related"], *base)})
    return out


def phrase_variants(phrase: str) -> list[str]:
    """The phrase and its plural spellings; a single word stays as it is."""
    *head, last = phrase.split()
    if not head:
        return [phrase]
    endings = [last, f"{last}s", f"{last}es"] + ([f"{last[:-1]}ies"] if last.endswith("y") and len(last) > 1 else [])
    return list(dict.fromkeys([phrase, *[" ".join([*head, e]) for e in endings]]))


def grams(tokens: Sequence[str], longest: int = 3) -> list[str]:
    return [" ".join(tokens[i : i + n]) for n in range(1, longest + 1) for i in range(len(tokens) - n + 1)]


@dataclass(frozen=True)
class Areas:
    """Area keywords with the TF-IDF weights derived from them."""

    keywords: Mapping[str, Sequence[str]] = field(default_factory=shipped_areas)
    stop_words: Sequence[str] = STOP_WORDS

    def weights(self) -> tuple[dict[str, float], dict[str, dict[str, float]]]:
        """(idf per term, unit-length weights per area)."""
        counts = {}
        for area, words in self.keywords.items():
            tokens = [t for t in re.findall(r"\b\w\w+\b", " ".join(words).lower()) if t not in set(self.stop_words)]
            counts[area] = Counter(grams(tokens))
        seen = Counter(t for c in counts.values() for t in c)
        n = len(counts)
        idf = {t: math.log((1 + n) / (1 + df)) + 1.0 for t, df in sorted(seen.items())}
        out = {}
        for area, c in counts.items():
            raw = {t: k * idf[t] for t, k in c.items()}
            norm = math.sqrt(sum(v * v for v in raw.values())) or 1.0
            out[area] = {t: v / norm for t, v in raw.items()}
        return idf, out


def _keyword_table(areas: Areas) -> Column:
    return constant(
        [
            {
                "cet_id": area,
                "i": i,
                "words": [{"k": k, "phrase": " " in k, "variants": phrase_variants(k), "tokens": k.split()} for k in words],
            }
            for i, (area, words) in enumerate(areas.keywords.items())
        ]
    )


def _total(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + value(x))


def _occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences; the replace only runs for contained parts."""
    count = (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)
    return F.when(F.contains(text, part), count).otherwise(0.0)


def _keyword_score(t: Column, words: Column, area: Column) -> Column:
    n = F.size(words)

    def partial(token: Column) -> Column:
        count = F.size(F.filter(words, lambda w: F.contains(w, token) & (w != token))).cast("double")
        return F.when(F.contains(t, token), count).otherwise(0.0)

    def one(k: Column) -> Column:
        exact = _total(k["variants"], lambda v: _occurrences(t, v))
        loose = _total(k["tokens"], partial)
        return F.least((exact * fx.EXACT_POINTS + loose * fx.PARTIAL_POINTS) / F.greatest(n, F.lit(1)), F.lit(fx.KEYWORD_CAP))

    return F.when(n == 0, 0.0).otherwise(F.least(_total(area["words"], one), F.lit(1.0)))


def _phrase_score(t: Column, words: Column, area: Column) -> Column:
    def one(k: Column) -> Column:
        exact = F.when(F.exists(k["variants"], lambda v: F.contains(t, v)), fx.PHRASE_POINTS).otherwise(0.0)
        present = F.size(F.filter(k["tokens"], lambda w: F.contains(t, w) & F.array_contains(words, w)))
        most = present >= F.size(k["tokens"]) * F.lit(fx.PARTIAL_PHRASE_SHARE)
        return exact + F.when(most, fx.PARTIAL_PHRASE_POINTS).otherwise(0.0)

    return F.least(_total(F.filter(area["words"], lambda k: k["phrase"]), one), F.lit(1.0))


def _term_hits(text: Column, areas: Areas) -> Column:
    """The area terms a text holds: (count x idf, weight per area). Terms are words, pairs and triples of the
    text without stop words; each word is fenced by its own spaces so that repeats are counted."""
    idf, weights = areas.weights()
    order = list(areas.keywords)
    by_first: dict[str, list[dict]] = {}
    for term, value in idf.items():
        entry = {"fenced": " " + term.replace(" ", "  ") + " ", "idf": value, "w": [weights[a].get(term, 0.0) for a in order]}
        by_first.setdefault(term.split()[0], []).append(entry)
    # Every word of a term is a term itself, so the words the text shares with the vocabulary tell which terms to look for.
    words = string_array(sorted(by_first))
    vocabulary = constant([{"first": w, "terms": by_first[w]} for w in sorted(by_first)])
    tokens = F.filter(
        F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1)), lambda w: ~w.isin(*areas.stop_words)
    )

    def weigh(toks: Column) -> Column:
        fenced = F.concat(F.lit(" "), F.array_join(toks, "  "), F.lit(" "))
        # The look-ahead counts terms that overlap themselves.
        count = lambda s, v: F.regexp_count(s, F.concat(F.lit("(?=\\Q"), v["fenced"], F.lit("\\E)")))

        def held(common: Column) -> Column:
            likely = F.flatten(F.transform(F.filter(vocabulary, lambda g: F.array_contains(common, g["first"])), lambda g: g["terms"]))
            return let(
                fenced,
                lambda s: F.transform(
                    F.filter(likely, lambda v: F.contains(s, v["fenced"])),
                    lambda v: F.struct((count(s, v) * v["idf"]).alias("x"), v["w"].alias("w")),
                ),
            )

        return let(F.array_intersect(toks, words), held)

    return let(tokens, weigh)


def component_array(text: Column, areas: Areas | None = None) -> Column:
    """``array<struct<cet_id, keyword, semantic, phrase, matched, score>>`` over the areas."""
    areas = areas or Areas()
    table = _keyword_table(areas)
    safe = F.coalesce(text, F.lit(""))

    def semantic(hits: Column, i: Column) -> Column:
        norm = F.sqrt(_total(hits, lambda h: h["x"] * h["x"]))
        dot = _total(hits, lambda h: h["x"] * F.get(h["w"], i))
        return F.when(norm > 0, F.greatest(dot / norm, F.lit(0.0))).otherwise(0.0)

    def combine(p: Column) -> Column:
        phrases = F.size(F.filter(p["matched"], lambda k: F.contains(k, F.lit(" "))))
        many = F.size(p["matched"]) >= 2
        base = (
            p["keyword"] * fx.KEYWORD_SHARE + p["semantic"] * fx.SEMANTIC_SHARE + p["phrase"] * fx.PHRASE_SHARE
            + F.when(many, fx.SYNERGY_MANY).otherwise(0.0) + F.when(phrases >= 1, fx.SYNERGY_PHRASE).otherwise(0.0)
        )
        floor = F.when(phrases >= 1, fx.FLOOR_PHRASE).when(F.size(p["matched"]) >= 1, fx.FLOOR_WORD).otherwise(0.0)
        names = ("cet_id", "keyword", "semantic", "phrase", "matched")
        return F.struct(*[p[n].alias(n) for n in names], F.least(F.lit(1.0), F.greatest(base, floor)).alias("score"))

    # A keyword can only score if the text holds one of its tokens; the rest drop out after one look per token.
    tokens = string_array(sorted({w for ks in areas.keywords.values() for k in ks for w in k.split()}))

    def active(a: Column, seen: Column) -> Column:
        live = F.filter(a["words"], lambda k: F.arrays_overlap(k["tokens"], seen))
        return F.struct(a["cet_id"].alias("cet_id"), a["i"].alias("i"), live.alias("words"))

    def parts(t: Column, words: Column, hits: Column) -> Column:
        live = let(F.filter(tokens, lambda w: F.contains(t, w)), lambda seen: F.transform(table, lambda a: active(a, seen)))
        return F.transform(
            live,
            lambda a: F.struct(
                a["cet_id"].alias("cet_id"), _keyword_score(t, words, a).alias("keyword"), semantic(hits, a["i"]).alias("semantic"),
                _phrase_score(t, words, a).alias("phrase"),
                F.transform(F.filter(a["words"], lambda k: F.contains(t, k["k"])), lambda k: k["k"]).alias("matched"),
            ),
        )

    scored = let(
        F.lower(safe),
        lambda t: let(
            F.filter(F.split(t, r"\s+"), lambda w: w != ""),
            lambda words: let(_term_hits(t, areas), lambda hits: parts(t, words, hits)),
        ),
    )
    return F.transform(scored, combine)


def components(texts: DataFrame, areas: Areas | None = None) -> DataFrame:
    """(key, cet_id, keyword, semantic, phrase, matched, score), one row per text and area."""
    return texts.select("key", F.inline_outer(component_array(F.col("text"), areas)))


def score(texts: DataFrame, areas: Areas | None = None) -> DataFrame:
    return components(texts, areas).select("key", "cet_id", "score")


def score_map(text: Column, areas: Areas | None = None) -> Column:
    """Scores as ``map<string, double>``."""
    pairs = F.transform(component_array(text, areas), lambda p: F.struct(p["cet_id"].alias("key"), p["score"].alias("value")))
    return F.map_from_entries(pairs)


def _scores(texts: DataFrame, areas: Areas | None, digits: int | None) -> DataFrame:
    value = lambda p: p["score"] if digits is None else F.round(p["score"], digits)
    return texts.select("key", F.transform(component_array(F.col("text"), areas), lambda p: F.struct(p["cet_id"].alias("cet_id"), value(p).alias("score"))).alias("scores"))


def top_areas(texts: DataFrame, n: int, areas: Areas | None = None, digits: int | None = None) -> DataFrame:
    """The n best areas per text with their rank, ``digits`` decided on. A text's areas lie in one array: no shuffle."""
    best = _scores(texts, areas, digits).select("key", F.posexplode_outer(top_of(F.col("scores"), n)).alias("p", "s"))
    return best.select("key", "s.cet_id", "s.score", (F.col("p") + 1).alias("area_rank"))


def normalized(texts: DataFrame, areas: Areas | None = None) -> DataFrame:
    """(key, cet_id, score): positive scores divided by their sum over the text's areas; all zero stays zero."""
    positive = lambda s: F.greatest(s["score"], F.lit(0.0))
    rows = _scores(texts, areas, None).withColumn("total", F.aggregate("scores", F.lit(0.0), lambda a, s: a + positive(s)))
    shares = F.transform("scores", lambda s: F.struct(s["cet_id"].alias("cet_id"), F.when(F.col("total") > 0, positive(s) / F.col("total")).otherwise(0.0).alias("score")))
    return rows.select("key", F.inline_outer(shares))


def parsed_scores(provided: Column, text: Column, areas: Areas | None = None) -> Column:
    """The provided score map where it has entries, else the computed one."""
    return F.when(F.size(provided) > 0, provided).otherwise(score_map(text, areas))


def parsed_keywords(provided: Column, text: Column, keywords: Sequence[str]) -> Column:
    from ..functions.text import found_keywords

    return F.when(F.size(provided) > 0, provided).otherwise(found_keywords(text, keywords))
