"""Rules and areas whose phrases occur in the test prose (the shipped ones hardly do)."""

from __future__ import annotations

from ..operators.relevance import Areas
from ..sources.rules import Rules

PROSE_RULES = Rules(
    keywords={
        "english": {
            "core": ("the", "and the", "with", "that is", "license", "thanedble the"),
            "related": ("tion", "ing", "for the", "from", "was a", "it is"),
            "negative": ("eaux", "und", " la ", "que"),
        },
        "french": {
            "core": ("eaux", "le ", "des", "être", "que la"),
            "related": ("tion", "ment", "pour", "avec"),
            "negative": ("the ", "und", "ing"),
        },
        "german": {
            "core": ("der die", "und", "sch", "ung", "von"),
            "related": ("den", "ist", "mit", "ein"),
            "negative": ("the ", "eaux"),
        },
        "spanish": {"core": ("el ", "los", "ción", "para"), "related": ("en la", "del", "una"), "negative": ()},
    },
    agency_priors={"EN": {"english": 10, "legal": 5}, "fr": {"french": 15}, "de": {"_all_cets": 5, "german": 10}},
    branch_priors={"src3": {"spanish": 20}, "src7": {"_all_cets": 3}},
    context={
        "legal": ((("license", "the"), 20), (("permission", "copy"), 15)),
        "english": ((("for the", "with"), 20),),
    },
)

PROSE_AREAS = Areas(
    keywords={
        "english": ["and attion", "eriner thanea", "for the", "license", "that the", "th", "with"],
        "french": ["de la", "des", "eaux", "ouon", "que la"],
        "german": ["der die", "und", "ung"],
        "spanish": ["el", "en la", "los ción"],
    },
    stop_words=("the", "of", "a", "and", "is"),
)
