"""Text extraction, rule scoring and relevance queries over the documents, benchmark and pages tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning as cl
from ..functions import fixed_values as fx
from ..functions import text as tx
from ..functions.literals import constant
from ..operators import relevance, rules
from ..sources.rules import Rules, context_rows, keyword_rows, prior_rows
from .adapters import ctes
from .prose import PROSE_AREAS, PROSE_RULES
from .registry import query


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows, alias: str) -> str:
    """SQL VALUES table of strings and numbers."""
    cell = lambda v: q(v) if isinstance(v, str) else f"CAST({v!r} AS DOUBLE)"
    return "(VALUES " + ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows) + f") {alias}"


_WORDS = r"list_filter(regexp_split_to_array({t}, '\s+'), lambda w: w <> '')"
_DOC = "CAST(doc_id AS VARCHAR)"


def docs(t):
    return t.texts


# --- text building ---------------------------------------------------------------------------
@query("p10_classification_text", ctes("award_text") + """
SELECT award_id, concat_ws(' ', nullif(trim(abstract), ''), nullif(array_to_string(keywords, ' '), '')) AS text FROM award_text""")
def p10(t):
    return t.award_text.select("award_id", tx.classification_text(F.col("abstract"), F.col("keywords")).alias("text"))


@query("p11_enriched_text", ctes("cache") + f"""
SELECT {_DOC} AS key, concat_ws(' ', text, nullif(trim(c.description), ''), nullif(array_to_string(c.technical_keywords, ' '), '')) AS text
FROM documents LEFT JOIN cache c ON c.solicitation_id = {_DOC}""")
def p11(t):
    joined = docs(t).join(t.cache, F.col("key") == F.col("solicitation_id"), "left")
    return joined.select("key", tx.enriched_text(F.col("text"), F.col("description"), F.col("technical_keywords")).alias("text"))


@query("p12_weighted_text", f"""
SELECT {_DOC} AS key, concat_ws(' ', CASE WHEN trim(text) <> '' THEN repeat(trim(text) || ' ', 4) || trim(text) END,
  repeat(lang || ' ', 2) || lang, repeat(source || ' ', 1) || source) AS text FROM documents""")
def p12(t):
    sources = {"abstract": F.col("text"), "lang": F.col("agency"), "source": F.col("branch")}
    weights = {"abstract": 0.5, "lang": 0.3, "source": 0.2}
    return docs(t).select("key", tx.weighted_text(sources, weights).alias("text"))


@query("p13_bands", ctes("assessments") + """
SELECT assessment_id, score, CASE WHEN score - 0.5 >= 70 THEN 'High' WHEN score - 0.5 >= 40 THEN 'Medium' ELSE 'Low' END AS band,
  CASE WHEN score - 0.5 BETWEEN 70 AND 100 THEN 'High' WHEN score - 0.5 BETWEEN 40 AND 69 THEN 'Medium' ELSE 'Low' END AS closed_band FROM assessments""")
def p13(t):
    s = F.col("score") - 0.5
    return t.assessments.select("assessment_id", "score", tx.band(s).alias("band"), tx.band(s, closed=True).alias("closed_band"))


@query("p14_first_words", rf"""
SELECT {_DOC} AS key, CASE WHEN len(regexp_split_to_array(trim(text, E' \t\n\r\f'), '\s+')) <= 50 THEN trim(text, E' \t\n\r\f')
  ELSE array_to_string(regexp_split_to_array(trim(text, E' \t\n\r\f'), '\s+')[:50], ' ') END AS excerpt FROM documents""")
def p14(t):
    return docs(t).select("key", tx.first_words(F.col("text")).alias("excerpt"))


@query("p15_clean_html", r"""
SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS text FROM pages""")
def p15(t):
    return t.raw("pages").select("page_id", tx.clean_text(F.col("html")).alias("text"))


# Solicitations whose labelled sections are filled from the tables.
_SOL_SQL = """sol AS (
  SELECT CAST(doc_id AS VARCHAR) AS key,
    'Overview of ' || source || chr(10)
    || CASE doc_id % 3 WHEN 0 THEN 'Technical Requirements: ' WHEN 1 THEN 'TECHNICAL APPROACH ' ELSE 'Technical objective: ' END
    || text || chr(10) || CASE doc_id % 4 WHEN 0 THEN 'EVALUATION CRITERIA:' WHEN 1 THEN 'SELECTION  CRITERIA' WHEN 2 THEN 'Award criteria:' ELSE 'NOTES' END
    || ' <b>' || lang || '</b>  quality' || chr(10) || 'FUNDING' || chr(10)
    || 'Phase I awards: $' || CAST(doc_id % 900 + 1 AS VARCHAR) || ',000 - $' || CAST(doc_id % 900 + 50 AS VARCHAR) || ',500' || chr(10)
    || CASE WHEN doc_id % 2 = 0 THEN 'Phase II: $1,' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') || ',000 to 2,000,000' ELSE 'Phase II to be set' END || chr(10)
    || CASE doc_id % 3 WHEN 0 THEN 'Proposal submission deadline: June ' || CAST(doc_id % 28 + 1 AS VARCHAR) || ', 2024'
            WHEN 1 THEN 'Due date: ' || CAST(doc_id % 12 + 1 AS VARCHAR) || '/15/2024' ELSE 'Deadline: on 2024-03-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || ' noon' END || chr(10)
    || CASE WHEN doc_id % 2 = 0 THEN 'Award notification: September 1, 2024' ELSE 'Notification date: soon' END || chr(10)
    || 'Performance start date: October ' || CAST(doc_id % 30 + 1 AS VARCHAR) || ', 2024' AS full_text
  FROM documents)"""


def solicitation_texts(t):
    d = F.col("doc_id")
    s = lambda c: c.cast("string")
    nl = F.lit("\n")
    requirement = F.when(d % 3 == 0, "Technical Requirements: ").when(d % 3 == 1, "TECHNICAL APPROACH ").otherwise("Technical objective: ")
    criteria = F.when(d % 4 == 0, "EVALUATION CRITERIA:").when(d % 4 == 1, "SELECTION  CRITERIA").when(d % 4 == 2, "Award criteria:").otherwise("NOTES")
    second = F.when(d % 2 == 0, F.concat(F.lit("Phase II: $1,"), F.lpad(s(d % 1000), 3, "0"), F.lit(",000 to 2,000,000"))).otherwise("Phase II to be set")
    due = (
        F.when(d % 3 == 0, F.concat(F.lit("Proposal submission deadline: June "), s(d % 28 + 1), F.lit(", 2024")))
        .when(d % 3 == 1, F.concat(F.lit("Due date: "), s(d % 12 + 1), F.lit("/15/2024")))
        .otherwise(F.concat(F.lit("Deadline: on 2024-03-"), F.lpad(s(d % 28 + 1), 2, "0"), F.lit(" noon")))
    )
    notice = F.when(d % 2 == 0, "Award notification: September 1, 2024").otherwise("Notification date: soon")
    text = F.concat(
        F.lit("Overview of "), "source", nl, requirement, "text", nl, criteria, F.lit(" <b>"), "lang", F.lit("</b>  quality"), nl,
        F.lit("FUNDING"), nl, F.lit("Phase I awards: $"), s(d % 900 + 1), F.lit(",000 - $"), s(d % 900 + 50), F.lit(",500"), nl,
        second, nl, due, nl, notice, nl, F.lit("Performance start date: October "), s(d % 30 + 1), F.lit(", 2024"),
    )
    return t.documents.select(s(d).alias("key"), text.alias("full_text"))


def _section_sql(headers) -> str:
    tail = r"\s*:?\s*(.*?)(?:^\s*[A-Z][A-Z ]+(?::|$)|\z)"
    found = ", ".join(f"nullif(regexp_extract(full_text, '(?ms)(?i:{h}){tail}', 1), '')" for h in headers)
    raw = f"coalesce({found}, '')"
    return rf"trim(regexp_replace(regexp_replace({raw}, '<[^>]+>', '', 'g'), '\s+', ' ', 'g'))"


@query("p16_sections", f"WITH {_SOL_SQL}\nSELECT key, lower({_section_sql(fx.REQUIREMENT_HEADERS)}) AS requirements, {_section_sql(fx.CRITERIA_HEADERS)} AS criteria FROM sol")
def p16(t):
    c = F.col("full_text")
    return solicitation_texts(t).select("key", tx.technical_requirements(c).alias("requirements"), tx.evaluation_criteria(c).alias("criteria"))


def _funding_sql(phase: str, group: int) -> str:
    a = fx.AMOUNT_PATTERN
    one = rf"(?i)Phase\s+{phase}\s+awards?:?\s*{a}\s*-\s*{a}"
    two = rf"(?i)Phase\s+{phase}:?\s*{a}\s*to\s*{a}"
    return f"try_cast(replace(coalesce(nullif(regexp_extract(full_text, '{one}', {group}), ''), nullif(regexp_extract(full_text, '{two}', {group}), '')), ',', '') AS BIGINT)"


@query("p17_funding", f"WITH {_SOL_SQL}\nSELECT key, " + ", ".join(
    f"{_funding_sql(p, g)} AS phase_{p.lower()}_{n}" for p in ("I", "II") for g, n in ((1, "min"), (2, "max"))) + " FROM sol")
def p17(t):
    c = F.col("full_text")
    cols = [b.alias(f"phase_{p.lower()}_{n}") for p in ("I", "II") for b, n in zip(tx.funding_range(c, p), ("min", "max"))]
    return solicitation_texts(t).select("key", *cols)


def _deadline_sql(label: str) -> str:
    tries = []
    for pattern in fx.DEADLINE_LABELS[label]:
        line = rf"regexp_extract(full_text, '(?i){pattern}:?\s*([^.\n]+)', 1)"
        for (shape, _), fmt in zip(fx.DATE_SHAPES, ("%B %d, %Y", "%m/%d/%Y", "%Y-%m-%d")):
            tries.append(f"try_strptime(nullif(regexp_extract({line}, '{shape}', 1), ''), '{fmt}')")
    return f"CAST(coalesce({', '.join(tries)}) AS DATE) AS {label}"


@query("p18_deadlines", f"WITH {_SOL_SQL}\nSELECT key, " + ", ".join(_deadline_sql(x) for x in fx.DEADLINE_LABELS) + " FROM sol")
def p18(t):
    return solicitation_texts(t).select("key", *[tx.labelled_date(F.col("full_text"), x).alias(x) for x in fx.DEADLINE_LABELS])


_PROSE_KEYWORDS = sorted({k for _, b, k in keyword_rows(PROSE_RULES) if b != "negative"} | {k for v in tx.area_keywords().values() for k in v})


@query("p19_area_keywords", f"""
SELECT {_DOC} AS key, list_sort(list(k) FILTER (k IS NOT NULL)) AS keywords, count(k) AS n
FROM documents LEFT JOIN {values([(k,) for k in _PROSE_KEYWORDS], 'v(k)')} ON contains(lower(text), k) GROUP BY 1""")
def p19(t):
    found = docs(t).select("key", tx.found_keywords(F.col("text"), _PROSE_KEYWORDS).alias("keywords"))
    return found.select("key", F.when(F.size("keywords") > 0, F.col("keywords")).alias("keywords"), F.size("keywords").cast("bigint").alias("n"))


_HEADS = ", ".join(q(h) for h in fx.TECH_HEADS)
_PHRASE_SQL = rf"""WITH toks AS (SELECT item_id, lower(text) AS low, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark),
n AS (SELECT item_id, unnest([2, 3, 4]) AS n, w, low FROM toks),
g AS (SELECT item_id, w[i : i + n - 1] AS p FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM n)),
t1 AS (SELECT item_id, CASE WHEN list_contains(['and','or','the','a','an'], p[1]) THEN p[2:] ELSE p END AS p FROM g),
t2 AS (SELECT item_id, CASE WHEN list_contains(['and','or','the','a','an'], p[1]) THEN p[2:] ELSE p END AS p FROM t1),
t3 AS (SELECT item_id, CASE WHEN list_contains(['and','or','the','a','an'], p[1]) THEN p[2:] ELSE p END AS p FROM t2),
t4 AS (SELECT item_id, CASE WHEN list_contains(['and','or','the','a','an'], p[1]) THEN p[2:] ELSE p END AS p FROM t3),
u AS (SELECT item_id, CASE WHEN len(p) >= 3 AND list_contains(['algorithms','methods','techniques'], p[-1]) THEN p[:-2] ELSE p END AS p FROM t4 WHERE len(p) >= 2),
kept AS (SELECT item_id, array_to_string(p, ' ') AS phrase FROM u WHERE list_contains([{_HEADS}], p[-1]) OR regexp_matches(p[-1], '(ing|tion|s)$')
  UNION SELECT item_id, unnest(regexp_extract_all(low, '\b[a-z]+\s+(?:{'|'.join(fx.TECH_HEADS)})\b')) FROM toks)
"""


@query("p20_technical_phrases", _PHRASE_SQL + "SELECT item_id, list_sort(coalesce(list(phrase) FILTER (phrase IS NOT NULL), [])) AS phrases FROM benchmark LEFT JOIN kept USING (item_id) GROUP BY 1")
def p20(t):
    return t.raw("benchmark").select("item_id", tx.technical_phrases(F.col("text")).alias("phrases"))


@query("p21_drop_non_technical", f"""
SELECT page_id, list_filter(string_split(lower(url), '/'), lambda x: NOT list_contains([{', '.join(q(x) for x in fx.NON_TECHNICAL_TERMS)}], lower(x))) AS terms FROM pages""")
def p21(t):
    return t.raw("pages").select("page_id", tx.drop_non_technical(F.split(F.lower("url"), "/")).alias("terms"))


@query("p22_rank_keywords", f"""WITH terms AS (
  SELECT item_id, regexp_split_to_array(lower(text), '[.,]\\s*') AS list FROM benchmark),
e AS (SELECT item_id, unnest(list) AS term, generate_subscripts(list, 1) AS pos FROM terms),
s AS (SELECT *, CASE WHEN list_contains([{', '.join(q(k) for k in _PROSE_KEYWORDS)}], term) THEN 10 ELSE 0 END
  + CASE WHEN EXISTS (SELECT 1 FROM {values([(k,) for k in fx.TECHNICAL_TERMS], 'v(k)')} WHERE contains(term, k)) THEN 5 ELSE 0 END
  + len(list_filter(regexp_split_to_array(term, '\\s+'), lambda w: w <> '')) AS score FROM e)
SELECT item_id, list(term ORDER BY score DESC, pos) AS ranked FROM s GROUP BY 1""")
def p22(t):
    terms = F.split(F.lower("text"), r"[.,]\s*")
    return t.raw("benchmark").select("item_id", tx.ranked_keywords(terms, _PROSE_KEYWORDS).alias("ranked"))


_EVIDENCE = ("eaux", "and the", "der die", "license")
_SENT_SQL = rf"""WITH s AS (SELECT {_DOC} AS key, text, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
  lambda x: trim(x, E' \t\n\r\f')), lambda x: x <> '') AS sents FROM documents),
f AS (SELECT *, list_filter(sents, lambda x: {' OR '.join(f"contains(lower(x), {q(k)})" for k in _EVIDENCE)}) AS hits FROM s),
p AS (SELECT key, hits, trim(coalesce(hits[1], substr(text, 1, 280)), E' \t\n\r\f') AS pick FROM f)
"""


@query("p23_evidence", _SENT_SQL + r"""SELECT key, len(hits) AS matching, CASE WHEN len(regexp_split_to_array(pick, '\s+')) <= 50 THEN pick
  ELSE array_to_string(regexp_split_to_array(pick, '\s+')[:50], ' ') END AS excerpt FROM p""")
def p23(t):
    c = F.col("text")
    return docs(t).select(
        "key", F.size(tx.evidence_sentences(c, _EVIDENCE)).cast("bigint").alias("matching"), tx.evidence_excerpt(c, _EVIDENCE).alias("excerpt")
    )


# --- rule scoring ----------------------------------------------------------------------------
def _rule_sql(r: Rules) -> str:
    kw = values(keyword_rows(r) or [("", "", "")], "kw(cet_id, bucket, phrase)")
    pr = values(prior_rows(r), "pr(scope, key, cet_id, points)")
    ctx = values([(a, i, w, b) for i, (a, req, b) in enumerate(context_rows(r)) for w in req], "cx(cet_id, rule, word, boost)")
    areas = values([(a,) for a in r.areas()], "ar(cet_id)")
    return rf"""WITH d AS (SELECT {_DOC} AS key, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t, lang AS agency, source AS branch FROM documents),
hits AS (SELECT key, cet_id, count(*) FILTER (bucket = 'core') AS c, count(*) FILTER (bucket = 'related') AS r, count(*) FILTER (bucket = 'negative') AS n
  FROM d JOIN {kw} ON contains(t, phrase) GROUP BY 1, 2),
pri AS (SELECT d.key, ar.cet_id, sum(points) AS points FROM d CROSS JOIN {areas} JOIN {pr}
  ON ((scope = 'agency' AND pr.key = lower(agency)) OR (scope = 'branch' AND pr.key = lower(branch))) AND (pr.cet_id = ar.cet_id OR pr.cet_id = '_all_cets') GROUP BY 1, 2),
cx0 AS (SELECT d.key, cet_id, rule, boost FROM d CROSS JOIN {ctx} GROUP BY ALL HAVING bool_and(contains(t, word))),
con AS (SELECT key, cet_id, sum(boost) AS boost FROM cx0 GROUP BY 1, 2),
scores AS (SELECT d.key, ar.cet_id, greatest(0.0, least(100.0, coalesce(points, 0) + 6.0 * least(coalesce(c, 0), 5) + 3.0 * least(coalesce(r, 0), 5)
   - 8.0 * least(coalesce(n, 0), 3) + coalesce(boost, 0)))::DOUBLE AS score
  FROM d CROSS JOIN {areas} LEFT JOIN hits USING (key, cet_id) LEFT JOIN pri USING (key, cet_id) LEFT JOIN con USING (key, cet_id))
"""


@query("m1_rule_scores", _rule_sql(PROSE_RULES) + "SELECT * FROM scores")
def m1(t):
    return rules.score(t.texts, PROSE_RULES)


@query("m1_rule_scores_shipped_rules", _rule_sql(Rules()) + "SELECT * FROM scores")
def m1s(t):
    return rules.score(t.texts, Rules())


@query("m2_squeezed_text", rf"SELECT {_DOC} AS key, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS text FROM documents")
def m2(t):
    return docs(t).select("key", tx.squeeze(F.col("text")).alias("text"))


@query("m3_prior_points", _rule_sql(PROSE_RULES) + "SELECT key, cet_id, points FROM pri WHERE points > 0")
def m3(t):
    areas = PROSE_RULES.areas()
    rows = [
        (scope, key, area, points)
        for scope, key, named, points in prior_rows(PROSE_RULES)
        for area in (areas if named == fx.ALL_AREAS else [named])
    ]
    flat = t.spark.createDataFrame(rows, "scope string, prior_key string, cet_id string, points double")
    scoped = docs(t).select("key", F.inline(F.array(
        F.struct(F.lit("agency").alias("scope"), F.lower("agency").alias("prior_key")),
        F.struct(F.lit("branch").alias("scope"), F.lower("branch").alias("prior_key")),
    )))
    # The rule document fixes the size of ``flat``, so it may be sent to every task.
    return scoped.join(F.broadcast(flat), ["scope", "prior_key"]).groupBy("key", "cet_id").agg(F.sum("points").alias("points"))


@query("m4_area_universe", _rule_sql(PROSE_RULES) + "SELECT cet_id, count(*) AS texts, CAST(sum(score) AS DOUBLE) AS total_score FROM scores GROUP BY 1")
def m4(t):
    return rules.score(t.texts, PROSE_RULES).groupBy("cet_id").agg(F.count(F.lit(1)).alias("texts"), F.sum("score").alias("total_score"))


@query("s17_rule_tables", _rule_sql(PROSE_RULES) + f"""
SELECT bucket, cet_id, count(*) AS hits FROM d JOIN {values(keyword_rows(PROSE_RULES), 'kw(cet_id, bucket, phrase)')} ON contains(t, phrase) GROUP BY 1, 2""")
def s17(t):
    # Keyword rows per text as literals, so that the rule tables meet the texts without a theta join.
    rows = keyword_rows(PROSE_RULES)
    table = constant([{"cet_id": a, "bucket": b, "phrase": p} for a, b, p in rows])
    hits = docs(t).select(F.inline_outer(cl.let(tx.squeeze(F.col("text")), lambda x: F.filter(table, lambda k: F.contains(x, k["phrase"]))))).where(F.col("bucket").isNotNull())
    return hits.groupBy("bucket", "cet_id").agg(F.count(F.lit(1)).alias("hits"))


@query("j14_keyword_containment", _rule_sql(PROSE_RULES) + "SELECT key, cet_id, c AS core, r AS related, n AS negative FROM hits")
def j14(t):
    rows = keyword_rows(PROSE_RULES)
    table = constant([{"cet_id": a, "bucket": b, "phrase": p} for a, b, p in rows])
    hits = docs(t).select("key", F.inline_outer(cl.let(tx.squeeze(F.col("text")), lambda x: F.filter(table, lambda k: F.contains(x, k["phrase"]))))).where(F.col("bucket").isNotNull())
    return hits.groupBy("key", "cet_id").agg(*[F.count_if(F.col("bucket") == b).alias(b) for b in ("core", "related", "negative")])


@query("w7_top_rule_areas", _rule_sql(PROSE_RULES) + """
SELECT key, cet_id, score, area_rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, cet_id) AS area_rank FROM scores) WHERE area_rank <= 3""")
def w7(t):
    return rules.top_areas(t.texts, PROSE_RULES, 3)


@query("m22_hybrid_scores", _rule_sql(PROSE_RULES) + """
SELECT s.key, s.cet_id, p.score, s.score AS rule_score, 0.7 * p.score + 0.3 * s.score AS hybrid_score
FROM scores s JOIN (SELECT CAST(doc_id AS VARCHAR) AS key, CASE lang WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' WHEN 'de' THEN 'german' ELSE 'spanish' END AS cet_id,
  CAST(n_chars % 101 AS DOUBLE) AS score FROM documents) p USING (key, cet_id)""")
def m22(t):
    lang = F.col("lang")
    ml = t.raw("documents").select(
        F.col("doc_id").cast("string").alias("key"),
        F.when(lang == "en", "english").when(lang == "fr", "french").when(lang == "de", "german").otherwise("spanish").alias("cet_id"),
        (F.col("n_chars") % 101).cast("double").alias("score"),
    )
    return rules.hybrid(ml, rules.score(t.texts, PROSE_RULES), 0.3)


# --- relevance -------------------------------------------------------------------------------
def _relevance_sql(areas: relevance.Areas) -> str:
    kw = values([(a, k) for a, ks in areas.keywords.items() for k in ks], "kw(cet_id, k)")
    var = values([(a, k, v) for a, ks in areas.keywords.items() for k in ks for v in relevance.phrase_variants(k)], "va(cet_id, k, v)")
    tok = values([(a, k, float(i), w) for a, ks in areas.keywords.items() for k in ks for i, w in enumerate(k.split())], "tk(cet_id, k, i, tok)")
    idf, weights = areas.weights()
    voc = values(list(idf.items()), "vo(term, idf)")
    wts = values([(a, term, w) for a, ws in weights.items() for term, w in ws.items()], "wt(cet_id, term, w)")
    ar = values([(a,) for a in areas.keywords], "ar(cet_id)")
    stops = ", ".join(q(s) for s in areas.stop_words)
    return rf"""WITH d AS (SELECT {_DOC} AS key, lower(text) AS t, {_WORDS.format(t='lower(text)')} AS words,
    list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: NOT list_contains([{stops}], w)) AS toks FROM documents),
kw AS (SELECT * FROM {kw}), ar AS (SELECT * FROM {ar}),
ex AS (SELECT key, cet_id, k, sum((length(t) - length(replace(t, v, ''))) / length(v)) AS exact, bool_or(contains(t, v)) AS any_variant FROM d CROSS JOIN {var} GROUP BY 1, 2, 3),
w0 AS (SELECT key, word, count(*) AS n FROM (SELECT key, unnest(words) AS word FROM d) GROUP BY 1, 2),
tokens AS (SELECT DISTINCT tok FROM {tok}),
part AS (SELECT key, tok, sum(n) FILTER (word <> tok) AS loose, bool_or(word = tok) AS whole FROM w0 JOIN tokens ON contains(word, tok) GROUP BY 1, 2),
pk AS (SELECT d.key, cet_id, k, sum(coalesce(loose, 0)) AS loose, count(*) FILTER (whole) AS present, count(*) AS n_tok
  FROM d CROSS JOIN {tok} LEFT JOIN part ON part.key = d.key AND part.tok = tk.tok GROUP BY 1, 2, 3),
ks AS (SELECT ex.key, ex.cet_id, least(1.0, sum(least(0.30, (exact * 5 + loose) / greatest(1, len(words))))) AS keyword,
   least(1.0, sum(CASE WHEN contains(k, ' ') THEN CASE WHEN any_variant THEN 0.25 ELSE 0 END + CASE WHEN present >= n_tok * 0.7 THEN 0.15 ELSE 0 END ELSE 0 END)) AS phrase,
   count(*) FILTER (contains(t, k)) AS present, count(*) FILTER (contains(t, k) AND contains(k, ' ')) AS present_multi,
   list_sort(list(k) FILTER (contains(t, k))) AS matched
  FROM ex JOIN pk USING (key, cet_id, k) JOIN d USING (key) GROUP BY 1, 2),
grams AS (SELECT key, array_to_string(toks[i : i + n - 1], ' ') AS term FROM (SELECT key, toks, n, unnest(range(1, len(toks) - n + 2)) AS i FROM d CROSS JOIN (VALUES (1), (2), (3)) g(n))),
tf AS (SELECT key, term, count(*) * any_value(idf) AS x FROM grams JOIN {voc} USING (term) GROUP BY 1, 2),
norm AS (SELECT key, sqrt(sum(x * x)) AS norm FROM tf GROUP BY 1),
sem AS (SELECT key, cet_id, sum(x * w) / any_value(norm) AS semantic FROM tf JOIN {wts} USING (term) JOIN norm USING (key) GROUP BY 1, 2),
parts AS (SELECT ks.*, coalesce(semantic, 0) AS semantic, 0.65 * keyword + 0.2 * coalesce(semantic, 0) + 0.15 * phrase
   + CASE WHEN present >= 2 THEN 0.25 ELSE 0 END + CASE WHEN present_multi >= 1 THEN 0.10 ELSE 0 END AS base FROM ks LEFT JOIN sem USING (key, cet_id)),
rel AS (SELECT key, cet_id, keyword, semantic, phrase, matched,
   least(1.0, greatest(base, CASE WHEN present_multi >= 1 THEN 0.80 WHEN present >= 1 THEN 0.72 ELSE 0 END)) AS score FROM parts)
"""


_PARTS = "round(keyword, 6) AS keyword, round(semantic, 6) AS semantic, round(phrase, 6) AS phrase, round(score, 6) AS score"
_REL = _relevance_sql(PROSE_AREAS)


def _rounded(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


@query("m5_relevance_scores", _REL + "SELECT key, cet_id, round(score, 6) AS score FROM rel")
def m5(t):
    return _rounded(relevance.score(t.texts, PROSE_AREAS), "score")


@query("m5_relevance_shipped_areas", _relevance_sql(relevance.Areas()) + f"SELECT key, cet_id, {_PARTS} FROM rel")
def m5s(t):
    return _rounded(relevance.components(t.texts).drop("matched"), "keyword", "semantic", "phrase", "score")


@query("m6_keyword_density", _REL + "SELECT key, cet_id, round(keyword, 6) AS keyword FROM rel")
def m6(t):
    return _rounded(relevance.components(t.texts, PROSE_AREAS).select("key", "cet_id", "keyword"), "keyword")


@query("m7_tfidf_similarity", _REL + "SELECT key, cet_id, round(semantic, 6) AS semantic FROM rel")
def m7(t):
    return _rounded(relevance.components(t.texts, PROSE_AREAS).select("key", "cet_id", "semantic"), "semantic")


@query("m8_phrase_score", _REL + "SELECT key, cet_id, round(phrase, 6) AS phrase FROM rel")
def m8(t):
    return _rounded(relevance.components(t.texts, PROSE_AREAS).select("key", "cet_id", "phrase"), "phrase")


@query("m9_normalized_scores", _REL + """
SELECT key, cet_id, round(CASE WHEN sum(score) OVER (PARTITION BY key) > 0 THEN score / sum(score) OVER (PARTITION BY key) ELSE 0 END, 6) AS score FROM rel""")
def m9(t):
    return _rounded(relevance.normalized(t.texts, PROSE_AREAS), "score")


@query("m10_explained_scores", _REL + f"SELECT key, cet_id, coalesce(matched, []) AS matched, {_PARTS} FROM rel")
def m10(t):
    df = relevance.components(t.texts, PROSE_AREAS).withColumn("matched", F.array_sort("matched"))
    return _rounded(df, "keyword", "semantic", "phrase", "score")


@query("m11_parsed_solicitations", _REL + f""", given AS (SELECT key, cet_id, CASE WHEN CAST(key AS BIGINT) % 2 = 0 THEN 0.5 ELSE score END AS score FROM rel
  WHERE CAST(key AS BIGINT) % 2 = 1 OR cet_id = 'french')
SELECT key, cet_id, round(score, 6) AS score, CASE WHEN CAST(key AS BIGINT) % 3 = 0 THEN 1 ELSE n END AS keywords FROM given
JOIN (SELECT {_DOC} AS key, count(k) AS n FROM documents LEFT JOIN {values([(k,) for k in _PROSE_KEYWORDS], 'v(k)')} ON contains(lower(text), k) GROUP BY 1) USING (key)""")
def m11(t):
    n = F.col("key").cast("bigint")
    provided = F.when(n % 2 == 0, F.create_map(F.lit("french"), F.lit(0.5)))
    words = F.when(n % 3 == 0, F.array(F.lit("given")))
    # both before the rows of a text's areas, so that its keywords are looked for once
    found = docs(t).select(
        "key", relevance.parsed_scores(provided, F.col("text"), PROSE_AREAS).alias("scores"),
        F.size(relevance.parsed_keywords(words, F.col("text"), _PROSE_KEYWORDS)).cast("bigint").alias("keywords"),
    )
    df = found.select("key", F.explode_outer("scores").alias("cet_id", "score"), "keywords")
    return _rounded(df, "score")


@query("w7_top_relevant_areas", _REL + """
SELECT key, cet_id, round(score, 6) AS score, area_rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round(score, 6) DESC, cet_id) AS area_rank FROM rel) WHERE area_rank <= 2""")
def w7r(t):
    return relevance.top_areas(t.texts, 2, PROSE_AREAS, digits=6)


# --- fallback and classification of awards ---------------------------------------------------
_DOMAINS = values([(k, n, " ".join(w)) for k, (n, w) in fx.TOPIC_DOMAINS.items()], "dm(prefix, name, words)")
_FOCUS = values(list(fx.AGENCY_FOCUS.items()), "fo(agency, focus)")
_FALLBACK_SQL = ctes("awards") + f""", tagged AS (
  SELECT award_id, agency, program, phase, upper(substr(['AI', 'bt', 'LC', 'ZZ', 'ST', 'MD'][custkey % 6 + 1], 1, 2)) AS prefix,
         ['NSF', 'DOD', 'NASA', 'USDA'][custkey % 4 + 1] AS code, CASE custkey % 3 WHEN 0 THEN 'SBX Phase II' WHEN 1 THEN 'phase i' ELSE 'other' END AS prog FROM awards),
fall AS (SELECT award_id, coalesce(dm.name, 'Technology Development') || ' research for ' || coalesce(fo.focus, 'research and development') AS description,
  coalesce(dm.words, 'innovation research') || CASE WHEN contains(lower(prog), 'phase ii') THEN ' development commercialization'
    WHEN contains(lower(prog), 'phase i') THEN ' feasibility proof of concept' ELSE '' END AS keywords
  FROM tagged LEFT JOIN {_DOMAINS} ON tagged.prefix = dm.prefix LEFT JOIN {_FOCUS} ON fo.agency = tagged.code)
"""


@query("p30_fallback_text", _FALLBACK_SQL + "SELECT award_id, description, keywords, 'award ' || description || ' ' || keywords AS text FROM fall")
def p30(t):
    c = F.col("custkey")
    topic = F.element_at(F.array(*[F.lit(x) for x in ("AI", "bt", "LC", "ZZ", "ST", "MD")]), (c % 6 + 1).cast("int"))
    code = F.element_at(F.array(*[F.lit(x) for x in ("NSF", "DOD", "NASA", "USDA")]), (c % 4 + 1).cast("int"))
    program = F.when(c % 3 == 0, "SBX Phase II").when(c % 3 == 1, "phase i").otherwise("other")
    description, words = cl.fallback_context(topic, code, program)
    return t.awards.select(
        "award_id", description.alias("description"), F.array_join(words, " ").alias("keywords"),
        tx.enriched_text(F.lit("award"), description, words).alias("text"),
    )
