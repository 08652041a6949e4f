"""Linkage, solicitation enrichment, telemetry, status and awardee queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning as cl
from ..functions import confidence as cf
from ..functions import fixed_values as fx
from ..functions import names as nm
from ..operators import awardees as aw
from ..operators import enrichment as en
from ..operators import linkage as lk
from .adapters import AS_OF, ctes
from .registry import query
from .text import q, values

# --- names -----------------------------------------------------------------------------------
_ENT_SQL = """entities AS (
  SELECT lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS uei, c_custkey AS custkey, n_name, c_mktsegment,
         CASE c_custkey % 3 WHEN 0 THEN upper(c_name) || ', INC.' WHEN 1 THEN replace(c_name, '#', ' ')
              ELSE 'The ' || c_mktsegment || ' ' || n_name || ' research group ' || CAST(c_custkey AS VARCHAR) END AS legal_name
  FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 4 <> 3),
claims AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS award_id,
         CASE WHEN o_orderkey % 5 = 0 THEN lpad(CAST(o_custkey AS VARCHAR), 12, '0') WHEN o_orderkey % 5 = 1 THEN 'X' || CAST(o_custkey AS VARCHAR) END AS awardee_uei,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN c_custkey % 3 < 2 THEN c_name || ' LLC'
              ELSE c_mktsegment || ' ' || n_name || ' research group ' || CAST(c_custkey AS VARCHAR) END AS awardee_name,
         CAST(o_orderkey % 1000 AS VARCHAR) AS award_number
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
entity_awards AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 12, '0') AS uei, CAST(o_orderkey % 1000 AS VARCHAR) AS award_number FROM orders WHERE o_orderkey % 2 = 0)"""


def _customers(t):
    return t.raw("customer").join(t.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))


def _uei(c):
    return F.lpad(F.col(c).cast("string"), 12, "0")


def entities(t):
    k = F.col("c_custkey")
    group = F.concat(F.lit("The "), "c_mktsegment", F.lit(" "), "n_name", F.lit(" research group "), k.cast("string"))
    name = F.when(k % 3 == 0, F.concat(F.upper("c_name"), F.lit(", INC."))).when(k % 3 == 1, F.replace("c_name", F.lit("#"), F.lit(" "))).otherwise(group)
    return _customers(t).where(k % 4 != 3).select(_uei("c_custkey").alias("uei"), name.alias("legal_name"), F.array("c_mktsegment", "n_name").alias("business_types"))


def claims(t):
    o, k = F.col("o_orderkey"), F.col("c_custkey")
    group = F.concat("c_mktsegment", F.lit(" "), "n_name", F.lit(" research group "), k.cast("string"))
    return t.raw("orders").join(_customers(t), F.col("o_custkey") == k).select(
        o.cast("string").alias("award_id"),
        F.when(o % 5 == 0, _uei("o_custkey")).when(o % 5 == 1, F.concat(F.lit("X"), F.col("o_custkey").cast("string"))).alias("awardee_uei"),
        F.when(o % 7 == 0, None).when(k % 3 < 2, F.concat("c_name", F.lit(" LLC"))).otherwise(group).alias("awardee_name"),
        (o % 1000).cast("string").alias("award_number"),
    )


def entity_awards(t):
    o = F.col("o_orderkey")
    return t.raw("orders").where(o % 2 == 0).select(_uei("o_custkey").alias("uei"), (o % 1000).cast("string").alias("award_number"))


def _normal_sql(c: str) -> str:
    out = f"lower(coalesce({c}, ''))"
    for p in fx.SUFFIX_PATTERNS:
        out = f"regexp_replace({out}, '{p}', '')"
    return rf"trim(regexp_replace(regexp_replace({out}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _squash_sql(c: str) -> str:
    out = f"lower(coalesce({c}, ''))"
    for p in fx.SUFFIX_SUBSTRINGS:
        out = f"replace({out}, {q(p)}, '')"
    return f"trim({out})"


def _jaccard_sql(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"CAST({both} AS DOUBLE) / (len({a}) + len({b}) - {both})"


@query("p24_normal_names", f"WITH {_ENT_SQL}\nSELECT uei, {_normal_sql('legal_name')} AS name FROM entities")
def p24(t):
    return entities(t).select("uei", nm.normal_name(F.col("legal_name")).alias("name"))


@query("p25_squashed_names", f"WITH {_ENT_SQL}\nSELECT uei, {_squash_sql('legal_name')} AS name FROM entities")
def p25(t):
    return entities(t).select("uei", nm.squashed_name(F.col("legal_name")).alias("name"))


_PAIRS_SQL = f"WITH {_ENT_SQL}, pairs AS (SELECT award_id, awardee_name, legal_name FROM claims c JOIN orders o ON CAST(o.o_orderkey AS VARCHAR) = c.award_id JOIN entities e ON e.custkey = o.o_custkey WHERE awardee_name IS NOT NULL)\n"


def _pairs(t):
    side = t.raw("orders").select(F.col("o_orderkey").cast("string").alias("award_id"), _uei("o_custkey").alias("uei"))
    return claims(t).where(F.col("awardee_name").isNotNull()).join(side, "award_id").join(entities(t), "uei")


@query("p26_word_similarity", _PAIRS_SQL + f"""SELECT award_id, CASE WHEN a = b THEN 1.0 ELSE {_jaccard_sql("list_distinct(string_split(a, ' '))", "list_distinct(string_split(b, ' '))")} END AS similarity
FROM (SELECT award_id, {_normal_sql('awardee_name')} AS a, {_normal_sql('legal_name')} AS b FROM pairs)""")
def p26(t):
    return _pairs(t).select("award_id", nm.word_similarity(F.col("awardee_name"), F.col("legal_name")).alias("similarity"))


@query("p27_character_similarity", _PAIRS_SQL + f"""SELECT award_id, CASE WHEN a = b THEN 1.0 ELSE {_jaccard_sql("list_distinct(string_split(a, ''))", "list_distinct(string_split(b, ''))")} END AS similarity
FROM (SELECT award_id, {_squash_sql('awardee_name')} AS a, {_squash_sql('legal_name')} AS b FROM pairs)""")
def p27(t):
    return _pairs(t).select("award_id", nm.character_similarity(F.col("awardee_name"), F.col("legal_name")).alias("similarity"))


# --- awardee matching ------------------------------------------------------------------------
_NAME_SQL = f"""WITH {_ENT_SQL},
an AS (SELECT DISTINCT awardee_name AS name, {_normal_sql('awardee_name')} AS n FROM claims WHERE awardee_name IS NOT NULL),
en AS (SELECT uei, {_normal_sql('legal_name')} AS n FROM entities),
sim AS (SELECT a.name, e.uei, CASE WHEN a.n = e.n THEN 1.0 ELSE {_jaccard_sql("a.w", "e.w")} END AS s
  FROM (SELECT *, list_distinct(string_split(n, ' ')) AS w FROM an) a CROSS JOIN (SELECT *, list_distinct(string_split(n, ' ')) AS w FROM en) e),
best AS (SELECT name, uei, s FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY s DESC, uei) AS rn FROM sim WHERE s >= 0.8) WHERE rn = 1),
"""


def _match_sql(use_uei: bool) -> str:
    hit = "e.uei IS NOT NULL" if use_uei else "FALSE"
    return f"""matched AS (SELECT c.*, {hit} OR b.uei IS NOT NULL AS is_match, CASE WHEN {hit} THEN 1.0 WHEN b.uei IS NOT NULL THEN b.s ELSE 0.0 END AS confidence_score,
  CASE WHEN {hit} THEN c.awardee_uei ELSE b.uei END AS matched_uei,
  CASE WHEN {hit} THEN 'exact_uei' WHEN b.s = 1 THEN 'exact_name' WHEN b.uei IS NOT NULL THEN 'fuzzy_name' WHEN awardee_name IS NULL THEN 'no_name_provided' ELSE 'no_name_match_above_threshold' END AS match_method
  FROM claims c LEFT JOIN entities e ON e.uei = c.awardee_uei LEFT JOIN best b ON b.name = c.awardee_name)
"""


@query("j7_awardee_match_uei_first", _NAME_SQL + _match_sql(True) + "SELECT award_id, is_match, confidence_score, matched_uei, match_method FROM matched")
def j7(t):
    return lk.match_awardees(claims(t), entities(t))


@query("j8b_awardee_match_name_only", _NAME_SQL + _match_sql(False) + "SELECT award_id, is_match, confidence_score, matched_uei, match_method FROM matched")
def j8b(t):
    return lk.match_awardees(claims(t), entities(t), strategy="name_only")


@query("j8b_award_number_match", f"""WITH {_ENT_SQL}, m AS (SELECT award_id, CASE WHEN coalesce(length(award_number), 0) = 0 OR NOT EXISTS (SELECT 1 FROM entity_awards e WHERE e.uei = c.awardee_uei AND length(e.award_number) > 0) THEN 'award_number_missing'
  WHEN EXISTS (SELECT 1 FROM entity_awards e WHERE e.uei = c.awardee_uei AND e.award_number = c.award_number) THEN 'exact_award_number' ELSE 'award_number_mismatch' END AS match_method FROM claims c)
SELECT award_id, match_method = 'exact_award_number' AS is_match, CASE WHEN match_method = 'exact_award_number' THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence_score, match_method FROM m""")
def j8n(t):
    return lk.match_award_numbers(claims(t), entity_awards(t))


@query("j8_awardee_match_comprehensive", _NAME_SQL + _match_sql(True) + f""", scored AS (
  SELECT m.*, coalesce(CASE WHEN awardee_name IS NOT NULL THEN CASE WHEN {_normal_sql('awardee_name')} = {_normal_sql('legal_name')} THEN 1.0 ELSE
    {_jaccard_sql(f"list_distinct(string_split({_normal_sql('awardee_name')}, ' '))", f"list_distinct(string_split({_normal_sql('legal_name')}, ' '))")} END END, 0.0) AS s,
    EXISTS (SELECT 1 FROM entity_awards x WHERE x.uei = m.matched_uei AND x.award_number = m.award_number) AS num
  FROM matched m LEFT JOIN entities e ON e.uei = m.matched_uei),
conf AS (SELECT *, least(1.0, 0.5 + CASE WHEN s >= 0.8 THEN 0.3 ELSE s * 0.2 END + CASE WHEN num THEN 0.2 ELSE 0 END)::DOUBLE AS c FROM scored)
SELECT award_id, is_match AND c >= 0.7 AS is_match, CASE WHEN is_match THEN c ELSE confidence_score END AS confidence_score, matched_uei,
  CASE WHEN is_match THEN 'comprehensive' ELSE match_method END AS match_method FROM conf""")
def j8(t):
    return lk.match_awardees(claims(t), entities(t), entity_awards(t), strategy="comprehensive")


@query("j8c_awardee_match_simple", f"""WITH {_ENT_SQL},
an AS (SELECT DISTINCT awardee_name AS name, {_squash_sql('awardee_name')} AS n FROM claims WHERE awardee_name IS NOT NULL),
en AS (SELECT uei, {_squash_sql('legal_name')} AS n FROM entities),
ac AS (SELECT DISTINCT n, list_distinct(string_split(n, '')) AS w FROM an),
ec AS (SELECT n, min(uei) AS uei, list_distinct(string_split(n, '')) AS w FROM en GROUP BY n),
sim AS (SELECT a.n, e.uei, CASE WHEN a.n = e.n THEN 1.0 ELSE {_jaccard_sql("a.w", "e.w")} END AS s FROM ac a CROSS JOIN ec e),
best AS (SELECT n, uei, s FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY s DESC, uei) AS rn FROM sim WHERE s > 0.7) WHERE rn = 1)
SELECT award_id, e.uei IS NOT NULL OR b.uei IS NOT NULL AS is_match, CASE WHEN e.uei IS NOT NULL THEN 0.95 WHEN b.uei IS NOT NULL THEN b.s ELSE 0.0 END::DOUBLE AS confidence_score,
  CASE WHEN e.uei IS NOT NULL THEN c.awardee_uei ELSE b.uei END AS matched_uei,
  CASE WHEN e.uei IS NOT NULL THEN 'exact_uei' WHEN b.uei IS NOT NULL THEN 'fuzzy_name' WHEN awardee_name IS NULL THEN 'no_name_provided' ELSE 'no_name_match_above_threshold' END AS match_method
FROM claims c LEFT JOIN entities e ON e.uei = c.awardee_uei LEFT JOIN an ON an.name = c.awardee_name LEFT JOIN best b ON b.n = an.n""")
def j8c(t):
    return lk.match_awardees(claims(t), entities(t), strategy="simple")


_PROJ_SQL = """a AS (SELECT CAST(doc_id AS VARCHAR) AS award_id, source || ' Corp' AS org_name, 1990 + doc_id % 2 AS year, 1000.0 + n_chars AS amount, text AS abstract, doc_id FROM documents),
p AS (SELECT 'P' || CAST(doc_id AS VARCHAR) AS project_id, CASE doc_id % 3 WHEN 0 THEN source || ' Corp' ELSE upper(source) || ', INC' END AS org_name, 1990 + doc_id % 2 AS year,
  CASE WHEN doc_id % 5 = 0 THEN 1000.0 + n_chars * 1.05 ELSE 1e7 + doc_id END AS amount, text || ' and more' AS abstract FROM documents),
""" + f"""
ap AS (SELECT a.*, {"trim(" + "replace(" * 8 + "upper(a.org_name)" + "".join(f", {q(s.upper())}, '')" for s in fx.SUFFIX_SUBSTRINGS) + ")"} AS org,
  list_distinct(regexp_extract_all(lower(abstract), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS w FROM a),
pp AS (SELECT p.*, {"trim(" + "replace(" * 8 + "upper(p.org_name)" + "".join(f", {q(s.upper())}, '')" for s in fx.SUFFIX_SUBSTRINGS) + ")"} AS org,
  list_distinct(regexp_extract_all(lower(abstract), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS w FROM p),
by_amount AS (SELECT award_id, project_id, tier FROM (SELECT award_id, project_id, CASE WHEN ap.org_name = pp.org_name THEN 1 ELSE 2 END AS tier,
  row_number() OVER (PARTITION BY award_id ORDER BY CASE WHEN ap.org_name = pp.org_name THEN 1 ELSE 2 END, project_id) AS rn
  FROM ap JOIN pp ON ap.org = pp.org AND ap.year = pp.year AND pp.amount BETWEEN ap.amount * 0.9 AND ap.amount * 1.1) WHERE rn = 1),
by_text AS (SELECT award_id, project_id, s FROM (SELECT *, row_number() OVER (PARTITION BY award_id ORDER BY s DESC, project_id) AS rn FROM (
  SELECT award_id, project_id, {_jaccard_sql("ap.w", "pp.w")} AS s FROM ap JOIN pp ON ap.org = pp.org AND ap.year = pp.year
  WHERE award_id NOT IN (SELECT award_id FROM by_amount) AND len(ap.w) > 0 AND len(pp.w) > 0) WHERE s >= 0.5) WHERE rn = 1)
SELECT award_id, project_id, CASE tier WHEN 1 THEN 'exact' ELSE 'fuzzy' END AS tier, 1.0::DOUBLE AS score FROM by_amount
UNION ALL SELECT award_id, project_id, 'similarity', s FROM by_text"""


@query("j12_project_linkage", "WITH " + _PROJ_SQL)
def j12(t):
    d, n = F.col("doc_id"), F.col("n_chars")
    docs = t.documents
    awards = docs.select(d.cast("string").alias("award_id"), F.concat("source", F.lit(" Corp")).alias("org_name"), (d % 2 + 1990).alias("year"),
                         (n + 1000.0).alias("amount"), F.col("text").alias("abstract"))
    projects = docs.select(
        F.concat(F.lit("P"), d.cast("string")).alias("project_id"),
        F.when(d % 3 == 0, F.concat("source", F.lit(" Corp"))).otherwise(F.concat(F.upper("source"), F.lit(", INC"))).alias("org_name"),
        (d % 2 + 1990).alias("year"), F.when(d % 5 == 0, n * 1.05 + 1000.0).otherwise(d + 1e7).alias("amount"),
        F.concat("text", F.lit(" and more")).alias("abstract"),
    )
    return lk.match_projects(awards, projects)


# --- confidence ------------------------------------------------------------------------------
_FACTORS_SQL = "f AS (SELECT p_partkey, p_size % 2 = 0 AS u, p_size % 3 = 0 AS n, p_size / 50.0 AS s, p_size % 5 = 0 AS w, (p_partkey % 10) / 10.0 AS a FROM part)"


def _factors(t):
    z = F.col("p_size")
    return t.raw("part").select("p_partkey", (z % 2 == 0).alias("u"), (z % 3 == 0).alias("n"), (z / F.lit(50.0)).alias("s"),
                                (z % 5 == 0).alias("w"), ((F.col("p_partkey") % 10) / F.lit(10.0)).alias("a"))


@query("m25_match_confidence", f"""WITH {_FACTORS_SQL}, g AS (SELECT *, (CASE WHEN u THEN 0.5 ELSE 0 END + CASE WHEN n THEN 0.3 ELSE 0 END + s * 0.2 + CASE WHEN w THEN 0.2 ELSE 0 END + a * 0.1)::DOUBLE AS t FROM f)
SELECT p_partkey, round(least(t, 1.0), 6) AS score, CASE WHEN least(round(t, 6), 1.0) >= 0.8 THEN 'high' WHEN round(t, 6) >= 0.5 THEN 'medium' ELSE 'low' END AS level,
  round((s * 0.2)::DOUBLE, 6) AS name_points, CASE WHEN u THEN 0.5 ELSE 0.0 END::DOUBLE AS uei_points FROM g""")
def m25(t):
    c = F.col
    rows = _factors(t).withColumn("parts", cf.match_components(c("u"), c("n"), c("s"), c("w"), c("a")))
    rows = rows.withColumn("score", F.round(cf.match_score(c("parts")), 6))
    return rows.select("p_partkey", "score", cf.confidence_level(c("score")).alias("level"),
                       F.round(c("parts.name_similarity"), 6).alias("name_points"), c("parts.uei_exact").alias("uei_points"))


@query("m26_simple_confidence", f"WITH {_FACTORS_SQL}\nSELECT p_partkey, round(least(1.0, CASE WHEN u THEN 0.5 ELSE 0 END + s * 0.65 + CASE WHEN w THEN 0.2 ELSE 0 END)::DOUBLE, 6) AS score FROM f")
def m26(t):
    return _factors(t).select("p_partkey", F.round(cf.simple_confidence(F.col("u"), F.col("s"), F.col("w")), 6).alias("score"))


@query("f15_confidence_threshold", f"WITH {_FACTORS_SQL}\nSELECT p_partkey, s AS confidence_score FROM f WHERE s >= 0.7")
def f15(t):
    return en.confident(_factors(t).select("p_partkey", F.col("s").alias("confidence_score")))


@query("p33_enrichment_confidence", f"""WITH {_ENT_SQL}
SELECT award_id, (CASE WHEN length(awardee_uei) > 0 THEN 4 ELSE 0 END + CASE WHEN length(awardee_name) > 0 THEN 3 ELSE 0 END
  + CASE WHEN o_totalprice - 250000 > 0 THEN 2 ELSE 0 END + CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) / 10.0::DOUBLE AS confidence FROM claims JOIN orders ON CAST(o_orderkey AS VARCHAR) = award_id""")
def p33(t):
    side = t.raw("orders").select(F.col("o_orderkey").cast("string").alias("award_id"), (F.col("o_totalprice") - 250000).alias("amount"), "o_orderstatus")
    conf = cl.enrichment_confidence(F.col("awardee_uei"), F.col("awardee_name"), F.col("amount"), F.col("o_orderstatus") == "F")
    return claims(t).join(side, "award_id").select("award_id", conf.alias("confidence"))


@query("p34_enrichment_validity", f"""WITH {_ENT_SQL}
SELECT award_id, awardee_name IS NOT NULL AND o_totalprice - 250000 >= 0 AS valid FROM claims JOIN orders ON CAST(o_orderkey AS VARCHAR) = award_id""")
def p34(t):
    side = t.raw("orders").select(F.col("o_orderkey").cast("string").alias("award_id"), (F.col("o_totalprice") - 250000).alias("amount"))
    return claims(t).join(side, "award_id").select("award_id", cl.enrichment_valid(F.col("awardee_name"), F.col("amount")).alias("valid"))


# --- offices and entities --------------------------------------------------------------------
@query("j15_office_by_agency", """
SELECT CAST(o_orderkey AS VARCHAR) AS award_id, 'A' || CAST(o_custkey % 300 AS VARCHAR) AS agency, s_name || kind AS office_name, 'O' || CAST(s_suppkey AS VARCHAR) || kind AS office_id
FROM orders LEFT JOIN (SELECT *, unnest(['x', 'y']) AS kind FROM supplier) ON s_suppkey = o_custkey % 300""")
def j15(t):
    agency = F.concat(F.lit("A"), (F.col("o_custkey") % 300).cast("string"))
    a = t.raw("orders").select(F.col("o_orderkey").cast("string").alias("award_id"), agency.alias("agency"))
    return lk.attach_office(a, _offices(t))


def _offices(t):
    """Two offices per agency, one agency per supplier."""
    kind = F.explode(F.array(F.lit("x"), F.lit("y"))).alias("kind")
    both = t.raw("supplier").select("s_suppkey", "s_name", kind)
    k = F.col("s_suppkey").cast("string")
    return both.select(F.concat(F.lit("O"), k, "kind").alias("office_id"), F.concat(F.lit("A"), k).alias("agency_code"), F.concat("s_name", "kind").alias("office_name"))


@query("j15_related_opportunities", """
SELECT 'O' || CAST(s_suppkey AS VARCHAR) || kind AS office_id, s_name || kind AS office_name, CAST(item_id AS VARCHAR) AS solicitation_id, text AS title
FROM (SELECT *, unnest(['x', 'y']) AS kind FROM supplier) LEFT JOIN benchmark ON item_id = s_suppkey AND kind = 'x'""")
def j15r(t):
    sols = t.raw("benchmark").select(F.concat(F.lit("O"), F.col("item_id").cast("string"), F.lit("x")).alias("program_office_id"),
                                     F.col("item_id").cast("string").alias("solicitation_id"), F.col("text").alias("title"))
    return lk.related_opportunities(_offices(t), sols)


@query("j16_attach_entity", f"""WITH {_ENT_SQL}
SELECT award_id, awardee_uei AS recipient_uei, coalesce(awardee_name, legal_name) AS recipient_name, legal_name, coalesce(n, 0) AS history_awards
FROM claims LEFT JOIN entities e ON e.uei = awardee_uei LEFT JOIN (SELECT uei, count(*) AS n FROM entity_awards GROUP BY 1) h ON h.uei = awardee_uei""")
def j16(t):
    a = claims(t).withColumnsRenamed({"awardee_uei": "recipientUEI", "awardee_name": "recipientName"})
    return lk.attach_entity(a, entities(t), entity_awards(t)).select("award_id", "recipient_uei", "recipient_name", "legal_name", "history_awards")


# --- solicitation enrichment -----------------------------------------------------------------
_SOLKEY_SQL = ctes("awards", "cache") + """, sol_awards AS (
  SELECT award_id, CASE WHEN custkey % 3 = 0 THEN 'NIH' WHEN custkey % 3 = 1 THEN 'nih west' ELSE agency END AS agency,
         CASE WHEN custkey % 5 = 0 THEN 'UNKNOWN' ELSE CAST(custkey % 60 AS VARCHAR) END AS topic_code,
         CASE WHEN custkey % 10 = 0 THEN '' ELSE 'S' || CAST(custkey % 9 AS VARCHAR) END AS solicitation_id,
         CASE WHEN custkey % 20 = 0 THEN NULL ELSE program END AS program, fiscal_year AS solicitation_year FROM awards),
keyed AS (SELECT award_id, coalesce(CASE WHEN topic_code <> 'UNKNOWN' THEN topic_code END, nullif(solicitation_id, ''),
           CASE WHEN program IS NOT NULL THEN program || '-' || CAST(solicitation_year AS VARCHAR) END) AS solicitation_id,
           CASE WHEN contains(upper(agency), 'NIH') THEN 'nih' ELSE 'grants.gov' END AS api_source FROM sol_awards),
attached AS (SELECT k.*, c.description, c.technical_keywords, c.retrieved_at, CASE WHEN k.solicitation_id IS NULL THEN 'not_attempted'
           WHEN c.retrieved_at IS NOT NULL THEN 'enriched' ELSE 'enrichment_failed' END AS enrichment_status
         FROM keyed k LEFT JOIN cache c ON c.api_source = k.api_source AND c.solicitation_id = k.solicitation_id)
"""


def _sol_awards(t):
    k = F.col("custkey")
    return t.awards.select(
        "award_id", F.when(k % 3 == 0, "NIH").when(k % 3 == 1, "nih west").otherwise(F.col("agency")).alias("agency"),
        F.when(k % 5 == 0, "UNKNOWN").otherwise((k % 60).cast("string")).alias("topic_code"),
        F.when(k % 10 == 0, "").otherwise(F.concat(F.lit("S"), (k % 9).cast("string"))).alias("solicitation_id"),
        F.when(k % 20 != 0, F.col("program")).alias("program"), F.col("fiscal_year").alias("solicitation_year"),
    )


@query("p28_solicitation_keys", _SOLKEY_SQL + "SELECT award_id, solicitation_id FROM keyed")
def p28(t):
    return en.with_request_key(_sol_awards(t), fx.DEFAULT_API_SOURCE).select("award_id", "solicitation_id")


@query("p29_api_sources", _SOLKEY_SQL + "SELECT award_id, api_source, nullif(api_source, 'grants.gov') AS without_default FROM keyed")
def p29(t):
    return _sol_awards(t).select("award_id", cl.api_source(F.col("agency"), fx.DEFAULT_API_SOURCE).alias("api_source"),
                                 cl.api_source(F.col("agency")).alias("without_default"))


def _attached(t):
    return en.attach_solicitations(_sol_awards(t), t.cache, fx.DEFAULT_API_SOURCE)


@query("j4_solicitation_enrichment", _SOLKEY_SQL + "SELECT award_id, api_source, solicitation_id, description, enrichment_status FROM attached")
def j4(t):
    return _attached(t).select("award_id", "api_source", "solicitation_id", "description", "enrichment_status")


@query("j4_missing_requests", _SOLKEY_SQL + "SELECT DISTINCT api_source, solicitation_id FROM attached WHERE enrichment_status = 'enrichment_failed'")
def j4m(t):
    return en.missing_requests(_sol_awards(t), t.cache, fx.DEFAULT_API_SOURCE)


@query("j5_request_statistics", _SOLKEY_SQL + """, c AS (SELECT count(*) AS total_awards, count(DISTINCT CASE WHEN solicitation_id IS NULL THEN 'lone ' || award_id ELSE api_source || ' ' || solicitation_id END) AS unique_solicitations,
  count(*) FILTER (enrichment_status = 'enriched') AS enriched_count, count(*) FILTER (enrichment_status <> 'enriched') AS failed_count FROM attached)
SELECT *, 1.0::DOUBLE - CAST(unique_solicitations AS DOUBLE) / CAST(total_awards AS DOUBLE) AS deduplication_ratio FROM c""")
def j5(t):
    return en.request_statistics(_attached(t))


@query("j6_solicitation_scores", ctes("awards") + """
SELECT award_id, coalesce(b.text, '') AS solicitation_text, CASE WHEN b.item_id IS NULL THEN 0 ELSE 1 END AS n_scores,
  CASE WHEN b.item_id IS NULL THEN NULL ELSE (b.item_id % 10) / 10.0::DOUBLE END AS ai_score FROM awards LEFT JOIN benchmark b ON CAST(b.item_id AS VARCHAR) = CAST(custkey % 60 AS VARCHAR)""")
def j6(t):
    sols = t.raw("benchmark").select(F.col("item_id").cast("string").alias("solicitation_id"), F.col("text").alias("full_text"),
                                     F.create_map(F.lit("ai"), (F.col("item_id") % 10) / F.lit(10.0)).alias("cet_relevance_scores"))
    a = t.awards.select("award_id", (F.col("custkey") % 60).cast("string").alias("solicitation_id"))
    out = en.attach_solicitation_scores(a, sols)
    scores = F.col("solicitation_cet_scores")
    return out.select("award_id", "solicitation_text", F.size(scores).alias("n_scores"), F.try_element_at(scores, F.lit("ai")).alias("ai_score"))


@query("a23_batch_summary", _SOLKEY_SQL + """
SELECT count(*) AS total, count(*) FILTER (enrichment_status = 'enriched') AS successful, count(*) FILTER (enrichment_status = 'enrichment_failed') AS failed,
  count(*) FILTER (enrichment_status = 'not_attempted') AS skipped, CAST(count(*) FILTER (enrichment_status = 'enriched') AS DOUBLE) / count(*) AS success_rate FROM attached""")
def a23(t):
    return en.batch_summary(_attached(t))


@query("m21_boosted_scores", """WITH b AS (SELECT CAST(doc_id AS VARCHAR) AS key, lang AS cet_id, (n_chars % 100) / 100.0::DOUBLE AS s FROM documents),
sol AS (SELECT CAST(doc_id AS VARCHAR) AS key, CASE WHEN quality = 1 THEN 'en' ELSE 'fr' END AS cet_id, (doc_id % 10) / 10.0::DOUBLE AS s FROM labels)
SELECT key, cet_id, CASE WHEN sol.s IS NULL THEN b.s WHEN b.s IS NULL THEN sol.s * 0.3::DOUBLE ELSE least(1.0::DOUBLE, b.s + sol.s * 0.3::DOUBLE) END AS score FROM b FULL JOIN sol USING (key, cet_id)""")
def m21(t):
    key = F.col("doc_id").cast("string").alias("key")
    base = t.raw("documents").select(key, F.col("lang").alias("cet_id"), ((F.col("n_chars") % 100) / F.lit(100.0)).alias("score"))
    sol = t.raw("labels").select(key, F.when(F.col("quality") == 1, "en").otherwise("fr").alias("cet_id"), ((F.col("doc_id") % 10) / F.lit(10.0)).alias("score"))
    return en.boost_scores(base, sol)


# --- telemetry and status --------------------------------------------------------------------
@query("a20_enrichment_telemetry", ctes("calls") + """
SELECT api_source, count(*) FILTER (cache_hit) AS cache_hits, count(*) FILTER (NOT cache_hit) AS cache_misses,
  CAST(count(*) FILTER (cache_hit) AS DOUBLE) / count(cache_hit) * 100 AS cache_hit_rate, count(*) FILTER (success) AS calls_ok, count(*) FILTER (NOT success) AS calls_failed,
  CAST(count(*) FILTER (success) AS DOUBLE) / count(success) * 100 AS success_rate, count(latency_ms) AS latency_count,
  round(quantile_cont(latency_ms, 0.5), 4) AS latency_p50, round(quantile_cont(latency_ms, 0.95), 4) AS latency_p95, round(quantile_cont(latency_ms, 0.99), 4) AS latency_p99
FROM calls GROUP BY 1""")
def a20(t):
    df = en.telemetry(t.calls)
    return df.select(*[F.round(c, 4).alias(c) if c.startswith("latency_p") else F.col(c) for c in df.columns])


_STATES = ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("completed", "failed", "pending", "in_progress"))
_RATE = "CAST(count(*) FILTER (status = 'completed') AS DOUBLE) / count(*) FILTER (status IN ('completed', 'failed')) AS success_rate"


@query("a21_status_summary", ctes("status") + f"SELECT count(*) AS total, {_STATES}, {_RATE} FROM status")
def a21(t):
    return en.status_summary(t.status)


@query("a21_status_progress", ctes("status") + f"""
SELECT enrichment_type, count(*) AS total, {_STATES}, {_RATE},
  CAST(sum(CAST(confidence_score AS DECIMAL(18,6))) FILTER (status = 'completed') AS DOUBLE) / count(*) FILTER (status = 'completed') AS avg_confidence
FROM (SELECT *, unnest(enrichment_types) AS enrichment_type FROM status) GROUP BY 1""")
def a21p(t):
    return en.status_progress(t.status)


_STATUS_COLS = ["award_id", "enrichment_types", "status", "confidence_score", "last_updated", "error_message"]


@query("f13_list_statuses", ctes("status") + "SELECT * FROM status WHERE status = 'completed' AND list_contains(enrichment_types, 'solicitation') ORDER BY last_updated DESC, award_id LIMIT 50")
def f13(t):
    return en.list_statuses(t.status, "completed", "solicitation", 50)


@query("f13_failed_awards", ctes("status") + "SELECT award_id, enrichment_types, error_message, last_updated FROM status WHERE status = 'failed'")
def f13f(t):
    return en.failed_awards(t.status)


@query("f13_drop_old_statuses", ctes("status") + "SELECT * FROM status WHERE last_updated >= TIMESTAMP '2024-01-10 00:00:00'")
def f13o(t):
    return en.drop_older(t.status, F.lit("2024-01-10").cast("timestamp_ntz"))


@query("w13_batch_update", ctes("status") + """, ch AS (SELECT award_id, CASE WHEN status = 'failed' THEN 'completed' END AS status, confidence_score / 2 AS confidence_score, CAST(NULL AS VARCHAR) AS error_message
  FROM status WHERE status IN ('failed', 'pending'))
SELECT s.award_id, s.enrichment_types, coalesce(ch.status, s.status) AS status, coalesce(ch.confidence_score, s.confidence_score) AS confidence_score,
  CASE WHEN ch.award_id IS NULL THEN s.last_updated ELSE TIMESTAMP '2025-01-01 00:00:00' END AS last_updated, s.error_message FROM status s LEFT JOIN ch USING (award_id)""")
def w13(t):
    s = F.col("status")
    ch = t.status.where(s.isin("failed", "pending")).select("award_id", F.when(s == "failed", "completed").alias("status"),
                                                            (F.col("confidence_score") / 2).alias("confidence_score"), F.lit(None).cast("string").alias("error_message"))
    return en.apply_changes(t.status, ch, F.lit("2025-01-01").cast("timestamp_ntz")).select(*_STATUS_COLS)


@query("w13_reset_failed", ctes("status") + """
SELECT award_id, enrichment_types, CASE WHEN hit THEN 'pending' ELSE status END AS status, confidence_score,
  CASE WHEN hit THEN TIMESTAMP '2025-01-01 00:00:00' ELSE last_updated END AS last_updated, CASE WHEN NOT hit THEN error_message END AS error_message
FROM (SELECT *, status = 'failed' AND error_message IN ('code 1', 'code 2') AS hit FROM status)""")
def w13r(t):
    picked = t.status.where(F.col("error_message").isin("code 1", "code 2")).select("award_id")
    return en.reset_failed(t.status, F.lit("2025-01-01").cast("timestamp_ntz"), picked).select(*_STATUS_COLS)


# --- awardee analytics -----------------------------------------------------------------------
_METRICS_SQL = ctes("history") + """, h AS (SELECT *, CAST(award_amount AS DECIMAL(18,2)) AS m FROM history),
metrics AS (SELECT uei, count(*) AS total_awards, CAST(sum(m) AS DOUBLE) AS total_funding, CAST(count(*) FILTER (award_status IN ('Completed', 'Active', 'Ongoing')) AS DOUBLE) / count(*) AS success_rate,
  CAST(sum(m) AS DOUBLE) / count(*) AS avg_award_amount, min(start_date) AS first_award_date, max(start_date) AS last_award_date,
  list_sort(list(DISTINCT funding_agency)) AS primary_agencies, count(*) FILTER (m < 100000) AS small_awards, count(*) FILTER (m BETWEEN 100000 AND 500000) AS medium_awards,
  count(*) FILTER (m > 500000) AS large_awards FROM h GROUP BY uei)
"""


@query("a7_awardee_metrics", _METRICS_SQL + "SELECT * FROM metrics")
def a7(t):
    return aw.metrics(t.history)


@query("a8_success_rate", _METRICS_SQL + "SELECT uei, success_rate FROM metrics")
def a8(t):
    return aw.success_rate(t.history)


_AREA_WORDS = {"Hot": ("red", "ring"), "Cold": ("blue", "economy"), "Small": ("small", "promo")}


@query("a9_technology_areas", ctes("history") + f""", hits AS (SELECT uei, area, count(*) AS awards FROM (
  SELECT DISTINCT uei, area, h.rid FROM (SELECT *, row_number() OVER () AS rid, lower(title || ' ' || abstract || ' ') AS t FROM history) h
  JOIN {values([(a, w) for a, ws in _AREA_WORDS.items() for w in ws], 'v(area, w)')} ON contains(t, w)) GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY uei ORDER BY awards DESC, area) AS area_rank FROM hits""")
def a9(t):
    rows = t.history.withColumn("keywords", F.array().cast("array<string>"))
    return aw.tech_areas(rows, areas=_AREA_WORDS)


@query("a10_agency_diversity", ctes("history") + """
SELECT uei, count(*) AS unique_agencies, CAST(count(*) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS diversity_score, max(n) FILTER (funding_agency = 'NATION_1') AS nation_1
FROM (SELECT uei, funding_agency, count(*) AS n FROM history GROUP BY 1, 2) GROUP BY 1""")
def a10(t):
    df = aw.diversity(t.history)
    return df.select("uei", "unique_agencies", "diversity_score", F.try_element_at("agency_distribution", F.lit("NATION_1")).alias("nation_1"))


@query("a11_funding_trend", ctes("history") + """, e AS (SELECT uei, count(*) AS n, arg_min(award_amount, (start_date, award_amount)) AS f, arg_max(award_amount, (start_date, award_amount)) AS l,
  min(start_date) AS fd, max(start_date) AS ld FROM history GROUP BY 1)
SELECT uei, CASE WHEN n < 2 THEN 'insufficient_data' WHEN l - f > 0 THEN 'increasing' WHEN l - f < 0 THEN 'decreasing' ELSE 'stable' END AS trend,
  CASE WHEN n < 2 THEN 0.0 ELSE l - f END AS total_growth, CASE WHEN n >= 2 AND ld > fd THEN (l - f) / (date_diff('day', fd, ld) / 365.25::DOUBLE) ELSE 0.0 END AS avg_annual_growth,
  CASE WHEN n < 2 THEN 0.0 ELSE date_diff('day', fd, ld) / 365.25::DOUBLE END AS years_span FROM e""")
def a11(t):
    return aw.trend(t.history)


@query("a12_benchmark", _METRICS_SQL + """, y AS (SELECT *, date_diff('day', first_award_date, last_award_date) / 365.25::DOUBLE AS years_active FROM metrics)
SELECT uei, CASE WHEN success_rate >= 0.9 THEN 90 WHEN success_rate >= 0.8 THEN 75 WHEN success_rate >= 0.7 THEN 60 WHEN success_rate >= 0.6 THEN 40 WHEN success_rate >= 0.5 THEN 25 ELSE 0 END AS success_rate_percentile,
  CASE WHEN total_funding < 500000 THEN 'startup' WHEN total_funding < 2000000 THEN 'small' WHEN total_funding < 10000000 THEN 'medium' ELSE 'large' END AS funding_level_category,
  CASE WHEN years_active >= 10 THEN 'veteran' WHEN years_active >= 5 THEN 'experienced' WHEN years_active >= 2 THEN 'emerging' ELSE 'new' END AS experience_level, years_active FROM y""")
def a12(t):
    return aw.benchmark(aw.metrics(t.history))


@query("a13_risk", ctes("history") + f""", s AS (SELECT uei, count(*) AS n, count(*) FILTER (award_status = 'Terminated') AS term, count(*) FILTER (start_date >= DATE '{AS_OF}' - 730 + 3000) AS recent FROM history GROUP BY 1),
sh AS (SELECT uei, CAST(max(n) AS DOUBLE) / sum(n) AS top FROM (SELECT uei, funding_agency, count(*) AS n FROM history GROUP BY 1, 2) GROUP BY 1),
r AS (SELECT *, CAST(term AS DOUBLE) / CAST(n AS DOUBLE) AS rate FROM s JOIN sh USING (uei))
SELECT 'u' || uei AS uei, least(1.0, CASE WHEN term > 0 THEN rate * 0.5::DOUBLE ELSE 0.0 END + CASE WHEN recent = 0 THEN 0.3::DOUBLE ELSE 0.0 END + CASE WHEN top > 0.8 THEN 0.2::DOUBLE ELSE 0.0 END)::DOUBLE AS risk_score,
  (term > 0)::INT + (recent = 0)::INT + (top > 0.8)::INT AS factors, (term > 0)::INT + (recent = 0)::INT + (top > 0.8)::INT AS advice FROM r
UNION ALL SELECT 'uextra' || CAST(r_regionkey AS VARCHAR), 1.0, 1, 1 FROM region""")
def a13(t):
    later = F.date_add(F.lit(AS_OF).cast("date"), 3000)
    extra = t.raw("region").select(F.concat(F.lit("extra"), F.col("r_regionkey").cast("string")).alias("uei"))
    df = aw.risk(t.history, later, extra, keep_history=True)
    return df.select(F.concat(F.lit("u"), "uei").alias("uei"), "risk_score", F.size("risk_factors").alias("factors"), F.size("recommendations").alias("advice"))


_PROFILE_SQL = _METRICS_SQL + """, ar AS (SELECT uei, list_sort(list(DISTINCT 'P ' || abstract)) AS technology_areas FROM history GROUP BY uei),
profiles AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 12, '0') AS uei, CASE s_suppkey % 9 WHEN 0 THEN 'Test' WHEN 1 THEN '' ELSE s_name END AS legal_name, m.* EXCLUDE (uei, success_rate, small_awards, medium_awards, large_awards),
  (SELECT CAST(count(*) FILTER (award_status IN ('Completed', 'Active')) AS DOUBLE) / count(*) FROM history x WHERE x.uei = m.uei) AS success_rate, technology_areas
  FROM supplier JOIN metrics m ON m.uei = lpad(CAST(s_suppkey AS VARCHAR), 12, '0') JOIN ar ON ar.uei = m.uei)
"""


def _profiles(t):
    k = F.col("s_suppkey")
    ent = t.raw("supplier").select(_uei("s_suppkey").alias("uei"), F.when(k % 9 == 0, "Test").when(k % 9 == 1, "").otherwise(F.col("s_name")).alias("legal_name"))
    areas = t.history.select("uei", F.concat(F.lit("P "), F.col("abstract")).alias("area")).distinct()
    return aw.profile(ent, t.history, areas)


@query("j17_awardee_profiles", _PROFILE_SQL + "SELECT * FROM profiles")
def j17(t):
    return _profiles(t)


@query("f8_profile_findings", _PROFILE_SQL + f""", f AS (
  SELECT 'legal_name' AS field, 'error' AS severity, 'Business name is required' AS message FROM profiles WHERE legal_name = ''
  UNION ALL SELECT 'legal_name', 'warning', 'Business name appears to be a placeholder' FROM profiles WHERE lower(legal_name) IN ('test', 'example', 'sample')
  UNION ALL SELECT 'avg_award_amount', 'warning', 'Average award amount is unusually high' FROM profiles WHERE avg_award_amount > 50000000
  UNION ALL SELECT 'total_funding', 'warning', 'Total funding amount is unusually high' FROM profiles WHERE total_funding > 1000000000
  UNION ALL SELECT 'first_award_date', 'warning', 'First award date is in the future' FROM profiles WHERE first_award_date > DATE '{AS_OF}'
  UNION ALL SELECT 'last_award_date', 'warning', 'Last award date is in the future' FROM profiles WHERE last_award_date > DATE '{AS_OF}'
  UNION ALL SELECT 'primary_agencies', 'warning', 'Unknown agency code: ' || a FROM (SELECT unnest(primary_agencies) AS a FROM profiles)
  UNION ALL SELECT 'technology_areas', 'warning', 'Unknown technology area: ' || a FROM (SELECT unnest(technology_areas) AS a FROM profiles)
  UNION ALL SELECT 'primary_agencies', 'warning', 'High concentration with single agency might indicate limited diversification' FROM profiles WHERE len(primary_agencies) = 1 AND total_awards > 10
  UNION ALL SELECT 'success_rate', 'warning', 'Very high success rate with many awards is unusual' FROM profiles WHERE total_awards > 50 AND success_rate > 0.95)
SELECT field, severity, message, count(*) AS profiles FROM f GROUP BY ALL""")
def f8(t):
    return aw.finding_report(aw.validate_profiles(_profiles(t), F.lit(AS_OF).cast("date")))


@query("f16_history_of_one_awardee", ctes("history") + "SELECT uei, award_number, award_amount, start_date FROM history WHERE uei = '000000000003' AND start_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'")
def f16(t):
    d = lambda s: F.lit(s).cast("date")
    return aw.history_between(t.history, "000000000003", d("1997-01-01"), d("1998-12-31")).select("uei", "award_number", "award_amount", "start_date")
