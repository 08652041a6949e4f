"""Source, cleaning, validation and table queries over award rows made untidy."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import cleaning as cl
from ..functions import fixed_values as fx
from ..operators import ingest as ing
from ..session import scratch_path
from ..sources import award_csv, schemas, tables
from .adapters import ctes
from .registry import query

INGESTED = datetime(2025, 1, 15)


def _case(expr: str, options: dict[int, str], default: str) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {k} THEN {v}" for k, v in options.items()) + f" ELSE {default} END"


_LONG = "Bureau of Remarkably Long Department Names"
_AGENCIES = {0: "Department of Defense", 1: "department of energy", 2: "NASA", 3: _LONG, 4: "", 5: "Navy"}
_STATES = {0: "California", 1: "oh", 2: "Atlantis", 3: "", 4: " New York "}
_PHASES = {0: "I", 1: "two", 2: "Phase III", 3: "IV", 4: "", 5: " 2 "}
_q = lambda s: "'" + s.replace("'", "''") + "'"

RAW_SQL = f"""raw AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS row_id,
         CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE CAST(o_orderkey // 2 AS VARCHAR) END AS "Award_Number",
         {_case('o_custkey % 6', {k: _q(v) for k, v in _AGENCIES.items()}, "''")} AS "Agency_Code",
         CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'Bureau ' || CAST(o_custkey % 9 AS VARCHAR) END AS "Bureau",
         CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE ' T' || CAST(o_custkey % 40 AS VARCHAR) || ' ' END AS "topic",
         CASE WHEN d.text IS NOT NULL THEN d.text WHEN o_orderkey % 3 = 0 THEN '  ' ELSE o_orderpriority END AS abstract,
         CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderstatus || ', ' || o_orderpriority || ' ,, x' END AS keywords,
         {_case('o_orderkey % 6', {k: _q(v) for k, v in _PHASES.items()}, "''")} AS phase,
         CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE c_name END AS firm,
         CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE n_name END AS city,
         {_case('o_custkey % 5', {k: _q(v) for k, v in _STATES.items()}, "''")} AS state,
         CASE o_orderkey % 5 WHEN 0 THEN '$' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)
              WHEN 1 THEN ' $ 1,' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || '.50 '
              WHEN 2 THEN 'invalid' WHEN 3 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) ELSE '-5' END AS amount,
         CASE o_orderkey % 7 WHEN 0 THEN CAST(year(o_orderdate) AS VARCHAR) WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d')
              WHEN 2 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 3 THEN '' WHEN 4 THEN 'not a date'
              WHEN 5 THEN strftime(o_orderdate, '%B %-d, %Y') ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS award_year,
         CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(year(o_orderdate) - 1 AS VARCHAR) END AS solicitation_year
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       LEFT JOIN documents d ON d.doc_id = o_orderkey)"""


def _pick(index, options, default=""):
    out = F
    for k, v in options.items():
        out = out.when(index == k, F.lit(v))
    return out.otherwise(F.lit(default))


def raw_awards(t):
    """Award rows as a careless CSV would hold them: aliased headers, mixed spellings, gaps."""
    docs = t.raw("documents").select("doc_id", "text")
    key = F.col("o_orderkey")
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    date = F.col("o_orderdate")
    year = F.year(date).cast("string")
    return (
        t.raw("orders")
        .join(t.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(docs, key == F.col("doc_id"), "left")
        .select(
            key.cast("string").alias("row_id"),
            F.when(key % 11 == 0, "").otherwise(F.floor(key / 2).cast("string")).alias("Award_Number"),
            _pick(F.col("o_custkey") % 6, _AGENCIES).alias("Agency_Code"),
            F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("Bureau "), (F.col("o_custkey") % 9).cast("string"))).alias("Bureau"),
            F.when(key % 5 == 0, "").otherwise(F.concat(F.lit(" T"), (F.col("o_custkey") % 40).cast("string"), F.lit(" "))).alias("topic"),
            F.when(F.col("text").isNotNull(), F.col("text")).when(key % 3 == 0, "  ").otherwise(F.col("o_orderpriority")).alias("abstract"),
            F.when(key % 2 == 0, "").otherwise(F.concat(F.col("o_orderstatus"), F.lit(", "), F.col("o_orderpriority"), F.lit(" ,, x"))).alias("keywords"),
            _pick(key % 6, _PHASES).alias("phase"),
            F.when(key % 13 == 0, "").otherwise(F.col("c_name")).alias("firm"),
            F.when(key % 17 == 0, "").otherwise(F.col("n_name")).alias("city"),
            _pick(F.col("o_custkey") % 5, _STATES).alias("state"),
            F.when(key % 5 == 0, F.concat(F.lit("$"), price))
            .when(key % 5 == 1, F.concat(F.lit(" $ 1,"), F.lpad((key % 1000).cast("string"), 3, "0"), F.lit(".50 ")))
            .when(key % 5 == 2, "invalid").when(key % 5 == 3, price).otherwise("-5").alias("amount"),
            F.when(key % 7 == 0, year).when(key % 7 == 1, F.date_format(date, "yyyy-MM-dd"))
            .when(key % 7 == 2, F.date_format(date, "MM/dd/yyyy")).when(key % 7 == 3, "").when(key % 7 == 4, "not a date")
            .when(key % 7 == 5, F.date_format(date, "MMMM d, yyyy")).otherwise(F.date_format(date, "yyyy-MM-dd HH:mm:ss")).alias("award_year"),
            F.when(key % 3 == 0, "").otherwise((F.year(date) - 1).cast("string")).alias("solicitation_year"),
        )
    )


def canonical_raw(t):
    return award_csv.canonical_columns(raw_awards(t))


def clean(t):
    return ing.clean_awards(canonical_raw(t), INGESTED)


_AGENCY_MAP = "(VALUES " + ", ".join(f"({_q(k.upper())}, {_q(v)})" for k, v in fx.AGENCY_CODES.items()) + ") am(k, code)"
_STATE_MAP = "(VALUES " + ", ".join(f"({_q(k)}, {_q(v)})" for k, v in fx.STATE_CODES.items()) + ") sm(k, code)"
_AGENCY = """CASE WHEN "Agency_Code" = '' THEN 'UNKNOWN' ELSE coalesce(am.code, CASE WHEN length("Agency_Code") <= 32 THEN "Agency_Code" END, 'UNKNOWN') END"""
_STATE = "coalesce(sm.code, CASE WHEN length(trim(state)) = 2 THEN upper(trim(state)) END, 'XX')"
_PHASE = """CASE WHEN regexp_replace(upper(trim(phase)), '^PHASE\\s+', '') IN ('I', '1', 'ONE') THEN 'I'
  WHEN regexp_replace(upper(trim(phase)), '^PHASE\\s+', '') IN ('II', '2', 'TWO') THEN 'II'
  WHEN regexp_replace(upper(trim(phase)), '^PHASE\\s+', '') IN ('III', '3', 'THREE') THEN 'III' ELSE 'Other' END"""
_AMOUNT = "try_cast(replace(replace(replace(amount, '$', ''), ',', ''), ' ', '') AS DOUBLE)"
_PARSED = """coalesce(CASE WHEN regexp_full_match(trim(award_year), '\\d{4}') THEN make_date(try_cast(trim(award_year) AS BIGINT), 7, 1) END,
  CAST(try_strptime(trim(award_year), ['%Y-%m-%d', '%Y-%m-%d %H:%M:%S', '%m/%d/%Y', '%B %d, %Y']) AS DATE))"""
_DATE = f"""CASE WHEN trim(award_year) <> '' THEN coalesce({_PARSED}, DATE '2025-01-15')
  ELSE coalesce(make_date(try_cast(solicitation_year AS BIGINT), 7, 1), DATE '2025-01-15') END"""
_KEYWORDS = "list_filter(list_transform(string_split(keywords, ','), lambda x: trim(x)), lambda x: x <> '')"
CLEAN_SQL = f"""clean AS (
  SELECT row_id, trim("Award_Number") AS award_id, {_AGENCY} AS agency, nullif(trim("Bureau"), '') AS sub_agency,
         coalesce(nullif(trim(topic), ''), 'UNKNOWN') AS topic_code, nullif(trim(abstract), '') AS abstract, {_KEYWORDS} AS keywords,
         {_PHASE} AS phase, coalesce(nullif(trim(firm), ''), 'UNKNOWN') AS firm_name, coalesce(nullif(trim(city), ''), 'Unknown') AS firm_city,
         {_STATE} AS firm_state, {_AMOUNT} AS award_amount, {_DATE} AS award_date, year({_DATE}) AS fiscal_year,
         try_cast(solicitation_year AS INTEGER) AS solicitation_year
  FROM raw LEFT JOIN {_AGENCY_MAP} ON upper("Agency_Code") = am.k LEFT JOIN {_STATE_MAP} ON lower(trim(state)) = sm.k)"""
_RAW = f"WITH {RAW_SQL}\n"
_CLEAN = f"WITH {RAW_SQL},\n{CLEAN_SQL}\n"
_CLEAN_COLS = ["row_id", "award_id", "agency", "sub_agency", "topic_code", "abstract", "keywords", "phase", "firm_name",
               "firm_city", "firm_state", "award_amount", "award_date", "fiscal_year", "solicitation_year"]


# --- sources ---------------------------------------------------------------------------------
def _written_csv(t, df):
    path = scratch_path(t.spark, "award-csv")
    df.write.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


@query("s1_read_award_csv", _RAW + """
SELECT row_id, "Award_Number" AS award_id, "Agency_Code" AS agency, "Bureau" AS sub_agency, topic AS topic_code, abstract, keywords,
       phase, firm AS firm_name, city AS firm_city, state AS firm_state, amount AS award_amount, award_year AS award_date, solicitation_year
FROM raw""")
def s1(t):
    return award_csv.read_award_csv(t.spark, _written_csv(t, raw_awards(t)))


_YEARLY_SQL = _RAW + """, yearly AS (
  SELECT "Award_Number" AS award_id, "Agency_Code" AS agency, "Bureau" AS sub_agency, topic AS topic_code, abstract, keywords, phase,
         firm AS firm_name, city AS firm_city, state AS firm_state, amount AS award_amount, award_year AS award_date, row_id FROM raw)
"""


def _yearly(t):
    return raw_awards(t).select(
        F.col("Award_Number").alias("award_id"), F.col("Agency_Code").alias("agency_code"), F.col("Bureau").alias("bureau_code"),
        F.col("topic").alias("topic_code"), "abstract", "keywords", "phase", "firm", F.col("city").alias("firm_city"),
        F.col("state").alias("firm_state"), F.col("amount").alias("award_amount"), "award_year", "row_id",
    )


@query("s2_read_yearly_csv", _YEARLY_SQL + "SELECT * FROM yearly")
def s2(t):
    return award_csv.read_yearly_csv(t.spark, _written_csv(t, _yearly(t)))


@query("s3_column_aliases", _RAW + """
SELECT row_id, "Award_Number" AS award_id, "Agency_Code" AS agency, "Bureau" AS sub_agency, topic AS topic_code, firm AS firm_name,
       city AS firm_city, state AS firm_state, amount AS award_amount, award_year AS award_date, solicitation_year FROM raw""")
def s3(t):
    return canonical_raw(t).drop("abstract", "keywords", "phase")


@query("s4_required_columns", _RAW + """
SELECT count(*) AS row_count, count(*) FILTER ("Award_Number" = '') AS blank_ids FROM raw""")
def s4(t):
    df = award_csv.require_columns(canonical_raw(t), fx.BOOTSTRAP_REQUIRED)
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("award_id") == "").alias("blank_ids"))


@query("s5_year_partitions", ctes("awards") + """
SELECT award_id, award_amount, CAST(fiscal_year AS INTEGER) AS fiscal_year FROM awards WHERE fiscal_year = 1997""")
def s5(t):
    path = scratch_path(t.spark, "awards-by-year")
    tables.write_partitions(t.awards, path)
    tables.write_partitions(t.awards.where("fiscal_year = 1997"), path)
    return tables.read_partition(t.spark, path, 1997, ["award_id", "award_amount", "fiscal_year"])


@query("s5_list_partitions", ctes("awards") + "SELECT DISTINCT CAST(fiscal_year AS INTEGER) AS fiscal_year FROM awards")
def s5l(t):
    path = scratch_path(t.spark, "awards-by-year")
    tables.write_partitions(t.awards.select("award_id", "fiscal_year"), path)
    return tables.list_partitions(t.spark, path)


_TAX2_SQL = """, versions AS (
  SELECT cet_id, name, definition, parent_cet_id, 'v1' AS version FROM taxonomy
  UNION ALL SELECT cet_id, CASE cet_id WHEN 'LARGE' THEN 'Very large' ELSE name END, definition, parent_cet_id, 'v2' FROM taxonomy WHERE cet_id <> 'SMALL'
  UNION ALL SELECT DISTINCT p_type, 'Standard', 'Added', CAST(NULL AS VARCHAR), 'v2' FROM part WHERE p_type = 'STANDARD')
"""


def taxonomy_versions(t):
    v1 = t.taxonomy.withColumn("version", F.lit("v1"))
    v2 = t.taxonomy.where(F.col("cet_id") != "SMALL").withColumn(
        "name", F.when(F.col("cet_id") == "LARGE", "Very large").otherwise(F.col("name"))
    ).withColumn("version", F.lit("v2"))
    extra = t.raw("part").where(F.col("p_type") == "STANDARD").select(
        F.col("p_type").alias("cet_id"), F.lit("Standard").alias("name"), F.lit("Added").alias("definition"),
        F.lit(None).cast("string").alias("parent_cet_id"), F.lit("v2").alias("version"),
    ).distinct()
    return v1.unionByName(v2).unionByName(extra)


@query("s6_latest_taxonomy", ctes("taxonomy") + _TAX2_SQL + "SELECT * FROM versions WHERE version = (SELECT max(version) FROM versions)")
def s6(t):
    return tables.latest_version(taxonomy_versions(t))


@query("s7_versioned_taxonomy_write", ctes("taxonomy") + _TAX2_SQL + "SELECT version, count(*) AS areas FROM versions GROUP BY version")
def s7(t):
    path = scratch_path(t.spark, "taxonomy")
    both = taxonomy_versions(t)
    tables.save_taxonomy(both.where("version = 'v1'"), path)
    tables.save_taxonomy(both.where("version = 'v2'"), path, t.spark.read.parquet(path))
    return t.spark.read.parquet(path).groupBy("version").agg(F.count(F.lit(1)).alias("areas"))


# --- keyed tables ----------------------------------------------------------------------------
_BATCH_SQL = """, batch AS (
  SELECT api_source, solicitation_id, 'fresh ' || solicitation_id AS description, retrieved_at + INTERVAL 400 DAY AS retrieved_at
  FROM cache WHERE CAST(solicitation_id AS INTEGER) % 3 = 0
  UNION ALL SELECT 'nih', 'new-' || CAST(r_regionkey AS VARCHAR), r_name, TIMESTAMP '2025-06-01 00:00:00' FROM region),
upserted AS (
  SELECT api_source, solicitation_id, description, retrieved_at FROM cache c
  WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE b.api_source = c.api_source AND b.solicitation_id = c.solicitation_id)
  UNION ALL SELECT * FROM batch)
"""
_CACHE_COLS = ["api_source", "solicitation_id", "description", "retrieved_at"]


def _cache(t):
    return t.cache.select(*_CACHE_COLS)


def _batch(t):
    again = t.cache.where(F.col("solicitation_id").cast("int") % 3 == 0).select(
        "api_source", "solicitation_id", F.concat(F.lit("fresh "), F.col("solicitation_id")).alias("description"),
        (F.col("retrieved_at") + F.make_dt_interval(days=F.lit(400))).alias("retrieved_at"),
    )
    new = t.raw("region").select(
        F.lit("nih").alias("api_source"), F.concat(F.lit("new-"), F.col("r_regionkey").cast("string")).alias("solicitation_id"),
        F.col("r_name").alias("description"), F.lit("2025-06-01").cast("timestamp_ntz").alias("retrieved_at"),
    )
    return again.unionByName(new)


_KEY = ["api_source", "solicitation_id"]


@query("s10_coverage_upsert", ctes("awards", "assessments") + """, covered AS (
  SELECT fiscal_year, count(*) AS total_awards, count(*) FILTER (generation_method = 'automated') AS automated
  FROM assessments JOIN awards USING (award_id) GROUP BY 1)
SELECT fiscal_year, total_awards, automated FROM covered WHERE fiscal_year <> 1998
UNION ALL SELECT fiscal_year, total_awards + 1, automated FROM covered WHERE fiscal_year = 1998""")
def s10(t):
    from ..operators.portfolio import coverage

    stored = coverage(t.assessments, t.awards).select("fiscal_year", "total_awards", "automated")
    rerun = stored.where("fiscal_year = 1998").withColumn("total_awards", F.col("total_awards") + 1)
    return tables.upsert(stored, rerun, ["fiscal_year"])


@query("s11_keyed_upsert", ctes("cache") + _BATCH_SQL + "SELECT * FROM upserted")
def s11(t):
    return tables.upsert(_cache(t), _batch(t), _KEY)


@query("s12_append", ctes("cache") + _BATCH_SQL + "SELECT api_source, solicitation_id, description, retrieved_at FROM cache UNION ALL SELECT * FROM batch")
def s12(t):
    return tables.append(_cache(t), _batch(t))


@query("s13_delete_by_keys", ctes("cache") + _BATCH_SQL + """
SELECT api_source, solicitation_id, description, retrieved_at FROM cache c
WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE b.api_source = c.api_source AND b.solicitation_id = c.solicitation_id)""")
def s13(t):
    return tables.delete_keys(_cache(t), _batch(t), _KEY)


@query("s13_deleted_count", ctes("cache") + _BATCH_SQL + """
SELECT count(*) AS deleted FROM cache c WHERE EXISTS (SELECT 1 FROM batch b WHERE b.api_source = c.api_source AND b.solicitation_id = c.solicitation_id)""")
def s13c(t):
    return tables.count_deleted(_cache(t), _batch(t), _KEY)


@query("s14_filtered_read", ctes("awards") + "SELECT award_id, award_amount FROM awards WHERE agency = 'MACHINERY' AND phase IN ('I', 'III')")
def s14(t):
    return tables.read_where(t.awards, {"agency": "MACHINERY", "phase": ["I", "III"]}, ["award_id", "award_amount"])


@query("s14_table_counts", """
SELECT 'documents' AS table_name, count(*) AS row_count FROM documents UNION ALL SELECT 'lineitem', count(*) FROM lineitem
UNION ALL SELECT 'orders', count(*) FROM orders""")
def s14c(t):
    return tables.table_counts({n: t.raw(n) for n in ("orders", "lineitem", "documents")})


_MODS_SQL = """mods AS (
  SELECT CAST(event_id AS VARCHAR) AS modification_id, CAST(user_id AS VARCHAR) AS award_id, CAST(event_id % 10 AS VARCHAR) AS modification_number,
         event_type AS modification_type, CAST(ts AS DATE) AS modification_date, props AS description,
         CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) END AS funding_change,
         CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(ts AS DATE) + CAST(event_id % 400 AS INTEGER) END AS new_end_date
  FROM events)"""


def modifications(t):
    e = F.col("event_id")
    none = F.lit(None).cast("string")
    return t.raw("events").select(
        e.cast("string").alias("modification_id"), F.col("user_id").cast("string").alias("award_id"),
        (e % 10).cast("string").alias("modification_number"), F.col("event_type").alias("modification_type"),
        F.col("ts").cast("date").alias("modification_date"), F.col("props").alias("description"),
        F.when(e % 4 != 0, F.col("value").cast("decimal(18,2)").cast("double")).alias("funding_change"),
        F.when(e % 3 != 0, F.date_add(F.col("ts").cast("date"), (e % 400).cast("int"))).alias("new_end_date"),
        none.alias("scope_changes"), F.lit("-").alias("justification"), F.lit("-").alias("approving_official"),
        F.col("ts").cast("timestamp_ntz").alias("created_at"),
    )


@query("s15_schema_conformance", f"""WITH {_MODS_SQL}
SELECT column_name, expected_type, actual_type, status, null_count, row_count FROM (VALUES
 ('approving_official', 'string', NULL, 'missing', NULL), ('award_id', 'string', 'string', 'ok', 0), ('created_at', 'timestamp_ntz', 'timestamp_ntz', 'ok', 0),
 ('description', 'string', 'string', 'ok', 0), ('event_hour', NULL, 'int', 'extra', 0), ('funding_change', 'double', 'double', 'ok', -1),
 ('justification', 'string', 'string', 'ok', 0), ('modification_date', 'date', 'date', 'ok', 0), ('modification_id', 'string', 'bigint', 'type_mismatch', 0),
 ('modification_number', 'string', 'string', 'ok', 0), ('modification_type', 'string', 'string', 'ok', 0), ('new_end_date', 'date', 'date', 'ok', -2),
 ('scope_changes', 'string', 'string', 'ok', -3)) v(column_name, expected_type, actual_type, status, nc),
 (SELECT count(*) AS row_count, count(*) FILTER (funding_change IS NULL) AS fn, count(*) FILTER (new_end_date IS NULL) AS en FROM mods),
 LATERAL (SELECT CASE nc WHEN -1 THEN fn WHEN -2 THEN en WHEN -3 THEN row_count ELSE nc END AS null_count)""")
def s15(t):
    df = modifications(t).drop("approving_official").withColumn("modification_id", F.col("modification_id").cast("bigint"))
    return tables.conformance(df.withColumn("event_hour", F.hour("created_at")), schemas.AWARD_MODIFICATIONS)


@query("s16_map_json_round_trip", """
SELECT CAST(doc_id AS VARCHAR) AS key, '{"chars":' || CAST(CAST(n_chars AS DOUBLE) AS VARCHAR) || ',"lang_length":' || CAST(CAST(length(lang) AS DOUBLE) AS VARCHAR) || '}' AS scores_json,
       CAST(n_chars AS DOUBLE) AS chars FROM documents""")
def s16(t):
    docs = t.raw("documents").select(
        F.col("doc_id").cast("string").alias("key"),
        F.create_map(F.lit("chars"), F.col("n_chars").cast("double"), F.lit("lang_length"), F.length("lang").cast("double")).alias("scores"),
    )
    stored = tables.map_to_json(docs, "scores").withColumn("scores_json", F.col("scores"))
    return tables.json_to_map(stored, "scores").select("key", "scores_json", F.col("scores")["chars"].alias("chars"))


@query("f14_purge_cache", ctes("cache") + """
SELECT api_source, solicitation_id, retrieved_at FROM cache
WHERE NOT (api_source = 'nih' AND retrieved_at >= TIMESTAMP '2024-01-05 00:00:00' AND retrieved_at <= TIMESTAMP '2024-01-25 00:00:00')""")
def f14(t):
    return tables.purge(t.cache, source="nih", start="2024-01-05", end="2024-01-25").select("api_source", "solicitation_id", "retrieved_at")


@query("f14_purged_count", ctes("cache") + "SELECT count(*) AS removed FROM cache WHERE api_source = 'grants.gov'")
def f14c(t):
    return tables.count_purged(t.cache, source="grants.gov")


@query("a22_cache_statistics", ctes("cache") + """
SELECT api_source, count(*) AS entries, min(retrieved_at) AS oldest, max(retrieved_at) AS newest FROM cache GROUP BY ROLLUP (api_source)""")
def a22(t):
    from ..operators.enrichment import cache_statistics

    return cache_statistics(t.cache)


# --- cleaning --------------------------------------------------------------------------------
@query("p1_agency_codes", _CLEAN + "SELECT row_id, agency FROM clean")
def p1(t):
    return raw_awards(t).select("row_id", cl.normalize_agency(F.col("Agency_Code")).alias("agency"))


@query("p2_state_codes", _CLEAN + "SELECT row_id, firm_state FROM clean")
def p2(t):
    return raw_awards(t).select("row_id", cl.normalize_state(F.col("state")).alias("firm_state"))


@query("p3_phases", _CLEAN + "SELECT row_id, phase FROM clean")
def p3(t):
    return raw_awards(t).select("row_id", cl.normalize_phase(F.col("phase")).alias("phase"))


@query("p4_amounts", _CLEAN + "SELECT row_id, award_amount FROM clean")
def p4(t):
    return raw_awards(t).select("row_id", cl.parse_amount(F.col("amount")).alias("award_amount"))


@query("p5_award_dates", _CLEAN + "SELECT row_id, award_date FROM clean")
def p5(t):
    return clean(t).select("row_id", "award_date")


@query("p6_yearly_dates", _RAW + """
SELECT row_id, coalesce(CASE WHEN regexp_full_match(trim(award_year), '\\d{4}') THEN make_date(try_cast(trim(award_year) AS BIGINT), 1, 1) END,
  CAST(try_strptime(trim(award_year), ['%Y-%m-%d', '%Y-%m-%d %H:%M:%S', '%m/%d/%Y', '%B %d, %Y']) AS DATE)) AS award_date FROM raw""")
def p6(t):
    return raw_awards(t).select("row_id", cl.parse_date(F.col("award_year"), year_only="01-01").alias("award_date"))


@query("p7_keywords", _RAW + f"""
SELECT row_id, {_KEYWORDS} AS keywords, list_filter(list_transform(string_split(keywords, ';'), lambda x: trim(x)), lambda x: x <> '') AS by_semicolon FROM raw""")
def p7(t):
    k = F.col("keywords")
    return raw_awards(t).select("row_id", cl.split_keywords(k, ",").alias("keywords"), cl.split_keywords(k).alias("by_semicolon"))


@query("p8_placeholders", _CLEAN + "SELECT row_id, topic_code, firm_name, firm_city FROM clean")
def p8(t):
    return clean(t).select("row_id", "topic_code", "firm_name", "firm_city")


@query("p9_fiscal_year", ctes("awards") + """
SELECT award_id, fiscal_year, CAST(year(award_date) + CASE WHEN month(award_date) >= 10 THEN 1 ELSE 0 END AS BIGINT) AS october_year FROM awards""")
def p9(t):
    d = F.col("award_date")
    return t.awards.select("award_id", cl.fiscal_year(d).alias("fiscal_year"), cl.fiscal_year(d, 10).cast("bigint").alias("october_year"))


@query("p1_to_p9_clean_awards", _CLEAN + "SELECT " + ", ".join(_CLEAN_COLS) + " FROM clean")
def p_all(t):
    return clean(t).select(*_CLEAN_COLS)


_SYNTH = "coalesce(nullif(trim(\"Award_Number\"), ''), 'SYNTH-' || substr(md5(concat_ws('|', firm, topic, award_year, amount, \"Agency_Code\")), 1, 16))"


@query("p31_synthetic_ids", _RAW + f"SELECT row_id, {_SYNTH} AS award_id FROM raw")
def p31(t):
    parts = [F.col(c) for c in ("firm", "topic", "award_year", "amount", "Agency_Code")]
    return raw_awards(t).select("row_id", cl.synthetic_id(F.col("Award_Number"), parts).alias("award_id"))


@query("p32_identifier_formats", ctes("awards") + """
SELECT award_id, regexp_full_match(awardee_uei, '[A-Za-z0-9]{12}') AS uei_ok, regexp_full_match(substr(firm_name, -9), '[0-9]{9}') AS duns_ok,
       length(award_id) >= 5 AS award_number_ok FROM awards""")
def p32(t):
    return t.awards.select(
        "award_id", cl.valid_uei(F.col("awardee_uei")).alias("uei_ok"),
        cl.valid_duns(F.substring("firm_name", -9, 9)).alias("duns_ok"), cl.valid_award_number(F.col("award_id")).alias("award_number_ok"),
    )


# --- validation ------------------------------------------------------------------------------
_RULES_SQL = {
    "has_text": "abstract IS NOT NULL OR len(keywords) > 0",
    "amount_positive": "award_amount > 0",
    "date_present": "award_date IS NOT NULL",
    "id_present": "trim(award_id) <> ''",
    "agency_present": "trim(agency) <> ''",
    "agency_length": "length(agency) BETWEEN 1 AND 32",
    "sub_agency_length": "sub_agency IS NULL OR length(sub_agency) <= 64",
    "topic_length": "length(topic_code) BETWEEN 1 AND 64",
    "phase_known": "phase IN ('I', 'II', 'III', 'Other')",
    "firm_present": "length(firm_name) >= 1",
    "city_present": "length(firm_city) >= 1",
    "state_length": "length(firm_state) = 2",
}


def _rules_sql(names) -> str:
    checks = ", ".join(f"CASE WHEN NOT coalesce({_RULES_SQL[n]}, FALSE) THEN '{n}' END" for n in names)
    return f"list_filter([{checks}], lambda x: x IS NOT NULL)"


_VALIDATED = _CLEAN + f", validated AS (SELECT *, {_rules_sql(_RULES_SQL)} AS failed_rules FROM clean)\n"


@query("f3_prevalidation_split", _CLEAN + f"SELECT row_id, {_rules_sql(list(_RULES_SQL)[:5])} AS failed_rules, len({_rules_sql(list(_RULES_SQL)[:5])}) = 0 AS is_valid FROM clean")
def f3(t):
    checked = ing.validate(clean(t), ing.prevalidation_rules())
    return checked.select("row_id", "failed_rules", (F.size("failed_rules") == 0).alias("is_valid"))


@query("f4_schema_validation", _VALIDATED + "SELECT row_id, failed_rules FROM validated")
def f4(t):
    return ing.validate(clean(t)).select("row_id", "failed_rules")


@query("f4_quarantine", _VALIDATED + "SELECT row_id, award_id, agency, award_amount, failed_rules FROM validated WHERE len(failed_rules) > 0")
def f4q(t):
    return ing.split_valid(ing.validate(clean(t)))[1].select("row_id", "award_id", "agency", "award_amount", "failed_rules")


@query("f5_assessment_rules", ctes("assessments") + """, tagged AS (
  SELECT *, CASE WHEN score % 7 = 0 THEN list_append(supporting_cet_ids, primary_cet_id) ELSE supporting_cet_ids END AS s,
         CASE WHEN score > 96 THEN score + 4 ELSE score END AS sc FROM assessments)
SELECT assessment_id, sc AS score, list_filter([CASE WHEN NOT (sc BETWEEN 0 AND 100) THEN 'score_range' END,
  CASE WHEN list_contains(s, primary_cet_id) THEN 'supporting_excludes_primary' END,
  CASE WHEN len(list_distinct(s)) <> len(s) THEN 'supporting_unique' END,
  CASE WHEN len(s) > 3 THEN 'supporting_at_most_three' END], lambda x: x IS NOT NULL) AS failed_rules FROM tagged""")
def f5(t):
    odd = t.assessments.withColumn(
        "supporting_cet_ids",
        F.when(F.col("score") % 7 == 0, F.concat("supporting_cet_ids", F.array("primary_cet_id"))).otherwise(F.col("supporting_cet_ids")),
    ).withColumn("score", F.when(F.col("score") > 96, F.col("score") + 4).otherwise(F.col("score")))
    odd = odd.withColumn("evidence_statements", F.lit(None).cast("array<struct<excerpt:string>>"))
    return ing.validate(odd, ing.assessment_rules()).select("assessment_id", "score", "failed_rules")


@query("f6_queue_and_taxonomy_dates", ctes("queue") + """
SELECT queue_id, CASE WHEN CAST(award_id AS BIGINT) % 5 = 0 THEN ['resolved_after_opened'] ELSE []::VARCHAR[] END AS failed_rules,
       CASE WHEN CAST(award_id AS BIGINT) % 3 = 0 THEN ['retired_after_effective'] ELSE []::VARCHAR[] END AS failed_dates FROM queue""")
def f6(t):
    n = F.col("award_id").cast("bigint")
    q = t.queue.withColumn("resolved_at", F.when(n % 5 == 0, F.col("opened_at") - F.make_dt_interval(days=F.lit(2))))
    q = ing.validate(q, ing.queue_rules()).withColumnRenamed("failed_rules", "queue_failed")
    q = q.withColumn("effective_date", F.col("due_by")).withColumn("retired_date", F.when(n % 3 == 0, F.date_sub("due_by", 1)))
    q = ing.validate(q.drop("status").withColumn("status", F.lit("active")), ing.taxonomy_rules())
    return q.select("queue_id", F.col("queue_failed").alias("failed_rules"), F.col("failed_rules").alias("failed_dates"))


@query("f7_modification_rules", f"""WITH {_MODS_SQL}
SELECT modification_id, CASE WHEN modification_date > DATE '2024-01-10' THEN ['date_not_future'] ELSE []::VARCHAR[] END AS failed_rules FROM mods""")
def f7(t):
    rules = ing.modification_rules(F.lit("2024-01-10").cast("date"))
    return ing.validate(modifications(t), rules).select("modification_id", "failed_rules")


@query("f7_solicitation_and_office_rules", """
SELECT p_partkey, list_filter([CASE WHEN p_retailprice - 950 < 0 THEN 'funding_min_not_negative' END, CASE WHEN p_size * 30 < p_retailprice - 950 THEN 'funding_order' END,
  CASE WHEN p_size % 10 = 0 THEN 'period_positive' END, CASE WHEN p_size > 40 THEN 'scores_in_unit' END], lambda x: x IS NOT NULL) AS failed_solicitation,
  list_filter([CASE WHEN p_size % 3 = 0 THEN 'email_format' END, CASE WHEN p_size % 4 = 0 THEN 'url_format' END], lambda x: x IS NOT NULL) AS failed_office
FROM part""")
def f7s(t):
    size = F.col("p_size")
    p = t.raw("part").select(
        "p_partkey", (F.col("p_retailprice") - 950).alias("funding_range_min"), (size * 30).cast("double").alias("funding_range_max"),
        (size % 10).alias("performance_period"), F.create_map(F.col("p_type"), size / F.lit(40.0)).alias("cet_relevance_scores"),
        F.when(size % 3 == 0, "no at sign").otherwise(F.concat("p_type", F.lit("@example.org"))).alias("contact_email"),
        F.when(size % 4 == 0, "ftp://example.org").otherwise(F.lit("https://example.org/a")).alias("website_url"),
        F.lit(None).cast("double").alias("annual_budget"), size.alias("active_solicitations_count"), size.alias("total_awards_managed"),
    )
    p = ing.validate(p, ing.solicitation_rules()).withColumnRenamed("failed_rules", "failed_solicitation")
    return ing.validate(p, ing.office_rules()).select("p_partkey", "failed_solicitation", F.col("failed_rules").alias("failed_office"))


@query("a27_load_report", _VALIDATED + """
SELECT count(*) AS total_rows, count(*) FILTER (len(failed_rules) = 0) AS loaded_rows, count(*) FILTER (len(failed_rules) > 0) AS skipped_rows FROM validated""")
def a27(t):
    return ing.load_report(ing.validate(clean(t)))


@query("a27_failure_reasons", _VALIDATED + "SELECT rule, count(*) AS failures FROM (SELECT unnest(failed_rules) AS rule FROM validated) GROUP BY rule")
def a27r(t):
    return ing.failure_reasons(ing.validate(clean(t)))


@query("a28_duplicate_ids", _CLEAN + "SELECT award_id, count(*) AS occurrences FROM clean WHERE trim(award_id) <> '' GROUP BY 1 HAVING count(*) >= 2")
def a28(t):
    return ing.duplicate_report(clean(t))


@query("a28_missing_ids_by_agency", _CLEAN + "SELECT agency, count(*) FILTER (trim(award_id) = '') AS missing_ids, count(*) AS row_count FROM clean GROUP BY 1")
def a28m(t):
    return ing.missing_id_report(clean(t))


@query("a26_modification_rollup", f"""WITH {_MODS_SQL}
SELECT award_id, count(*) AS modifications, CAST(sum(CAST(funding_change AS DECIMAL(18,2))) AS DOUBLE) AS total_funding_change, max(new_end_date) AS latest_end_date
FROM mods GROUP BY award_id""")
def a26(t):
    from ..operators.awardees import modification_rollup

    return modification_rollup(modifications(t))


# --- deduplication and set operations --------------------------------------------------------
@query("w2_dedup_keep_last", _CLEAN + """
SELECT row_id, award_id, agency, award_amount FROM (SELECT *, row_number() OVER (PARTITION BY award_id, agency ORDER BY CAST(row_id AS BIGINT) DESC) AS rn FROM clean) WHERE rn = 1""")
def w2(t):
    df = clean(t)
    return ing.dedup_last(df, ["award_id", "agency"], [F.col("row_id").cast("bigint").desc()]).select("row_id", "award_id", "agency", "award_amount")


@query("w3_dedup_keep_first_synthetic", _RAW + f"""
SELECT row_id, award_id FROM (SELECT row_id, {_SYNTH} AS award_id, row_number() OVER (PARTITION BY {_SYNTH} ORDER BY CAST(row_id AS BIGINT)) AS rn FROM raw) WHERE rn = 1""")
def w3(t):
    raw = raw_awards(t).withColumn("award_id", F.col("Award_Number"))
    parts = ["firm", "topic", "award_year", "amount", "Agency_Code"]
    return ing.dedup_first_synthetic(raw, parts, [F.col("row_id").cast("bigint")]).select("row_id", "award_id")


@query("x1_union", ctes("cache") + _BATCH_SQL + "SELECT api_source, solicitation_id FROM cache UNION ALL SELECT api_source, solicitation_id FROM batch")
def x1(t):
    return tables.append(_cache(t).select(*_KEY), _batch(t).select(*_KEY))


@query("x2_difference_and_intersection", ctes("awards", "assessments") + """
SELECT award_id, 'never_assessed' AS side FROM (SELECT award_id FROM awards EXCEPT SELECT award_id FROM assessments)
UNION ALL SELECT award_id, 'assessed' FROM (SELECT award_id FROM awards INTERSECT SELECT award_id FROM assessments)""")
def x2(t):
    # one pass over both tables; their ids are combined before the shuffle and never sorted
    ids = t.awards.select("award_id", F.lit(True).alias("awarded"), F.lit(False).alias("assessed"))
    ids = ids.unionByName(t.assessments.select("award_id", F.lit(False).alias("awarded"), F.lit(True).alias("assessed")))
    seen = ids.groupBy("award_id").agg(F.max("awarded").alias("awarded"), F.max("assessed").alias("assessed"))
    return seen.where("awarded").select("award_id", F.when(F.col("assessed"), "assessed").otherwise("never_assessed").alias("side"))


@query("x3_label_universe", ctes("reviewer", "predictions") + "SELECT label FROM reviewer UNION SELECT enhanced FROM predictions")
def x3(t):
    from ..operators.evaluation import label_universe

    return label_universe(t.reviewer.select("label"), t.predictions.select(F.col("enhanced").alias("label")))


@query("j13_semi_and_anti_joins", ctes("awards") + """
SELECT award_id, EXISTS (SELECT 1 FROM labels WHERE CAST(doc_id AS VARCHAR) = award_id) AS has_label FROM awards""")
def j13(t):
    known = t.raw("labels").select(F.col("doc_id").cast("string").alias("award_id"))
    a = t.awards.select("award_id")
    yes = a.join(known, "award_id", "left_semi").withColumn("has_label", F.lit(True))
    return yes.unionByName(a.join(known, "award_id", "left_anti").withColumn("has_label", F.lit(False)))


@query("j9_taxonomy_hierarchy", ctes("taxonomy") + """
SELECT t.cet_id, t.name, t.parent_cet_id, p.name AS parent_name FROM taxonomy t LEFT JOIN taxonomy p ON p.cet_id = t.parent_cet_id""")
def j9(t):
    from ..operators.taxonomy import with_parent

    return with_parent(t.taxonomy).select("cet_id", "name", "parent_cet_id", "parent_name")


@query("j10_taxonomy_diff", ctes("taxonomy") + _TAX2_SQL + """
SELECT coalesce(o.cet_id, n.cet_id) AS cet_id, CASE WHEN o.cet_id IS NULL THEN 'added' WHEN n.cet_id IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM (SELECT * FROM versions WHERE version = 'v1') o FULL JOIN (SELECT * FROM versions WHERE version = 'v2') n ON o.cet_id = n.cet_id
WHERE o.cet_id IS NULL OR n.cet_id IS NULL OR o.name IS DISTINCT FROM n.name OR o.definition IS DISTINCT FROM n.definition""")
def j10(t):
    from ..operators.taxonomy import diff

    v = taxonomy_versions(t)
    return diff(v.where("version = 'v1'"), v.where("version = 'v2'"))
