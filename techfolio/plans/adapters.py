"""Domain-shaped views over the test tables, in Spark and as SQL CTEs for the oracle.

Every SQL twin starts from the CTEs below, built with :func:`ctes`, so both engines read the same shape.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import band
from ..operators.portfolio import Filters
from ..session import spread

AS_OF = "1999-06-30"
AREAS = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
FILTERS = Filters(1996, 1999, agencies=("AUTOMOBILE", "BUILDING", "MACHINERY"))
ALL_YEARS = Filters(1900, 2999)
FILTER_SQL = "fiscal_year BETWEEN 1996 AND 1999 AND agency IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY')"

_CTES = {
    "awards": """
  SELECT CAST(o_orderkey AS VARCHAR) AS award_id, c_mktsegment AS agency,
         'REGION ' || CAST(n_regionkey AS VARCHAR) AS sub_agency,
         substr(c_mktsegment, 1, 2) || '-' || CAST(o_custkey % 50 AS VARCHAR) AS topic_code,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'I' WHEN '2' THEN 'II' WHEN '3' THEN 'III' ELSE 'Other' END AS phase,
         c_name AS firm_name, n_name AS firm_city, n_name AS firm_state,
         o_totalprice AS award_amount, CAST(o_orderdate AS DATE) AS award_date,
         year(o_orderdate) AS fiscal_year, o_orderstatus = 'P' AS is_export_controlled,
         lpad(CAST(o_custkey AS VARCHAR), 12, '0') AS awardee_uei,
         'Phase ' || substr(o_orderpriority, 1, 1) || ' program' AS program,
         o_custkey AS custkey
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "award_text": """
  SELECT a.*, d.text AS abstract,
         CASE WHEN d.lang IS NULL THEN NULL ELSE [d.lang, d.source] END AS keywords
  FROM awards a LEFT JOIN documents d ON a.award_id = CAST(d.doc_id AS VARCHAR)""",
    "assessments": """
  SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
                   CAST(l_suppkey AS VARCHAR), CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR)) AS assessment_id,
         CAST(l_orderkey AS VARCHAR) AS award_id, 'v' || l_linestatus AS taxonomy_version,
         2 * l_quantity AS score,
         CASE WHEN 2 * l_quantity >= 70 THEN 'High' WHEN 2 * l_quantity >= 40 THEN 'Medium' ELSE 'Low' END AS classification,
         p_type AS primary_cet_id,
         list_filter([CASE p_size % 6 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'LARGE' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'PROMO' WHEN 4 THEN 'SMALL' ELSE 'STANDARD' END,
                      CASE (p_size + l_linenumber) % 6 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'LARGE' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'PROMO' WHEN 4 THEN 'SMALL' ELSE 'STANDARD' END],
                     lambda x: x <> p_type) AS supporting_cet_ids,
         CASE l_returnflag WHEN 'R' THEN 'manual_review' ELSE 'automated' END AS generation_method,
         CAST(l_shipdate AS TIMESTAMP) AS assessed_at
  FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "latest": """
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY award_id ORDER BY assessed_at DESC NULLS LAST, assessment_id DESC NULLS LAST) AS rn
    FROM assessments) WHERE rn = 1""",
    "classified": """
  SELECT a.*, l.* EXCLUDE (award_id) FROM awards a LEFT JOIN latest l USING (award_id) WHERE {filter}""",
    "classified_all": """
  SELECT a.*, l.* EXCLUDE (award_id) FROM awards a LEFT JOIN latest l USING (award_id)""",
    "taxonomy": """
  SELECT p_type AS cet_id, upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS name,
         'Parts of ' || CAST(count(DISTINCT p_brand) AS VARCHAR) || ' brands' AS definition,
         CASE p_type WHEN 'PROMO' THEN 'ECONOMY' WHEN 'SMALL' THEN 'MEDIUM' END AS parent_cet_id
  FROM part WHERE p_type <> 'STANDARD' GROUP BY p_type""",
    "queue": """
  SELECT 'q' || CAST(o_orderkey AS VARCHAR) AS queue_id, CAST(o_orderkey AS VARCHAR) AS award_id,
         CASE o_orderkey % 4 WHEN 0 THEN 'missing_text' WHEN 1 THEN 'low_confidence' WHEN 2 THEN 'controlled_data' ELSE 'conflict' END AS reason,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'pending' WHEN '2' THEN 'in_review' WHEN '3' THEN 'resolved' ELSE 'escalated' END AS status,
         CAST(o_orderdate AS TIMESTAMP) AS opened_at, CAST(o_orderdate AS DATE) + 90 AS due_by
  FROM orders WHERE o_orderstatus = 'O'""",
    "open_queue": """
  SELECT * EXCLUDE (rn) FROM (
    SELECT queue_id, award_id, reason,
           CASE WHEN status IN ('pending', 'in_review') AND due_by < DATE '{as_of}' THEN 'escalated' ELSE status END AS status,
           opened_at, due_by,
           row_number() OVER (PARTITION BY award_id ORDER BY opened_at DESC NULLS LAST, queue_id DESC NULLS LAST) AS rn
    FROM queue WHERE status <> 'resolved') WHERE rn = 1""",
    "merged": """
  SELECT a.* , l.* EXCLUDE (award_id, score), coalesce(l.score, -1.0) AS score,
         coalesce(t.name, l.primary_cet_id) AS cet_name, q.queue_id, q.reason AS queue_reason, q.status AS queue_status,
         q.due_by AS queue_due_by,
         NOT (a.abstract IS NOT NULL AND trim(a.abstract) <> '' AND a.keywords IS NOT NULL)
           OR coalesce(q.status IN ('pending', 'in_review', 'escalated'), FALSE) AS data_incomplete
  FROM award_text a LEFT JOIN latest l USING (award_id)
  LEFT JOIN taxonomy t ON t.cet_id = l.primary_cet_id
  LEFT JOIN open_queue q ON q.award_id = a.award_id
  WHERE {filter}""",
    "texts": """
  SELECT CAST(doc_id AS VARCHAR) AS key, text, lang AS agency, source AS branch FROM documents""",
    "cache": """
  SELECT CASE item_id % 2 WHEN 0 THEN 'nih' ELSE 'grants.gov' END AS api_source,
         CAST(item_id AS VARCHAR) AS solicitation_id, text AS description,
         ['k' || CAST(item_id % 7 AS VARCHAR), 'k' || CAST(item_id % 5 AS VARCHAR)] AS technical_keywords,
         TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 DAY * item_id AS retrieved_at
  FROM benchmark""",
    "history": """
  SELECT lpad(CAST(l_suppkey AS VARCHAR), 12, '0') AS uei, CAST(l_orderkey AS VARCHAR) AS award_number,
         l_extendedprice AS award_amount, CAST(l_shipdate AS DATE) AS start_date, n_name AS funding_agency,
         CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'Completed' WHEN 'AO' THEN 'Active' WHEN 'NF' THEN 'Ongoing'
              WHEN 'NO' THEN 'Terminated' ELSE 'Cancelled' END AS award_status,
         p_name AS title, p_type AS abstract, l_partkey AS partkey, l_linenumber AS linenumber, l_orderkey AS orderkey
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey
       JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""",
    "calls": """
  SELECT event_type AS api_source, value AS latency_ms, ts,
         CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 = 0 AS cache_hit,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 = 0 THEN NULL
              ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 <> 0 END AS success
  FROM events""",
    "status": """
  SELECT CAST(user_id AS VARCHAR) || '-' || CAST(event_id AS VARCHAR) AS award_id,
         CASE WHEN event_id % 3 = 0 THEN ['awardee', 'solicitation'] WHEN event_id % 3 = 1 THEN ['awardee'] ELSE ['program_office'] END AS enrichment_types,
         CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'pending' ELSE 'in_progress' END AS status,
         CAST(json_extract_string(props, '$.k') AS INTEGER) / 100.0 AS confidence_score, CAST(ts AS TIMESTAMP) AS last_updated,
         CASE event_type WHEN 'error' THEN 'code ' || CAST(user_id % 5 AS VARCHAR) END AS error_message
  FROM events""",
    "reviewer": """
  SELECT CAST(doc_id AS VARCHAR) AS award_id, CASE quality WHEN 1 THEN 'good' ELSE 'poor' END AS label FROM labels""",
    "predictions": """
  SELECT CAST(d.doc_id AS VARCHAR) AS award_id, CASE WHEN n_chars >= 800 THEN 'good' ELSE 'poor' END AS baseline,
         CASE WHEN n_chars >= 400 AND lang <> 'de' THEN 'good' WHEN source = 'src3' THEN 'other' ELSE 'poor' END AS enhanced
  FROM documents d""",
}
_NEEDS = {
    "award_text": ("awards",),
    "latest": ("assessments",),
    "classified": ("awards", "latest"),
    "classified_all": ("awards", "latest"),
    "open_queue": ("queue",),
    "merged": ("award_text", "latest", "taxonomy", "open_queue"),
}


def ctes(*names: str, filter_sql: str = FILTER_SQL) -> str:
    """``WITH`` clause that defines ``names`` and what they need."""
    done: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, ()):
            add(need)
        if name not in done:
            done.append(name)

    for n in names:
        add(n)
    body = ",\n".join(f"{n} AS ({_CTES[n].replace('{filter}', filter_sql).replace('{as_of}', AS_OF)})" for n in done)
    return f"WITH {body}\n"


def _area_of(index):
    return F.element_at(F.array(*[F.lit(a) for a in AREAS]), index + 1)


class Tables:
    """The test tables of one folder as DataFrames, raw and domain-shaped."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def lineitem(self) -> DataFrame:
        return spread(self.raw("lineitem"))

    @cached_property
    def documents(self) -> DataFrame:
        """Documents for text work, spread over the cores where they lie in few files."""
        return spread(self.raw("documents"))

    @cached_property
    def awards(self) -> DataFrame:
        first = F.substring("o_orderpriority", 1, 1)
        return (
            self.raw("orders")
            .join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("o_orderkey").cast("string").alias("award_id"),
                F.col("c_mktsegment").alias("agency"),
                F.concat(F.lit("REGION "), F.col("n_regionkey").cast("string")).alias("sub_agency"),
                F.concat_ws("-", F.substring("c_mktsegment", 1, 2), F.col("o_custkey") % 50).alias("topic_code"),
                F.when(first == "1", "I").when(first == "2", "II").when(first == "3", "III").otherwise("Other").alias("phase"),
                F.col("c_name").alias("firm_name"),
                F.col("n_name").alias("firm_city"),
                F.col("n_name").alias("firm_state"),
                F.col("o_totalprice").alias("award_amount"),
                F.col("o_orderdate").cast("date").alias("award_date"),
                F.year("o_orderdate").alias("fiscal_year"),
                (F.col("o_orderstatus") == "P").alias("is_export_controlled"),
                F.lpad(F.col("o_custkey").cast("string"), 12, "0").alias("awardee_uei"),
                F.concat(F.lit("Phase "), first, F.lit(" program")).alias("program"),
                F.col("o_custkey").alias("custkey"),
            )
        )

    @cached_property
    def award_text(self) -> DataFrame:
        docs = self.raw("documents").select(
            F.col("doc_id").cast("string").alias("award_id"), F.col("text").alias("abstract"),
            F.array("lang", "source").alias("keywords"),
        )
        return self.awards.join(docs, "award_id", "left")

    @cached_property
    def assessments(self) -> DataFrame:
        score = F.col("l_quantity") * 2
        return (
            self.lineitem
            .join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
            .select(
                F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                            F.col("l_extendedprice").cast("decimal(18,2)")).alias("assessment_id"),
                F.col("l_orderkey").cast("string").alias("award_id"),
                F.concat(F.lit("v"), F.col("l_linestatus")).alias("taxonomy_version"),
                score.alias("score"),
                band(score).alias("classification"),
                F.col("p_type").alias("primary_cet_id"),
                F.filter(
                    F.array(_area_of(F.col("p_size") % 6), _area_of((F.col("p_size") + F.col("l_linenumber")) % 6)),
                    lambda x: x != F.col("p_type"),
                ).alias("supporting_cet_ids"),
                F.when(F.col("l_returnflag") == "R", "manual_review").otherwise("automated").alias("generation_method"),
                F.col("l_shipdate").alias("assessed_at"),
            )
        )

    @cached_property
    def taxonomy(self) -> DataFrame:
        """One row per part type but one, so that a missing name is also met."""
        return (
            self.raw("part").where(F.col("p_type") != "STANDARD")
            .groupBy(F.col("p_type").alias("cet_id"))
            .agg(F.count_distinct("p_brand").alias("brands"))
            .select(
                "cet_id", F.initcap("cet_id").alias("name"),
                F.concat(F.lit("Parts of "), F.col("brands").cast("string"), F.lit(" brands")).alias("definition"),
                F.when(F.col("cet_id") == "PROMO", "ECONOMY").when(F.col("cet_id") == "SMALL", "MEDIUM").alias("parent_cet_id"),
            )
        )

    @cached_property
    def queue(self) -> DataFrame:
        first = F.substring("o_orderpriority", 1, 1)
        reason = F.element_at(
            F.array(*[F.lit(r) for r in ("missing_text", "low_confidence", "controlled_data", "conflict")]),
            (F.col("o_orderkey") % 4 + 1).cast("int"),
        )
        return self.raw("orders").where(F.col("o_orderstatus") == "O").select(
            F.concat(F.lit("q"), F.col("o_orderkey").cast("string")).alias("queue_id"),
            F.col("o_orderkey").cast("string").alias("award_id"),
            reason.alias("reason"),
            F.when(first == "1", "pending").when(first == "2", "in_review").when(first == "3", "resolved")
            .otherwise("escalated").alias("status"),
            F.col("o_orderdate").alias("opened_at"),
            F.date_add(F.col("o_orderdate").cast("date"), 90).alias("due_by"),
        )

    @cached_property
    def texts(self) -> DataFrame:
        return self.documents.select(
            F.col("doc_id").cast("string").alias("key"), "text", F.col("lang").alias("agency"), F.col("source").alias("branch")
        )

    @cached_property
    def cache(self) -> DataFrame:
        return self.raw("benchmark").select(
            F.when(F.col("item_id") % 2 == 0, "nih").otherwise("grants.gov").alias("api_source"),
            F.col("item_id").cast("string").alias("solicitation_id"), F.col("text").alias("description"),
            F.array(F.concat(F.lit("k"), (F.col("item_id") % 7).cast("string")), F.concat(F.lit("k"), (F.col("item_id") % 5).cast("string"))).alias("technical_keywords"),
            (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=F.col("item_id").cast("int"))).alias("retrieved_at"),
        )

    @cached_property
    def history(self) -> DataFrame:
        pair = F.concat("l_returnflag", "l_linestatus")
        # Orders find their agency before the lines come in. A task hashes its share of the parts and of the orders, of few short
        # columns, in place of sorting its share of the lines, which are many more.
        agencies = (
            self.raw("orders")
            .join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select("o_orderkey", "n_name")
        )
        return (
            self.lineitem
            .join(self.raw("part").hint("shuffle_hash"), F.col("l_partkey") == F.col("p_partkey"))
            .join(agencies.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                F.lpad(F.col("l_suppkey").cast("string"), 12, "0").alias("uei"),
                F.col("l_orderkey").cast("string").alias("award_number"),
                F.col("l_extendedprice").alias("award_amount"),
                F.col("l_shipdate").cast("date").alias("start_date"),
                F.col("n_name").alias("funding_agency"),
                F.when(pair == "AF", "Completed").when(pair == "AO", "Active").when(pair == "NF", "Ongoing")
                .when(pair == "NO", "Terminated").otherwise("Cancelled").alias("award_status"),
                F.col("p_name").alias("title"), F.col("p_type").alias("abstract"),
                F.col("l_partkey").alias("partkey"), F.col("l_linenumber").alias("linenumber"),
                F.col("l_orderkey").alias("orderkey"),
            )
        )

    @cached_property
    def calls(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        return self.raw("events").select(
            F.col("event_type").alias("api_source"), F.col("value").alias("latency_ms"), "ts",
            (k % 3 == 0).alias("cache_hit"), F.when(k % 3 != 0, k % 7 != 0).alias("success"),
        )

    @cached_property
    def status(self) -> DataFrame:
        e = F.col("event_id") % 3
        kind = F.col("event_type")
        return self.raw("events").select(
            F.concat_ws("-", "user_id", "event_id").alias("award_id"),
            F.when(e == 0, F.array(F.lit("awardee"), F.lit("solicitation"))).when(e == 1, F.array(F.lit("awardee")))
            .otherwise(F.array(F.lit("program_office"))).alias("enrichment_types"),
            F.when(kind.isin("purchase", "signup"), "completed").when(kind == "error", "failed")
            .when(kind == "view", "pending").otherwise("in_progress").alias("status"),
            (F.get_json_object("props", "$.k").cast("int") / F.lit(100.0)).alias("confidence_score"),
            F.col("ts").alias("last_updated"),
            F.when(kind == "error", F.concat(F.lit("code "), (F.col("user_id") % 5).cast("string"))).alias("error_message"),
        )

    @cached_property
    def reviewer(self) -> DataFrame:
        return self.raw("labels").select(
            F.col("doc_id").cast("string").alias("award_id"),
            F.when(F.col("quality") == 1, "good").otherwise("poor").alias("label"),
        )

    @cached_property
    def predictions(self) -> DataFrame:
        n = F.col("n_chars")
        return self.raw("documents").select(
            F.col("doc_id").cast("string").alias("award_id"),
            F.when(n >= 800, "good").otherwise("poor").alias("baseline"),
            F.when((n >= 400) & (F.col("lang") != "de"), "good").when(F.col("source") == "src3", "other")
            .otherwise("poor").alias("enhanced"),
        )
