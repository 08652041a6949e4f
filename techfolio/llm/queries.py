"""The named queries of this subpackage: thin digests of the operators, with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, common, html_main, langid, lexical, licenses, ngram_join, packing, pieces, quality_zstd, rules_learn, secrets, vectors

def tokenizer_file(name: str) -> str:
    """Place of a vocabulary of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        common.ship(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


@_query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(common.table(spark, sf_dir, "documents"))
    rows = found.withColumn("base", secrets.listed(secrets.KINDS[:3])).withColumn("every", secrets.listed())
    counts = {f"n_{kind}": F.size(kind).cast("long") for kind in secrets.KINDS}
    digest = F.sha2(secrets.written(F.col("base")), 256)
    return rows.withColumns(counts).select("doc_id", "n_assign", "n_access", "n_hex", digest.alias("base_sha256"), secrets.written(F.col("every")).alias("spans"), "n_random")


@_query
def op2_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(common.table(spark, sf_dir, "pages"))


@_query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    return bpe.digests(common.table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), PATTERN)


@_query
def op4_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(common.table(spark, sf_dir, "embeddings"))


ORACLES["op4_pruned_graph"] = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
r(n, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.n),
m AS (SELECT n AS vec_id, min(c) AS component_id FROM r GROUP BY 1),
k AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(k.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN m USING (vec_id) LEFT JOIN k USING (vec_id)"""


@_query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held_out = common.crc_remainder("doc_id", 3) == 1
    found = langid.predict(docs, langid.learn(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "mixture")


@_query
def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(common.table(spark, sf_dir, "documents"))


ORACLES["op6_ngram_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
k AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r(d, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.d),
m AS (SELECT d AS doc_id, min(c) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)"""


@_query
def op7_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    held_out = common.crc_remainder("doc_id", 5) == 0
    scored = quality_zstd.score(docs, quality_zstd.learn(docs, labels, ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@_query
def op8_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(common.table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["label"], x["first_word"], x["last_word"], x["edits"])), ",")
    return found.withColumn("spans", spans).drop("found")


@_query
def op9_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenised(common.table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return packing.packed(pieces)


@_query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    judged = rules_learn.judge(rules_learn.statistics(docs), rules_learn.learn(docs, labels))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("rule").cast("long").alias("rule"))


@_query
def op11_best_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


ORACLES["op11_best_position"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
f AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY 1, 2),
k AS (SELECT t, CAST(floor(1000 * ln((2 * g.n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, g WHERE t IN (SELECT t FROM q) GROUP BY t, g.n),
m AS (SELECT r, doc_id, 50 + (50 * len(w) * g.n) // g.l AS m FROM d, g WHERE len(w) > 0),
s AS (SELECT item_id, r, doc_id, CAST(sum(k.w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM q JOIN k USING (t) JOIN f USING (t) JOIN m USING (r) GROUP BY 1, 2, 3),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS INT) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 50"""


@_query
def op12_piece_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(common.table(spark, sf_dir, "documents"), lambda: tokenizer_file("piece_bpe_32k.model"))


@_query
def op13_lockstep_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    a, b = (lambda: tokenizer_file("byte_bpe_50k.json")), (lambda: tokenizer_file("piece_bpe_32k.model"))
    return alignment.align(common.table(spark, sf_dir, "documents"), a, b, PATTERN)
