from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

WORDS = "stone river window garden letter summer silver morning yellow market thunder paper candle forest winter bridge".split()


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents table from {id: text} or [(id, text)], with extra columns whose names clash with the operators' own."""

    def make(texts, lang="en"):
        rows = texts.items() if isinstance(texts, dict) else texts
        df = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in rows], DOCS)
        return df.selectExpr("*", "1 AS row", "'x' AS score", "2 AS k", "3 AS items", "4 AS first", "5 AS candidates", "6 AS `in0`")

    return make


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}
