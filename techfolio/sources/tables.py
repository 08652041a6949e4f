"""Stored tables: partitions, upsert, append, delete, reads, conformance, map columns.

A rewritten table goes to a new folder (or a partition overwrite); nothing is read and written in place.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import STORED


def write_partitions(df: DataFrame, path: str, partition: str = "fiscal_year") -> None:
    """Replace only the partitions present in ``df``."""
    (
        df.write.partitionBy(partition)
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "snappy")
        .mode("overwrite")
        .parquet(path)
    )


def read_partition(spark: SparkSession, path: str, value: object, columns: Sequence[str] | None = None,
                   partition: str = "fiscal_year") -> DataFrame:
    df = spark.read.parquet(path).where(F.col(partition) == F.lit(value))
    return df.select(*columns) if columns else df


def list_partitions(spark: SparkSession, path: str, partition: str = "fiscal_year") -> DataFrame:
    return spark.read.parquet(path).select(partition).distinct()


# --- taxonomy --------------------------------------------------------------------------------
def latest_version(taxonomy: DataFrame) -> DataFrame:
    """Rows of the highest version by string order. One row per version crosses the join."""
    newest = taxonomy.agg(F.max("version").alias("version"))
    return taxonomy.join(newest, "version", "left_semi")


def taxonomy_versions(taxonomy: DataFrame) -> DataFrame:
    return taxonomy.select("version").distinct()


def save_taxonomy(df: DataFrame, path: str, existing: DataFrame | None = None) -> None:
    """Append new versions; a version that is already stored is refused."""
    if existing is not None:
        clash = df.select("version").distinct().join(existing.select("version"), "version", "left_semi")
        if not clash.isEmpty():
            raise ValueError("taxonomy version exists already")
    df.write.partitionBy("version").mode("append").parquet(path)


# --- keyed changes ---------------------------------------------------------------------------
def append(existing: DataFrame, batch: DataFrame) -> DataFrame:
    return existing.unionByName(batch)


def upsert(existing: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the batch replace rows with the same key."""
    return existing.join(batch.select(*keys), list(keys), "left_anti").unionByName(batch)


def delete_keys(existing: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return existing.join(keys.select(*on), list(on), "left_anti")


def count_deleted(existing: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return existing.join(keys.select(*on), list(on), "left_semi").agg(F.count(F.lit(1)).alias("deleted"))


def _purge_predicate(source: str | None, solicitation_id: str | None, start: str | None, end: str | None) -> Column:
    tests = []
    if source is not None:
        tests.append(F.col("api_source") == source)
    if solicitation_id is not None:
        tests.append(F.col("solicitation_id") == solicitation_id)
    if start is not None:
        tests.append(F.col("retrieved_at") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        tests.append(F.col("retrieved_at") <= F.lit(end).cast("timestamp_ntz"))
    if not tests:
        raise ValueError("name a source, an id or a date bound")
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def purge(cache: DataFrame, source: str | None = None, solicitation_id: str | None = None,
          start: str | None = None, end: str | None = None) -> DataFrame:
    """Cache without the rows that meet every given test; both date bounds are inclusive."""
    return cache.where(~_purge_predicate(source, solicitation_id, start, end))


def count_purged(cache: DataFrame, **tests: str) -> DataFrame:
    bounds = {"source": None, "solicitation_id": None, "start": None, "end": None, **tests}
    return cache.where(_purge_predicate(**bounds)).agg(F.count(F.lit(1)).alias("removed"))


# --- reads -----------------------------------------------------------------------------------
def read_where(df: DataFrame, filters: Mapping[str, object] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Equality filters (a list means IN), then the named columns."""
    for column, value in (filters or {}).items():
        test = F.col(column).isin(list(value)) if isinstance(value, list | tuple | set) else F.col(column) == F.lit(value)
        df = df.where(test)
    return df.select(*columns) if columns else df


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    parts = [
        df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
        for name, df in sorted(tables.items())
    ]
    return reduce(DataFrame.unionByName, parts)


# --- conformance -----------------------------------------------------------------------------
def detect_table(columns: Sequence[str]) -> str | None:
    """Stored table whose columns are all present; the one with most columns when several fit."""
    fits = [(len(s.fieldNames()), name) for name, s in STORED.items() if set(s.fieldNames()) <= set(columns)]
    return max(fits)[1] if fits else None


def conformance(df: DataFrame, schema: T.StructType) -> DataFrame:
    """One row per column of either side: expected and actual type, status, nulls among all rows."""
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    expected = {f.name: f.dataType.simpleString() for f in schema.fields}
    names = sorted(set(actual) | set(expected))

    def status(name: str) -> str:
        if name not in actual:
            return "missing"
        if name not in expected:
            return "extra"
        return "ok" if actual[name] == expected[name] else "type_mismatch"

    rows = [
        F.struct(
            F.lit(n).alias("column_name"),
            F.lit(expected.get(n)).cast("string").alias("expected_type"),
            F.lit(actual.get(n)).cast("string").alias("actual_type"),
            F.lit(status(n)).alias("status"),
            (F.col(f"nulls.{n}") if n in actual else F.lit(None)).cast("bigint").alias("null_count"),
            F.col("total").alias("row_count"),
        )
        for n in names
    ]
    counted = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.struct(*[F.count_if(F.col(c).isNull()).alias(c) for c in actual]).alias("nulls"),
    )
    return counted.select(F.inline(F.array(*rows)))


# --- map columns at the storage edge ---------------------------------------------------------
def map_to_json(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.to_json(F.col(column)))


def json_to_map(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.from_json(F.col(column), "map<string,double>"))
