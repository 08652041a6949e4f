"""Governed export: controlled awards out, weights per area, metadata record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .portfolio import Filters, classified, taxonomy_version


def controlled() -> Column:
    return F.coalesce(F.col("is_export_controlled"), F.lit(False))


def without_controlled(df: DataFrame) -> DataFrame:
    return df.where(~controlled())


def controlled_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(controlled()).alias("controlled_awards_excluded"))


def weights(df: DataFrame, cet_ids: Sequence[str], lone_primary: float = 1.0) -> DataFrame:
    """``weight_<area>`` per known area: 0.6 primary, 0.4 split over the supporting ones. An award without
    supporting areas gives its primary ``lone_primary``. A narrow projection; no pivot, no shuffle."""
    supporting = F.coalesce(F.col("supporting_cet_ids"), F.array().cast("array<string>"))
    n = F.size(supporting)
    columns = []
    for area in cet_ids:
        share = (
            F.when(F.array_contains(supporting, area), F.lit(0.4) / n)
            .when(F.col("primary_cet_id") == area, F.when(n > 0, 0.6).otherwise(lone_primary))
            .otherwise(0.0)
        )
        columns.append(share.alias(f"weight_{area}"))
    return df.select("*", *columns)


def build(
    awards: DataFrame, assessments: DataFrame, cet_ids: Sequence[str], filters: Filters, lone_primary: float = 1.0
) -> tuple[DataFrame, DataFrame]:
    """(rows, metadata): uncontrolled awards under the filters with weights, and a one-row record."""
    rows = classified(awards, assessments, filters)
    out = weights(without_controlled(rows), cet_ids, lone_primary)
    return out, metadata(rows)


def metadata(rows: DataFrame) -> DataFrame:
    """Excluded controlled awards, exported awards, taxonomy version in force ('unknown' if none).

    Counted per version first, so that one small table answers all three.
    """
    per_version = rows.groupBy("taxonomy_version").agg(
        F.count_if(controlled()).alias("out"), F.count_if(~controlled()).alias("kept")
    )
    named = F.when((F.col("kept") > 0) & F.col("taxonomy_version").isNotNull(), F.struct((-F.col("kept")).alias("k"), F.col("taxonomy_version").alias("v")))
    return per_version.agg(
        F.coalesce(F.sum("out"), F.lit(0)).alias("controlled_awards_excluded"),
        F.coalesce(F.sum("kept"), F.lit(0)).alias("exported_awards"),
        F.coalesce(F.min(named)["v"], F.lit("unknown")).alias("taxonomy_version"),
    ).withColumn("currency", F.lit("USD"))


def write(rows: DataFrame, record: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Result set as CSV or Parquet, the record beside it as JSON."""
    if fmt == "csv":
        plain = [F.to_json(c).alias(c) if kind.startswith(("array", "map", "struct")) else F.col(c) for c, kind in rows.dtypes]
        rows.select(*plain).write.mode("overwrite").csv(f"{path}/rows", header=True, quote='"', escape='"')
    elif fmt == "parquet":
        rows.write.mode("overwrite").parquet(f"{path}/rows")
    else:
        raise ValueError(f"unknown format: {fmt}")
    record.write.mode("overwrite").json(f"{path}/metadata")


def run_manifest(rows: DataFrame, score_columns: Sequence[str], parameters: dict[str, str]) -> DataFrame:
    """One row: row count, non-null count per score column, the run's parameters."""
    return rows.agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.count(c).alias(f"{c}_count") for c in score_columns],
        *[F.lit(v).alias(k) for k, v in parameters.items()],
    )


def write_observed(rows: DataFrame, path: str, score_columns: Sequence[str], parameters: dict[str, str]) -> DataFrame:
    """Write ``rows`` as Parquet and append the manifest of ``run_manifest`` beside them; the counts are observed by the write
    itself, so the rows are worked out once. Returns the manifest."""
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("row_count"), *[F.count(c).alias(f"{c}_count") for c in score_columns]]
    rows.observe(seen, *counts).write.mode("overwrite").parquet(f"{path}/rows")
    values = {"row_count": 0} | {f"{c}_count": 0 for c in score_columns} | seen.get
    names = ["row_count", *[f"{c}_count" for c in score_columns], *parameters]
    schema = ", ".join(f"`{n}` {'string' if n in parameters else 'long'}" for n in names)
    manifest = rows.sparkSession.createDataFrame([tuple((values | parameters)[n] for n in names)], schema)
    append_manifest(manifest, f"{path}/manifests")
    return manifest


def append_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("append").json(path)


__all__ = ["append_manifest", "build", "controlled_count", "metadata", "run_manifest", "taxonomy_version", "weights", "without_controlled", "write", "write_observed"]
