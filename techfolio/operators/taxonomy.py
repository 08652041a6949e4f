"""Taxonomy: hierarchy, version diff, area names for id lists, re-assessment."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_parent(taxonomy: DataFrame) -> DataFrame:
    """Each area with the name of its parent area, where it has one."""
    parent = taxonomy.select(F.col("cet_id").alias("parent_cet_id"), F.col("name").alias("parent_name"))
    return taxonomy.join(parent, "parent_cet_id", "left")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Areas added, removed, or modified in name or definition between two versions."""
    o = old.select("cet_id", F.struct("name", "definition").alias("old"))
    n = new.select("cet_id", F.struct("name", "definition").alias("new"))
    change = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "removed")
        .when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    )
    return o.join(n, "cet_id", "full_outer").select("cet_id", change.alias("change")).where(F.col("change").isNotNull())


def with_supporting_names(df: DataFrame, taxonomy: DataFrame, column: str = "supporting_cet_ids") -> DataFrame:
    """``supporting_names``: area names of an id list, ids without a name kept, nulls left out.

    The names depend on the list alone, and lists are few: each distinct one is named once and joined back.
    """
    names = taxonomy.select(F.col("cet_id").alias("__id"), F.col("name").alias("__name"))
    lists = df.select(F.col(column).alias("__list")).where(F.col("__list").isNotNull()).distinct()
    each = lists.select("__list", F.posexplode_outer("__list").alias("__pos", "__id")).join(names, "__id", "left")
    shown = F.struct("__pos", F.coalesce("__name", "__id").alias("name"))
    named = each.groupBy("__list").agg(F.array_sort(F.collect_list(F.when(F.col("__id").isNotNull(), shown))).alias("__named"))
    named = named.select("__list", F.transform("__named", lambda x: x["name"]).alias("supporting_names"))
    return df.join(named, F.col(column) == F.col("__list"), "left").drop("__list")


def reassess(
    awards: DataFrame,
    version: str,
    scorer: Callable[[DataFrame], DataFrame],
    assessed_at: Column,
    years: tuple[int, int] | None = None,
) -> DataFrame:
    """Assessments of the awards under a new version. ``scorer`` gives (award_id, primary_cet_id, score,
    classification, supporting_cet_ids); the result is appended to the stored assessments."""
    if years is not None:
        awards = awards.where(F.col("fiscal_year").between(*years))
    return scorer(awards).select(
        F.sha2(F.concat_ws("|", F.lit(version), F.col("award_id")), 256).alias("assessment_id"),
        "award_id",
        F.lit(version).alias("taxonomy_version"),
        "score",
        "classification",
        "primary_cet_id",
        "supporting_cet_ids",
        F.lit("automated").alias("generation_method"),
        assessed_at.alias("assessed_at"),
    )


def reassessment_manifest(previous_latest: DataFrame, fresh: DataFrame, changes: DataFrame) -> DataFrame:
    """One row: awards processed, affected (all of them if the taxonomy changed at all), primary area changed,
    and the number of added, removed and modified areas."""
    before = previous_latest.select("award_id", F.col("primary_cet_id").alias("__before"))
    moved = fresh.select("award_id", "primary_cet_id").join(before, "award_id", "left")
    counted = moved.agg(
        F.count(F.lit(1)).alias("awards_processed"),
        F.count_if(~F.col("primary_cet_id").eqNullSafe(F.col("__before"))).alias("primary_changed"),
    ).withColumn("k", F.lit(0))
    edits = changes.agg(
        *[F.count_if(F.col("change") == c).alias(f"areas_{c}") for c in ("added", "removed", "modified")]
    ).withColumn("k", F.lit(0))
    changed = reduce(lambda a, b: a + b, [F.col(f"areas_{c}") for c in ("added", "removed", "modified")])
    return (
        counted.join(edits, "k")
        .withColumn("awards_affected", F.when(changed > 0, F.col("awards_processed")).otherwise(0))
        .drop("k")
    )
