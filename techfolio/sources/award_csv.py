"""Award CSV sources: all columns as text, header aliases, required columns."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fx
from . import csv_records


def read_csv_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every column as string; records may hold line breaks inside quotes. Large files are split over many tasks."""
    raw = csv_records.read(spark, path)
    return raw.select([F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in raw.columns])


def column_aliases(columns: Sequence[str]) -> dict[str, str]:
    """Header to canonical name: first alias wins, a canonical column already there is never replaced."""
    taken = set(columns)
    out: dict[str, str] = {}
    for column in columns:
        canonical = fx.COLUMN_ALIASES.get(column.lower().strip())
        if canonical and canonical not in taken:
            out[column] = canonical
            taken.add(canonical)
    return out


def canonical_columns(df: DataFrame) -> DataFrame:
    names = column_aliases(df.columns)
    return df.select([F.col(f"`{c}`").alias(names.get(c, c).lower()) for c in df.columns])


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df


def read_award_csv(spark: SparkSession, path: str | list[str], required: Iterable[str] = fx.BOOTSTRAP_REQUIRED) -> DataFrame:
    return require_columns(canonical_columns(read_csv_text(spark, path)), required)


def read_yearly_csv(spark: SparkSession, directory: str) -> DataFrame:
    """Unpacked yearly archive: the twelve fixed columns under their canonical names."""
    raw = require_columns(read_csv_text(spark, f"{directory.rstrip('/')}/*.csv"), fx.YEARLY_REQUIRED)
    return raw.withColumnsRenamed(
        {"agency_code": "agency", "bureau_code": "sub_agency", "firm": "firm_name", "award_year": "award_date"}
    )
