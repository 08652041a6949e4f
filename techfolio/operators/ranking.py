"""Keyed ranking helpers shared by the other operators."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.literals import constant


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """First ``k`` rows per key.

    ``row_number() <= k`` lets Spark cut every map-side partition to k rows per key before the shuffle
    (WindowGroupLimit), so a key that holds a third of all rows does not travel whole.
    """
    column = rank or "__rank"
    ranked = df.withColumn(column, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    ranked = ranked.where(F.col(column) <= k)
    return ranked if rank else ranked.drop(column)


def _cell_of(value: Column, cuts: Column, many: int) -> Column:
    """Number of ``cuts`` (ascending) below the value, found in two steps of about the square root of their number."""
    step = max(1, math.isqrt(many))
    marks = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(cuts)), F.lit(step)), lambda i: F.get(cuts, i - 1))
    whole = F.greatest(F.lit(0), (F.size(F.filter(marks, lambda c: c < value)) - 1) * step)
    return whole + F.size(F.filter(F.slice(cuts, whole + 1, F.lit(step)), lambda c: c < value))


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], buckets: int = 256, levels: int = 1) -> DataFrame:
    """Linear-interpolated percentiles per key without gathering a key's values in one task.

    Equal values are counted first. A quantile sketch of each key's distinct values gives cut points, so that a cell between
    two of them holds about one in ``buckets`` of the values however they are spread; exact counts tell which
    cells hold the wanted ranks. Their values are cut again for each further one of ``levels``, then ordered: a task
    orders about one in ``buckets ** levels`` of a key's distinct values. The sketch only chooses the cuts, results are
    exact. One column per name in ``probs``; null values are ignored, keys without values give no row.
    """
    keys = list(keys)
    # One struct as group key: null key values then meet each other in the joins below.
    group = F.struct(*keys) if keys else F.lit(0)
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(group.alias("g"), F.col(value).cast("double").alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = counted.groupBy("g").agg(F.sum("n").alias("total"))
    wanted = F.array(*[F.least(F.floor((F.col("total") - 1) * F.lit(float(p))) + step, F.col("total") - 1) for p in probs.values() for step in (0, 1)])
    placed = counted.join(total, "g").withColumn("before", F.lit(0).cast("bigint"))
    path = ["g"]
    for level in range(levels):
        cell = f"cell{level}"
        shares = constant([k / buckets for k in range(1, buckets)])
        cuts = placed.groupBy(*path).agg(F.percentile_approx("v", shares, 10 * buckets).alias("cuts"))
        celled = placed.join(cuts, path).withColumn(cell, _cell_of(F.col("v"), F.col("cuts"), buckets)).drop("cuts")
        running = Window.partitionBy(*path).orderBy(cell).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        by_cell = celled.groupBy(*path, cell).agg(F.sum("n").alias("inside"), F.max("total").alias("total"), F.max("before").alias("before"))
        by_cell = by_cell.withColumn("upto", F.col("before") + F.sum("inside").over(running))
        start = F.col("upto") - F.col("inside")
        hits = by_cell.where(F.exists(wanted, lambda r: (r >= start) & (r < F.col("upto")))).select(*path, cell, start.alias("before"))
        path = [*path, cell]
        placed = celled.drop("before").join(hits, path)
    ordered = Window.partitionBy(*path).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("upto", F.col("before") + F.sum("n").over(ordered))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("upto") - F.col("n")) & (rank < F.col("upto")), F.col("v")))

    picks = []
    for name, p in probs.items():
        position = (F.col("total") - 1) * F.lit(float(p))
        low = F.floor(position)
        high = F.least(low + 1, F.col("total") - 1)
        picks += [at(low).alias(f"{name}__a"), at(high).alias(f"{name}__b"), F.max(position - low).alias(f"{name}__f")]
    found = placed.groupBy("g").agg(*picks)
    return found.select(
        *[F.col(f"g.{k}").alias(k) for k in keys],
        *[
            (F.col(f"{n}__a") + (F.col(f"{n}__b") - F.col(f"{n}__a")) * F.col(f"{n}__f")).alias(n)
            for n in probs
        ],
    )
