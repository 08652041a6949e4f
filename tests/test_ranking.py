"""Exact percentiles against a sort, with outliers, ties and nulls, and how even their cells are."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from techfolio.operators import ranking

PROBS = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "least": 0.0, "most": 1.0}


@pytest.mark.parametrize("cells,levels", [(256, 1), (4, 1), (4, 3), (16, 2)])
def test_equals_a_sort(spark, cells, levels):
    rng = random.Random(cells)
    rows = [("a", rng.gauss(0, 1)) for _ in range(400)] + [("a", 1e12)] + [("b", float(rng.randint(0, 3))) for _ in range(200)]
    rows += [("c", 7.0), (None, 1.0), (None, 2.0), ("d", None)] + [("e", -1e300), ("e", 1e300)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in ranking.exact_percentiles(df, ["k"], "v", PROBS, buckets=cells, levels=levels).collect()}
    assert set(got) == {"a", "b", "c", "e", None}
    for key in got:
        values = [v for k, v in rows if k == key]
        for name, p in PROBS.items():
            assert got[key][name] == pytest.approx(float(np.percentile(values, 100 * p)), rel=1e-12), (key, name)
    assert ranking.exact_percentiles(df, [], "v", {"m": 0.5}, buckets=cells, levels=levels).count() == 1
    assert ranking.exact_percentiles(df.limit(0), ["k"], "v", PROBS).count() == 0


def test_an_outlier_leaves_the_cells_even(spark):
    df = spark.range(100_000).select(F.when(F.col("id") == 5, 1e12).otherwise(F.rand(3) * 1000).alias("v"))
    cuts = df.agg(F.percentile_approx("v", [k / 64 for k in range(1, 64)], 640).alias("cuts"))
    sizes = [r["count"] for r in df.crossJoin(cuts).groupBy(ranking._cell_of(F.col("v"), F.col("cuts"), 64).alias("c")).count().collect()]
    # each about one in 64
    assert len(sizes) == 64 and max(sizes) < 100_000 * 0.02
