"""Manifests observed by the write itself."""

from __future__ import annotations

from techfolio.operators import export as ex


def test_observed_manifest_equals_counts(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0, None), ("b", None, "x"), ("c", 3.0, "y")], "award_id string, score double, area string")
    path = str(tmp_path / "run")
    seen = ex.write_observed(rows, path, ["score", "area"], {"weight": "0.3"})
    want = ex.run_manifest(rows, ["score", "area"], {"weight": "0.3"})
    assert seen.collect() == want.collect() and seen.columns == want.columns
    assert sorted(spark.read.parquet(f"{path}/rows").collect()) == sorted(rows.collect())
    # a second run replaces the rows and adds its manifest
    ex.write_observed(rows.limit(0), path, ["score", "area"], {"weight": "0.4"})
    assert spark.read.parquet(f"{path}/rows").count() == 0
    kept = spark.read.schema(want.schema).json(f"{path}/manifests").orderBy("weight").collect()
    assert [r["row_count"] for r in kept] == [3, 0]
