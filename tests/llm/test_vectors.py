"""Pruned graphs against brute force, odd vectors included."""

from __future__ import annotations

import numpy as np

from techfolio.llm import vectors


def planted(rng, n=900, d=24):
    x = rng.normal(size=(n, d))
    for k in range(0, 200, 4):  # small groups
        x[k + 1 : k + 4] = x[k] + rng.normal(size=(3, d)) * 0.08
    x[300:420] = x[300] + rng.normal(size=(120, d)) * 0.05  # a dense one
    x[500] = x[501]  # equal vectors
    x[502] = x[501]
    return x.astype(np.float32)


def truth(x, ids, least=0.95):
    u = vectors.unit(x)
    s = u @ u.T >= least
    root = ids.copy()
    a, b = np.nonzero(s)
    while True:
        before = root.copy()
        np.minimum.at(root, a, before[b])
        if (root == before).all():
            return s.sum(1) - 1, root


def test_links_and_components(spark):
    rng = np.random.default_rng(1)
    x = planted(rng)
    ids = np.arange(len(x)) * 3 + 7
    odd = [(1, None), (2, []), (3, [0.0] * 24), (4, [float("nan")] * 24), (5, [1.0] * 3), (6, [None] + [1.0] * 23), (None, x[0].tolist()), (8, [float("inf")] * 24)]
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)] + odd
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS label", "2 AS vec", "3 AS x")
    for shard_size in (300, 60):
        got = {r["vec_id"]: r for r in vectors.near_duplicates(table, shard_size=shard_size).collect()}
        links, root = truth(x, ids)
        assert len(got) == len(rows)
        found = np.array([got[int(i)]["n_links"] for i in ids])
        assert (found <= links).all() and found.sum() >= 0.95 * links.sum()
        assert np.mean([got[int(i)]["component_id"] == r for i, r in zip(ids, root, strict=True)]) > 0.97
        for i, _ in odd:
            assert got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] == (i is not None)


def test_empty_and_tiny_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.near_duplicates(empty).count() == 0
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (2, [1.0, 0.1])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in vectors.near_duplicates(two).collect()) == [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False)]


def test_isolated_pairs_beside_a_hot_spot(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 64))
    x[:300] = x[0] + rng.normal(size=(300, 64)) * 0.05
    u = vectors.unit(x)
    for k in range(400, 560, 2):  # pairs at a cosine of 0.955
        side = rng.normal(size=64)
        side -= side @ u[k] * u[k]
        x[k + 1] = 0.955 * u[k] + np.sqrt(1 - 0.955**2) * side / np.linalg.norm(side)
    x = x.astype(np.float32)
    ids = np.arange(len(x))
    table = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_duplicates(table, shard_size=60).collect()}
    links, _ = truth(x, ids)
    few = [i for i in ids if 0 < links[i] <= 8]
    assert len(few) >= 160 and np.mean([got[int(i)] == links[i] for i in few]) >= 0.93


def test_audit_sees_rare_links_and_does_not_pool(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 32))
    x[1], x[3] = x[0] + 0.01, x[2] + 0.01  # two pairs
    reps = lambda x: spark.createDataFrame([(k, v.astype(np.float32).tobytes(), 1) for k, v in enumerate(x)], "vec long, x binary, copies long")
    true, measured = vectors.true_links(reps(x), 0.95)
    assert true == {0: 1, 1: 1, 2: 1, 3: 1} and measured
    none = spark.createDataFrame([], "vec long, links long")
    assert vectors.audit(true, none) == 0.0
    rare, measured = vectors.true_links(reps(x), 0.95, queries=16, most=64)
    assert len(rare) < 4 and not measured
    # all links of a hot spot and none of the pairs
    x[100:400] = x[100] + rng.normal(size=(300, 32)) * 0.02
    true, measured = vectors.true_links(reps(x), 0.95, linked=3000)
    hot = spark.createDataFrame([(k, 299) for k in range(100, 400)], "vec long, links long")
    assert measured and len(true) == 304 and vectors.audit(true, hot) == 0.0
