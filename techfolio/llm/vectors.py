"""Near-duplicate vectors by robust-pruned flat graphs on overlapping cluster shards.

Vectors are normalised, equal ones reduced to one, and each is assigned to its nearest centroids, so neighbours share a
shard although clusters have borders. Every shard builds a flat graph: robust pruning keeps, among a vector's nearest
and some random candidates, those that no kept neighbour is closer to. The adjacency lists that a vector has in its
shards are united; each shard then searches its united graph from its medoids for every member: greedily to the nearest
vectors, then on through all that lie within the range. Hits are verified in double precision. An audit compares
queries with brute force over all vectors, more and more until enough of them are linked; while recall is too low the
overlap is doubled. Where links are too rare to be met within 16,384 queries of a larger table, recall counts as not
measured: a warning says so, and the overlap is 8 at least.

A shard is bounded: a cluster above ``shard_size`` is dealt into parts, and each pair of parts is a shard. A pair that
several shards hold is counted by the first of them, so counts need no list of pairs.

Defined results: null, empty, zero and non-finite vectors, and those whose length is not the table's most frequent one,
link with nothing; rows with equal vectors link with each other; a null vec_id has no component and is not kept; an
empty table gives no rows; labels and other columns are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

log = logging.getLogger(__name__)

#: Rows of the sample that centroids are learned from; every row is assigned to them afterwards.
SAMPLE = 16384
#: Linked queries that the audit of the recall takes, and the number of links that are few.
LINKED, FEW = 256, 8
#: Least overlap where the audit saw too few linked queries to measure a recall.
UNMEASURED = 8


def unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def learn_centroids(x: np.ndarray, k: int, *, rounds: int = 6, apart: float = 0.8) -> np.ndarray:
    """Spherical k-means; of centroids closer than ``apart`` one is kept, so a dense spot is not cut into cells."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for r in range(rounds):
        kept: list[int] = []
        close = centres @ centres.T > apart
        for j in range(len(centres)):
            if not close[j, kept].any():
                kept.append(j)
        centres = centres[kept]
        if r == rounds - 1:
            break
        nearest = np.concatenate([(x[low : low + 4096] @ centres.T).argmax(1) for low in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centres)
    return centres


def robust_prune(x: np.ndarray, *, degree: int = 24, near: int = 64, far: int = 16, alpha: float = 1.2, seed: int = 7) -> np.ndarray:
    """Flat graph of unit vectors: up to ``degree`` neighbours each, padded with -1. All vectors are pruned at once."""
    n = len(x)
    near = min(near, n - 1)
    if near <= 0:
        return np.full((n, 1), -1)
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    nearest = np.argpartition(-sims, near - 1, axis=1)[:, :near]
    wide = np.random.default_rng(seed).integers(0, n, (n, far))
    candidates = np.concatenate((nearest, wide), 1)
    order = np.argsort(-np.take_along_axis(sims, candidates, 1), axis=1, kind="stable")
    candidates = np.take_along_axis(candidates, order, 1)
    distance = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(sims, candidates, 1)))
    open_ = candidates != np.arange(n)[:, None]
    out = np.full((n, degree), -1)
    rows = np.arange(n)
    for r in range(degree):
        first = open_.argmax(1)
        live = open_[rows, first]
        chosen = candidates[rows, first]
        out[live, r] = chosen[live]
        # a candidate goes when the chosen neighbour is clearly closer to it than the vector itself
        between = np.sqrt(np.maximum(0, 2 - 2 * np.maximum(sims[chosen[:, None], candidates], -1)))
        open_ &= ~((alpha * between <= distance) & live[:, None])
        open_[rows, first] = False
        open_ &= candidates != chosen[:, None]
    return out


def medoids(x: np.ndarray, count: int = 12) -> np.ndarray:
    """The vector nearest to the mean, then those farthest from the ones taken so far."""
    first = int((x @ x.mean(0)).argmax())
    taken, best = [first], x @ x[first]
    for _ in range(min(count, len(x)) - 1):
        nxt = int(best.argmin())
        taken.append(nxt)
        best = np.maximum(best, x @ x[nxt])
    return np.unique(taken)


def range_search(x: np.ndarray, graph: list[np.ndarray], least: float, *, beam: int = 24, slack: float = 0.08) -> tuple[np.ndarray, np.ndarray]:
    """(query, hit) for every vector as a query, similarity at least ``least`` in single precision.

    All queries walk together: each step expands every query's best unexpanded vector among its ``beam`` best, until
    none is left; then everything found within ``least - slack`` is expanded until no more is found there.
    """
    n = len(x)
    width = max(1, max(len(g) for g in graph))
    table = np.full((n, width), -1)
    for j, g in enumerate(graph):
        table[j, : len(g)] = g
    hits: list[np.ndarray] = []
    starts = medoids(x)
    for low in range(0, n, 512):
        q = np.arange(low, min(low + 512, n))
        m = len(q)
        sims = np.full((m, n), -2.0, np.float32)  # -2: not visited
        expanded = np.zeros((m, n), bool)
        sims[:, starts] = x[q] @ x[starts].T

        def visit(rows: np.ndarray, nodes: np.ndarray, q=q, sims=sims) -> None:
            """Similarities of the unvisited neighbours of (row, node)."""
            for part in range(0, len(rows), 4096):
                r = np.repeat(rows[part : part + 4096], width)
                to = table[nodes[part : part + 4096]].ravel()
                fresh = to >= 0
                r, to = r[fresh], to[fresh]
                fresh = sims[r, to] == -2
                both = np.unique(r[fresh] * n + to[fresh])
                r, to = both // n, both % n
                for k in range(0, len(r), 1 << 16):
                    a, b = r[k : k + (1 << 16)], to[k : k + (1 << 16)]
                    sims[a, b] = np.einsum("ij,ij->i", x[q[a]], x[b])

        keep = min(beam, n)
        live = np.arange(m)
        while len(live):
            top = np.argpartition(-sims[live], keep - 1, axis=1)[:, :keep]
            value = np.where(expanded[live[:, None], top], -3, sims[live[:, None], top])
            best = value.argmax(1)
            going = value[np.arange(len(live)), best] > -2
            live, nodes = live[going], top[np.arange(len(top)), best][going]
            expanded[live, nodes] = True
            visit(live, nodes)
        while True:
            rows, nodes = np.nonzero((sims >= least - slack) & ~expanded)
            if not len(rows):
                break
            expanded[rows, nodes] = True
            visit(rows, nodes)
        rows, nodes = np.nonzero(sims >= least - 1e-4)
        hits.append(np.stack((q[rows], nodes)))
    query, hit = np.concatenate(hits, 1)
    return query, hit


def _shards(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[int, list[tuple]]]:
    """(shard, rows) from batches that are sorted by shard."""
    shard, rows = None, []
    for batch in batches:
        for at, *row in zip(*[batch.column(c).to_pylist() for c in columns], strict=True):
            if at != shard:
                if rows:
                    yield shard, rows
                shard, rows = at, []
            rows.append(tuple(row))
    if rows:
        yield shard, rows


def _decode(rows: list[tuple]) -> np.ndarray:
    return unit(np.stack([np.frombuffer(r[1], np.float32) for r in rows]))


def _assigned(reps: DataFrame, centres: np.ndarray, overlap: int, shard_size: int) -> DataFrame:
    """(shard, vec, x, copies, shards): every vector in the shards of its nearest ``overlap`` centroids."""
    shared = reps.sparkSession.sparkContext.broadcast(centres)  # at most SAMPLE / 4 centroids

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(np.stack([np.frombuffer(v, np.float32) for v in batch.column("x").to_pylist()]))
            count = min(overlap, len(c))
            top = np.sort(np.argpartition(-(x @ c.T), count - 1, axis=1)[:, :count], 1)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in ("vec", "x", "copies")], pa.array(top.tolist(), pa.list_(pa.int32()))], ["vec", "x", "copies", "clusters"])

    rows = reps.mapInArrow(nearest, "vec long, x binary, copies long, clusters array<int>")
    # parts of half a shard; counted first, cluster by cluster, with at most as many rows as there are centroids
    sizes = {r["cluster"]: r["n"] for r in rows.select(F.explode("clusters").alias("cluster")).groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    parts = {c: -(-n * 2 // shard_size) if n > shard_size else 1 for c, n in sizes.items()}
    names = rows.sparkSession.sparkContext.broadcast(parts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = names.value
        for batch in batches:
            vecs = batch.column("vec").to_pylist()
            lists = []
            for vec, clusters in zip(vecs, batch.column("clusters").to_pylist(), strict=True):
                mine = []
                for c in clusters:
                    own = int(common.mix(np.array([vec], np.int64).view(np.uint64))[0] % np.uint64(p[c]))
                    # a pair of parts (i, j), i <= j, is a shard; the pair of a part with itself lies in the others
                    others = range(p[c]) if p[c] > 1 else (0,)
                    mine += [(c << 32) + (min(own, j) << 16) + max(own, j) for j in others if j != own or p[c] == 1]
                lists.append(mine)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in ("vec", "x", "copies")], pa.array(lists, pa.list_(pa.int64()))], ["vec", "x", "copies", "shards"])

    dealt = rows.mapInArrow(deal, "vec long, x binary, copies long, shards array<long>")
    return dealt.select(F.explode("shards").alias("shard"), "vec", "x", "copies", "shards")


def _adjacency(members: DataFrame) -> DataFrame:
    """(vec, near): neighbours of every vector in the graphs of all its shards, and those it is a neighbour of."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _shards(batches, ["shard", "vec", "x"]):
            graph = robust_prune(_decode(rows))
            names = np.array([r[0] for r in rows], np.int64)
            a, k = np.nonzero(graph >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(names[a]), pa.array(names[graph[a, k]])], ["vec", "to"])

    sorted_ = members.select("shard", "vec", "x").repartition("shard").sortWithinPartitions("shard", "vec")
    edges = sorted_.mapInArrow(build, "vec long, to long")
    # a list holds the degree times the number of the vector's shards, at most
    return edges.groupBy("vec").agg(F.collect_set("to").alias("near"))


def _owned(pairs_a, pairs_b, rows, shard):
    """Pairs for which ``shard`` is the first that holds both."""
    kinds: dict[tuple, int] = {}
    kind = np.array([kinds.setdefault(tuple(r[3]), len(kinds)) for r in rows])
    lists = list(kinds)
    code = kind[pairs_a].astype(np.int64) * len(lists) + kind[pairs_b]
    own = {int(c): min(set(lists[c // len(lists)]) & set(lists[c % len(lists)])) == shard for c in np.unique(code)}
    return np.fromiter((own[int(c)] for c in code), bool, len(code)) if len(code) else np.zeros(0, bool)


def _searched(members: DataFrame, adjacency: DataFrame, least: float) -> DataFrame:
    """(vec, links, least_neighbour) per vector and shard: copies linked in pairs that this shard owns, and the smallest
    vector reachable by links inside the shard."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _shards(batches, ["shard", "vec", "x", "copies", "shards", "near"]):
            if len(rows) < 2:
                continue
            x = _decode(rows)
            names = np.array([r[0] for r in rows], np.int64)
            place = {v: k for k, v in enumerate(names.tolist())}
            graph: list[set[int]] = [set() for _ in rows]
            for k, r in enumerate(rows):
                for to in r[4] or ():
                    if (j := place.get(to)) is not None and j != k:
                        graph[k].add(j)
                        graph[j].add(k)
            a, b = range_search(x.astype(np.float32), [np.fromiter(g, np.int64, len(g)) for g in graph], least)
            # both directions of what was found, once, verified in double precision
            code = np.unique(np.minimum(a, b) * len(rows) + np.maximum(a, b))
            a, b = code // len(rows), code % len(rows)
            a, b = a[a != b], b[a != b]
            good = np.zeros(len(a), bool)
            for low in range(0, len(a), 1 << 16):
                s = slice(low, low + (1 << 16))
                good[s] = np.einsum("ij,ij->i", x[a[s]], x[b[s]]) >= least
            a, b = a[good], b[good]
            root = names.copy()
            while len(a):
                before = root.copy()
                np.minimum.at(root, a, before[b])
                np.minimum.at(root, b, before[a])
                if (root == before).all():
                    break
            mine = _owned(a, b, [(r[0], r[1], r[2], r[3]) for r in rows], shard)
            copies = np.array([r[2] for r in rows], np.int64)
            links = np.zeros(len(rows), np.int64)
            np.add.at(links, a[mine], copies[b[mine]])
            np.add.at(links, b[mine], copies[a[mine]])
            some = np.flatnonzero((links > 0) | (root != names))
            yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(links[some]), pa.array(root[some])], ["vec", "links", "least"])

    full = members.join(adjacency, "vec", "left").repartition("shard").sortWithinPartitions("shard", "vec")
    return full.select("shard", "vec", "x", "copies", "shards", "near").mapInArrow(search, "vec long, links long, least long")


def true_links(reps: DataFrame, least: float, *, queries: int = 256, linked: int = LINKED, most: int = SAMPLE) -> tuple[dict[int, int], bool]:
    """(vector: number of its links) for the linked ones of a sample by hash, and whether that is a measure of the table.

    The queries are compared with every vector, block by block. The sample is made four times as large until it has
    ``linked`` linked queries, all vectors, or ``most``. It is no measure if it ends with fewer and is not the table.
    """
    spark = reps.sparkSession
    sample = reps.withColumn("h", F.xxhash64("vec")).orderBy("h", "vec").limit(most + 1).select("vec", "x").collect()
    whole, sample = len(sample) <= most, sample[:most]
    true: dict[int, int] = {}
    done, upto = 0, queries
    while done < len(sample) and len(true) < linked:
        part = sample[done:upto]
        shared = spark.sparkContext.broadcast((np.array([r["vec"] for r in part], np.int64), unit(np.stack([np.frombuffer(r["x"], np.float32) for r in part]))))

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            total = np.zeros(len(ids), np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                vec, copies = batch.column("vec").to_numpy(), batch.column("copies").to_numpy()
                x = unit(np.stack([np.frombuffer(v, np.float32) for v in batch.column("x").to_pylist()]))
                for low in range(0, len(ids), 512):
                    s = slice(low, low + 512)
                    row, query = np.nonzero(x @ q[s].T >= least)
                    other = vec[row] != ids[s][query]
                    np.add.at(total[s], query[other], copies[row[other]])
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(total[some])], ["vec", "n"])

        true |= {r["vec"]: r["n"] for r in reps.select("vec", "x", "copies").mapInArrow(count, "vec long, n long").groupBy("vec").agg(F.sum("n").alias("n")).collect()}
        done, upto = upto, upto * 4
    return true, len(true) >= linked or (whole and done >= len(sample))


def audit(true: dict[int, int], found: DataFrame) -> float:
    """Mean share of its links that ``found`` (vec, links) has of a query of ``true``: the lower one of the mean of the
    queries with at most ``FEW`` links and that of the others, so that a hot spot does not outweigh isolated pairs. 1 if
    there are no queries."""
    if not true:
        return 1.0
    wanted = found.sparkSession.createDataFrame([(int(v),) for v in true], "vec long")
    got = {r["vec"]: r["links"] for r in found.join(F.broadcast(wanted), "vec").select("vec", "links").collect()}
    shares = {few: [min(got.get(v, 0), n) / n for v, n in true.items() if (n <= FEW) == few] for few in (True, False)}
    return min(float(np.mean(each)) for each in shares.values() if each)


def near_duplicates(table: DataFrame, *, least: float = 0.95, overlap: int = 2, shard_size: int = 1500, recall: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``table`` (vec_id, embedding)."""
    from ..session import ensure_checkpoint_dir

    spark = table.sparkSession
    ensure_checkpoint_dir(spark)
    rows = table.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
    # a vector can be compared if it is finite, not zero, and of the table's usual length
    usable = "vec_id IS NOT NULL AND size(embedding) > 0 AND forall(embedding, e -> e IS NOT NULL AND NOT isnan(e) AND abs(e) < double('infinity')) AND exists(embedding, e -> e <> 0)"
    lengths = rows.filter(usable).groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    length = lengths[0]["d"] if lengths else 0
    good = rows.filter(usable).filter(F.size("embedding") == length)
    reps = good.groupBy("embedding").agg(F.min("vec_id").alias("vec"), F.count("*").alias("copies"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(batch.num_rows, -1) if batch.num_rows else np.empty((0, 1), np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("vec"), pa.array([v.tobytes() for v in x], pa.binary()), batch.column("copies")], ["vec", "x", "copies"])

    # a zero by underflow of its squares cannot be normalised either
    packed = reps.mapInArrow(pack, "vec long, x binary, copies long").checkpoint()
    total = packed.count()
    sample = [r["x"] for r in packed.withColumn("h", F.xxhash64("vec")).orderBy("h").limit(SAMPLE).select("x").collect()]
    if total:
        centres = learn_centroids(unit(np.stack([np.frombuffer(v, np.float32) for v in sample])), max(1, min(SAMPLE // 4, -(-total * 2 // shard_size))))
        true, measured = true_links(packed, least)
        if not measured:
            log.warning("recall of vector links is judged by %d linked queries among %d only: overlap is at least %d", len(true), SAMPLE, UNMEASURED)
            overlap = max(overlap, UNMEASURED)
        while True:
            members = _assigned(packed, centres, overlap, shard_size).checkpoint()
            found = _searched(members, _adjacency(members), least).checkpoint()
            links = found.groupBy("vec").agg(F.sum("links").alias("links")).checkpoint()
            if audit(true, links) >= recall or overlap >= len(centres):
                break
            overlap *= 2
        joined = common.components(found.filter("vec <> least").select(F.col("vec").alias("a"), F.col("least").alias("b")))
    else:
        links = spark.createDataFrame([], "vec long, links long")
        joined = spark.createDataFrame([], "node long, component long")
    each = packed.select("vec", "copies").join(links, "vec", "left").join(joined.withColumnRenamed("node", "vec"), "vec", "left")
    each = each.select("vec", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "vec").alias("component_id"))
    # back from distinct vectors to rows
    named = reps.select("embedding", "vec").join(each, "vec").withColumnRenamed("embedding", "_embedding")
    linked = good.join(named, F.col("embedding") == F.col("_embedding")).select("vec_id", "n_links", "component_id")
    apart = rows.filter(f"NOT coalesce(({usable}) AND size(embedding) = {length}, false)").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(apart).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
