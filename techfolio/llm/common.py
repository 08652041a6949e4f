"""Helpers shared by the operators: row-wise Arrow maps, word hashes, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes hashed at once; a longer text goes block by block, cut at white space.
HASH_BLOCK = 4 << 20


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once per application, as ``--py-files`` would.

    Functions reach the workers by the name of their module, and a worker has no other way to a package that is
    neither installed on every node nor in its working directory.
    """
    context = spark.sparkContext
    if getattr(context, "_techfolio_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="py-files-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._techfolio_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(col), F.lit(""))


def crc_remainder(col: str, modulus: int) -> Column:
    """crc32 of the value written as text, modulo ``modulus``; null stays null."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % modulus


def hash_sample(rows: DataFrame, by: str, per_value: int, key: str = "doc_id") -> DataFrame:
    """The ``per_value`` rows of each value of ``by`` with the smallest hash ``h`` of ``key``, numbered ``n`` from 1.

    Counts per value come first; then a hash threshold leaves about twice the rows wanted of each value, so ordering
    them takes no more rows for a value that most of the table has.
    """
    from pyspark.sql import Window

    counts = {r[by]: r["count"] for r in rows.groupBy(by).count().collect()}
    space = 1 << 40
    share = F.lit(0)
    for value, count in sorted(counts.items(), key=lambda x: str(x[0])):
        share = F.when(F.col(by) == F.lit(value), min(space, 2 * (per_value + 50) * space // count)).otherwise(share)
    hashed = rows.withColumn("h", F.pmod(F.xxhash64(key), F.lit(space))).filter(F.col("h") < share)
    order = Window.partitionBy(by).orderBy("h", key)
    return hashed.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_value)


def give_back() -> None:
    """Return free memory of this process to the system. Spark keeps Python workers for later tasks, and what their
    allocators hold on to is missing for others on the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library, which has no such call


def returning_memory(run: Callable) -> Callable:
    """``run`` (batches to batches), with the free memory given back at the end of the task."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def map_rows(df: DataFrame, per_row: Callable, columns: list[str], schema: str, setup: Callable | None = None) -> DataFrame:
    """Apply ``per_row(*values) -> iterable of tuples`` to each row of ``df``, in Arrow batches inside the tasks.

    ``columns`` are the inputs in order. ``setup()`` runs once per task and its value comes first among the arguments.
    Rows are taken one after the other: a task holds one batch and its output, whatever the size of the table.
    """
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    parsed = StructType.fromDDL(schema)
    arrow = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = (setup(),) if setup else ()
        for batch in batches:
            inputs = [batch.column(c) for c in columns]
            for low in range(0, batch.num_rows, 1000):
                values = [x.slice(low, 1000).to_pylist() for x in inputs]
                rows = [out for row in zip(*values, strict=True) for out in per_row(*first, *row)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return df.select(*columns).mapInArrow(returning_memory(run), parsed)


def with_results(df: DataFrame, per_row: Callable, columns: list[str], schema: str, setup: Callable | None = None) -> DataFrame:
    """``df`` as one struct column ``row`` beside the columns of ``schema``, one result of ``per_row`` for each row.

    Like ``map_rows``, but the rows travel along untouched, so nothing has to be joined back and the names of their
    columns cannot clash with the results'. ``per_row`` yields one tuple.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    results = StructType.fromDDL(schema)
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[F.col(f"`{c}`").alias(f"in{k}") for k, c in enumerate(columns)])
    arrow = to_arrow_schema(results)
    out = StructType([whole.schema["row"], *results.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = (setup(),) if setup else ()
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                values = [x.to_pylist() for x in part.columns[1:]]
                rows = [next(iter(per_row(*first, *row))) for row in zip(*values, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)]], ["row", *arrow.names])

    return whole.mapInArrow(returning_memory(run), out)


def unpacked(df: DataFrame, names: list[str]) -> DataFrame:
    """The rows that ``with_results`` carried along, with their own columns."""
    return df.select(*[F.col("row").getField(c).alias(c) for c in names])


_POWER = np.uint64(0x9E3779B97F4A7C15)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of an odd number modulo 2**64 and of its inverse, kept for the next text."""
    if len(_POWERS["up"]) <= n:
        size = 1 << int(n + 1).bit_length()
        inverse = np.uint64(pow(int(_POWER), -1, 1 << 64))
        for key, base in (("up", _POWER), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _block_hashes(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    word = ~_SPACE[b]
    if not word.any():
        return np.empty(0, np.uint64)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers(len(b))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTES[b] * up[: len(b)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hash of every word (run without ASCII white space) of UTF-8 ``data``, in order; equal words, equal hashes."""
    if len(data) <= HASH_BLOCK:
        return _block_hashes(data)
    out, low = [], 0
    while low < len(data):
        high = low + HASH_BLOCK
        while high < len(data) and not _SPACE[data[high]]:
            high += 1
        out.append(_block_hashes(data[low:high]))
        low = high
    return np.concatenate(out)


_LANES = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words; empty when there are fewer words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = words[:n] * _LANES[0]
    for k in range(1, size):
        total = total + mix(words[k : k + n] + _LANES[k]) * _LANES[k]
    return mix(total)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list: one row (node, component) per node with an edge.

    ``component`` is the smallest node of the component. Alternates the large-star and small-star steps, which halve
    paths and need only grouped minima and one equi-join each; node ids never leave the executors. Each round is cut
    by checkpoint(), so that a lost executor costs one round. Loops and repeated or null edges are ignored; an empty
    list gives no rows. Raises if ``rounds`` do not suffice (they grow with the logarithm of the longest path).
    """
    from ..session import ensure_checkpoint_dir

    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    pair = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v")
    # every edge points from its larger to its smaller node
    pair = pair.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    before = None
    for _ in range(rounds):
        both = pair.union(pair.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pair = low.select("u", F.col("m").alias("v")).union(moved).filter("u <> v").distinct().checkpoint()
        # a forest of stars keeps its edges; sums tell whether anything moved
        now = pair.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle; raise rounds")
    roots = pair.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return pair.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
