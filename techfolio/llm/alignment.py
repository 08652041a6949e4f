"""Alignment of two tokenizers' tokens over the same bytes, by lockstep merging.

Tokenizer A is byte-level BPE (a ``tokenizers`` file), B a SentencePiece model; both encode a space and the text. Whole
batches of documents are merged at once: a NumPy state vector holds, for every document of the batch (and every
``LANE`` tokens of a long one), a pointer to a token of A and one to a token of B. Each step emits the link of the two
tokens under the pointers and, where both end at the same byte, a cut; it then advances the pointer whose token ends
first, or both, and compacts away the lanes that are finished. The cuts divide a document into groups.

How often each pair of ids is linked in the whole corpus is counted in Spark from the distinct pairs of every document,
which are written to the shared folder once. The counts go back to the documents by a broadcast while there are at most
``pair_limit`` of them, and by a join beyond that, with equal results.

Long texts are cut at single spaces between other characters: a space starts a token there in both tokenizers, so a piece
without its space is a text of its own. Tokens of a document may thus pass through several batches.

Defined results: null and empty texts, and texts whose tokens don't spell a space and the text (``▁`` in the text, where B
reads a space), have no tokens: zeros and an empty digest. Repeated rows and null ids give a row each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Tokens of A that one lane merges.
LANE = 256
#: Characters after which a text is cut, and characters of a batch.
PIECE = 1 << 16
BATCH = 1 << 20
#: Distinct pairs of ids that are broadcast at most: 12 bytes each.
PAIR_LIMIT = 4_000_000
#: Pairs that a task counts before it hands them on.
HELD = 1 << 20
_EDGE = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")
FACTS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes for themselves, the others in
    order from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Pair:
    """Both tokenizers, the bytes of their tokens, and tables for writing groups."""

    def __init__(self, a_path: str, b_path: str, pattern: str):
        import tiktoken
        from sentencepiece import SentencePieceProcessor

        with open(a_path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = byte_alphabet()
        added = {x["content"] for x in spec["added_tokens"] if x["special"]}
        vocabulary = {name: k for name, k in spec["model"]["vocab"].items() if name not in added}
        order = [vocabulary["".join(m)] if not isinstance(m, str) else vocabulary[m.replace(" ", "", 1)] for m in spec["model"]["merges"]]
        kind = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or kind.get("type") != "ByteLevel" or kind["add_prefix_space"] or not kind["use_regex"] or order != sorted(set(order)):
            raise ValueError("A must be plain byte-level BPE with ids in the order of its merges")
        # ids in the order of the merges are ranks, so the faster library gives the same ids
        ranks = {bytes(alphabet[c] for c in name): k for name, k in vocabulary.items()}
        self.encoding = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, k in ranks.items():
            self.a_bytes[k] = token
        self.pieces = SentencePieceProcessor(model_file=b_path)
        size = self.pieces.get_piece_size()
        names = [self.pieces.id_to_piece(k) for k in range(size)]
        self.b_bytes = [bytes([int(name[1:-1], 16)]) if self.pieces.is_byte(k) else b"" if self.pieces.is_control(k) or self.pieces.is_unknown(k) else name.replace("▁", " ").encode() for k, name in enumerate(names)]
        # a text may be cut before a space if no piece of B has one after another character
        self.cuttable = not any(re.search("[^▁]▁", name) for name in names)
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.ids_b = size
        # entry 2 k + 1: the last token of its group
        self.written = [f"{k}{mark}" for k in range(len(self.a_bytes)) for mark in ",|"]
        self.b_from = len(self.written)
        self.written += [f"{k}{mark}" for k in range(size) for mark in ",;"]

    def cut(self, text: str) -> list[str]:
        """Pieces of about ``PIECE`` characters that are encoded each on its own; the spaces between them are left out."""
        parts, low = [], 0
        while self.cuttable and len(text) - low > PIECE and (edge := _EDGE.search(text, low + PIECE)):
            parts.append(text[low : edge.start()])
            low = edge.end()
        return [*parts, text[low:]]

    def encode(self, parts: list[str]) -> Iterator[tuple[list[int], list[int], bool]]:
        """Ids of a space and each part by A and B, and whether both spell it."""
        for part, b in zip(parts, self.pieces.encode(parts, num_threads=1), strict=True):
            a, want = self.encoding.encode_ordinary(" " + part), b" " + part.encode()
            yield a, b, b"".join(map(self.a_bytes.__getitem__, a)) == want == b"".join(map(self.b_bytes.__getitem__, b))


_PAIRS: dict[tuple, Pair] = {}


def pair(a_path: str | Callable[[], str], b_path: str | Callable[[], str], pattern: str) -> Pair:
    """The worker's tokenizers of these files; functions name the files on the worker's own machine."""
    key = (a_path() if callable(a_path) else a_path, b_path() if callable(b_path) else b_path, pattern)
    if key not in _PAIRS:
        _PAIRS[key] = Pair(*key)
    return _PAIRS[key]


def lockstep(a_sizes: np.ndarray, b_sizes: np.ndarray, documents: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (indices of A, indices of B) and cuts (indices of the last token of A and of B before each).

    ``a_sizes`` and ``b_sizes`` are the tokens' bytes, document after document; ``documents`` is the index of each
    document's first token of A. Both tokenizers have equal bytes for every document.
    """
    a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
    stops = np.append(documents[1:], len(a_ends))
    counts = -(-(stops - documents) // lane)
    first = np.repeat(documents, counts)
    a = first + (np.arange(len(first)) - np.repeat(np.cumsum(counts) - counts, counts)) * lane
    stop = np.minimum(a + lane, np.repeat(stops, counts))
    # a lane starts where its token of A does, inside the token of B that covers this byte
    b = np.searchsorted(b_ends, a_ends[a] - a_sizes[a], side="right")
    links_a, links_b, cuts_a, cuts_b = [], [], [], []
    while len(a):
        a_end, b_end = a_ends[a], b_ends[b]
        links_a.append(a)
        links_b.append(b)
        both = a_end == b_end
        cuts_a.append(a[both])
        cuts_b.append(b[both])
        a, b = a + (a_end <= b_end), b + (b_end <= a_end)
        going = a < stop
        if not going.all():
            a, b, stop = a[going], b[going], stop[going]
    none = [np.empty(0, np.int64)]
    return tuple(np.concatenate(x or none) for x in (links_a, links_b, cuts_a, cuts_b))


def packed(codes: np.ndarray) -> bytes:
    """Ascending 32-bit numbers as their differences, byte plane after byte plane, which compresses well."""
    steps = np.diff(codes, prepend=0).astype("<u4")
    return steps.view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.int64)


class Documents:
    """Facts of documents whose parts come batch after batch."""

    def __init__(self, tokenizers: Pair):
        self.t = tokenizers
        self.waiting: list[tuple[int, str, bool]] = []  # number, part, last
        self.chars = 0
        self.open: dict[int, dict] = {}

    def add(self, number: int, key: tuple, text: str) -> Iterator[tuple]:
        self.open[number] = {"key": key, "sums": np.zeros(4, np.int64), "sha": hashlib.sha256(), "pairs": [], "times": [], "spelled": bool(text)}
        parts = self.t.cut(text) if text else [""]
        for k, part in enumerate(parts):
            self.waiting.append((number, part, k == len(parts) - 1))
            self.chars += len(part) + 50
            if self.chars >= BATCH:
                yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        t, batch = self.t, self.waiting
        self.waiting, self.chars = [], 0
        wanted = [(n, part) for n, part, _ in batch if self.open[n]["spelled"]]
        encoded: dict[int, list] = {}
        for (n, _), (a, b, spelled) in zip(wanted, t.encode([part for _, part in wanted]) if wanted else (), strict=True):
            self.open[n]["spelled"] &= spelled
            encoded.setdefault(n, []).append((a, b))
        encoded = {n: parts for n, parts in encoded.items() if self.open[n]["spelled"]}
        if encoded:
            self._merge(encoded)
        for n, _, last in batch:
            if last:
                yield self._closed(self.open.pop(n))

    def _merge(self, encoded: dict[int, list]) -> None:
        t, numbers = self.t, list(encoded)
        lists_a, lists_b = ([[k for part in encoded[n] for k in part[side]] for n in numbers] for side in (0, 1))
        ids_a, ids_b = (np.concatenate([np.array(x, np.int64) for x in lists]) for lists in (lists_a, lists_b))
        from_a, from_b = (np.concatenate(([0], np.cumsum([len(x) for x in lists]))) for lists in (lists_a, lists_b))
        links_a, links_b, cuts_a, cuts_b = lockstep(t.a_sizes[ids_a], t.b_sizes[ids_b], from_a[:-1])
        cuts_a, cuts_b = np.sort(cuts_a), np.sort(cuts_b)
        last_a, last_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
        last_a[cuts_a], last_b[cuts_b] = True, True
        # tokens in the order of the groups, those of A before those of B in each
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        order = np.empty(len(ids_a) + len(ids_b), np.int64)
        order[np.arange(len(ids_a)) + np.concatenate(([0], cuts_b + 1))[group_a]] = 2 * ids_a + last_a
        order[np.arange(len(ids_b)) + cuts_a[group_b] + 1] = t.b_from + 2 * ids_b + last_b
        of_link = np.searchsorted(from_a, links_a, side="right") - 1
        space = len(t.a_bytes) * t.ids_b
        codes, times = np.unique(of_link * space + ids_b[links_b] * len(t.a_bytes) + ids_a[links_a], return_counts=True)
        edges = np.searchsorted(codes, np.arange(len(numbers) + 1) * space)
        groups = np.searchsorted(cuts_a, from_a)
        n_links = np.bincount(of_link, minlength=len(numbers))
        names = t.written
        for k, n in enumerate(numbers):
            doc = self.open[n]
            listed = "".join(map(names.__getitem__, order[from_a[k] + from_b[k] : from_a[k + 1] + from_b[k + 1]].tolist()))
            doc["sha"].update((";" * bool(doc["pairs"]) + listed[:-1]).encode())
            doc["sums"] += (from_a[k + 1] - from_a[k], from_b[k + 1] - from_b[k], groups[k + 1] - groups[k], n_links[k])
            doc["pairs"].append(codes[edges[k] : edges[k + 1]] - k * space)
            doc["times"].append(times[edges[k] : edges[k + 1]])

    def _closed(self, doc: dict) -> tuple:
        if not doc["spelled"] or not doc["pairs"]:
            return (*doc["key"], 0, 0, 0, 0, "", b"", b"")
        codes, times = doc["pairs"][0], doc["times"][0]
        if len(doc["pairs"]) > 1:
            codes, at = np.unique(np.concatenate(doc["pairs"]), return_inverse=True)
            times = np.bincount(at, np.concatenate(doc["times"])).astype(np.int64)
        times_bytes = np.minimum(times, 255).astype(np.uint8).tobytes() + times[times >= 255].astype("<i8").tobytes()
        return (*doc["key"], *map(int, doc["sums"]), doc["sha"].hexdigest(), packed(codes), times_bytes)


def pairs_of(pairs: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pair codes (id of B times the number of ids of A, plus the id of A) and how often each is linked."""
    codes = unpacked(pairs)
    n = np.frombuffer(times, np.uint8, len(codes)).astype(np.int64)
    n[n == 255] = np.frombuffer(times, "<i8", offset=len(codes))
    return codes, n


def aligned(docs: DataFrame, a_path, b_path, pattern: str) -> DataFrame:
    """One row of ``FACTS`` for each of ``docs`` (doc_id, text); ``row`` numbers the rows. A narrow map."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(FACTS)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, number = Documents(pair(a_path, b_path, pattern)), 0
        shaped = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
        done: list[tuple] = []
        for batch in batches:
            for row, doc_id, text in zip(*[batch.column(k) for k in range(3)], strict=True):
                done += work.add(number, (row.as_py(), doc_id.as_py()), text.as_py() or "")
                number += 1
                if len(done) >= 500:
                    yield shaped(done)
                    done = []
        done += work.flush()
        if done:
            yield shaped(done)

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def pair_counts(facts: DataFrame) -> DataFrame:
    """(code, n): how often each pair of ids is linked in the corpus. Tasks hand on sums of at most ``HELD`` pairs and more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            codes, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            return codes, np.bincount(at, np.concatenate([n for _, n in held]), len(codes)).astype(np.int64)

        def rows(codes, n):
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], ["code", "n"])

        for batch in batches:
            for pairs, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append(pairs_of(pairs, times))
                size += len(held[-1][0])
                if size > 2 * HELD:
                    held = [summed()]
                    size = len(held[0][0])
                    if size > HELD:
                        yield rows(*held[0])
                        held, size = [], 0
        if held:
            yield rows(*summed())

    return facts.filter("n_links > 0").select("pairs", "times").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, a_path, b_path, pattern: str, *, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs`` (doc_id, text)."""
    from ..session import scratch_path

    spark = docs.sparkSession
    path = scratch_path(spark, "aligned")
    aligned(docs, a_path, b_path, pattern).write.option("compression", "zstd").parquet(f"{path}/facts")
    facts = spark.read.parquet(f"{path}/facts")
    pair_counts(facts).write.parquet(f"{path}/counts")
    counts = spark.read.parquet(f"{path}/counts")
    ids_a = len(pair(a_path, b_path, pattern).a_bytes)
    b = F.expr(f"code div {ids_a}")
    # at most one row for each id of B
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    judged = counts.withColumn("b", b).join(most, "b").select("code", "n", (F.col("n") == F.col("most")).alias("best"))
    plain = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    if counts.count() <= pair_limit:
        table = judged.sort("code").toArrow()
        shared = spark.sparkContext.broadcast(tuple(table.column(k).to_numpy() for k in range(3)))

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes, n, best = shared.value
            for batch in batches:
                bests, sums = [], []
                for pairs, times in zip(batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True):
                    own, k = pairs_of(pairs, times)
                    at = np.searchsorted(codes, own)
                    bests.append(int(k[best[at]].sum()))
                    sums.append(int((k * n[at]).sum()))
                kept = [batch.column(c) for c in range(6)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(bests, pa.int64()), pa.array(sums, pa.int64())], [*plain, "groups_sha256", "n_best", "count_sum"])

        found = facts.select(*plain, "groups_sha256", "pairs", "times").mapInArrow(look_up, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    else:

        def listed(row, pairs, times):
            codes, k = pairs_of(pairs, times)
            return zip([row] * len(codes), codes.tolist(), k.tolist(), strict=True)

        linked = common.map_rows(facts.filter("n_links > 0"), listed, ["row", "pairs", "times"], "row long, code long, k long").join(judged, "code")
        sums = linked.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("n_best"), F.sum(F.col("k") * F.col("n")).alias("count_sum"))
        found = facts.drop("pairs", "times").join(sums, "row", "left").fillna(0, ["n_best", "count_sum"])
    return found.select(*plain, "n_best", "count_sum", "groups_sha256")
