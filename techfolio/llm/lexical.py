"""Ranked lexical search by the Best Position Algorithm.

One pass over the documents writes, for every document, its number of terms and the frequencies of those terms that some
query has; counts over it give the corpus statistics. Each task then takes its share of that table in blocks, sorts the
postings of every term into an impact list, and answers all queries: lists are read from the first position not yet seen;
every new document is scored at once by direct access to its other impacts, and the positions found there count as
seen too. The best position of a list is the end of its unbroken run of seen positions; no unseen document can have
more than the sum of the impacts behind the best positions, so a search stops when that sum is strictly below the kth score
(equal scores still compete by id). The kth score carries over from block to block. The tasks' best ``k`` are ranked by a
window that keeps ``k`` rows of each query before the shuffle.

Queries are taken in blocks of bounded size, so what is broadcast does not grow with their table.

Defined results: null and empty texts have no terms and are never found; an item without terms has no rows; rows that
share an id count each on their own, null ids rank last among equal scores; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Queries, and characters of queries, of one block.
ITEMS, ITEM_CHARS = 2_000, 4 << 20
#: Postings of one block of documents.
POSTINGS = 1_000_000
#: Bytes of a text that are split at once.
TEXT_BLOCK = 4 << 20
#: Positions that are read in a round at first; the number doubles round by round.
STRIP = 32
_TERM_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, block by block: runs of ASCII letters, digits and all characters beyond ASCII; A-Z lower-cased."""
    data = text.encode().translate(_TERM_BYTES)
    low = 0
    while low < len(data):
        high = low + TEXT_BLOCK
        if high < len(data):
            high = data.find(b" ", high)
            high = len(data) if high < 0 else high
        yield data[low:high].split()
        low = high


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


class Block:
    """Impact lists of some documents: postings by term, highest impact first, and by document."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int):
        """``doc`` ascends. Postings without impact must not be among them."""
        self.term, self.impact, self.n_docs, self.n_terms = term, impact, n_docs, n_terms
        self.of_doc = np.searchsorted(doc, np.arange(n_docs + 1))
        order = np.lexsort((-impact, term))
        self.list_doc, self.list_impact = doc[order], impact[order]
        self.edges = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order)) - self.edges[term[order]]

    def search(self, query: np.ndarray, k: int, floor: float, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores) among which are all of this block's best ``k`` that reach ``floor``, and the number of
        documents scored. ``slots``: -1 for every term; it is used and given back so."""
        lists = [(int(self.edges[t]), int(self.edges[t + 1])) for t in query]
        used = [(t, low, high) for t, (low, high) in zip(query, lists, strict=True) if high > low]
        bases = np.cumsum([0, *[high - low for _, low, high in used]])
        seen = np.zeros(bases[-1], bool)
        best = [0] * len(used)  # positions before this one are all seen
        known = np.zeros(self.n_docs, bool)
        slots[[t for t, _, _ in used]] = np.arange(len(used))
        docs, scores, strip = [np.empty(0, np.int64)], [np.empty(0, np.int64)], STRIP
        top = np.empty(0, np.int64)
        while True:
            unread = [(low + b, min(low + b + strip, high)) for (_, low, high), b in zip(used, best, strict=True) if low + b < high]
            bound = sum(int(self.list_impact[at]) for at, _ in unread)
            kth = int(top[0]) if len(top) == k else 0
            if not unread or bound < max(kth, floor):
                break
            fresh = np.unique(np.concatenate([self.list_doc[a:b] for a, b in unread]))
            fresh = fresh[~known[fresh]]
            if len(fresh):
                known[fresh] = True
                low, size = self.of_doc[fresh], self.of_doc[fresh + 1] - self.of_doc[fresh]
                ends = np.cumsum(size)
                at = np.repeat(low - (ends - size), size) + np.arange(ends[-1])
                slot = slots[self.term[at]]
                mine = slot >= 0
                owner = np.repeat(np.arange(len(fresh)), size)[mine]
                at, slot = at[mine], slot[mine]
                seen[bases[slot] + self.place[at]] = True
                # sums stay far below 2**53, so they are exact
                found = np.bincount(owner, self.impact[at], len(fresh)).astype(np.int64)
                docs.append(fresh)
                scores.append(found)
                top = np.concatenate((top, found))
                if len(top) > k:
                    top = np.partition(top, len(top) - k)[-k:]
                if len(top) == k:
                    top[[0, np.argmin(top)]] = top[[np.argmin(top), 0]]
            for j, (_, low, high) in enumerate(used):
                rest = seen[bases[j] + best[j] : bases[j + 1]]
                if len(rest):
                    gap = int(np.argmin(rest))
                    best[j] += gap if not rest[gap] else len(rest)
            strip *= 2
        slots[[t for t, _, _ in used]] = -1
        return np.concatenate(docs), np.concatenate(scores), int(known.sum())


def best_rows(scores: np.ndarray, ids: list, k: int) -> list[tuple[int, int | None]]:
    """The ``k`` best (score, id): highest scores first, then smallest ids, null ids last."""
    rows = sorted(zip((-scores).tolist(), [x is None for x in ids], [0 if x is None else x for x in ids], strict=True))
    return [(-s, None if null else x) for s, null, x in rows[:k]]


def search(docs: DataFrame, items: DataFrame, *, k: int = 50, item_block: int = ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best of ``docs`` (doc_id, text) for each row of ``items`` (item_id, text)."""
    sizes = items.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    blocks = max(1, -(-sizes["n"] // item_block), -(-(sizes["chars"] or 0) // ITEM_CHARS))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    found = None
    for b in range(blocks):
        # at most about item_block rows: rows are dealt to the blocks by hash
        rows = items.filter(part == b).select(F.col("item_id").cast("long").alias("item_id"), "text").collect()
        one = _search_block(docs, [(r["item_id"], r["text"] or "") for r in rows], k)
        found = one if found is None else found.unionByName(one)
    return found


def _search_block(docs: DataFrame, items: list[tuple[int | None, str]], k: int) -> DataFrame:
    from ..session import scratch_path

    spark = docs.sparkSession
    item_terms = [sorted({t for block in terms(text) for t in block}) for _, text in items]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*item_terms)))}
    known = spark.sparkContext.broadcast(vocabulary)

    def count(number, doc_id, text):
        tf: Counter = Counter()
        n = 0
        for block in terms(text or ""):
            n += len(block)
            tf.update(map(number.get, block))
        tf.pop(None, None)
        if n:
            ids = np.array(sorted(tf), np.int32)
            yield doc_id, n, ids.tobytes(), np.array([tf[i] for i in ids.tolist()], np.int64).tobytes()

    path = scratch_path(spark, "postings")
    counted = common.map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), count, ["doc_id", "text"], "doc_id long, n long, terms binary, tfs binary", setup=lambda: known.value)
    counted.write.parquet(path)
    index = spark.read.parquet(path)
    totals = index.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    n_docs, n_terms = totals["n"], totals["l"]

    def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(known.value), np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32), minlength=len(df))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["term", "df"])

    # at most one row for each term of this block of items
    df = np.zeros(len(vocabulary), np.int64)
    for r in index.select("terms").mapInArrow(holding, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    queries = [np.array([vocabulary[t] for t in own if df[vocabulary[t]]], np.int64) for own in item_terms]
    shared = spark.sparkContext.broadcast((weights(df, n_docs), queries, [item_id for item_id, _ in items]))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, asked, item_ids = shared.value
        slots = np.full(len(weight), -1, np.int64)
        best: list[list[tuple[int, int | None]]] = [[] for _ in asked]
        for ids, n, term, tf, size in _doc_blocks(batches):
            m = 50 + (50 * n * n_docs) // n_terms
            doc = np.repeat(np.arange(len(ids)), size)
            impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
            some = impact > 0
            block = Block(doc[some], term[some], impact[some], len(ids), len(weight))
            for i, query in enumerate(asked):
                floor = best[i][-1][0] if len(best[i]) == k else 1
                found, scores, _ = block.search(query, k, floor, slots)
                if len(scores) > k:
                    near = scores >= max(floor, np.partition(scores, len(scores) - k)[-k])
                    found, scores = found[near], scores[near]
                if len(scores):
                    merged = np.concatenate((scores, np.array([s for s, _ in best[i]], np.int64)))
                    best[i] = best_rows(merged, [ids[d] for d in found.tolist()] + [x for _, x in best[i]], k)
        rows = [(i, item_ids[i], x, s) for i, own in enumerate(best) for s, x in own if s > 0]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["item", "item_id", "doc_id", "score"])

    each = index.mapInArrow(answer, "item int, item_id long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _doc_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(ids, numbers of terms, terms, frequencies, postings of each document) of documents with about ``POSTINGS`` postings."""
    held, size = [], 0
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "n", "terms", "tfs")], strict=True):
            held.append(row)
            size += len(row[2]) // 4
            if size >= POSTINGS:
                yield _block_of(held)
                held, size = [], 0
    if held:
        yield _block_of(held)


def _block_of(rows: list[tuple]) -> tuple:
    ids, n, term, tf = zip(*rows, strict=True)
    return list(ids), np.array(n, np.int64), np.frombuffer(b"".join(term), np.int32).astype(np.int64), np.frombuffer(b"".join(tf), np.int64), np.array([len(x) // 4 for x in term])
