"""N-gram Jaccard self-join by prefix trees.

Every document is the set of its word n-grams, as 64-bit hashes in one global order (that of the hashes). Documents that
may be similar are brought together, and each such group is joined in a task by prefix trees: sets with a common
beginning share a path, a query walks down with the overlap counted so far, and a subtree is left as soon as the
elements that remain on either side cannot reach the overlap its set sizes ask for.

Bringing together is exact. With similarity num/den, two sets of sizes a and b differ in at most
H = (a + b)(den - num)/(den + num) elements. The hash range is cut into more than H equal segments, so at least one
segment is the same in both; sets with an equal segment meet under its hash. Segment counts depend on a size class; a
set takes part in its own class and in the next. A third more segments than that, the spare ones, allow empty segments,
which say nothing, to be left out (a set with more of them than spares uses all its segments), and ask for more than one
meeting: a similar pair shares at least 1 + spare segments, so a set that meets others in fewer has no partner and goes.
That removes what shares a passage or a frequent line only.

Equal sets are reduced to one before, and inside a group a set is compared with a component only until its first link:
components need no more, so a group of n near copies takes about n comparisons. Groups above ``group_elements``
elements are split into shards that all hold the group's first set; whatever is not yet connected to it goes through
all shards afterwards. No candidate is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Digests that a task remembers in order to leave out the segments of an equal set.
REMEMBERED = 500_000


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word windows; a shorter text is one window; without words, none."""
    words = common.word_hashes(text.encode("utf-8", "surrogatepass").lower())
    if len(words) == 0:
        return words
    if len(words) < size:
        return common.mix(common.window_hashes(words, len(words)) + np.uint64(len(words)))
    return np.unique(common.window_hashes(words, size))


class Segments:
    """Size classes and segment counts for the similarity num/den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low = [1]

    def class_of(self, n: int) -> int:
        while self.low[-1] <= n:
            # the first size that is too large for a set of the size before to reach
            self.low.append(self.low[-1] * self.den // self.num + 1)
        return int(np.searchsorted(self.low, n, side="right")) - 1

    def count(self, k: int) -> tuple[int, int]:
        """Segments of class k and how many of them are spare; none where only equal sets can link."""
        self.class_of(self.low[min(k, len(self.low) - 1)])
        while len(self.low) < k + 2:
            self.low.append(self.low[-1] * self.den // self.num + 1)
        differ = 2 * (self.low[k + 1] - 1) * (self.den - self.num) // (self.den + self.num)
        if not differ:
            return 0, 0
        spare = 1 + differ // 3
        return differ + 1 + spare, spare

    def keys(self, items: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """Hashes under which a set of sorted ``items`` meets others, for its own class and the next, and in how many of
        them it meets every partner at least."""
        own = self.class_of(len(items))
        sums = np.zeros(len(items) + 1, np.uint64)
        np.cumsum(common.mix(items), out=sums[1:])
        out = []
        for k in (own, own + 1):
            parts, spare = self.count(k)
            if not parts:
                continue
            at = ((items >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            edges = np.searchsorted(at, np.arange(parts + 1, dtype=np.uint64))
            keep = np.diff(edges) > 0
            empty = int(np.count_nonzero(~keep))
            # equal segments number 1 + spare or more; a partner may leave out its empty ones, at most spare
            least = 1 + spare - empty
            if empty > spare:
                keep[:] = True
                least = 1
            tag = np.arange(parts, dtype=np.uint64) + np.uint64(k << 40)
            out.append((common.mix(sums[edges[1:]] - sums[edges[:-1]] + common.mix(tag))[keep], least))
        return out


class Tree:
    """Prefix tree of sorted sets with joined edges. A node: [edge, children by first element, sets ending here,
    smallest and largest set size below]."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.root = [np.empty(0, np.uint64), {}, [], 1 << 60, 0]
        self.size = 0

    def needed(self, a: int, b: int) -> int:
        """Least overlap of sets of these sizes that are similar enough."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def add(self, items: np.ndarray, name: int) -> None:
        self.size += 1
        n, node, pos = len(items), self.root, 0
        while True:
            node[3], node[4] = min(node[3], n), max(node[4], n)
            if pos == n:
                node[2].append(name)
                return
            child = node[1].get(int(items[pos]))
            if child is None:
                node[1][int(items[pos])] = [items[pos:], {}, [name], n, n]
                return
            edge = child[0]
            m = min(len(edge), n - pos)
            differ = np.flatnonzero(edge[:m] != items[pos : pos + m])
            same = int(differ[0]) if len(differ) else m
            if same < len(edge):
                # split the edge where the two sets part
                lower = [edge[same:], child[1], child[2], child[3], child[4]]
                child[0], child[1], child[2] = edge[:same], {int(edge[same]): lower}, []
            node, pos = child, pos + same

    def first_link(self, items: np.ndarray) -> int | None:
        """Name of a set similar to ``items``, or None if there is none. Exact."""
        n = len(items)
        stack = [(self.root, 0, 0, 0)]  # node, elements of its path above, overlap so far, place in items
        while stack:
            node, depth, overlap, pos = stack.pop()
            smallest, largest = node[3], node[4]
            # sizes that a partner may have at all
            smallest, largest = max(smallest, -(-n * self.num // self.den)), min(largest, n * self.den // self.num)
            if smallest > largest:
                continue
            need = self.needed(n, smallest)
            edge, low, alive = node[0], 0, True
            while low < len(edge):
                part = edge[low : low + 256]
                place = pos + np.searchsorted(items[pos:], part)
                overlap += int(np.count_nonzero(items[np.minimum(place, n - 1)] == part))
                low += len(part)
                pos = int(np.searchsorted(items, part[-1], side="right"))
                # what is left on either side can add no more than the shorter rest
                if overlap + min(n - pos, largest - depth - low) < need:
                    alive = False
                    break
            if not alive:
                continue
            depth += len(edge)
            if node[2] and overlap >= self.needed(n, depth) and self.num * (n + depth - overlap) <= self.den * overlap:
                return node[2][0]
            for child in node[1].values():
                stack.append((child, depth, overlap, pos))
        return None


def link_group(names: list[int], sets: list[np.ndarray], known: list[int], num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect all sets of a group that are connected by links within it. ``known``: equal values are
    connected already. One tree for each component; a query leaves a tree at its first link."""
    trees: dict[int, Tree] = {}
    held: dict[int, list[int]] = {}
    links = []
    for k, (name, items) in enumerate(zip(names, sets, strict=True)):
        home = ("known", known[k])
        if home not in trees:
            trees[home], held[home] = Tree(num, den), []
        for key in [x for x in trees if x != home]:
            other = trees[key].first_link(items)
            if other is None:
                continue
            links.append((name, other))
            big, small = (key, home) if trees[key].size >= trees[home].size else (home, key)
            for j in held[small]:
                trees[big].add(sets[j], names[j])
            held[big] += held[small]
            tree, members = trees[big], held[big]
            del trees[small], held[small]
            if big != home:
                del trees[big], held[big]
            trees[home], held[home] = tree, members
        trees[home].add(items, name)
        held[home].append(k)
    return links


def summaries(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, d1, d2) per row: set size and a digest that is equal for equal sets only."""

    def one(doc_id, text):
        items = shingles(text or "", size)
        a = common.mix(items).sum(dtype=np.uint64)
        b = common.mix(items ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
        yield doc_id, len(items), int(a.view(np.int64)), int(b.view(np.int64))

    return common.map_rows(docs, one, ["doc_id", "text"], "doc_id long, n_shingles long, d1 long, d2 long")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]]:
    """(columns, first document of the row's key, is the key's only row) of batches sorted by key and document.

    A batch waits for the next one, which tells whether its last key goes on; nothing else is held.
    """
    held, last_key, first = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        if held is not None:
            goes_on = now["key"][0] == held["key"][-1]
            head, alone = _heads(held, last_key, first)
            if goes_on:
                alone[-1] = False
            yield held, head, alone
            last_key, first = held["key"][-1], head[-1]
        held = now
    if held is not None:
        head, alone = _heads(held, last_key, first)
        yield held, head, alone


def _heads(columns: dict[str, np.ndarray], last_key, first) -> tuple[np.ndarray, np.ndarray]:
    key, doc = columns["key"], columns["doc"]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(starts, len(key)))
    heads, alone = doc[starts].copy(), sizes == 1
    if last_key is not None and key[0] == last_key:
        heads[0], alone[0] = first, False
    return np.repeat(heads, sizes), np.repeat(alone, sizes)


def _meetings(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(doc, first): documents that share a segment with the smallest document that has it, among those that meet others
    often enough to have a partner."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments, seen = Segments(num, den), set()
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for low in range(0, len(ids), 500):
                keys, names, needs = [], [], []
                for doc_id, text in zip(ids[low : low + 500], texts.slice(low, 500).to_pylist(), strict=True):
                    items = shingles(text, size)
                    digest = int(common.mix(items).sum(dtype=np.uint64))
                    if len(items) == 0 or digest in seen:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(digest)
                    for level, (found, least) in enumerate(segments.keys(items)):
                        keys.append(found)
                        names.append(np.full(len(found), doc_id, np.int64))
                        needs.append(np.full(len(found), 2 * least + level, np.int32))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(names)), pa.array(np.concatenate(needs))], ["key", "doc", "need"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, _, alone in _runs(batches):
            yield pa.RecordBatch.from_arrays([pa.array(columns[c][~alone]) for c in ("key", "doc", "need")], ["key", "doc", "need"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, head, _ in _runs(batches):
            away = np.flatnonzero(head != columns["doc"])
            pairs = np.unique(np.stack((columns["doc"][away], head[away]), 1), axis=0) if len(away) else np.empty((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["doc", "first"])

    rows = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").mapInArrow(common.returning_memory(emit), "key long, doc long, need int")
    def enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a document's rows of one class follow each other; they are held until the next ones begin
        last, keys = None, []
        for batch in batches:
            key, doc, need = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "doc", "need"))
            edges = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (need[1:] != need[:-1])))) if len(key) else np.empty(0, np.int64)
            out_keys, out_docs = [], []
            for low, high in zip(edges, np.append(edges[1:], len(key)), strict=True):
                if (doc[low], need[low]) != last:
                    if last is not None and sum(map(len, keys)) >= last[1] // 2:
                        out_keys += keys
                        out_docs += [np.full(sum(map(len, keys)), last[0])]
                    last, keys = (doc[low], need[low]), []
                keys.append(key[low:high])
            if out_keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_keys)), pa.array(np.concatenate(out_docs))], ["key", "doc"])
        if last is not None and sum(map(len, keys)) >= last[1] // 2:
            held = np.concatenate(keys)
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(np.full(len(held), last[0]))], ["key", "doc"])

    # one shuffle brings equal segments together; the sorted partition is read as a stream, whatever a segment's size
    met = rows.repartition("key").sortWithinPartitions("key", "doc").mapInArrow(common.returning_memory(shared), "key long, doc long, need int")
    # a second one, of those that somebody shares, brings each document's together
    left = met.repartition("doc").sortWithinPartitions("doc", "need").mapInArrow(common.returning_memory(enough), "key long, doc long")
    return left.repartition("key").sortWithinPartitions("key", "doc").mapInArrow(common.returning_memory(meet), "doc long, first long").distinct()


def _merged(groups: DataFrame, rounds: int = 3) -> DataFrame:
    """``groups`` (first, doc, n) with fewer of them, in which all that shared a group still do.

    The first document of a group is often a member of an earlier group that holds most of the others as well, as where
    many near copies lie; such a group joins the earlier one. Only ids are moved, in work linear in the memberships.
    """
    for _ in range(rounds):
        parent = groups.filter("first < doc").groupBy(F.col("doc").alias("first")).agg(F.min("first").alias("parent"))
        tagged = groups.join(parent, "first")
        inside = tagged.join(groups.select(F.col("first").alias("parent"), "doc"), ["parent", "doc"]).groupBy("first").agg(F.count("*").alias("both"))
        sizes = tagged.groupBy("first", "parent").agg(F.count("*").alias("size"))
        move = sizes.join(inside, "first").filter("2 * both >= size").select("first", "parent").checkpoint()
        if move.isEmpty():
            break
        further = move.select(F.col("first").alias("parent"), F.col("parent").alias("to"))
        move = move.join(further, "parent", "left").select("first", F.coalesce("to", "parent").alias("to"))
        groups = groups.join(move, "first", "left").select(F.coalesce("to", "first").alias("first"), "doc", "n").distinct().checkpoint()
    return groups


def _groups(members: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) within each (first, shard) of ``members`` (first, shard, doc, known, items)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def close():
            links = link_group([r[0] for r in rows], [r[2] for r in rows], [r[1] for r in rows], num, den) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[j] for x in links], pa.int64()) for j in (0, 1)], ["a", "b"])

        for batch in batches:
            names = [batch.column(c).to_pylist() for c in ("first", "shard", "doc", "known", "items")]
            for first, shard, doc, known, items in zip(*names, strict=True):
                if (first, shard) != key:
                    if rows:
                        yield close()
                    key, rows = (first, shard), []
                rows.append((doc, known, np.frombuffer(items, np.uint64)))
        if rows:
            yield close()

    dealt = members.repartition("first", "shard").sortWithinPartitions("first", "shard", "doc")
    return dealt.select("first", "shard", "doc", "known", "items").mapInArrow(common.returning_memory(run), "a long, b long")


def join(docs: DataFrame, *, size: int = 4, num: int = 85, den: int = 100, group_elements: int = 2_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs`` (doc_id, text).

    Two documents link when den * intersection >= num * union of their sets of ``size``-word shingles, in lower case
    for A-Z; component_id is the smallest doc_id reachable by links.

    Defined results: null, empty and blank texts have no shingles and are their own component; rows that repeat a
    doc_id are one document; a null doc_id gets its count, no links and a null component; an empty table gives no rows;
    other columns are ignored.
    """
    from ..session import ensure_checkpoint_dir, scratch_path

    ensure_checkpoint_dir(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    each = summaries(docs, size).checkpoint()
    named = each.filter("doc_id IS NOT NULL AND n_shingles > 0")
    rep = named.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    # the smallest document with the same set; rows that repeat an id join its smallest
    same = named.join(rep, ["d1", "d2", "n_shingles"]).groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("n_shingles").alias("n")).checkpoint()

    met = _meetings(docs, size, num, den)
    left, right = same.select(F.col("doc_id").alias("doc"), F.col("rep").alias("a"), "n"), same.select(F.col("doc_id").alias("first"), F.col("rep").alias("b"))
    pairs = met.join(left, "doc").join(right, "first").filter("a <> b").select(F.col("b").alias("first"), F.col("a").alias("doc"), "n").distinct().checkpoint()

    sizes = same.filter("doc_id = rep").select(F.col("doc_id").alias("doc"), "n")
    heads = pairs.select(F.col("first").alias("doc")).distinct().join(sizes, "doc").select(F.col("doc").alias("first"), "doc", "n")
    groups = _merged(pairs.unionByName(heads))

    sized = groups.groupBy("first").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / group_elements)).cast("int").alias("shards"))
    members = groups.join(sized, "first").select("first", "doc", "shards", F.pmod(F.xxhash64("doc"), F.col("shards").cast("long")).cast("int").alias("shard"))
    # every shard of a split group holds its first set
    split = sized.filter("shards > 1")
    extra = split.select("first", F.col("first").alias("doc"), "shards", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    members = members.unionByName(extra).distinct().checkpoint()

    # written, so that Spark knows the size of the list when it picks the join
    path = scratch_path(docs.sparkSession, "ngram-sets")
    members.select(F.col("doc").alias("doc_id")).distinct().write.parquet(path)
    wanted = docs.sparkSession.read.schema("doc_id long").parquet(path)

    def pack(doc_id, text):
        yield doc_id, shingles(text, size).tobytes()

    sets = common.map_rows(docs.filter("text IS NOT NULL").join(wanted, "doc_id"), pack, ["doc_id", "text"], "doc long, items binary")
    filled = members.join(sets, "doc").withColumn("known", F.col("doc"))
    links = _groups(filled, num, den).checkpoint()
    found = common.components(links)

    if not sized.filter("shards > 1").isEmpty():
        # sets of a split group that are not connected to its first set yet visit every shard of the group
        part = found.select(F.col("node").alias("doc"), "component")
        own = members.filter("shards > 1").join(part, "doc", "left").select("first", "doc", "shards", "shard", F.coalesce("component", "doc").alias("known"))
        head = part.select(F.col("doc").alias("first"), F.col("component").alias("home"))
        away = own.join(head, "first", "left").filter(F.col("known") != F.coalesce("home", "first")).select("first", "doc", "shards", "known").distinct()
        visits = away.select("first", "doc", "shards", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "known")
        again = own.unionByName(visits).distinct().join(away.select("first").distinct(), "first", "left_semi").checkpoint()
        more = _groups(again.join(sets, "doc"), num, den)
        found = common.components(links.union(more))

    whole = same.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    # documents with one id are one node even when their sets differ
    return each.join(whole, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """One row of each group of linked documents: the one with the smallest doc_id. Columns and their order stay.

    Of rows that repeat a doc_id one stays, the first by text and the other columns' hash; rows without doc_id all stay.
    The lists of ids that go and of ids that repeat are written first, so Spark knows their sizes when it picks the
    joins: the texts are only moved where a list is too long to send around.
    """
    from pyspark.sql import Window

    from ..session import scratch_path

    spark, names = docs.sparkSession, docs.columns

    def listed(ids: DataFrame, label: str) -> DataFrame:
        path = scratch_path(spark, label)
        ids.write.parquet(path)
        return spark.read.schema("_listed long").parquet(path)

    found = join(docs, **parameters).groupBy("doc_id").agg(F.min("component_id").alias("c"), F.count("*").alias("n")).filter("doc_id IS NOT NULL").checkpoint()
    gone = listed(found.filter("doc_id <> c").select(F.col("doc_id").alias("_listed")), "ngram-gone")
    again = listed(found.filter("doc_id = c AND n > 1").select(F.col("doc_id").alias("_listed")), "ngram-repeated")
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    is_listed = F.col("_id") == F.col("_listed")
    single = rows.join(gone, is_listed, "left_anti").join(again, is_listed, "left_anti")
    within = Window.partitionBy("_id").orderBy("_text", F.xxhash64("row"))
    first = rows.join(again, is_listed, "left_semi").withColumn("_n", F.row_number().over(within)).filter("_n = 1")
    return common.unpacked(single.select("row").union(first.select("row")), names)
