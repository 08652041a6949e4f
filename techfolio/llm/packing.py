"""Best-fit packing of tokenised documents into sequences of fixed length, by bin completion.

``tokenised`` cuts every document into pieces of at most ``capacity`` tokens. Only the number of pieces of each length
matters for a packing, so ``plan`` works on the histogram, at most ``capacity`` numbers whatever the corpus: while many
pieces are left it takes the largest length, searches undominated fillings of the room beside it (``filling``) and applies
the best one as often as the histogram allows; the last 48 pieces are packed by branch-and-bound over whole sequences,
with best-fit decreasing as incumbent and bounds on the waste. Best-fit decreasing of everything is the incumbent of the whole,
so no packing is worse. Both searches end after a stated number of nodes with what they have. ``packed`` deals the pieces
of each length out to the planned places by rank.

Defined results: null and empty text gives one piece, the end-of-document id alone; repeated rows and null ids are
packed each on their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048
END = 0
#: Words kept with their ids in a task before its cache starts anew. The cache goes with the task: Spark keeps Python
#: workers, and what a worker holds on to is missing for later stages.
CACHE_WORDS = 250_000
#: Characters that Python takes for white space and the tokenizer doesn't.
_ODD = "\x1c\x1d\x1e\x1f"


_TOKENIZERS: dict = {}


def tokenizer(path: str):
    """The worker's tokenizer of this file."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
        _TOKENIZERS[path].encode_special_tokens = True
    return _TOKENIZERS[path]


#: Stands for the end of a word in ``WordRanks``.
_MARK = "\x01"
# The parts of a word in the kind of tokenizer that WordRanks serves.
_WORD_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordRanks:
    """Ids of words without white space whose characters are below U+0100, many in one call of the rank library.

    The tokenizer ends the last symbol of every part of a word with a suffix. Here the part ends with a mark, and joining it
    with the symbol before it comes before all other merges. Merges by rank then give what the merges of the file give.
    """

    def __init__(self, spec: dict):
        import regex
        import tiktoken

        from .alignment import byte_alphabet

        alphabet = byte_alphabet()
        model = spec["model"]
        end, vocabulary, mark = model["end_of_word_suffix"], model["vocab"], _MARK.encode()

        def spelled(name: str) -> bytes:
            return bytes(alphabet[c] for c in name.removesuffix(end)) + mark * name.endswith(end)

        # ends of words first, then the merges in their order; single bytes are never the outcome of a merge
        joined = [c + end for c in alphabet] + ["".join(m) for m in model["merges"]]
        order = [*joined, *alphabet]
        self.to_id = np.array([vocabulary[name] for name in order], "<u4")
        self.ends = np.array([name.endswith(end) for name in order])
        self.parts = regex.compile(_WORD_PARTS).findall
        self.encoding = tiktoken.Encoding("words", pat_str="[^ ]+", mergeable_ranks={spelled(name): k for k, name in enumerate(order)}, special_tokens={})

    @staticmethod
    def fits(word: str) -> bool:
        return max(word) < "\u0100" and _MARK not in word

    def ids(self, words: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each word."""
        split = [[w] if w.isalpha() else self.parts(w) for w in map(str.lower, words)]
        ranks = np.array(self.encoding.encode_ordinary(" ".join(part + _MARK for parts in split for part in parts)), np.int64)
        # a word ends with the last token of its last part
        ends = 4 * (np.flatnonzero(self.ends[ranks])[np.cumsum([len(parts) for parts in split]) - 1] + 1)
        data = self.to_id[ranks].tobytes()
        return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


_RANKS: dict[str, WordRanks | None] = {}


def word_ranks(path: str) -> WordRanks | None:
    """The worker's ranks of this file, none if it is of another kind."""
    if path not in _RANKS:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        steps = [x.get("type") for x in (spec["normalizer"] or {}).get("normalizers", [])]
        cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        model = spec["model"]
        plain = steps == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in cuts] == ["Split", "ByteLevel"] and cuts[0]["pattern"] == {"Regex": _WORD_PARTS} and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]
        _RANKS[path] = WordRanks(spec) if plain and model["end_of_word_suffix"] and not model["continuing_subword_prefix"] and not model["dropout"] else None
    return _RANKS[path]


class Encoder:
    """Ids of texts by a tokenizer file. Words between white space are encoded on their own, each distinct one once:
    the tokenizer's normaliser and splitter never look across white space. The cache lives as long as the encoder."""

    def __init__(self, path: str):
        self.path = path
        self.ranks = word_ranks(path)
        self.clear()

    @property
    def tokenizer(self):
        """The library's tokenizer. It takes memory in every worker, so it is read only where a word needs it."""
        return tokenizer(self.path)

    def clear(self) -> None:
        self.known: dict[str, bytes] = {}  # little-endian 32-bit ids

    def _add(self, words: list[str]) -> None:
        """Ids of new words. A full stop or comma that ends a word after a letter or number is a part of its own, so such
        a word is put together from its two parts."""
        known = self.known
        # a letter that becomes two, the second a mark, may not be parted from what follows
        stopped = [w for w in words if len(w) > 1 and w[-1] in ".," and w[-2].lower().isalnum()]
        if stopped:
            parts = {w[:-1] for w in stopped} | {".", ","} | set(words).difference(stopped)
            words = list(parts.difference(known))
        near = [w for w in words if self.ranks and self.ranks.fits(w)]
        if near:
            known.update(zip(near, self.ranks.ids(near), strict=True))
        if len(near) < len(words):
            far = sorted(set(words).difference(near))
            for word, got in zip(far, self.tokenizer.encode_batch_fast(far, add_special_tokens=False), strict=True):
                known[word] = np.array(got.ids, "<u4").tobytes()
        for word in stopped:
            known[word] = known[word[:-1]] + known[word[-1]]

    def ids(self, text: str) -> np.ndarray:
        if any(c in text for c in _ODD):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        if len(self.known) > CACHE_WORDS:
            self.clear()
        try:
            # the tokenizer lower-cases as well; done here where both surely agree, more words are found in the cache
            text = text.encode("latin-1").decode("latin-1").lower()
        except UnicodeEncodeError:
            pass
        words = text.split()
        if new := set(words).difference(self.known):
            self._add(list(new))
        return np.frombuffer(b"".join(map(self.known.__getitem__, words)), "<u4")


def tokenised(docs: DataFrame, path: str, *, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the pieces of every document's ids, end id included. A narrow map."""

    def cut(known: Encoder, doc_id, text):
        ids = np.append(known.ids(text or ""), np.uint32(END)).astype("<u4")
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            yield doc_id, piece, start, len(part), zlib.crc32(part.tobytes())

    return common.map_rows(docs, cut, ["doc_id", "text"], "doc_id long, piece int, start long, length long, ids_crc32 long", setup=lambda: Encoder(path))


def filling(counts: np.ndarray, lengths: list[int], room: int, *, nodes: int = 4000) -> list[int]:
    """Lengths to put into ``room``, descending, each used at most ``counts`` times, with as little waste as found.

    Depth first over descending lengths, so the first filling of a given waste is one that no other dominates. The
    incumbent is the best-fit filling; a branch is cut when even all that is left below it cannot waste less. Ends at
    zero waste, or after ``nodes`` steps with the incumbent.
    """
    fits = [x for x in lengths if x <= room]  # descending
    rest = np.concatenate((np.cumsum([counts[x] * x for x in fits][::-1])[::-1], [0])) if fits else np.zeros(1)
    best: list[int] = []
    left = room
    for x in fits:
        take = min(int(counts[x]), left // x)
        best += [x] * take
        left -= take * x
    waste = left
    if waste == 0:
        return best
    chosen: list[tuple[int, int]] = []
    # (place in fits, room left, depth, number taken); larger numbers of the larger length first
    stack = [(0, room, 0, 0, 0)]
    seen: set[tuple[int, int]] = set()
    while stack and nodes > 0:
        nodes -= 1
        k, left, depth, x, take = stack.pop()
        del chosen[depth:]
        if take:
            chosen.append((x, take))
            depth += 1
        if left < waste:
            waste, best = left, [y for y, t in chosen for _ in range(t)]
            if waste == 0:
                return best
        while k < len(fits) and fits[k] > left:
            k += 1
        if k == len(fits) or left - rest[k] >= waste or (k, left) in seen:
            continue
        seen.add((k, left))
        for n in range(0, min(int(counts[fits[k]]), left // fits[k]) + 1):
            stack.append((k + 1, left - n * fits[k], depth, fits[k], n))
    return best


@dataclass(frozen=True)
class Plan:
    """Places by length and rank: rows sorted by (length, first rank); arrays of equal size, a few thousand rows at most.

    A piece of this length and rank r of the row goes to sequence ``base + r // times``, at ``offset + r % times * length``.
    """

    length: np.ndarray
    first: np.ndarray
    base: np.ndarray
    times: np.ndarray
    offset: np.ndarray
    sequences: int


def best_fit(counts: np.ndarray, *, capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing of ``counts[length]`` pieces: (number of each length in a sequence, number of such sequences).
    Sequences with equal contents move together, so the work follows the number of lengths."""
    groups: list[tuple[int, dict[int, int], int]] = []  # room, contents, sequences
    for x in map(int, np.flatnonzero(counts)[::-1]):
        left = int(counts[x])
        # the least room first; a sequence that took one piece has still less room, so it takes all that fit
        for room, inside, n in sorted((g for g in groups if g[0] >= x), key=lambda g: g[0]):
            if not left:
                break
            groups.remove((room, inside, n))
            fit = room // x
            full = min(n, left // fit)
            rest = left - full * fit if full < n and left - full * fit < fit else 0
            for times, repeats in ((fit, full), (rest, 1 if rest else 0), (0, n - full - (1 if rest else 0))):
                if repeats:
                    groups.append((room - times * x, inside | ({x: times} if times else {}), repeats))
            left -= full * fit + rest
        fit = capacity // x
        for times, repeats in ((fit, left // fit), (left % fit, 1 if left % fit else 0)):
            if repeats:
                groups.append((capacity - times * x, {x: times}, repeats))
    return [(inside, n) for _, inside, n in groups]


def completed(counts: np.ndarray, *, capacity: int = CAPACITY, exact: int = 48, nodes: int = 20_000) -> list[tuple[dict[int, int], int]]:
    """Bin completion of ``counts``, in the form of ``best_fit``.

    While more than ``exact`` pieces are left, the best filling around the largest is used as often as it fits. The rest
    is searched: every undominated filling around the largest piece is a branch, best first, cut where the waste so
    far leaves no room for fewer sequences than the incumbent, which at first is best-fit decreasing of the rest. The
    search ends at the lower bound, or after ``nodes`` branches with its incumbent.
    """
    counts = counts.copy()
    out: list[tuple[dict[int, int], int]] = []
    while int(counts.sum()) > exact:
        lengths = [int(x) for x in np.flatnonzero(counts)[::-1]]
        top = lengths[0]
        counts[top] -= 1
        inside = [top, *filling(counts, [x for x in lengths if counts[x]], capacity - top)]
        counts[top] += 1
        wanted = {x: inside.count(x) for x in dict.fromkeys(inside)}
        repeats = int(min(counts[x] // n for x, n in wanted.items()))
        for x, n in wanted.items():
            counts[x] -= n * repeats
        out.append((wanted, repeats))
    return out + _searched(counts, capacity, nodes)


def _searched(counts: np.ndarray, capacity: int, nodes: int) -> list[tuple[dict[int, int], int]]:
    incumbent = [inside for inside, n in best_fit(counts, capacity=capacity) for _ in range(n)]
    total = int((counts * np.arange(len(counts))).sum())
    least = -(-total // capacity)
    left = {int(x): int(counts[x]) for x in np.flatnonzero(counts)[::-1]}
    budget = nodes

    def fillings(room: int, most_waste: int) -> list[tuple[int, dict[int, int]]]:
        """(waste, contents) of the maximal fillings of ``room`` that waste no more than allowed, least waste first."""
        fits = [x for x, n in left.items() if n and x <= room]
        found: list[tuple[int, dict[int, int]]] = []

        def extend(k: int, room: int, inside: dict[int, int], skipped: int) -> None:
            nonlocal budget
            budget -= 1
            if budget <= 0:
                return
            if k == len(fits):
                # a piece that was left out and still fits: a filling with it dominates
                if room <= most_waste and room < skipped:
                    found.append((room, inside))
                return
            x = fits[k]
            most = min(left[x], room // x)
            for n in range(most, -1, -1):
                extend(k + 1, room - n * x, inside | {x: n} if n else inside, min(skipped, x) if n < left[x] else skipped)

        extend(0, room, {}, capacity + 1)
        found.sort(key=lambda f: f[0])
        kept: list[tuple[int, dict[int, int]]] = []
        for waste, inside in found:
            # of two with one piece exchanged, the one with the larger piece dominates
            if not any(_dominates(other, inside) for _, other in kept):
                kept.append((waste, inside))
        return kept

    def branch(used: list[dict[int, int]], waste: int) -> None:
        nonlocal incumbent
        top = next((x for x, n in left.items() if n), None)
        if top is None:
            if len(used) < len(incumbent):
                incumbent = list(used)
            return
        # one sequence fewer than the incumbent may waste so much in all
        allowed = (len(incumbent) - 1) * capacity - total - waste
        if allowed < 0 or budget <= 0 or len(incumbent) == least:
            return
        left[top] -= 1
        options = fillings(capacity - top, allowed)
        left[top] += 1
        for more, inside in options:
            if len(incumbent) == least or budget <= 0:
                return
            contents = inside | {top: inside.get(top, 0) + 1}
            for x, n in contents.items():
                left[x] -= n
            branch([*used, contents], waste + more)
            for x, n in contents.items():
                left[x] += n

    if len(incumbent) > least:
        branch([], 0)
    return [(inside, 1) for inside in incumbent]


def _dominates(a: dict[int, int], b: dict[int, int]) -> bool:
    """Whether every piece of ``b`` has one of its own in ``a`` that is as long or longer."""
    longer = sorted((x for x, n in a.items() for _ in range(n)), reverse=True)
    shorter = sorted((x for x, n in b.items() for _ in range(n)), reverse=True)
    return len(longer) >= len(shorter) and all(x >= y for x, y in zip(longer, shorter))  # noqa: B905


def plan(histogram: dict[int, int], *, capacity: int = CAPACITY) -> Plan:
    """Packing of ``histogram[length]`` pieces of each length: the better of bin completion and best-fit decreasing.
    The kinds of sequences are bounded by the capacity and not by the corpus."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    packings = best_fit(counts, capacity=capacity), completed(counts, capacity=capacity)
    chosen = min(packings, key=lambda kinds: sum(n for _, n in kinds))
    used = np.zeros(capacity + 1, np.int64)
    rows, base = [], 0
    for inside, repeats in chosen:
        offset = 0
        for x, n in inside.items():
            rows.append((x, int(used[x]), base, n, offset))
            used[x] += n * repeats
            offset += n * x
        base += repeats
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return Plan(*table.T, base)


def packed(pieces: DataFrame, *, capacity: int = CAPACITY, per_bucket: int = 500_000) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    The histogram reaches the driver (``capacity`` rows at most). Ranks within a length are taken in hash buckets of
    about ``per_bucket`` rows and moved by the sizes of the buckets before, so a length that a third of all pieces
    share is still dealt out over many tasks.
    """
    from ..session import ensure_checkpoint_dir

    spark = pieces.sparkSession
    ensure_checkpoint_dir(spark)
    pieces = pieces.checkpoint()
    sizes = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()
    shared = spark.sparkContext.broadcast(plan({r["length"]: r["n"] for r in sizes}, capacity=capacity))
    buckets = max(1, -(-max((r["n"] for r in sizes), default=1) // per_bucket)) * 8
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    each = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(within) - 1).join(each, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("earlier")).alias("rank"))

    def place(batches):
        p = shared.value
        # lengths and ranks in one sorted key: the row of a piece is the last one that does not lie behind it
        key = (p.length << 48) + p.first
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            row = np.searchsorted(key, (length << 48) + rank, side="right") - 1
            r = rank - p.first[row]
            sequence, offset = p.base[row] + r // p.times[row], p.offset[row] + r % p.times[row] * length
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(common.returning_memory(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
