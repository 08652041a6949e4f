"""Encoding and decoding by a merge-type SentencePiece model, exact, by backtracking.

A text is normalised as the model says (spaces become ``▁``, one more in front) and cut into segments where no entry of the
vocabulary has the two characters at the cut side by side, so no merge ever crosses one. In a segment an Aho-Corasick automaton
finds the longest vocabulary entry at a place. The encoder takes the longest entry at hand if it is compatible with
the one before it, else the next shorter one that starts there; where none is left it steps back and marks the place as
failed in a bitfield, so no place is tried twice. Two entries are compatible if re-merging their joined characters by
the scores gives the two again; a row of entries that are compatible pair by pair is the one that merging the whole segment
gives. Characters without an entry become their UTF-8 bytes' pieces. Segments come back often, so their ids are kept in two
bounded generations of a cache in the worker.

Decoding concatenates the entries' bytes, with spaces for ``▁``, and takes off the space that encoding put in front.

Defined results: null and empty text has no ids but the end id, and decodes to the empty string; repeated rows and null ids
give a row each; an empty table gives no rows; other columns are ignored. A text is worked on in blocks, whatever its length.
Models that are not of this kind (other types, a character map, own symbols, no byte pieces) raise ``ValueError``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import ahocorasick
from pyspark.sql import DataFrame

from . import common

SPACE = "▁"
#: Segments and pairs of entries kept in a worker before the older half goes.
KEPT = 200_000
KEPT_PAIRS = 400_000
#: Characters cut into segments at once.
BLOCK = 1 << 20
#: Score of a merge that doesn't happen.
NEVER = float("-inf")
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Line breaks, single digits, runs of letters (and all that is no common mark), runs of marks, each after the spaces before it.
_MARKS = r"\x00-\x09\x0b-/:-@\[-`{-\xbf\u2000-\u206f"
_SEGMENTS = re.compile(rf"\n|▁*[0-9]|▁*[^▁\n0-9{_MARKS}]+|▁*[{_MARKS}]+|▁+")
_WHOLE = re.compile(r".+", re.S)


class TwoGenerations(dict):
    """A dictionary that fills missing keys by ``make`` and holds at most about twice ``kept`` of them: the ones used since
    the last change of generation, and those of the generation before."""

    def __init__(self, make: Callable, kept: int):
        super().__init__()
        self.make, self.kept, self.old = make, kept, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.kept:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class PieceCodec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        with open(path, "rb") as file:
            spec.ParseFromString(file.read())
        rules, kinds = spec.normalizer_spec, pb.ModelProto.SentencePiece
        if spec.trainer_spec.model_type != pb.TrainerSpec.BPE or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces:
            raise ValueError("a merge-type model without a character map is needed")
        if not spec.trainer_spec.byte_fallback or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in spec.pieces):
            raise ValueError("a model with byte pieces and without own symbols is needed")
        self.end = SentencePieceProcessor(model_file=path).eos_id()
        self.scores = {p.piece: p.score for p in spec.pieces if p.type == kinds.NORMAL}
        self.names = [p.piece if p.type == kinds.NORMAL else "" for p in spec.pieces]
        self.bytes = [p.piece.replace(SPACE, " ").encode() if p.type == kinds.NORMAL else bytes([int(p.piece[1:-1], 16)]) if p.type == kinds.BYTE else b"" for p in spec.pieces]
        self.byte_ids = {self.bytes[k][0]: k for k, p in enumerate(spec.pieces) if p.type == kinds.BYTE}
        entries = {p.piece: k for k, p in enumerate(spec.pieces) if p.type == kinds.NORMAL}
        # characters that only occur inside longer entries: they merge, and alone they stand for their bytes
        inner = sorted({c for name in entries for c in name}.difference(entries))
        self.spelled = {len(self.names) + k: [self.byte_ids[b] for b in c.encode()] for k, c in enumerate(inner)}
        self.names += inner
        entries |= {c: len(spec.pieces) + k for k, c in enumerate(inner)}
        self.split, tied = {}, set()
        for name in list(entries):
            parts, cut = self.merged(name)
            if len(parts) > 1:
                del entries[name]  # merging never gives it
                continue
            self.split[name] = cut
            if any(x in tied or len(x) > 1 and self.scores[x] <= self.scores[name] for x in (name[:cut], name[cut:])):
                tied.add(name)
        self.alphabet = {c for name in entries for c in name}
        self.sizes = list(map(len, self.names))
        self.shorter = [-1] * len(self.names)
        self.longest = ahocorasick.Automaton()
        for name, k in entries.items():
            self.longest.add_word(name, k)
            self.shorter[k] = next((entries[name[:n]] for n in range(len(name) - 1, 0, -1) if name[:n] in entries), -1)
        self.longest.make_automaton()
        # of entries whose parts all have higher scores, so that merges at an edge come in the order of their lengths
        self.rights, self.lefts = ([self._edge(name, side) if name in entries and name not in tied else None for name in self.names] for side in (1, 0))
        # the pattern cuts by the two characters at the cut alone, so it is safe if it cuts no entry
        self.pattern = _SEGMENTS if all(len(_SEGMENTS.findall(name)) == 1 for name in entries) else _WHOLE
        self.compatible = TwoGenerations(self._compatible, KEPT_PAIRS)
        self.segments = TwoGenerations(self._segment, KEPT)

    def merged(self, text: str) -> tuple[list[str], int]:
        """The symbols that merging leaves of ``text``, the best-scored adjacent pair first, the leftmost of equal ones;
        and the length of the left part in the last merge."""
        parts, left = list(text), 0
        scores = self.scores
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                break
            left = len(parts[at])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, left

    def _edge(self, name: str, side: int) -> list[tuple[str, float]]:
        """What stands at the left (0) or right (1) edge of an entry while it is merged, from its outer character to itself,
        each with the score of the merge that ends it."""
        chain, ends = [], NEVER
        while True:
            chain.append((name, ends))
            if len(name) == 1:
                return chain[::-1]
            ends = self.scores[name]
            cut = self.split[name]
            name = name[cut:] if side else name[:cut]

    def _compatible(self, pair: tuple[int, int]) -> bool:
        """Whether merging keeps the border between two entries: the merges at both edges are run again in the order of
        their scores, beside the merge that would join the edges."""
        rights, lefts = self.rights[pair[0]], self.lefts[pair[1]]
        if rights is None or lefts is None:
            left, right = self.names[pair[0]], self.names[pair[1]]
            return self.merged(left + right)[0] == [left, right]
        i = k = 0
        while True:
            right, right_ends = rights[i]
            left, left_ends = lefts[k]
            joint = self.scores.get(right + left, NEVER)
            # of equal scores the leftmost merge comes first
            if joint > right_ends and joint >= left_ends:
                return False
            if right_ends == NEVER == left_ends:
                return True
            if right_ends >= left_ends:
                i += 1
            else:
                k += 1

    def _backtrack(self, run: str) -> list[int]:
        """Entries of a run of known characters."""
        size, sizes, compatible, shorter, longest = len(run), self.sizes, self.compatible, self.shorter, self.longest.iter_long
        at_place: dict[int, int] = {}
        # every character is an entry, so the leftmost longest matches stand side by side
        for end, k in longest(run):
            at_place[end + 1 - sizes[k]] = k
        chosen: list[int] = []
        failed = place = 0
        last, k = -1, at_place.get(0, -1)
        while place < size:
            while k >= 0:
                end = place + sizes[k]
                if not failed >> end & 1 and (last < 0 or compatible[last, k]):
                    break
                k = shorter[k]
            if k >= 0:
                chosen.append(k)
                last, place = k, end
                if place < size:
                    k = at_place.get(place, -1)
                    if k < 0:
                        k = at_place[place] = next(longest(run, place))[1]
            else:
                failed |= 1 << place
                k = chosen.pop()
                place -= sizes[k]
                last = chosen[-1] if chosen else -1
        return chosen

    def _ids(self, segment: str) -> list[int]:
        if self.alphabet.issuperset(segment):
            ids = self._backtrack(segment)
        else:
            ids, low = [], 0
            for k, c in enumerate(segment):
                if c not in self.alphabet:
                    ids += self._backtrack(segment[low:k])
                    ids += [self.byte_ids[b] for b in c.encode()]
                    low = k + 1
            ids += self._backtrack(segment[low:])
        if self.spelled:
            ids = [x for k in ids for x in self.spelled.get(k, (k,))]
        return ids

    def _segment(self, segment: str) -> tuple[str, bytes]:
        """The ids in decimal, and the bytes they decode to."""
        ids = self._ids(segment)
        return " ".join(map(str, ids)), self.bytes_of(ids)

    def blocks(self, text: str) -> Iterator[list[tuple[str, bytes]]]:
        """Results of the segments of ``text``, block by block."""
        low = 0
        while low < len(text):
            high = low + BLOCK
            # a block ends before a space that follows another character: always the edge of a segment
            while high < len(text) and not (text[high] in " ▁" and text[high - 1] not in " ▁"):
                high += 1
            if self.pattern is _WHOLE:
                high = len(text)
            block = text[low:high].replace(" ", SPACE)
            found = self.pattern.findall(block if low else SPACE + block)
            yield list(map(self.segments.__getitem__, found))
            low = high

    def encode(self, text: str, end: bool = True) -> list[int]:
        return [int(k) for block in self.blocks(text) for ids, _ in block for k in ids.split()] + [self.end] * end

    def bytes_of(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode(self, ids) -> str:
        return self.bytes_of(ids).removeprefix(b" ").decode("utf-8", "replace")

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, and digests of the ids in decimal and of the bytes they decode to."""
        count, ids, decoded, first = 1, hashlib.sha256(), hashlib.sha256(), True
        for block in self.blocks(text):
            decimals, raws = zip(*block, strict=True)
            listed = " ".join(decimals) + " "
            count += listed.count(" ")
            ids.update(listed.encode())
            raw = b"".join(raws)
            decoded.update(raw.removeprefix(b" ") if first else raw)
            first = False
        ids.update(str(self.end).encode())
        return count, ids.hexdigest(), decoded.hexdigest()


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str | Callable[[], str]) -> PieceCodec:
    """The worker's codec of this file; a function names the file on the worker's own machine."""
    path = path() if callable(path) else path
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def encode(docs: DataFrame, path: str | Callable[[], str], *, end: bool = True) -> DataFrame:
    """Every row's doc_id with the ``ids`` of its text."""
    return common.map_rows(docs, lambda c, i, t: [(i, c.encode(t or "", end))], ["doc_id", "text"], "doc_id long, ids array<int>", setup=lambda: codec(path))


def decode(encoded: DataFrame, path: str | Callable[[], str]) -> DataFrame:
    """The texts of ``encoded`` (doc_id, ids); null ids give the empty text."""
    return common.map_rows(encoded, lambda c, i, ids: [(i, c.decode(ids or []))], ["doc_id", "ids"], "doc_id long, text string", setup=lambda: codec(path))


def digests(docs: DataFrame, path: str | Callable[[], str]) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text, end id included. A narrow map."""
    return common.map_rows(docs, lambda c, i, t: [(i, *c.digests(t or ""))], ["doc_id", "text"], RESULT, setup=lambda: codec(path))
