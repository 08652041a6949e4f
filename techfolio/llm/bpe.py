"""Byte-level BPE of whole texts by a public rank file.

Short texts are encoded where they are read. A text of more than ``CHUNK`` characters is cut into overlapping chunks,
dealt out over the cluster and pre-tokenised in parallel. Every chunk but the first starts at an arbitrary place, so its
first boundaries may be wrong; but the splitting pattern never looks back, so from the first boundary on that two
neighbours share inside their overlap, both are right. Chunks are stitched there, the pieces between the seams are
encoded in parallel, and their ids are put together again. Where two neighbours share no usable boundary (a run of one kind
of characters longer than the overlap), the earlier piece grows over the later chunk, so the result is always exact.
Decoding concatenates the tokens' bytes.

Defined results: null and empty text has no tokens and the digests of the empty string; repeated rows and null ids give a
row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CHUNK = 1 << 15
OVERLAP = 512
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Encoder, and the tables of the tokens' bytes and of their ids in decimal."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        ranks = read_ranks(path)
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.decimal = [str(k) for k in range(len(self.bytes))]

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def digests(self, ids: list[int]) -> tuple[int, str, str]:
        text = " ".join(map(self.decimal.__getitem__, ids))
        return len(ids), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec of this file and pattern."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def boundaries(chunk: str, pattern: str, last: bool) -> np.ndarray:
    """Starts of the pre-tokens of a chunk. A token that touches the end of a chunk may go on in the next one, and one
    before it may have been cut short by it, so unless the chunk is the last its final two starts don't count."""
    starts = np.fromiter((m.start() for m in regex.finditer(pattern, chunk)), np.int32)
    return starts if last else starts[:-2]


def stitch(texts: list[str], starts: list[np.ndarray], step: int, pattern: str) -> list[str]:
    """Pieces whose concatenation is the text and whose edges are true boundaries, from chunks at 0, step, 2 step, ..."""
    pieces, low = [], 0  # low: start of the open piece in the whole text
    open_text, base, sure = texts[0], 0, starts[0]
    for k in range(1, len(texts)):
        at = k * step
        both = np.intersect1d(sure[sure >= at - base] + base, starts[k] + at)
        # white space is split by what follows it, so no piece may end with it
        seam = next((x for x in map(int, both) if x > low and not open_text[x - base - 1].isspace()), None)
        if seam is not None:
            pieces.append(open_text[low - base : seam - base])
            low, open_text, base, sure = seam, texts[k], at, starts[k]
        else:
            # no shared boundary: scan on over the next chunk from the open piece's start
            open_text = open_text[low - base : at - base] + texts[k]
            base = low
            sure = boundaries(open_text, pattern, k == len(texts) - 1)
    pieces.append(open_text[low - base :])
    return pieces


def encode(docs: DataFrame, path: str, pattern: str, *, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, piece, ids) of ``docs`` (doc_id, text): ids as an array; concatenated in the order of ``piece`` they are
    the text's ids. ``row`` tells rows with equal ids apart."""
    short = docs.filter(F.coalesce(F.length("text"), F.lit(0)) <= chunk)
    direct = common.map_rows(short.select("doc_id", "text"), lambda c, i, t: [(0, i, 0, c.encode(t or ""))], ["doc_id", "text"], "row long, doc_id long, piece int, ids array<int>", setup=lambda: codec(path, pattern))
    return direct.unionByName(_long_ids(docs, path, pattern, chunk, overlap))


def _long_ids(docs: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    # the row number follows from the scan's splits and order alone, so a repeated task gives the same
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")).filter(F.length("text") > chunk)

    def cut(doc_id, text, row):
        count = max(1, -(-(len(text) - overlap) // chunk))
        for k in range(count):
            yield row, doc_id, k, k == count - 1, text[k * chunk : (k + 1) * chunk + overlap if k < count - 1 else len(text)]

    chunks = common.map_rows(rows, cut, ["doc_id", "text", "row"], "row long, doc_id long, k int, last boolean, text string")

    def scan(row, doc_id, k, last, text):
        yield row, doc_id, k, text, boundaries(text, pattern, last).tobytes()

    scanned = common.map_rows(chunks.repartition("row", "k"), scan, ["row", "doc_id", "k", "last", "text"], "row long, doc_id long, k int, text string, starts binary")

    def join(group: pd.DataFrame) -> pd.DataFrame:
        # one document: no more than the row that held it
        group = group.sort_values("k")
        pieces = stitch(list(group["text"]), [np.frombuffer(x, np.int32) for x in group["starts"]], chunk, pattern)
        return pd.DataFrame({"row": group["row"].iloc[0], "doc_id": group["doc_id"].iloc[0], "piece": range(len(pieces)), "text": pieces})

    pieces = scanned.groupBy("row").applyInPandas(join, "row long, doc_id long, piece int, text string")
    return common.map_rows(pieces.repartition("row", "piece"), lambda c, r, i, p, t: [(r, i, p, c.encode(t))], ["row", "doc_id", "piece", "text"], "row long, doc_id long, piece int, ids array<int>", setup=lambda: codec(path, pattern))


def digests(docs: DataFrame, path: str, pattern: str, *, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids in decimal and of the bytes they decode to."""
    short = docs.filter(F.coalesce(F.length("text"), F.lit(0)) <= chunk)

    def direct(c: Codec, doc_id, text):
        yield doc_id, *c.digests(c.encode(text or ""))

    near = common.map_rows(short, direct, ["doc_id", "text"], RESULT, setup=lambda: codec(path, pattern))

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("piece")
        found = codec(path, pattern).digests(np.concatenate(group["ids"].to_list()).tolist())
        return pd.DataFrame([(group["doc_id"].iloc[0], *found)], columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    far = _long_ids(docs, path, pattern, chunk, overlap).groupBy("row").applyInPandas(whole, RESULT)
    return near.unionByName(far)
