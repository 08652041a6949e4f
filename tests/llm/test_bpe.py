"""Chunked encoding against the library in one piece, and exact round trips."""

from __future__ import annotations

import hashlib
import random

from conftest_llm import by_id
from public_tokenizers import PATTERN, path

from techfolio.llm import bpe

RANKS = path("byte_bpe_50k.tiktoken")
PARTS = ["a", "b", " ", "  ", "\n", "1", "2", "#", "'s", "'", "é", "日", "\t", "s", "t", "re", "!", " \n ", "😀"]


def test_stitching_equals_one_scan():
    codec, rng = bpe.Codec(RANKS, PATTERN), random.Random(5)
    for _ in range(1500):
        text = "".join(rng.choice(PARTS) * rng.choice([1, 1, 1, 2, 9]) for _ in range(rng.randint(1, 120)))
        step, overlap = rng.choice([(7, 3), (20, 8), (30, 5)])
        count = max(1, -(-(len(text) - overlap) // step))
        chunks = [text[k * step : (k + 1) * step + overlap if k < count - 1 else len(text)] for k in range(count)]
        starts = [bpe.boundaries(x, PATTERN, k == count - 1) for k, x in enumerate(chunks)]
        pieces = bpe.stitch(chunks, starts, step, PATTERN)
        assert "".join(pieces) == text
        assert sum((codec.encode(p) for p in pieces), []) == codec.encode(text), text


def test_digests_short_and_long(spark, docs_of):
    codec, rng = bpe.Codec(RANKS, PATTERN), random.Random(6)
    texts = {1: None, 2: "", 3: "x", 4: "#" * 3000, 5: " " * 2000, None: "word " * 500, **{10 + k: "".join(rng.choice(PARTS) for _ in range(900)) for k in range(20)}}
    got = by_id(bpe.digests(docs_of(texts), RANKS, PATTERN, chunk=200, overlap=30))
    assert len(got) == len(texts)
    for key, text in texts.items():
        ids = codec.encode(text or "")
        assert got[key]["n_tokens"] == len(ids)
        assert got[key]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[key]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_repeated_rows_and_empty_table(spark, docs_of):
    twice = docs_of([(1, "long text " * 100), (1, "long text " * 100), (2, "b")])
    assert bpe.digests(twice, RANKS, PATTERN, chunk=200, overlap=30).count() == 3
    ids = bpe.encode(twice, RANKS, PATTERN, chunk=200, overlap=30)
    whole = {}
    for r in sorted(ids.collect(), key=lambda r: (r["doc_id"], r["row"], r["piece"])):
        whole.setdefault((r["doc_id"], r["row"]), []).extend(r["ids"])
    assert {bpe.Codec(RANKS, PATTERN).decode(v) for v in whole.values()} == {b"long text " * 100, b"b"}
    assert bpe.digests(docs_of({}), RANKS, PATTERN).count() == 0
