"""Lockstep merging against a plain two-pointer walk over bytes, and whole results against a brute-force corpus count."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from public_tokenizers import PATTERN, path

from techfolio.llm import alignment

A, B = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")
PARTS = ["a", "b", " ", "  ", "\n", "1", "23", "#", "<s>", "<|endoftext|>", "é", "日本", "\t", "the", "ing", "😀", "don't", "unbelievable ", "Café ", ");\r\n"]


@pytest.fixture(scope="module")
def tokens():
    """(ids, bytes) of a text by each library, without the operator's tables."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True

    def of(text):
        got = a.encode(" " + text, add_special_tokens=False)
        spelled = alignment.byte_alphabet()
        ids_b = b.encode(text)
        names = [b.id_to_piece(k) for k in ids_b]
        return got.ids, [bytes(spelled[c] for c in t) for t in got.tokens], ids_b, [bytes([int(x[3:-1], 16)]) if b.is_byte(k) else x.replace("▁", " ").encode() for k, x in zip(ids_b, names, strict=True)]

    return of


def brute(texts, of):
    """Rows by the words of the contract: overlapping byte ranges, counts over the corpus, groups between common ends."""
    found, count = [], Counter()
    for text in texts:
        a, a_bytes, b, b_bytes = of(text) if text else ([], [], [], [])
        if not text or b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            found.append(None)
            continue
        spans = []
        for parts in (a_bytes, b_bytes):
            ends = np.cumsum([len(x) for x in parts]).tolist()
            spans.append(list(zip([0, *ends[:-1]], ends, strict=True)))
        links = [(i, k) for i, (s, e) in enumerate(spans[0]) for k, (u, v) in enumerate(spans[1]) if s < v and u < e]
        count.update((a[i], b[k]) for i, k in links)
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for cut in cuts:
            groups.append(",".join(str(x) for x, (s, e) in zip(a, spans[0], strict=True) if low <= s and e <= cut) + "|" + ",".join(str(x) for x, (s, e) in zip(b, spans[1], strict=True) if low <= s and e <= cut))
            low = cut
        found.append((a, b, groups, [(a[i], b[k]) for i, k in links]))
    most = {}
    for (_, b), n in count.items():
        most[b] = max(n, most.get(b, 0))
    rows = []
    for x in found:
        if x is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = x
        rows.append((len(a), len(b), len(groups), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return rows


def values(df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in df.collect())


def some_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_whole_results(spark, docs_of, tokens):
    texts = [None, "", " ", "x", "▁ low line", "a▁b", "tail ", "same text", "same text", *some_texts(1, 60)]
    keys = [None if k == 3 else 7 if k in (7, 8) else k for k in range(len(texts))]
    docs = docs_of(list(zip(keys, texts, strict=True)))
    want = sorted((-1 if k is None else k, *row) for k, row in zip(keys, brute(texts, tokens), strict=True))
    assert values(alignment.align(docs, A, B, PATTERN)) == want
    # the other way for tables of pairs that are too large to broadcast
    assert values(alignment.align(docs, lambda: A, lambda: B, PATTERN, pair_limit=0)) == want


def test_long_texts_in_parts_and_lanes(spark, docs_of, tokens, monkeypatch):
    texts = ["word by word, " * 200, "x" * 3000, " " * 900, " ".join(some_texts(2, 40)), "a ▁ b " * 300, "né " * 500]
    tokenizers = alignment.Pair(A, B, PATTERN)
    want = brute(texts, tokens)
    for part, batch in ((40, 100), (64, 10_000), (1 << 16, 1 << 20)):
        monkeypatch.setattr(alignment, "PIECE", part)
        monkeypatch.setattr(alignment, "BATCH", batch)
        work = alignment.Documents(tokenizers)
        rows = [r for k, text in enumerate(texts) for r in work.add(k, (k, k), text)] + list(work.flush())
        rows.sort()
        assert [(*r[2:6], r[6]) for r in rows] == [(*w[:4], w[6]) for w in want]
        for r, w in zip(rows, want, strict=True):
            assert alignment.pairs_of(r[7], r[8])[1].sum() == w[3]


def test_lockstep_lanes():
    rng = np.random.default_rng(3)
    for lane in (1, 2, 5, 300):
        a_all, b_all, starts, want_links, want_cuts = [], [], [], [], []
        for _ in range(30):
            total = int(rng.integers(1, 60))
            sizes = []
            for _ in range(2):
                ends = np.unique(np.append(rng.integers(1, total + 1, rng.integers(0, 20)), total))
                sizes.append(np.diff(ends, prepend=0))
            starts.append(sum(map(len, a_all)))
            base_a, base_b = starts[-1], sum(map(len, b_all))
            ends_a, ends_b = np.cumsum(sizes[0]), np.cumsum(sizes[1])
            want_links += [(base_a + i, base_b + k) for i in range(len(ends_a)) for k in range(len(ends_b)) if ends_a[i] - sizes[0][i] < ends_b[k] and ends_b[k] - sizes[1][k] < ends_a[i]]
            want_cuts += [(base_a + i, base_b + k) for i in range(len(ends_a)) for k in range(len(ends_b)) if ends_a[i] == ends_b[k]]
            a_all.append(sizes[0])
            b_all.append(sizes[1])
        a, b, cut_a, cut_b = alignment.lockstep(np.concatenate(a_all), np.concatenate(b_all), np.array(starts), lane)
        assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == sorted(want_links)
        assert sorted(zip(cut_a.tolist(), cut_b.tolist(), strict=True)) == sorted(want_cuts)


def test_pair_bytes_and_many_repeats():
    codes = np.array([0, 5, 1 << 20, (1 << 31) + 7], np.int64)
    assert alignment.unpacked(alignment.packed(codes)).tolist() == codes.tolist()
    assert alignment.unpacked(alignment.packed(codes[:0])).tolist() == []
    work = alignment.Documents(alignment.Pair(A, B, PATTERN))
    row = (list(work.add(0, (0, 0), "again " * 1000)) + list(work.flush()))[0]
    got, times = alignment.pairs_of(row[7], row[8])
    assert times.sum() == row[5] and times.max() > 900 and len(got) == len(times)


def test_empty_table(spark, docs_of):
    assert alignment.align(docs_of({}), A, B, PATTERN).count() == 0
    assert values(alignment.align(docs_of({1: None, 2: ""}), A, B, PATTERN)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
