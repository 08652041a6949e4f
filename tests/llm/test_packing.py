"""Packing: every piece once, no gap, no overflow, few sequences; ids as the library gives them."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import WORDS
from public_tokenizers import path

from techfolio.llm import packing

FILE = path("word_bpe_49k.json")
ODD = ["It's  the end,we'll see\x1cit\x85don't", "<|endoftext|> foo <|startoftext|>", "é ́x İI ΣΣ ẞ", "\ta\n\nb\r\x0b\x0cc", "'S 'LL x'Re 12 3a4", "   ", "日本語 テキスト。 ﬁ ½", "a. b, c ., d.", "½, x. É, ².", "Éİ. a İ, \x01 a\x01b"]


def test_ids_equal_the_library():
    encoder, rng = packing.Encoder(FILE), random.Random(1)
    parts = [*WORDS, ".", ", ", " ", "\n", "É", "ß", "'s", "42", "½", "　", "Σ", "!"]
    for text in ODD + ["".join(rng.choice(parts) for _ in range(60)) for _ in range(400)]:
        assert encoder.ids(text).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("seed", range(6))
def test_plans_hold_every_piece_once(seed):
    rng = random.Random(seed)
    counts = Counter(rng.choices(range(1, rng.choice([40, 700, 2049])), k=rng.randint(1, 4000)))
    plan = packing.plan(counts)
    inside, used = Counter(), Counter()
    starts = sorted(zip(plan.length.tolist(), plan.first.tolist(), plan.base.tolist(), plan.times.tolist(), strict=True))
    for length in counts:
        rows = [r for r in starts if r[0] == length]
        for (_, first, base, times), nxt in zip(rows, [*rows[1:], (length, counts[length])], strict=True):
            for r in range(nxt[1] - first):
                inside[base + r // times] += length
                used[length] += 1
    assert used == counts and max(inside.values()) <= 2048 and len(inside) == plan.sequences
    lower = max(-(-sum(k * n for k, n in counts.items()) // 2048), sum(n for k, n in counts.items() if k > 1024))
    assert plan.sequences <= lower * 1.03 + 2


def test_small_fillings_are_optimal():
    rng = random.Random(9)
    for _ in range(300):
        counts = np.zeros(60, int)
        for x in rng.choices(range(2, 30), k=6):
            counts[x] += 1
        room, sums = rng.randint(0, 50), {0}
        for x in np.flatnonzero(counts):
            for _ in range(counts[x]):
                sums |= {s + int(x) for s in sums if s + x <= room}
        got = packing.filling(counts, [int(x) for x in np.flatnonzero(counts)[::-1]], room)
        assert sum(got) == max(sums) and all(n <= counts[x] for x, n in Counter(got).items())


def fewest(items, capacity):
    """Least number of sequences, by trying every place for every piece."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for room in {r for r in rooms if r >= items[k]}:
            at = rooms.index(room)
            go(k + 1, [*rooms[:at], room - items[k], *rooms[at + 1 :]])
        go(k + 1, [*rooms, capacity - items[k]])

    go(0, [])
    return best[0]


def best_fit_one_by_one(items, capacity):
    rooms = []
    for x in sorted(items, reverse=True):
        fit = [r for r in rooms if r >= x]
        if fit:
            rooms.remove(min(fit))
        rooms.append((min(fit) if fit else capacity) - x)
    return len(rooms)


def test_small_plans_are_optimal():
    rng = random.Random(10)
    for _ in range(200):
        items = [rng.randint(3, 15) for _ in range(rng.randint(1, 10))]
        assert packing.plan(Counter(items), capacity=20).sequences == fewest(items, 20)


def test_never_worse_than_best_fit():
    rng, better = random.Random(11), 0
    for k in range(1000):
        # most of them short, so that the test stays quick
        items = [rng.randint(300, 1099) for _ in range(rng.randint(20, 80 if k % 10 == 0 else 30))] if k % 2 else [rng.choice([rng.randint(1, 2048), rng.randint(1, 300), 700]) for _ in range(rng.randint(1, 200))]
        counts = np.bincount(items, minlength=2049)
        plain = best_fit_one_by_one(items, 2048)
        assert sum(n for _, n in packing.best_fit(counts)) == plain
        got = packing.plan(Counter(items)).sequences
        assert got <= plain
        better += got < plain
    assert better > 20


def test_packed_rows(spark, docs_of):
    rng = random.Random(3)
    texts = [(k, " ".join(rng.choice(WORDS) for _ in range(rng.choice([3, 40, 900, 2500])))) for k in range(120)]
    texts += [(500, None), (501, ""), (None, "x"), (7, "again"), (7, "again"), (502, "word " * 9000)]
    encoder = packing.Encoder(FILE)
    out = packing.packed(packing.tokenised(docs_of(texts), FILE), per_bucket=10).toPandas()
    sizes = [len(encoder.ids(t or "")) + 1 for _, t in texts]
    assert out["length"].sum() == sum(sizes) and len(out) == sum(-(-n // 2048) for n in sizes)
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]] and s["length"].sum() <= 2048
    ids = np.append(encoder.ids(texts[-1][1]), 0).astype("<u4")
    for _, r in out[out["doc_id"] == 502].iterrows():
        assert r["start"] == 2048 * r["piece"] and r["ids_crc32"] == zlib.crc32(ids[int(r["start"]) : int(r["start"] + r["length"])].tobytes())
    assert packing.packed(packing.tokenised(docs_of({}), FILE)).count() == 0
