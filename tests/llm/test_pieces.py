"""Backtracking against the library, against plain merging, and exact round trips."""

from __future__ import annotations

import hashlib
import random

import pytest
from conftest_llm import by_id
from public_tokenizers import path

from techfolio.llm import pieces

PARTS = ["a", "b", " ", "  ", "▁", "\n", "1", "23", "#", "<s>", "</s>", "<0x0A>", "é", "日本", "語", "\t", "the", "ing", "tion", "!!", "...", "😀", "\x00", "ß", "ре", "  \n ", "́", "don't", ");\r\n", ".”"]


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def codec():
    return pieces.PieceCodec(path("piece_bpe_32k.model"))


def test_equals_library(codec, library):
    rng = random.Random(3)
    parts = PARTS + rng.sample([x for x in codec.names if x], 3000)
    for _ in range(4000):
        text = "".join(rng.choice(PARTS if rng.random() < 0.5 else parts) for _ in range(rng.randint(0, 30)))
        want = library.encode(text, add_eos=True)
        assert codec.encode(text) == want, text
        assert codec.decode(want) == library.decode(want), text
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, want)), library.decode(want))]
        assert codec.digests(text) == (len(want), *digests), text


def test_backtracking_equals_plain_merging(codec):
    rng = random.Random(4)
    stepped_back = 0
    for _ in range(3000):
        run = "".join(rng.choice("abcdehinorst▁") for _ in range(rng.randint(1, 24)))
        got = [codec.names[k] for k in codec._backtrack(run)]
        assert got == codec.merged(run)[0], run
        greedy, at = [], 0
        while at < len(run):
            n = next(n for n in range(len(run) - at, 0, -1) if run[at : at + n] in codec.split)
            greedy.append(run[at : at + n])
            at += n
        stepped_back += got != greedy
    assert stepped_back > 100  # longest matches alone would not do


def test_long_texts_go_in_blocks(codec, library, monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK", 50)
    rng = random.Random(5)
    for text in ("word and more, " * 300, " " * 700, "a" * 900, "ab▁" * 200, "\n" * 300, "".join(rng.choice(PARTS) for _ in range(3000))):
        assert codec.encode(text) == library.encode(text, add_eos=True)


def test_rows(spark, docs_of, library):
    texts = [(1, None), (2, ""), (3, " "), (4, "Hello  world\n"), (None, "x"), (4, "Hello  world\n"), (5, "long text " * 30_000)]
    docs = docs_of(texts)
    got = by_id(pieces.digests(docs, path("piece_bpe_32k.model")))
    assert pieces.digests(docs, lambda: path("piece_bpe_32k.model")).count() == len(texts)
    for key, text in texts:
        want = library.encode(text or "", add_eos=True)
        assert got[key]["n_tokens"] == len(want)
        assert got[key]["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert got[key]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    back = by_id(pieces.decode(pieces.encode(docs, path("piece_bpe_32k.model")), path("piece_bpe_32k.model")))
    assert all(back[key]["text"] == (text or "") for key, text in texts)
    assert pieces.digests(docs_of({}), path("piece_bpe_32k.model")).count() == 0


def test_other_models_are_refused():
    with pytest.raises(Exception):  # noqa: B017 - not a model file at all
        pieces.PieceCodec(path("byte_bpe_50k.json"))
