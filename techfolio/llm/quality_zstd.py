"""Compression classifier: zstandard dictionaries of good and of bad text against each other.

``learn`` builds one dictionary from good and one from bad labelled texts. A text is compressed with both, block by
block so that the dictionaries matter all along it; the difference of the two sizes, normalised by the length, becomes
a probability through a logistic calibration on labelled texts that no dictionary has seen.

Defined results: null or empty text scores the share of good labels; repeated rows give a row each; an empty table gives
no rows; other columns are ignored. Without labels of both kinds every text scores the share of good labels (0.5 if
there are none).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .rules_learn import labelled

#: Bytes compressed at once.
BLOCK = 2048
LEVEL = 3


@dataclass(frozen=True)
class Model:
    """Dictionaries (None: not learned), coefficients of the calibration, and the share of good labels."""

    good: bytes | None
    bad: bytes | None
    coefficients: tuple[float, ...]
    base_rate: float


class Sizes:
    """Compressors of a task."""

    def __init__(self, good: bytes, bad: bytes):
        def made(raw):
            content = zstandard.ZstdCompressionDict(raw)
            content.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(dict_data=content, write_content_size=False, write_dict_id=False)

        self.good, self.bad = made(good), made(bad)

    def of(self, text: str) -> tuple[int, int, int]:
        """Length in bytes, and the sizes by the good and by the bad dictionary, over the whole text."""
        data = text.encode("utf-8", "surrogatepass")
        good = bad = 0
        for low in range(0, len(data), BLOCK):
            part = data[low : low + BLOCK]
            good += len(self.good.compress(part))
            bad += len(self.bad.compress(part))
        return len(data), good, bad


def features(length: int, good: int, bad: int) -> list[float]:
    """Intercept, normalised difference, its square with sign, difference for short texts, and both normalised sizes."""
    n = max(length, 1)
    d = (bad - good) / n
    short = 1 / (1 + n / 200)
    return [1.0, 10 * d, 100 * d * abs(d), 10 * d * short, good / n, bad / n, short]


def fit_logistic(x: np.ndarray, y: np.ndarray, *, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Newton's method for the penalised logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def spread_blocks(text: str, count: int) -> list[bytes]:
    """At most ``count`` blocks of the text, evenly spaced from its first to its last; all of them if there are no more."""
    data = text.encode("utf-8", "surrogatepass")
    total = -(-len(data) // BLOCK)
    places = range(total) if total <= count else np.unique(np.linspace(0, total - 1, count).round().astype(int)).tolist()
    return [data[k * BLOCK : (k + 1) * BLOCK] for k in places]


def _dictionary(blocks: list[bytes], size: int) -> bytes | None:
    """Trained dictionary of ``size`` bytes; too little text for the trainer is taken as a raw-content dictionary."""
    parts = [p for p in blocks if len(p) >= 8]
    if not parts:
        return None
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[:size]


def learn(docs: DataFrame, labels: DataFrame, usable: Column | None = None, *, per_class: int = 2000, calibrate: int = 6000, blocks: int = 8, dictionary_bytes: int = 65536) -> Model:
    """Fit on labelled documents where ``usable`` (an expression over doc_id) holds.

    Bounds of the fit, and of the fit alone: ``per_class`` texts of any length for each dictionary, of each at most
    ``blocks`` blocks spread over the whole text, and ``calibrate`` other texts of any length for the calibration; those
    with the smallest hash of their id. At most 2 x per_class x blocks x BLOCK bytes reach the driver, cut on the
    executors, and three numbers for each text of the calibration, which is compressed on the executors.
    """
    known = labelled(labels)
    if usable is not None:
        known = known.filter(usable)
    rates = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(rates.values())
    base = rates.get(1, 0) / total if total else 0.5
    if len(rates) < 2:
        return Model(None, None, (), base)
    ranked = common.hash_sample(known, "label", max(2 * per_class, calibrate))
    # per_class (id, label) pairs; even ranks train, odd ranks calibrate, so no text does both
    train = F.broadcast(ranked.filter(f"n % 2 = 0 AND n <= {2 * per_class}").select("doc_id", "label"))
    # one text for each id, however often the id is repeated
    texts = docs.join(train, "doc_id").filter("text IS NOT NULL").groupBy("label", "doc_id").agg(F.min("text").alias("text"))
    got = common.map_rows(texts, lambda i, label, text: [(i, label, spread_blocks(text, blocks))], ["doc_id", "label", "text"], "doc_id long, label int, parts array<binary>")
    got = got.toPandas().sort_values(["label", "doc_id"])
    good, bad = (_dictionary([bytes(b) for parts in got.loc[got["label"] == k, "parts"] for b in parts], dictionary_bytes) for k in (1, 0))
    if good is None or bad is None:
        return Model(None, None, (), base)
    held = F.broadcast(ranked.filter(f"n % 2 = 1 AND n <= {calibrate}").select("doc_id", "label"))
    sizes = common.map_rows(docs.join(held, "doc_id"), lambda s, i, label, text: [(i, label, *s.of(text or ""))], ["doc_id", "label", "text"], "doc_id long, label int, length long, good long, bad long", setup=lambda: Sizes(good, bad))
    measured = sizes.groupBy("doc_id", "label").agg(F.min(F.struct("length", "good", "bad")).alias("s")).select("label", "s.*").toPandas().sort_values(["label", "length", "good", "bad"])
    if measured["label"].nunique() < 2:
        return Model(None, None, (), base)
    x = np.array([features(*r) for r in measured[["length", "good", "bad"]].itertuples(index=False)])
    y = measured["label"].to_numpy(float)
    w = fit_logistic(x, y)
    # the sample holds as many of either label as it can; move the intercept back to the shares of all labels
    share = y.mean()
    w[0] += np.log(base / (1 - base)) - np.log(share / (1 - share))
    return Model(good, bad, tuple(float(v) for v in w), base)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) per row of ``docs``: probability that its text is good. A narrow map; the dictionaries travel
    with the task, two times ``dictionary_bytes``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def setup():
        known = shared.value
        return known, Sizes(known.good, known.bad) if known.good else None

    def judge(state, doc_id, text):
        known, sizes = state
        if not text or sizes is None:
            yield doc_id, known.base_rate
            return
        z = float(np.dot(features(*sizes.of(text)), known.coefficients))
        yield doc_id, 1 / (1 + np.exp(-min(max(z, -30.0), 30.0)))

    return common.map_rows(docs, judge, ["doc_id", "text"], "doc_id long, score double", setup=setup)
