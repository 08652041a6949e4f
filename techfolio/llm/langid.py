"""Language identification by mixture inference.

A text is taken as drawn from a mixture of languages. ``learn`` counts hashed character trigrams per language;
``predict`` estimates every text's language proportions by expectation-maximisation over its trigram likelihoods and
selects the set of languages by penalised likelihood (a language stays while it pays for its parameter).

Defined results: null text, or text without letters, is ``und`` with score 0 and no proportions; ties go to the language
that sorts first; repeated rows give a row each; an empty table gives no rows; other columns are ignored. If nothing can
be learned every text is ``und``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

UNDETERMINED = "und"
#: Trigrams fall into so many cells; the model has one weight per language and cell.
CELLS = 1 << 15
#: So many trigrams are hashed at once.
PIECE = 1 << 20


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def letter_codes(text: str) -> np.ndarray:
    """Code points of the lower-cased letters of ``text``, runs of other characters (and both ends) read as one space."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    if not letter.any():
        return np.empty(0, np.uint32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    space = np.array([32], np.uint32)
    return np.concatenate((space, np.where(letter, code, space)[keep], space))


def trigram_cells(code: np.ndarray) -> np.ndarray:
    """Cell of each three neighbours of ``code``."""
    code = code.astype(np.uint64)
    h = (code[:-2] * np.uint64(0x9E3779B97F4A7C15) + code[1:-1]) * np.uint64(0xBF58476D1CE4E5B9) + code[2:]
    h *= np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(64 - 15)).astype(np.int64)


def cell_counts(text: str) -> np.ndarray:
    """Trigrams of the whole text by cell; pieces of a long one share two letters, so none is lost or made up."""
    code = letter_codes(text)
    counts = np.zeros(CELLS, np.int64)
    for low in range(0, len(code) - 2, PIECE):
        counts += np.bincount(trigram_cells(code[low : low + PIECE + 2]), minlength=CELLS)
    return counts


@dataclass(frozen=True)
class Model:
    """``weight[cell, language]`` is the probability of a trigram cell in a language; languages are sorted."""

    langs: tuple[str, ...]
    weight: np.ndarray


def learn(docs: DataFrame, usable: Column, *, per_lang: int = 4000, smoothing: float = 0.5) -> Model:
    """Trigram probabilities per ``lang`` from the rows where ``usable`` holds and ``lang`` is not null.

    At most ``per_lang`` documents of each language are read, those with the smallest hash of their id: a bound on the
    fit alone. Counts are summed in Spark; languages x CELLS numbers reach the driver, whatever the corpus.
    """
    known = docs.filter(usable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang")
    chosen = common.hash_sample(known, "lang", per_lang).select("doc_id", "lang").distinct()
    # per_lang pairs a language: the size is bounded by the parameter
    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").filter("text IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                total[lang] = total.get(lang, 0) + cell_counts(text)
        for lang, counts in total.items():
            cells = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cells), pa.string()), pa.array(cells, pa.int64()), pa.array(counts[cells], pa.int64())], ["lang", "cell", "n"])

    got = rows.select("lang", "text").mapInArrow(common.returning_memory(count), "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    langs = tuple(sorted(got["lang"].unique()))
    weight = np.full((CELLS, len(langs)), smoothing)
    weight[got["cell"].to_numpy(int), got["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy(int)] += got["n"].to_numpy(float)
    return Model(langs, weight / weight.sum(0, keepdims=True))


def proportions(counts: np.ndarray, p: np.ndarray, *, steps: int = 30, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Mixture shares of the columns of ``p`` for trigram ``counts``, and the log-likelihood."""
    share = np.full(p.shape[1], 1 / p.shape[1])
    total = counts.sum()
    for _ in range(steps):
        each = p @ share
        new = share * ((counts / each) @ p) / total
        done = np.abs(new - share).max() < tolerance
        share = new
        if done:
            break
    return share, float(counts @ np.log(p @ share))


def mixture(counts: np.ndarray, p: np.ndarray, *, overlap: float = 3.0) -> np.ndarray:
    """Shares after selection: languages are dropped, smallest share first, while the penalised likelihood improves.

    Overlapping trigrams repeat each other's evidence, so the log-likelihood is divided by ``overlap`` before the
    penalty of half a log of the sample size for each language kept.
    """
    kept = np.arange(p.shape[1])
    share, fit = proportions(counts, p)
    size = np.log(max(counts.sum() / overlap, 2.0))
    score = fit / overlap - 0.5 * size * len(kept)
    while len(kept) > 1:
        # of equal shares the language that sorts last goes
        fewer = np.delete(kept, len(share) - 1 - np.argmin(share[::-1]))
        less, fit = proportions(counts, p[:, fewer]) if len(fewer) > 1 else (np.ones(1), float(counts @ np.log(p[:, fewer[0]])))
        now = fit / overlap - 0.5 * size * len(fewer)
        if now < score:
            break
        kept, share, score = fewer, less, now
    out = np.zeros(p.shape[1])
    out[kept] = share
    return out


def _judge(known: Model, text) -> tuple[str, float, str]:
    counts = cell_counts(text) if text and known.langs else np.zeros(0)
    cells = np.flatnonzero(counts)
    if not len(cells):
        return UNDETERMINED, 0.0, ""
    share = mixture(counts[cells].astype(float), known.weight[cells])
    order = [k for k in np.argsort(-share, kind="stable") if share[k] > 0]
    return known.langs[order[0]], float(min(share[order[0]], 1.0)), ",".join(f"{known.langs[k]}:{share[k]:.4f}" for k in order)


RESULT = "lang_pred string, score double, mixture string"


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, mixture) per row of ``docs`` (doc_id, text); mixture lists ``lang:share`` by share.

    A narrow map; the model travels with the task, languages x CELLS numbers.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return common.map_rows(docs, lambda i, text: [(i, *_judge(shared.value, text))], ["doc_id", "text"], f"doc_id long, {RESULT}")


def keep_identified(docs: DataFrame, model: Model, *, least_share: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text has a language with ``least_share`` or more of it; a null ``lang`` is filled in.

    Undetermined texts and mixtures without a main language are rejected. Columns and their order stay.
    """
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)
    found = common.with_results(docs, lambda text: [_judge(shared.value, text)], ["text"], RESULT)
    kept = found.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least_share))
    lang = F.coalesce(F.col("row").getField("lang"), F.col("lang_pred"))
    return kept.select(*[(lang if c == "lang" else F.col("row").getField(c)).alias(c) for c in names])
