"""Quality classifier: Bradley-Terry pairwise ranking of documents.

A document's strength is a sum of weights, one for the quantile bin each of
its text statistics falls in. Weights are learned from preference pairs (a
good document over a bad one) by logistic loss on the difference of their
features; the cut is the quantile of the strengths at the share of bad
documents, and strengths are mapped to 0..1 so that the cut lies at 0.3.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.llm.common import texts

#: The score at and above which a document is taken for good.
CUT = 0.3
#: Labelled rows that the classifier is fitted on at most, and preference pairs made of them.
SAMPLE, PAIRS = 20_000, 60_000
BINS = 12
_RUN = re.compile(r"(\S)\1\1+")
_KINDS = np.zeros(256, dtype=np.int64)  # byte kinds: 0 other, 1 a-z, 2 A-Z, 3 digit, 4 space, 5 newline, 6 plain punctuation, 7 UTF-8 beyond ASCII
_KINDS[97:123], _KINDS[65:91], _KINDS[48:58], _KINDS[32], _KINDS[10], _KINDS[128:] = 1, 2, 3, 4, 5, 7
_KINDS[[33, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = 6
NAMES = (
    "lower", "upper", "digits", "spaces", "punctuation", "beyond_ascii", "symbols", "bangs", "log_words", "word_length", "word_length_spread",
    "distinct_words", "commonest_word", "repeated_neighbours", "symbol_words", "upper_words", "log_lines", "distinct_lines", "runs", "stops", "pipes",
    "distinct_tail", "short_words", "longest_word",
)


def statistics(text: str) -> list[float]:
    """The text statistics that a score is made of, of the whole text; all 0 for the empty text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = text.split()
    if not words:
        return [0.0] * len(NAMES)
    bytes_of = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    kinds = np.bincount(_KINDS, weights=bytes_of, minlength=8) / len(raw)
    n = len(words)
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=n)
    lines = [x for x in text.split("\n") if x.strip()]
    tail = words[-200:]
    return [
        *(float(kinds[k]) for k in (1, 2, 3, 4, 6, 7, 0)), bytes_of[33] / len(raw), math.log1p(n), float(lengths.mean()), float(lengths.std()),
        len(counts) / n, max(counts.values()) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        sum(k for w, k in counts.items() if not w[-1].isalnum() and w[-1] not in ".,") / n,
        sum(k for w, k in counts.items() if w.isupper()) / n, math.log1p(len(lines)), len(set(lines)) / max(1, len(lines)),
        len(_RUN.findall(text)) / n, bytes_of[46] / n, bytes_of[124] / n, len(set(tail)) / len(tail), float((lengths <= 3).mean()), math.log1p(lengths.max()),
    ]


@dataclass
class Ranking:
    """Bin edges per statistic, a weight per bin, and the line that maps a strength to the log odds of its score."""

    edges: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float

    def strengths(self, stats: np.ndarray) -> np.ndarray:
        return sum(self.weights[k][np.searchsorted(self.edges[k], stats[:, k], side="right")] for k in range(stats.shape[1]))

    def scores(self, stats: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.strengths(stats) + self.offset, -40, 40)))


def fit(stats: np.ndarray, good: np.ndarray, pairs: int = PAIRS, ridge: float = 2.0, seed: int = 7) -> Ranking:
    """Bradley-Terry weights by Newton's method on pairs of a good and a bad row.

    Without rows of both kinds there is nothing to prefer: all scores are then 0.5.
    """
    dims = stats.shape[1]
    edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T if len(stats) else np.zeros((dims, BINS - 1))
    weights = np.zeros((dims, BINS))
    won, lost = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(won) or not len(lost):
        return Ranking(edges, weights, 0.0, 0.0)
    bins = np.stack([np.searchsorted(edges[k], stats[:, k], side="right") + k * BINS for k in range(dims)], axis=1)
    rng = np.random.default_rng(seed)
    a, b = bins[rng.choice(won, pairs)], bins[rng.choice(lost, pairs)]
    w, size = np.zeros(dims * BINS), 4000
    for _ in range(8):
        slope, bend = ridge * w, ridge * np.eye(len(w))
        for lo in range(0, pairs, size):
            x = np.zeros((len(a[lo : lo + size]), len(w)))
            rows = np.arange(len(x))[:, None]
            np.add.at(x, (rows, a[lo : lo + size]), 1.0)
            np.add.at(x, (rows, b[lo : lo + size]), -1.0)
            p = 1 / (1 + np.exp(np.clip(x @ w, -40, 40)))
            slope -= x.T @ p
            bend += (x * (p * (1 - p))[:, None]).T @ x
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-3:
            break
    weights = w.reshape(dims, BINS)
    got = Ranking(edges, weights, 1.0, 0.0)
    s = got.strengths(stats)
    at = float(np.quantile(s, (~good).mean()))
    return Ranking(edges, weights, 1.0, math.log(CUT / (1 - CUT)) - at)


def _described(docs: DataFrame, more: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(x) for x in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in more), pa.array(stats, pa.list_(pa.float64()))], [*more, "stats"])

    schema = docs.select(*more).schema
    return docs.select("text", *more).mapInArrow(run, schema.add("stats", T.ArrayType(T.DoubleType())))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept from learning: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ranking:
    """Fits on at most ``sample`` labelled rows that aren't held out, chosen by a hash of their ids."""
    known = labels.where(F.col("quality").isNotNull() & ~held_out()).select("doc_id", (F.col("quality") == 1).alias("good"))
    share = min(1.0, 0.98 * sample / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000) if share < 1 else F.lit(True)).limit(sample)
    rows = _described(docs.select("doc_id", "text").join(known, "doc_id"), ["doc_id", "good"]).collect()
    rows.sort(key=lambda r: r["doc_id"])
    stats = np.array([r["stats"] for r in rows], dtype=np.float64).reshape(-1, len(NAMES))
    return fit(stats, np.array([r["good"] for r in rows], dtype=bool))


def score(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``; columns of these names are replaced.

    Map only. Null texts count as empty, an empty text has the score of its (all 0) statistics, equal texts equal scores.
    """
    model = docs.sparkSession.sparkContext.broadcast(ranking)
    own = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = np.array([statistics(x) for x in texts(batch.column("text"))]).reshape(-1, len(NAMES))
            s = model.value.scores(stats)
            more = [pa.array(s), pa.array((s >= CUT).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *more], [*own, "score", "predicted"])

    schema = docs.select([F.col(f"`{c}`") for c in own]).schema
    rows = docs.select([F.col(f"`{c}`") for c in own]).mapInArrow(run, schema.add("score", "double").add("predicted", "integer"))
    return rows.withColumn("held_out", held_out())
