"""A quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance, shrunk towards the pooled one and its diagonal. A score is the logistic of the
difference of the two log densities (half squared Mahalanobis distances and log determinants, from Cholesky factors that
are computed once) plus the log odds of the classes. Moments come from all labelled rows, in one aggregation.

Defined results: a label that is given twice counts once, and a document with two different ones is not learned from; a
null text counts as empty and is scored like any other; where a class has no labelled row the score
is the share of good labels (0.5 without labels); repeated rows come back repeated; an empty table gives an empty result.
Statistics are those of whole texts, whatever their length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_remainder, text_of

FEATURES = ["words", "word_size", "lower", "upper", "digits", "marks", "symbols", "variety", "same_lines", "same_next", "same_fours"]
# Usual shares of lower, upper, digit, mark and symbol characters: few characters say little, so shares start from these.
USUAL = {1: 0.93, 2: 0.02, 3: 0.0, 5: 0.04, 6: 0.0}
_CLASSES: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """For each code point of the basic plane: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 mark, 6 symbol."""
    if not _CLASSES:
        table = np.zeros(1 << 16, np.int64)
        for i in range(1 << 16):
            c = chr(i)
            table[i] = 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c.isspace() else 5 if c in ".,;:!?'\"()-" else 6 if i < 128 and c.isprintable() else 0
        _CLASSES.append(table)
    return _CLASSES[0]


def statistics(text: str) -> list[float]:
    """The transformed statistics of one text, in the order of FEATURES."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    counts = np.bincount(_classes()[np.minimum(points, 0xFFFF)], minlength=7)
    solid = len(points) - int(counts[4])
    words = text.split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    fours = list(zip(words, words[1:], words[2:], words[3:]))  # noqa: B905
    near = sum(a == b for a, b in zip(words, words[1:]))  # noqa: B905
    share = lambda x, of, usual=0.0, weight=40: math.log(0.01 + (x + usual * weight) / (of + weight))
    kinds = [share(int(counts[k]), solid, usual) for k, usual in USUAL.items()]
    repeated = [share(len(lines) - len(set(lines)), len(lines), weight=4), share(near, n), share(len(fours) - len(set(fours)), len(fours))]
    return [math.log(min(max(n, 20), 5000)), math.log((solid + 100) / (n + 20)), *kinds, math.log(len(set(words)) + 20) / math.log(n + 20), *repeated]


def with_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and a double column for each of FEATURES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([statistics(t.as_py()) for t in batch.column("text")]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(made[:, k]) for k in range(len(FEATURES))]], names=["doc_id", *FEATURES])

    narrow = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_of(F.col(f"`{text}`")).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


@dataclass
class Discriminant:
    """log_odds, and for each class (0, 1) its mean, the inverse of its Cholesky factor and half its log determinant."""

    log_odds: float
    means: list[np.ndarray]
    whiteners: list[np.ndarray]
    half_logs: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), 1 / (1 + np.exp(-self.log_odds)))
        density = [-0.5 * (((x - m) @ w.T) ** 2).sum(axis=1) - h for m, w, h in zip(self.means, self.whiteners, self.half_logs, strict=True)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.log_odds, -700, 700)))


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", pooled: float = 0.1, diagonal: float = 0.1) -> Discriminant:
    """Fit on all labelled rows of stats whose doc_id isn't held out (remainder 0 of 5)."""
    own = labels.where(F.col(label).isin(0, 1) & (id_remainder(F.col("doc_id"), 5) != 0))
    own = own.groupBy("doc_id").agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("other")).where("y = other").select("doc_id", "y")
    pairs = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
    sums = [F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)]
    sums += [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i, j in pairs]
    got = {r["y"]: r for r in stats.join(own, "doc_id").groupBy("y").agg(F.count("*").alias("n"), *sums).collect()}
    n = {y: got[y]["n"] if y in got else 0 for y in (0, 1)}
    if not (n[0] and n[1]):
        return Discriminant(float(np.log((n[1] + 1) / (n[0] + 1))), [], [], [])
    means, covs = [], []
    for y in (0, 1):
        mean = np.array([got[y][f"s{i}"] for i in range(len(FEATURES))]) / n[y]
        second = np.zeros((len(FEATURES), len(FEATURES)))
        for i, j in pairs:
            second[i, j] = second[j, i] = got[y][f"p{i}_{j}"] / n[y]
        means.append(mean)
        covs.append(second - np.outer(mean, mean))
    both = sum(n[y] * covs[y] for y in (0, 1)) / (n[0] + n[1])
    whiteners, half_logs = [], []
    for c in covs:
        c = (1 - pooled) * c + pooled * both
        c = (1 - diagonal) * c + diagonal * np.diag(np.diag(c)) + 1e-4 * np.eye(len(FEATURES))
        factor = np.linalg.cholesky(c)
        whiteners.append(np.linalg.inv(factor))
        half_logs.append(float(np.log(np.diag(factor)).sum()))
    return Discriminant(float(np.log(n[1] / n[0])), means, whiteners, half_logs)


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; texts are read once."""
    stats = cut(with_statistics(docs, doc_id, text))
    model = fit(stats, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([np.asarray(batch.column(f)) for f in FEATURES], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    made = stats.mapInArrow(run, "doc_id long, score double")
    return made.select("doc_id", (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
