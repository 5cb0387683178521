"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Each text becomes a short vector of transformed statistics (shares of marks and capitals, repeats, line and word lengths), taken from the
whole text. Spark adds up counts, sums and products per class; from them the driver forms class means and covariances of a fixed, small
size. Each covariance is shrunk towards the pooled one and that towards a multiple of the identity. The Cholesky factors are computed
once; a score is the logistic of the difference of the two Gaussian log densities, from Mahalanobis distances, plus the log ratio of the
class shares, tempered because statistics of one text are not independent.

Edges: null and empty texts have the vector of an empty text and a score like any other. Labels without a document or with a null quality are
ignored; of several labels for one key the lowest counts. With one class only, or none, the score is that class's smoothed share. Repeated
rows are scored each. An empty table gives an empty result. Extra columns are kept by ``keep``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_of, materialize, slices

CUTOFF = 0.7
#: Share of the pooled covariance in each class's, and of the scaled identity in the pooled one.
TO_POOLED, TO_IDENTITY = 0.2, 0.02
TEMPER = 0.5
MARKS = b"#*$%&<>"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = b"0123456789"
NAMES = ("length", "marks", "bangs", "bars", "capitals", "digits", "other_points", "word_length", "same_neighbours", "distinct", "dup_lines", "line_words")


def statistics(text: str | None) -> list[float]:
    """The vector of NAMES. Shares enter as logarithms, so that one mark in a long text and none are told apart, but not by much."""
    data = (text or "").encode("utf-8")
    n = max(1, len(data))
    words = data.split()
    m = max(1, len(words))
    lines = [line for line in data.split(b"\n") if line]
    among = lambda some: n - len(data.translate(None, some)) if data else 0
    share = lambda count, of: float(np.log1p(200.0 * count / of))
    return [
        float(np.log1p(len(words))),
        share(among(MARKS), n),
        share(data.count(b"!"), n),
        share(data.count(b"|"), n),
        share(among(CAPITALS), n),
        share(among(DIGITS), n),
        share(among(b".,;:?()"), n),
        float(np.log1p(sum(map(len, words)) / m)),
        share(sum(map(eq, words, words[1:])), m),
        # Long texts repeat words anyway: distinct words against the number that grows with the root of the length.
        float(np.log1p(len(set(words))) - 0.8 * np.log1p(len(words))),
        share(len(lines) - len(set(lines)), max(1, len(lines))),
        float(np.log1p(len(words) / max(1, len(lines)))),
    ]


@dataclass
class Discriminant:
    means: list[np.ndarray]
    inverses: list[np.ndarray]  # of the lower Cholesky factors
    offset: float  # half the difference of the log determinants
    prior: float  # log ratio of the class shares

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(vectors), 1 / (1 + np.exp(-self.prior)))
        far = [(((vectors - mean) @ inverse.T) ** 2).sum(axis=1) for mean, inverse in zip(self.means, self.inverses)]
        logit = TEMPER * (0.5 * (far[0] - far[1]) + self.offset) + self.prior
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def discriminant(counts: list[int], sums: list[np.ndarray], products: list[np.ndarray]) -> Discriminant:
    """The model of two classes from their counts, sums and sums of products."""
    prior = float(np.log((counts[1] + 1) / (counts[0] + 1)))
    if min(counts) < 2:
        return Discriminant([], [], 0.0, prior)
    means = [s / c for s, c in zip(sums, counts)]
    scatters = [p - c * np.outer(m, m) for p, c, m in zip(products, counts, means)]
    pooled = sum(scatters) / sum(counts)
    size = len(pooled)
    pooled = (1 - TO_IDENTITY) * pooled + TO_IDENTITY * np.eye(size) * max(float(np.trace(pooled)) / size, 1e-6)
    factors = [np.linalg.cholesky((1 - TO_POOLED) * s / c + TO_POOLED * pooled) for s, c in zip(scatters, counts)]
    logs = [float(np.log(np.diag(f)).sum()) for f in factors]
    return Discriminant(means, [np.linalg.inv(f) for f in factors], logs[0] - logs[1], prior)


def measured() -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 512):
            vectors = [statistics(t) for t in part.column(1).to_pylist()]
            yield pa.record_batch({"key": part.column(0), "vector": pa.array(vectors, pa.list_(pa.float64()))})

    return run


def document_vectors(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, vector) of every row."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(measured(), f"key {kind}, vector array<double>")


def fit(vectors: DataFrame, labels: DataFrame, key: str = "doc_id", quality: str = "quality") -> Discriminant:
    """The model from (key, vector) rows and their labels; what reaches the driver has the size of one covariance per class."""
    size = len(NAMES)
    marks = labels.where(F.col(quality).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(quality).alias("good"))
    known = vectors.join(marks, "key").select((F.col("good") >= 1).alias("good"), "vector")
    at = lambda i: F.get("vector", F.lit(i))
    sums = [F.sum(at(i)).alias(f"s{i}") for i in range(size)]
    products = [F.sum(at(i) * at(j)).alias(f"p{i}_{j}") for i in range(size) for j in range(i + 1)]
    found = {row["good"]: row for row in known.groupBy("good").agg(F.count(F.lit(1)).alias("n"), *sums, *products).collect()}
    counts, totals, squares = [], [], []
    for good in (False, True):
        row = found.get(good)
        counts.append(row["n"] if row else 0)
        totals.append(np.array([row[f"s{i}"] if row else 0.0 for i in range(size)]))
        squares.append(np.array([[row[f"p{max(i, j)}_{min(i, j)}"] if row else 0.0 for j in range(size)] for i in range(size)]))
    return discriminant(counts, totals, squares)


def scored(model: Discriminant, of_text: bool) -> Callable[[Column], Column]:
    """Score of a column of vectors, or of texts."""

    def run(values: pd.Series) -> pd.Series:
        if not len(values):
            return pd.Series([], dtype="float64")
        return pd.Series(model.scores(np.array([statistics(v) for v in values] if of_text else [list(v) for v in values])))

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")


def learnable(column: str) -> Column:
    """Whether the labels of a key may be learnt from: crc32 of the key as text, modulo 4, is not 2."""
    return F.pmod(crc32_of(F.col(column)), F.lit(4)) != 2


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """(key, held_out, score, predicted) of every row; texts are read once, their vectors are stored."""
    vectors = materialize(document_vectors(docs, key, text))
    model = fit(vectors, labels.where(learnable(key)), key)
    return vectors.select(F.col("key").alias(key), F.coalesce(~learnable("key"), F.lit(False)).alias("held_out"), scored(model, False)("vector").alias("score")).withColumn(
        "predicted", (F.col("score") >= cutoff).cast("int")
    )


def keep(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` that score at least ``cutoff``. Texts are read twice, to fit and to score, and never shuffled."""
    model = fit(document_vectors(docs, key, text), labels.where(learnable(key)), key)
    return docs.where(scored(model, True)(F.col(text)) >= cutoff)
