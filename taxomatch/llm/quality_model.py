"""Quality classifier: a regularised quadratic discriminant.

Each text becomes a short vector of transformed statistics.  Per class a mean
and a covariance are gathered by Spark as sums over all training rows (the
driver receives a few hundred numbers, however many rows there are), the
covariances are shrunk towards the pooled one and towards the identity, and
their Cholesky factors are kept in the model.  A score is the logistic of the
difference of the two Gaussian log-densities (squared Mahalanobis distances by
one triangular product each) plus the log prior odds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxomatch.llm.common import with_ids, with_text_columns
from taxomatch.llm.quality_rules import STOP_WORDS

FEATURES = (
    "log_words", "word_length", "symbols", "shouts", "capitals", "digits", "stops", "distinct",
    "echoes", "stop_words", "repeated_lines", "line_words", "long_words",
)
STOPS = frozenset(w.encode() for w in STOP_WORDS)
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text (null and texts without a
    word: all zero).  Rates go through square roots, counts through logarithms."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    size = len(data)
    count = lambda chars: size - len(data.translate(None, chars))
    capitals, small = count(UPPER), count(LOWER)
    lines = data.split(b"\n")
    lowered = data.lower().split()
    return [
        math.log1p(n),
        math.log(sum(map(len, words)) / n),
        math.sqrt(count(b"#*$%&|<>") / n),
        math.sqrt(count(b"!?") / n),
        math.sqrt(capitals / (capitals + small + 1)),
        math.sqrt(count(b"0123456789") / size),
        math.sqrt(count(b".,;:") / n),
        math.log(len(set(words)) / n),
        math.sqrt(sum(map(eq, words, islice(words, 1, None))) / n),
        math.sqrt(sum(map(STOPS.__contains__, lowered)) / n),
        math.sqrt(1 - len(set(lines)) / len(lines)),
        math.log(n / len(lines)),
        math.log(max(map(len, words))),
    ]


@dataclass
class Model:
    """Per class (0, 1): mean, inverse Cholesky factor and constant of the
    log-density, over statistics centred by ``shift`` and scaled by ``scale``."""

    shift: np.ndarray
    scale: np.ndarray
    means: list
    factors: list
    constants: list
    log_odds: float
    temperature: float
    few_words: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.means:  # one class only: the share of label 1
            return np.full(len(x), 1 / (1 + math.exp(-self.log_odds)))
        z = (x - self.shift) / self.scale
        density = [c - 0.5 * np.square((z - m) @ f.T).sum(axis=1)
                   for m, f, c in zip(self.means, self.factors, self.constants)]
        n = np.maximum(np.expm1(x[:, 0]), 0)
        weight = np.where(n > 0, n / np.maximum(n + self.few_words, 1e-9), 1.0)
        logit = weight * (density[1] - density[0]) / self.temperature + self.log_odds
        return 1 / (1 + np.exp(-np.clip(logit, -700, 700)))


def with_statistics(df: DataFrame, text: str = "text", out: str = "statistics") -> DataFrame:
    """Add ``out``: the statistics of the text (``array<double>``)."""
    new = T.StructType().add(out, T.ArrayType(T.DoubleType()))
    kind = pa.list_(pa.float64())
    return with_text_columns(
        df, text, new, lambda: lambda texts: [pa.array([statistics(t) for t in texts.to_pylist()], kind)])


def fit(rows: DataFrame, shrink_pooled: float = 0.2, shrink_identity: float = 0.02,
        temperature: float = 8.0, few_words: float = 10.0) -> Model:
    """Fit on all ``rows`` (``statistics``, ``label`` 0 or 1; others are left out).

    Sums of each class are made per partition and added up by Spark; only the
    d + d * (d + 1) / 2 sums of a class reach the driver.  With under two rows
    in a class there is no discriminant and each score is the share of label 1
    (0.5 without rows).  ``shrink_pooled`` and ``shrink_identity`` are the weights
    of the pooled covariance and of the identity in scaled units;
    ``temperature`` softens the log-density difference, which takes the words of
    a text as independent; a text of n words counts with n / (n + ``few_words``) of
    it, since rates over a handful of words say little (a text without words
    is judged in full).
    """
    d = len(FEATURES)
    upper = np.triu_indices(d)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + len(upper[0])))
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            y = b.column(1).to_numpy(zero_copy_only=False)
            for c in (0, 1):
                own = x[y == c]
                total[c, 0] += len(own)
                total[c, 1 : 1 + d] += own.sum(axis=0)
                total[c, 1 + d :] += (own.T @ own)[upper]
        for c in (0, 1):
            yield pa.RecordBatch.from_pydict({
                "label": pa.array(np.full(total.shape[1], c), pa.int32()),
                "place": pa.array(np.arange(total.shape[1]), pa.int32()),
                "total": pa.array(total[c])})

    use = rows.where(F.col("label").isin(0, 1)).select("statistics", F.col("label").cast("int").alias("label"))
    parts = use.mapInArrow(sums, "label int, place int, total double")
    got = np.zeros((2, 1 + d + len(upper[0])))
    for r in parts.groupBy("label", "place").agg(F.sum("total").alias("total")).collect():
        got[r.label, r.place] = r.total

    n = got[:, 0]
    odds = math.log((n[1] + 0.5) / (n[0] + 0.5))
    if n.min() < 2:
        return Model(np.zeros(d), np.ones(d), [], [], [], odds, temperature, few_words)

    def covariance(counts: float, s: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        square = np.zeros((d, d))
        square[upper] = products
        square = square + np.triu(square, 1).T
        mean = s / counts
        return mean, square / counts - np.outer(mean, mean)

    both = got.sum(axis=0)
    shift, all_rows = covariance(both[0], both[1 : 1 + d], both[1 + d :])
    scale = np.sqrt(np.maximum(np.diag(all_rows), 1e-12))
    scale[scale < 1e-5] = 1.0
    own = [covariance(n[c], got[c, 1 : 1 + d], got[c, 1 + d :]) for c in (0, 1)]
    means = [(m - shift) / scale for m, _ in own]
    scaled = [v / np.outer(scale, scale) for _, v in own]
    pooled = (n[0] * scaled[0] + n[1] * scaled[1]) / n.sum()
    factors, constants = [], []
    for v in scaled:
        shrunk = (1 - shrink_pooled) * v + shrink_pooled * pooled
        shrunk = (1 - shrink_identity) * shrunk + shrink_identity * np.eye(d)
        low = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(low))
        constants.append(-float(np.log(np.diag(low)).sum()))
    return Model(shift, scale, means, factors, constants, odds, temperature, few_words)


def with_score(df: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """Add ``out`` from the ``statistics`` column."""
    @F.pandas_udf("double")
    def of(s: pd.Series) -> pd.Series:
        x = np.array(s.tolist(), float).reshape(len(s), len(FEATURES))
        return pd.Series(model.scores(x))

    return df.withColumn(out, of("statistics"))


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(stats: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(statistics, label) of the labelled rows that are not held out.  Of
    several labels of one id the smallest counts; a null id or label is left out."""
    own = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
           .groupBy("doc_id").agg(F.min(label).alias("label")))
    return stats.where(~held_out(F.col("doc_id"))).select("doc_id", "statistics").join(own, "doc_id").select(
        "statistics", "label")


def predict(df: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Add ``predicted`` (1 if the score is at least ``threshold``)."""
    return df.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))


def keep_good(df: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``df`` (doc_id, text and any other columns) that the classifier,
    fitted on the labelled rows among them, predicts to be good.  Texts without
    a word are scored like any other; every row is judged by itself."""
    ids = labels.select("doc_id").where("doc_id IS NOT NULL").distinct()
    train = with_statistics(with_ids(df.select("doc_id", "text"), ids)).drop("text")
    model = fit(training_rows(train, labels))
    score, kind = "_quality_score", T.StructType().add("_quality_score", "double")

    def maker():
        def of(texts: pa.Array) -> list[pa.Array]:
            x = np.array([statistics(t) for t in texts.to_pylist()], float).reshape(len(texts), len(FEATURES))
            return [pa.array(model.scores(x))]

        return of

    return with_text_columns(df, "text", kind, maker).where(F.col(score) >= threshold).drop(score)
