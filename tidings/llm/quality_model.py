"""Quality classifier: regularised quadratic discriminant over transformed statistics of whole texts.

Each class has a mean and a covariance, shrunk towards the covariance of all examples and a multiple of the identity.
Its Cholesky factor is computed once on the driver; tasks score a batch of documents with two triangular products:
score = sigmoid(difference of the Mahalanobis log-densities + log prior ratio).

The model is fitted on at most TRAIN_ROWS labelled rows (a documented bound), one for each labelled id; an id labelled
both ways counts by its majority, 1 if even. Every document is scored, whole and on its own: null and empty texts as texts
without words, repeated rows and rows without doc_id like any other. Other columns are ignored whatever their names. Without
examples of both classes all scores are the share of label 1 (0.5 if none). An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import texts
from tidings.llm.folds import fold, labelled_sample

TRAIN_ROWS = 20_000
#: Shrinkage towards the pooled covariance, then towards the identity (features are standardised).
POOL, RIDGE = 0.2, 0.05
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
DIGITS = b"0123456789"
SYMBOLS = b"#*$%&<>"
STOPS = b".,;:"


def features(text: bytes) -> list[float]:
    """Statistics of a text, transformed to be nearer to a normal distribution."""
    words = text.split()
    n, size = len(words), len(text)
    d = max(1, n)

    def count(chars: bytes) -> int:
        return size - len(text.translate(None, chars))

    letters = count(LETTERS)
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:])))
    same = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    rate = lambda x, by: math.log1p(20.0 * x / max(1, by))
    return [
        math.log1p(n),
        math.log1p(letters / d),
        rate(count(SYMBOLS), d),
        rate(text.count(b"|"), d),
        rate(text.count(b"!"), d),
        rate(count(STOPS), d),
        rate(count(UPPER), letters),
        rate(count(DIGITS), size),
        math.log1p(distinct) / math.log1p(d),
        math.log1p(pairs) / math.log1p(d),
        rate(same, d),
        rate(len(lines) - len(set(lines)), d),
    ]


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    share = float(y.mean()) if len(y) else 0.5
    if len(y) < 2 or not 0 < share < 1:
        return {"share": share}
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = (x - centre) / scale
    pooled = np.cov(z, rowvar=False, bias=True)
    model = {"share": share, "centre": centre, "scale": scale}
    for c in (0, 1):
        own = z[y == c]
        cov = (1 - POOL) * np.cov(own, rowvar=False, bias=True) + POOL * pooled if len(own) > 1 else pooled
        cov = (1 - RIDGE) * cov + RIDGE * np.eye(len(centre))
        chol = np.linalg.cholesky(cov)
        model[c] = (own.mean(axis=0), np.linalg.inv(chol), float(np.log(np.diag(chol)).sum()))
    return model


def score(model: dict, x: np.ndarray) -> np.ndarray:
    if 0 not in model:
        return np.full(len(x), model["share"])
    z = (x - model["centre"]) / model["scale"]
    density = []
    for c in (0, 1):
        mean, inverse, half_log_det = model[c]
        density.append(-0.5 * np.square((z - mean) @ inverse.T).sum(axis=1) - half_log_det)
    logit = density[1] - density[0] + math.log(model["share"] / (1 - model["share"]))
    return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def held_out():
    return fold(F.col("doc_id"), 5) == 0


def trained(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> dict:
    def run(batches):
        for b in batches:
            x = np.array([features(t) for t in texts(b)], float).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b.column(b.schema.get_field_index("y"))], names=["x", "y"])

    got = labelled_sample(docs, labels, "quality", held_out(), rows).select("text", "y").mapInArrow(run, "x array<double>, y int").toPandas()
    got = got.assign(key=got["x"].map(tuple)).sort_values(["key", "y"])  # the same sums in every run
    return fit(np.array(got["x"].tolist(), float), got["y"].to_numpy(float))


def scored(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, rows))  # two small matrices

    def run(batches):
        for b in batches:
            x = np.array([features(t) for t in texts(b)], float).reshape(b.num_rows, -1)
            s = score(model.value, x) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    out = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
