"""Text quality by a support vector machine on naive Bayes features.

Features are indicators of n-grams (``labelled.shape_features``), each scaled by
its class log-count ratio, log((p / |p|) / (q / |q|)), where p and q count it in
rows of quality 1 and 0, plus one. A row has length one. A linear hinge-loss
model is fitted to them by dual coordinate descent, on three quarters of at most
``ROWS`` labelled rows on the driver; the last quarter sets the sigmoid that turns
a margin into a score. Every document is scored in one scan without a shuffle.

Defined cases: a null or empty text has no n-grams and scores by the sigmoid at
margin 0; without labelled rows, or with one class only, the score is the share
of quality 1 (0.5 without rows); repeated rows are scored one by one; a null id
is held out, its remainder counts as 0. Other columns are unread.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import labelled as lb
from tidemark.llm.scratch import partitions

ROWS, EPOCHS, COST = 8_000, 12, 1.0
FOLDS, OUT, CUT = 5, 0, 0.3


@dataclass
class Model:
    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, n: int, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
        r = self.ratio[place]
        norm = np.sqrt(np.bincount(doc, r * r, n))
        return np.bincount(doc, r * self.weight[place], n) / np.maximum(norm, 1e-9) + self.bias

    def score(self, n: int, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(n, doc, place) + self.shift, -30, 30)))


def hinge_dual(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, size: int, seed: int = 3) -> np.ndarray:
    """Weights (the last is the bias) of a linear model with L2 penalty and hinge
    loss; ``cost`` bounds the dual variable of each row. One coordinate at a time."""
    rng = np.random.default_rng(seed)
    w, alpha = np.zeros(size + 1), np.zeros(len(y))
    diag = np.array([float(v @ v) for v in values]) + 1.0
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(len(y)):
            at, v = rows[i], values[i]
            slack = y[i] * (float(v @ w[at]) + w[-1]) - 1
            new = min(max(alpha[i] - slack / diag[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[at] += step * y[i] * v
                w[-1] += step * y[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


def _sigmoid(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve that fits y best (Newton steps, light prior)."""
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    ab = np.array([1.0, 0.0])
    x = np.stack([margin, np.ones(len(margin))], 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        grad = x.T @ (p - t) + 1e-3 * ab
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), grad)
        ab = ab - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(ab[0]), float(ab[1])


def fit(rows: list[np.ndarray], y: np.ndarray) -> Model:
    """Fit a model to rows of places and 0/1 labels."""
    size = 1 << lb.BITS
    none = np.zeros(size, np.float32)
    share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    if len(np.unique(y)) < 2:
        return Model(none, none, 0.0, 0.0, float(np.log(share / (1 - share))))
    rng = np.random.default_rng(5)
    order = rng.permutation(len(y))
    cut = len(y) - len(y) // 4
    if len(y) < 40 or len(np.unique(y[order[:cut]])) < 2:
        cut = len(y)
    train, test = order[:cut], order[cut:] if cut < len(y) else order
    picked = [rows[i] for i in train]
    p, q = 1.0 + lb.place_counts(picked, y[train]), 1.0 + lb.place_counts(picked, 1 - y[train])
    seen = p + q - 2 >= min(3, cut)
    ratio = np.where(seen, np.log((p / p.sum()) / (q / q.sum())), 0.0).astype(np.float32)

    def unit(row: np.ndarray) -> np.ndarray:
        v = ratio[row]
        return v / max(1e-9, float(np.sqrt(v @ v)))

    sign = np.where(y[train] > 0, 1.0, -1.0)
    balance = np.where(sign > 0, 0.5 / max(1e-3, (sign > 0).mean()), 0.5 / max(1e-3, (sign < 0).mean()))
    w = hinge_dual(picked, [unit(r) for r in picked], sign, COST * 10 * balance, size)
    model = Model(ratio, w[:-1].astype(np.float32), float(w[-1]), 1.0, 0.0)
    margins = [model.margin(len(part), *lb.csr([rows[i] for i in part])) for part in (test[k : k + 500] for k in range(0, len(test), 500))]
    model.slope, model.shift = _sigmoid(np.concatenate(margins), y[test])
    return model


def score_column(model: Model):
    """A scalar Arrow function from text to score."""

    @F.arrow_udf("double")
    def quality(texts: pa.Array) -> pa.Array:
        return pa.array(lb.per_text(texts, lb.shape_features, model.score), pa.float64())

    return quality


def fit_documents(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model:
    """A model of the labelled rows that are not held out."""
    return fit(*lb.sample(docs, labels, "quality", FOLDS, OUT, rows, lb.shape_features))


def score_documents(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted."""
    partitions(docs.sparkSession)
    score = score_column(fit_documents(docs, labels, rows))(F.coalesce(F.col("text").cast("string"), F.lit("")))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score.alias("score"))
    return found.select(
        "doc_id", (lb.remainder(F.col("doc_id"), FOLDS) == OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """The documents that the model accepts, with all columns."""
    score = score_column(fit_documents(docs, labels, rows))
    return docs.filter(score(F.coalesce(F.col("text").cast("string"), F.lit(""))) >= CUT)
