"""Toxicity by a factorization machine over hashed words.

score = sigmoid(bias + sum_i w_i + sum_{i<j} <v_i, v_j>) over the distinct words
of a text and their ends: besides a weight for each word there is one for each pair, so that an
insult next to the mention of a group may count for more than both alone. The
machine is fitted with logistic loss and AdaGrad on at most ``ROWS`` labelled
rows on the driver; every document is then scored in one scan without a shuffle.
The model is 2**18 places of 1 + 8 numbers, whatever the corpus.

Chance gives most words some association with the label in so few rows. Fitted are
the words whose own association is significant and those of a significant pair:
words that tell little alone, but more together than each of them and than both
effects added up. Their weights and factors all take part in the fit.

Defined cases: a null or empty text has no words and scores by the bias alone;
without labelled rows the score is 0.5 everywhere; rows that repeat are scored one
by one; a null id is not held out. Columns but ``doc_id`` and ``text`` are unread.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import labelled as lb
from tidemark.llm.scratch import partitions

ROWS, FACTORS, EPOCHS, BATCH, RATE, DECAY = 12_000, 8, 40, 256, 0.1, 2e-5
#: Chi-square from which on a place is fitted for its own association with the label
#: (p = 0.001), and one for that of a pair of places in at least so many rows (p = 2e-9,
#: for there are millions of pairs). Places that are paired with all others.
CHI, PAIR_CHI, PAIR_ROWS, STRONG = 10.83, 36.0, 20, 512
FOLDS, OUT, CUT = 4, 2, 0.3


@dataclass
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray

    def margin(self, n: int, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
        m = self.bias + np.bincount(doc, self.w[place], n)
        for f in range(self.v.shape[1]):
            x = self.v[place, f]
            m += 0.5 * (np.bincount(doc, x, n) ** 2 - np.bincount(doc, x * x, n))
        return m

    def score(self, n: int, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(n, doc, place), -30, 30)))


def _dense(rows: list[np.ndarray], column: np.ndarray, width: int) -> np.ndarray:
    """Rows of 0 and 1; ``column`` of a place is its column, -1 if it has none."""
    doc, at = lb.csr(rows)
    at = column[at]
    x = np.zeros((len(rows), width), np.float32)
    x[doc[at >= 0], at[at >= 0]] = 1
    return x


def paired(rows: list[np.ndarray], y: np.ndarray, seen: np.ndarray, toxic: np.ndarray, chi: np.ndarray) -> np.ndarray:
    """The places of pairs on which the label depends in another way than on either
    place alone and than on both effects added up. Pairs are of one of the ``STRONG``
    places of the greatest chi-square and any other of at least ``PAIR_ROWS`` rows."""
    used = np.flatnonzero(seen >= PAIR_ROWS)
    strong = used[np.argsort(-chi[used], kind="stable")[:STRONG]]
    base = (y.sum() + 0.5) / (len(y) + 1)
    rate = lambda at: ((toxic[at] + base) / (seen[at] + 1)).astype(np.float32)
    odds = lambda p: np.log(p / (1 - p))
    row = np.full(len(seen), -1)
    row[strong] = np.arange(len(strong))
    hit = np.zeros(len(seen), bool)
    for lo in range(0, len(used), 8192):
        part = used[lo : lo + 8192]
        column = np.full(len(seen), -1)
        column[part] = np.arange(len(part))
        n, t = (np.zeros((len(strong), len(part)), np.float32) for _ in range(2))
        for label, sums in ((0, n), (1, t)):
            mine = np.flatnonzero((y > 0) == (label > 0))
            for at in range(0, len(mine), 500):
                some = [rows[i] for i in mine[at : at + 500]]
                sums += _dense(some, row, len(strong)).T @ _dense(some, column, len(part))
        n += t
        p, q = rate(strong)[:, None], rate(part)[None, :]
        least = np.full(n.shape, np.inf, np.float32)
        for e in (p, q, 1 / (1 + np.exp(odds(base) - odds(p) - odds(q)))):
            np.minimum(least, (t - n * e) ** 2 / np.maximum(n * e * (1 - e), np.float32(1)), out=least)
        least[n < PAIR_ROWS] = 0
        hit[strong[(least >= PAIR_CHI).any(axis=1)]] = True
        hit[part[(least >= PAIR_CHI).any(axis=0)]] = True
    return np.flatnonzero(hit)


def fit(rows: list[np.ndarray], y: np.ndarray, seed: int = 7) -> Machine:
    """Fit a machine to rows of places and 0/1 labels. Places of fewer than three
    rows, and those of no significant association, alone or in a pair, stay at zero."""
    size = 1 << lb.BITS
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(size, np.float32), np.zeros((size, FACTORS), np.float32))
    if not len(y):
        return m
    seen, toxic = lb.place_counts(rows, np.ones(len(y))), lb.place_counts(rows, y)
    n, t = float(len(y)), float(y.sum())
    gap = toxic * n - seen * t  # chi-square of the place and the label
    chi = gap**2 * n / np.maximum(seen * (n - seen) * t * (n - t), 1.0)
    fitted = (seen >= 3) & (chi >= CHI)
    fitted[paired(rows, y, seen, toxic, chi)] = True
    used = np.flatnonzero(fitted)
    short = np.full(size, -1)
    short[used] = np.arange(len(used))
    rows = [r[r >= 0] for r in (short[r] for r in rows)]
    w, v = np.zeros(len(used)), rng.normal(0, 0.05, (len(used), FACTORS))
    gw, gv = np.full(len(used), 1e-2), np.full((len(used), FACTORS), 1e-4)
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    bias, gb = float(np.log(rate / (1 - rate))), 1.0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), BATCH):
            pick = order[lo : lo + BATCH]
            doc, at = lb.csr([rows[i] for i in pick])
            n = len(pick)
            vx = v[at]
            sums = np.stack([np.bincount(doc, vx[:, f], n) for f in range(FACTORS)], 1)
            squares = np.stack([np.bincount(doc, vx[:, f] ** 2, n) for f in range(FACTORS)], 1)
            margin = bias + np.bincount(doc, w[at], n) + 0.5 * (sums**2 - squares).sum(1)
            err = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[pick]
            err /= n
            here, inv = np.unique(at, return_inverse=True)
            e = err[doc]
            dw = np.bincount(inv, e, len(here)) + DECAY * w[here]
            gw[here] += dw**2
            w[here] -= RATE * dw / np.sqrt(gw[here])
            dv = np.stack([np.bincount(inv, e * (sums[doc, f] - vx[:, f]), len(here)) for f in range(FACTORS)], 1) + 10 * DECAY * v[here]
            gv[here] += dv**2
            v[here] -= 0.3 * RATE * dv / np.sqrt(gv[here])
            gb += err.sum() ** 2
            bias -= RATE * err.sum() / np.sqrt(gb)
    m.bias = bias
    m.w[used], m.v[used] = w, v
    return m


def score_column(machine: Machine):
    """A scalar Arrow function from text to score."""

    @F.arrow_udf("double")
    def toxicity(texts: pa.Array) -> pa.Array:
        return pa.array(lb.per_text(texts, lb.word_features, machine.score), pa.float64())

    return toxicity


def score_documents(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted."""
    partitions(docs.sparkSession)
    machine = fit(*lb.sample(docs, labels, "toxic", FOLDS, OUT, rows, lb.word_features))
    score = score_column(machine)(F.coalesce(F.col("text").cast("string"), F.lit("")))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score.alias("score"))
    return found.select(
        "doc_id", (lb.remainder(F.col("doc_id"), FOLDS) == OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
