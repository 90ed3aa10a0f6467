"""Learned scores: held-out accuracy, and the solver against its optimum."""

import random

import numpy as np
import pyarrow as pa

from tests.llm.helpers import docs, rows_of
from tidemark.llm import labelled as lb
from tidemark.llm import quality, toxicity

R = random.Random(9)
VOCAB = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 7))) for _ in range(300)]


def labelled(n=400):
    """(documents, labels): toxic ones hold an insult, poor ones are shouted."""
    rows, labels = [], []
    for i in range(n):
        w = [R.choice(VOCAB) for _ in range(R.randint(20, 80))]
        toxic, good = int(R.random() < 0.3), int(R.random() < 0.7)
        if toxic:
            w[R.randrange(len(w))] = R.choice(["nitwit", "nitwits", "blockhead"])
        text = " ".join(w) if good else "!! ".join(w).upper()
        rows.append((i, text, "s"))
        labels.append((i, good, toxic))
    return rows, labels


ROWS, LABELS = labelled()


def accuracy(df, which):
    truth = {i: (good, toxic)[which] for i, good, toxic in LABELS}
    held = [(r["predicted"], truth[r["doc_id"]]) for r in df.collect() if r["held_out"]]
    assert len(held) > 30
    return sum(p == t for p, t in held) / len(held)


def test_toxicity_held_out(spark):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert accuracy(toxicity.score_documents(docs(spark, ROWS, True), labels), 1) > 0.95


def test_quality_held_out(spark):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert accuracy(quality.score_documents(docs(spark, ROWS, True), labels), 0) > 0.95


def test_odd_rows_and_no_labels(spark):
    odd = [(None, "a b", "s"), (1, None, None), (2, "", "s"), (2, "", "s"), (3, "x" * 200_000, "s"), (4, "idiot " * 50_000, "s")]
    none = spark.createDataFrame([(None, None, None)], "doc_id long, quality int, toxic int")
    for f in (toxicity.score_documents, quality.score_documents):
        got = rows_of(f(docs(spark, odd), none))
        assert len(got) == 6 and all(r[2] == 0.5 and r[3] == 1 for r in got)
        assert f(docs(spark, []), none).count() == 0
    assert quality.keep_good(docs(spark, odd), none).columns == docs(spark, odd).columns


def test_labels_of_held_out_rows_are_not_used(spark):
    def flipped(folds, out):
        return spark.createDataFrame([(i, 1 - g if lb_out(i, folds) == out else g, 1 - t if lb_out(i, folds) == out else t) for i, g, t in LABELS], "doc_id long, quality int, toxic int")

    import zlib

    def lb_out(i, folds):
        return zlib.crc32(str(i).encode()) % folds

    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    for f, folds, out in ((toxicity.score_documents, 4, 2), (quality.score_documents, 5, 0)):
        assert rows_of(f(docs(spark, ROWS), labels)) == rows_of(f(docs(spark, ROWS), flipped(folds, out)))


def test_machine_is_a_factorization_machine():
    rng = np.random.default_rng(1)
    size = 1 << lb.BITS
    m = toxicity.Machine(0.3, np.zeros(size), np.zeros((size, 3)))
    at = rng.choice(size, 6, replace=False)
    m.w[at], m.v[at] = rng.normal(size=6), rng.normal(size=(6, 3))
    want = 0.3 + m.w[at].sum() + sum(m.v[at[i]] @ m.v[at[j]] for i in range(6) for j in range(i))
    assert np.isclose(m.margin(2, np.zeros(6, int), at)[0], want)
    assert np.isclose(m.margin(2, np.zeros(6, int), at)[1], 0.3)


def test_pairs_matter():
    """Two words are harmless alone and toxic together: only an interaction can tell."""
    rng = np.random.default_rng(2)
    rows, y = [], []
    for _ in range(2000):
        a, b = rng.random(2) < 0.5
        rows.append(np.array(sorted([1] * int(a) + [2] * int(b) + [int(10 + rng.integers(30))])))
        y.append(int(a != b))
    m = toxicity.fit(rows, np.array(y))
    got = m.score(4, np.array([1, 2, 3, 3]), np.array([1, 2, 1, 2]))
    assert got[1] > 0.6 and got[2] > 0.6 and got[3] < 0.3


def test_an_insult_counts_more_next_to_a_group():
    """Neither word is worse than chance alone; with each other they are, among many more."""
    rng = np.random.default_rng(4)
    rows, y = [], []
    for _ in range(6000):
        insult, group = rng.random(2) < 0.1
        noise = 10 + np.flatnonzero(rng.random(400) < 0.1)
        rows.append(np.array(sorted([1] * int(insult) + [2] * int(group) + noise.tolist())))
        y.append(int(rng.random() < (0.95 if insult and group else 0.1)))
    m = toxicity.fit(rows, np.array(y))
    assert m.v[1] @ m.v[2] > 1
    got = m.score(4, np.array([1, 2, 3, 3]), np.array([1, 2, 1, 2]))
    assert got[3] > 0.6 and max(got[:3]) < 0.4


def test_scores_of_the_query_are_those_of_the_formula(spark):
    """A whole query against its formula, written out word by word."""
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    df = docs(spark, ROWS)
    truth = dict(zip([r[0] for r in ROWS], [r[1] for r in ROWS]))
    m = toxicity.fit(*lb.sample(df, labels, "toxic", 4, 2, toxicity.ROWS, lb.word_features))
    q = quality.fit_documents(df, labels)
    for found, model in ((toxicity.score_documents(df, labels), "fm"), (quality.score_documents(df, labels), "svm")):
        for r in found.collect()[::7]:
            features = lb.word_features if model == "fm" else lb.shape_features
            at = [p for *_, places in features(pa.array([truth[r["doc_id"]]])) for p in places.tolist()]
            if model == "fm":
                x = m.bias + sum(m.w[i] for i in at) + sum(float(m.v[i] @ m.v[j]) for k, i in enumerate(at) for j in at[:k])
            else:
                norm = sum(float(q.ratio[i]) ** 2 for i in at) ** 0.5
                x = q.slope * (sum(float(q.ratio[i]) * float(q.weight[i]) for i in at) / norm + q.bias) + q.shift
            want = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
            assert abs(r["score"] - want) < 1e-5 and r["predicted"] == int(r["score"] >= 0.3)


def test_hinge_dual_reaches_the_optimum():
    rng = np.random.default_rng(3)
    rows = [np.arange(4) for _ in range(60)]
    x = rng.normal(size=(60, 4))
    y = np.sign(x @ np.array([1.0, -2, 0.5, 0]) + 0.3 * rng.normal(size=60))
    old, quality.EPOCHS = quality.EPOCHS, 400
    try:
        w = quality.hinge_dual(rows, list(x), y, np.ones(60), 4)
    finally:
        quality.EPOCHS = old

    def loss(w):
        return 0.5 * w @ w + np.maximum(0, 1 - y * (x @ w[:-1] + w[-1])).sum()

    best = loss(w)
    assert all(best <= loss(w + d) + 1e-2 for d in rng.normal(0, 0.05, (300, 5)))


def test_features_do_not_cross_documents():
    texts = pa.array(["ab cd", None, "ef ef ef"])
    got = [(first, n, doc, place) for first, n, doc, place in lb.shape_features(texts)]
    alone = [set(p.tolist()) for t in ("ab cd", "ef ef ef") for _, _, _, p in lb.shape_features(pa.array([t]))]
    doc, place = got[0][2], got[0][3]
    assert set(place[doc == 0].tolist()) == alone[0] and set(place[doc == 2].tolist()) == alone[1] and not (doc == 1).any()
