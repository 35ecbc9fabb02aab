"""The chain of the registered query against dense regressions over sets of words."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.llm import queries, toxicity
from lexweave.llm.quality import CLASSES

LOWER = {i: i + 32 for i in range(65, 91)}
WORD, VISIBLE = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "[^\x20\x09-\x0d]+"


def features(text):
    """Words, and the character classes of what stands between blanks."""
    text = text or ""
    shapes = {("shape", tuple(CLASSES[np.frombuffer(w.encode(), np.uint8)].tolist())) for w in re.findall(VISIBLE, text)}
    return set(re.findall(WORD, text.translate(LOWER))) | shapes


def regression(sets, label, earlier):
    """Log-odds as a function of feature sets and earlier log-odds; Newton's method on the dense design."""
    n, positive = len(sets), label.sum()
    if label.min() == label.max():
        prior = np.log((positive + 0.5) / (n + 1) / (1 - (positive + 0.5) / (n + 1)))
        return lambda some, before: np.full(len(some), prior)
    seen, both = {}, {}
    for own, y in zip(sets, label, strict=True):
        for f in own:
            seen[f] = seen.get(f, 0) + 1
            both[f] = both.get(f, 0) + y
    chosen = []
    for f, s in seen.items():
        if toxicity.LEAST <= s < n:
            expected = s * positive / n
            value = (both[f] - expected) ** 2 / max(expected * (1 - s / n) * (n - positive) / n, 1e-12)
            if value >= toxicity.CLEAR:
                chosen.append(f)
    assert len(chosen) <= toxicity.WORDS
    ratio = np.array([np.log((both[f] + 0.5) / (positive + 1)) - np.log((seen[f] - both[f] + 0.5) / (n - positive + 1)) for f in chosen])
    scale = np.maximum(np.abs(earlier).max(axis=0, initial=1.0), 1.0)

    def design(some, before):
        words = np.array([[f in own for f in chosen] for own in some], float).reshape(len(some), len(chosen)) * ratio
        return np.column_stack([words, before / scale, np.ones(len(some))])

    x, theta = design(sets, earlier), np.zeros(len(chosen) + earlier.shape[1] + 1)
    ridge = np.full(len(theta), toxicity.RIDGE)
    ridge[-1] = 0
    theta[-1] = np.log(label.mean() / (1 - label.mean()))
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ theta))
        hessian = (x * (p * (1 - p))[:, None]).T @ x / n + np.diag(ridge) + 1e-12 * np.eye(len(theta))
        theta -= np.linalg.solve(hessian, x.T @ (p - label) / n + ridge * theta)
    return lambda some, before: design(some, before) @ theta


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_registered_query_equals_dense_regressions(spark, monkeypatch, folder):
    # Enough steps to reach the optimum that Newton's method finds.
    monkeypatch.setattr(toxicity, "STEPS", 20_000)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", (F.col("quality") == 0).cast("int").alias("junk"), "toxic")
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(toxicity.FITS)).alias("fold")
    rows = docs.join(labels, "doc_id").where(~toxicity.held_out()).select("text", "junk", "toxic", fold).collect()
    assert 0 < len(rows) <= toxicity.SAMPLE
    sets, folds = [features(r.text) for r in rows], np.array([r.fold for r in rows])
    targets = np.array([[r.junk, r.toxic] for r in rows], float)
    every = docs.collect()
    asked = [features(r.text) for r in every]
    inputs, odds = np.zeros((len(rows), 0)), np.zeros((len(every), 0))
    for column in range(2):
        unseen = np.zeros(len(rows))
        for number in range(toxicity.FITS):
            own, others = folds == number, folds != number
            model = regression([s for s, o in zip(sets, others, strict=True) if o], targets[others, column], inputs[others])
            unseen[own] = model([s for s, o in zip(sets, own, strict=True) if o], inputs[own])
        model = regression(sets, targets[:, column], inputs)
        odds = np.column_stack([odds, model(asked, odds)])
        inputs = np.column_stack([inputs, unseen])
    want = {r.doc_id: 1 / (1 + np.exp(-o)) for r, o in zip(every, odds, strict=True)}
    found = queries.op10_toxicity_chain(spark, folder).collect()
    assert len(found) == len(every)
    for r in found:
        np.testing.assert_allclose((r.p_junk, r.score), want[r.doc_id], atol=5e-3)
        assert r.predicted == int(r.score >= 0.5)
    assert 0 < sum(r.predicted for r in found) < len(found)
