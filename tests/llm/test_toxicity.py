"""The chain: out-of-fold inputs, accuracy on unseen texts, edges."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexweave.llm import common, toxicity


def sample(n, seed=0):
    """Texts whose second label needs the first: ``rude`` if a rude word, ``threat`` if rude and a place word."""
    rng = np.random.default_rng(seed)
    texts, labels = [], []
    for _ in range(n):
        rude, place = rng.random() < 0.4, rng.random() < 0.5
        words = [f"w{int(x)}" for x in rng.integers(0, 300, 40)]
        words += [f"rude{rng.integers(0, 4)}"] * rude + [f"place{rng.integers(0, 3)}"] * place
        rng.shuffle(words)
        texts.append(" ".join(words))
        labels.append((int(rude), int(rude and place)))
    return texts, np.array(labels)


def test_chain_learns_and_feeds_forward():
    texts, labels = sample(1500)
    doc, hashes = toxicity.distinct_words(*common.utf8(pa.array(texts)))
    chain = toxicity.fit_chain(doc, hashes, labels, np.arange(len(texts)) % 5)
    assert len(chain[0].chain) == 0 and len(chain[1].chain) == 1 and chain[1].chain[0] > 0
    texts, labels = sample(500, 7)
    doc, hashes = toxicity.distinct_words(*common.utf8(pa.array(texts)))
    odds = np.zeros((500, 0))
    for model in chain:
        odds = np.column_stack([odds, model.odds(doc, hashes, odds)])
    assert ((odds > 0) == labels).mean(axis=0).min() > 0.97


def test_out_of_fold_inputs_are_unseen(monkeypatch):
    texts, labels = sample(200)
    doc, hashes = toxicity.distinct_words(*common.utf8(pa.array(texts)))
    folds, used, fit = np.arange(200) % 5, [], toxicity.fit

    def spy(doc, hashes, label, earlier, rows, most, least):
        used.append((rows.copy(), earlier.copy()))
        return fit(doc, hashes, label, earlier, rows, most, least)

    monkeypatch.setattr(toxicity, "fit", spy)
    toxicity.fit_chain(doc, hashes, labels, folds)
    for fold in range(5):
        assert not used[fold][0][folds == fold].any()
    last = used[-1][1][:, 0]
    for fold in range(5):
        own = fit(doc, hashes, labels[:, 0], np.zeros((200, 0)), folds != fold)
        np.testing.assert_allclose(last[folds == fold], own.odds(doc, hashes, np.zeros((200, 0)))[folds == fold])


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet").withColumn("junk", (F.col("quality") == 0).cast("int"))
    chain = toxicity.train(docs, labels, ("junk", "toxic"))
    found = toxicity.score(docs, chain, ("junk", "toxic")).join(labels.drop("junk"), "doc_id").where(toxicity.held_out()).collect()
    bad, good = [r.p_toxic for r in found if r.toxic == 1], [r.p_toxic for r in found if r.toxic == 0]
    assert np.mean([b > g for b in bad for g in good]) > 0.97
    assert np.mean(np.array(bad) >= 0.5) > 0.85 and np.mean(np.array(good) >= 0.5) < 0.01


def test_edges(spark):
    rows = [(1, None, 1.0), (2, "", 1.0), (None, "a b", 1.0), (3, "x " * 50_000, 1.0), (3, "x " * 50_000, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, p_toxic double")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    chain = toxicity.train(docs, labels, ("toxic",))
    assert [r.p_toxic for r in toxicity.score(docs, chain, ("toxic",)).collect()] == [0.5] * 5
    assert toxicity.score(docs.where(F.lit(False)), chain, ("toxic",)).count() == 0
    one = spark.createDataFrame([(2, 0), (3, 0), (3, None)], "doc_id long, toxic int")
    assert all(r.p_toxic < 0.5 for r in toxicity.score(docs, toxicity.train(docs, one, ("toxic",)), ("toxic",)).collect())
