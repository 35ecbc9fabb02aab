"""The line field against enumeration of all labellings, and its accuracy on unseen documents."""

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexweave.llm import common, quality


def lines_of(texts):
    return quality.Lines(*common.utf8(pa.array(texts)))


def test_lines_of_any_text():
    texts = ["a\nbb\n", "", "\n\n", "x", "é\n!!", "", "last\n"]
    lines = lines_of(texts)
    want = [[len(x.encode()) for x in t.split("\n")] for t in texts]
    assert np.diff(lines.first).tolist() == [len(w) for w in want]
    assert lines.lengths.tolist() == [n for w in want for n in w]
    alone = [lines_of([t]) for t in texts]
    np.testing.assert_allclose(lines.features, np.vstack([a.features for a in alone]))


def enumerate_field(field, features):
    score, link = features @ field.weights[:-4], field.weights[-4:].reshape(2, 2)
    total, good = 0.0, np.zeros(len(score))
    for states in itertools.product((0, 1), repeat=len(score)):
        value = sum(score[i] * s for i, s in enumerate(states)) + sum(link[a, b] for a, b in zip(states, states[1:], strict=False))
        total += np.exp(value)
        good += np.exp(value) * np.array(states)
    return good / total, np.log(total)


def test_marginals_and_gradient():
    rng = np.random.default_rng(1)
    lines = lines_of(["Some text\nMORE!!\n\nx x x\n| a |", "one", "a\nb\nc"])
    features = lines.features.astype(float)
    field = quality.Field(rng.normal(size=quality.N_FEATURES + 4) / 2)
    good, _, total = field.marginals(features, lines.first)
    for doc in range(3):
        a, b = lines.first[doc], lines.first[doc + 1]
        want, log_total = enumerate_field(field, features[a:b])
        np.testing.assert_allclose(good[a:b], want)
        np.testing.assert_allclose(total[doc], log_total)
    labels = rng.integers(0, 2, len(features))
    value, gradient = field.loss(features, lines.first, labels)
    for at in [0, 5, 20, *range(quality.N_FEATURES, quality.N_FEATURES + 4)]:
        moved = field.weights.copy()
        moved[at] += 1e-6
        assert abs((quality.Field(moved).loss(features, lines.first, labels)[0] - value) / 1e-6 - gradient[at]) < 1e-4


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    field = quality.train(docs, labels)
    found = quality.score(docs, field).withColumn("held_out", quality.held_out()).join(labels, "doc_id").where("held_out").collect()
    good = [r.score for r in found if r.quality == 1]
    bad = [r.score for r in found if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([g >= quality.THRESHOLD for g in good]) > 0.98
    assert np.mean([b < quality.THRESHOLD for b in bad]) > 0.6


def test_edges(spark):
    rows = [(1, None, 9.0), (2, "", 9.0), (3, "\n" * 3000, 9.0), (None, "a\n", 9.0), (3, "word " * 30_000, 9.0), (3, "word " * 30_000, 9.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (None, 1), (77, 1)], "doc_id long, quality int")
    field = quality.train(docs, labels)
    assert all(abs(r.score - 0.5) < 1e-9 for r in quality.score(docs, field).collect())
    kept = quality.keep(docs, field, 0.4)
    assert kept.columns == docs.columns and kept.count() == 6
    assert quality.keep(docs.where(F.lit(False)), field).count() == 0


def test_fit_reads_whole_texts(spark):
    """Texts that differ only after line 100; the fit equals one on whole texts, in the driver and summed in Spark."""
    rng = np.random.default_rng(3)
    words = ["river", "stone", "walks", "under", "bright", "early", "quiet"]

    def clean(n):
        return [" ".join(rng.choice(words, 6)) + "." for _ in range(n)]

    texts = {}
    for doc in range(60):
        tail = ["$$$ BUY NOW!!! | | |", "click click click"] * 20 if doc % 2 else clean(40)
        texts[doc] = "\n".join(clean(105 + doc % 7) + tail)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(doc, 1 - doc % 2) for doc in texts], "doc_id long, quality int")
    fitted = [r.doc_id for r in labels.where(~quality.held_out()).collect()]
    lines = lines_of([texts[doc] for doc in fitted])
    good = np.repeat([1 - doc % 2 for doc in fitted], np.diff(lines.first))
    want = quality.fit(lines.features.astype(float), lines.first, good)
    near = quality.train(docs, labels)
    loss = [f.loss(lines.features.astype(float), lines.first, good)[0] for f in (want, near, quality.train(docs, labels, fit_lines=1000))]
    assert max(loss) - min(loss) < 1e-5
    found = {r.doc_id: r.score for r in quality.score(docs, near).collect()}
    assert min(found[d] for d in found if d % 2 == 0) > max(found[d] for d in found if d % 2)
