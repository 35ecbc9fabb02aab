"""The model against dictionaries of counts, and its probabilities summed over the vocabulary."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from lexweave.llm import katz

LOWER = {i: i + 32 for i in range(65, 91)}


class Plain:
    """Katz backoff from dictionaries, for the words of small texts."""

    def __init__(self, rows, order):
        self.order = order
        self.texts = [(i, [*re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER)), 1]) for i, t in rows]
        self.counts = [collections.Counter() for _ in range(order)]
        for doc_id, words in self.texts:
            if zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 != 2:
                padded = [2] * (order - 1) + words
                for j in range(len(words)):
                    for n in range(1, order + 1):
                        self.counts[n - 1][tuple(padded[j + order - n : j + order])] += 1
        self.factors = [katz.discounts([sum(v == r for v in c.values()) for r in range(1, katz.LARGEST + 2)]) for c in self.counts]
        self.after = [collections.defaultdict(list) for _ in range(order)]
        for n in range(order):
            for gram in self.counts[n]:
                self.after[n][gram[:-1]].append(gram[-1])
        self.sums = {}

    def factor(self, n, count):
        return self.factors[n][count - 1] if count <= katz.LARGEST else 1.0

    def share(self, n, context, word):
        seen = self.after[n].get(context)
        if not seen:
            return self.share(n - 1, context[1:], word) if n else 1.0
        if (n, context) not in self.sums:
            counts = [self.counts[n][(*context, w)] for w in seen]
            left = sum((1 - self.factor(n, c)) * c for c in counts)
            low = sum(self.share(n - 1, context[1:], w) for w in seen) if n else 0.0
            whole = sum(counts) if left > 1e-12 else sum(counts) + 1
            if 1 - low < 1e-9:
                whole = sum(counts) - left
            self.sums[n, context] = whole, left if left > 1e-12 else 1.0, low
        whole, left, low = self.sums[n, context]
        count = self.counts[n].get((*context, word), 0)
        if count:
            return self.factor(n, count) * count / whole
        return left / whole / (1 - low) * (self.share(n - 1, context[1:], word) if n else 1.0)

    def rows(self):
        total, kinds = sum(self.counts[0].values()), len(self.counts[0])
        for doc_id, words in self.texts:
            padded = [2] * (self.order - 1) + words
            base = sum(math.log10((self.counts[0].get((w,), 0) + 1) / (total + kinds + 1)) for w in words)
            own = sum(math.log10(self.share(self.order - 1, tuple(padded[j : j + self.order - 1]), w)) for j, w in enumerate(words))
            held = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2
            yield doc_id, held, len(words), sum((w,) in self.counts[0] for w in words), total, base, own


def texts(n):
    rng = random.Random(6)
    words = [f"w{int(rng.paretovariate(0.6)) % 90}" for _ in range(4000)]
    rows = [(i, " ".join(rng.choice(words).upper() if j % 9 == 0 else rng.choice(words) for j in range(rng.randrange(0, 60)))) for i in range(n)]
    return [*rows, (None, None), (None, "w1  w2"), (3, ""), (3, rows[5][1]), (3, rows[5][1]), (500, "w1 w1 w2 \t\n" * 400)]


@pytest.mark.parametrize(("order", "sizes"), [(1, {}), (2, {}), (2, {"chunk_tokens": 300, "part_tokens": 200}), (3, {"chunk_tokens": 900, "part_tokens": 500})])
def test_scores(spark, order, sizes, monkeypatch):
    if sizes:
        monkeypatch.setattr(katz, "SPLIT_COUNT", 40)
    rows = texts(60)
    table = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double").repartition(3)
    found = sorted(map(tuple, katz.score(table, order, **sizes).collect()), key=str)
    want = sorted(Plain(rows, order).rows(), key=str)
    assert [f[:5] for f in found] == [w[:5] for w in want]
    np.testing.assert_allclose(sorted(f[5] for f in found), sorted(w[5] for w in want), atol=1e-8)
    np.testing.assert_allclose(sorted(f[6] for f in found), sorted(w[6] for w in want), atol=1e-8)


def test_plain_probabilities_add_up():
    model = Plain(texts(60), 3)
    words = [g[0] for g in model.counts[0]] + ["never"]
    for context in [("w1", "w2"), (2, 2), (2, "w1"), ("never", "w3"), ("w5", "w5")]:
        assert abs(sum(model.share(2, context, w) for w in words) - 1) < 1e-9


def test_closed_and_undiscounted_contexts():
    sums = np.array([[20, 0, 0, 0, 0, 0, 0.4], [3, 3, 0, 0, 0, 0, 1.0], [0, 0, 0, 0, 0, 0, 0.0]])
    factors = np.full(katz.LARGEST, 0.5)
    shares = katz.probabilities(np.array([20, 1, 0]), sums, np.array([0.4, 0.2, 0.1]), factors)
    np.testing.assert_allclose(shares, [20 / 21, 1 / 3, 0.1])
    unseen = katz.probabilities(np.array([0]), sums[:1], np.array([0.6]), factors)
    np.testing.assert_allclose(unseen, 1 / 21)


def test_packed_round_trip():
    for values in (np.array([], np.uint32), np.arange(9, dtype=np.int64), np.array([0.5, 0.5, 0.25]), np.array([True, False])):
        np.testing.assert_array_equal(katz.unpacked(katz.packed(values)), values)
        np.testing.assert_array_equal(katz.decoded(katz.coded(values)), values)


def test_no_training_text_and_empty_table(spark):
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = katz.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.score, row.base_score) == (3, 0, 0, 0.0, 0.0)
    assert katz.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
