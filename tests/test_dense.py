"""Low-rank factors, ridge regression and vectors against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.functions import vectors
from lexweave.operators import lowrank, ridge


def coo(spark, dense):
    cells = [(int(i), int(j), float(dense[i, j])) for i, j in zip(*np.nonzero(dense))]
    return spark.createDataFrame(cells, "row long, col long, val double")


def dense(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.idx] = r.vec
    return out


@pytest.fixture(scope="module")
def tiny():
    rng = np.random.default_rng(3)
    full = (rng.random((6, 3)) @ rng.random((3, 8))).round(3)
    full[:, 5] = 0.0
    return full


def test_svd_recovers_rank_three(spark, tiny):
    exact = np.linalg.svd(tiny)[1]
    rank = int((exact > 1e-2).sum())
    svd = lowrank.randomized_svd(coo(spark, tiny), 5, seed=1)
    u, v = dense(svd.left, (6, len(svd.values))), dense(svd.right, (8, len(svd.values)))
    assert len(svd.values) >= rank
    np.testing.assert_allclose(svd.values[:rank], exact[:rank], rtol=1e-2)
    np.testing.assert_allclose(u.T @ u, np.eye(len(svd.values)), atol=1e-8)
    np.testing.assert_allclose(u * svd.values @ v.T, tiny, atol=5e-3)


def test_svd_drops_to_exact_rank(spark):
    rng = np.random.default_rng(5)
    low = rng.integers(0, 2, (20, 2)) @ rng.integers(0, 2, (2, 30)).astype(float)
    rank = np.linalg.matrix_rank(low)
    svd = lowrank.randomized_svd(coo(spark, low), 6)
    assert len(svd.values) == rank
    np.testing.assert_allclose(svd.values, np.linalg.svd(low)[1][:rank], rtol=1e-8)


def test_graded_values_down_to_ten_digits(spark):
    rng = np.random.default_rng(6)
    u, v = (np.linalg.qr(rng.standard_normal((n, 11)))[0] for n in (90, 40))
    exact = 1e8 * 10.0 ** -np.arange(0, 11)
    svd = lowrank.randomized_svd(coo(spark, u * exact @ v.T).repartition(7), 11)
    assert len(svd.values) == 11
    np.testing.assert_allclose(svd.values, exact, rtol=1e-5)
    left, right = dense(svd.left, (90, 11)), dense(svd.right, (40, 11))
    np.testing.assert_allclose(left.T @ left, np.eye(11), atol=1e-8)
    np.testing.assert_allclose(right.T @ right, np.eye(11), atol=1e-8)


def test_tree_of_triangles(spark, monkeypatch):
    monkeypatch.setattr(lowrank, "FAN_IN", 2)
    rng = np.random.default_rng(7)
    x = rng.standard_normal((50, 4)) @ np.diag([1e9, 1e3, 1.0, 1e-1])
    table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "idx long, vec array<double>").repartition(13)
    upper = lowrank.tall_triangle(table, np.eye(4))
    exact = np.linalg.qr(x, mode="r")
    np.testing.assert_allclose(np.diag(upper), np.abs(np.diag(exact)), rtol=1e-6)
    few = spark.createDataFrame([(0, [3.0, 4.0])], "idx long, vec array<double>")
    np.testing.assert_allclose(lowrank.tall_triangle(few, np.eye(2)), [[3.0, 4.0], [0.0, 0.0]])


def test_sign_matrix_in_blocks(spark, monkeypatch):
    full = np.random.default_rng(4).integers(0, 3, (60, 9)).astype(float)
    signs = np.zeros((60, 5))
    for place, value in lowrank._signs(np.arange(60), 5, 3):
        signs[np.arange(60), place] += value
    assert (np.abs(signs) > 0).all()
    for block in (1 << 22, 16):
        monkeypatch.setattr(lowrank, "SIGN_ROWS", block)
        made = lowrank.times_signs(coo(spark, full), "col", "row", 60, 5, 3)
        # Only blocks need their dense rows added up.
        assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1 + (block == 16)
        np.testing.assert_allclose(dense(made, (9, 5)), full.T @ signs, atol=1e-12)


def test_truncated_basis_and_word_vectors(spark, monkeypatch):
    monkeypatch.setattr(lowrank, "ROWS_PER_SALT", 3)
    rng = np.random.default_rng(8)
    full = (rng.random((2500, 12)) < 0.2).astype(float)
    full[:, 4] = 0.0
    svd = lowrank.randomized_svd(coo(spark, full), 4, seed=2)
    u = dense(svd.left, (2500, 4))
    np.testing.assert_allclose(u.T @ u, np.eye(4), atol=1e-9)
    got = {r.idx: np.array(r.vec) for r in lowrank.dense_word_vectors(coo(spark, full), svd.left, 4).collect()}
    assert 4 not in got and len(got) == 11
    projected = u.T @ full
    for j, vec in got.items():
        np.testing.assert_allclose(vec, projected[:, j] / np.linalg.norm(projected[:, j]), atol=1e-9)


def test_eigen_and_pca(spark):
    rng = np.random.default_rng(9)
    half = (rng.random((10, 10)) < 0.4).astype(float)
    full = half + half.T
    eigen = lowrank.randomized_eigen(coo(spark, full), 10)
    np.testing.assert_allclose(eigen.values, np.linalg.eigvalsh(full), atol=1e-8)
    assert list(eigen.values) == sorted(eigen.values)
    pca = lowrank.randomized_pca(coo(spark, full), 10)
    scores, parts = dense(pca.left, (10, 10)), dense(pca.right, (10, 10))
    np.testing.assert_allclose(scores @ parts.T, full, atol=1e-8)


def test_phrase_vectors_keep_labels_apart(spark):
    rng = np.random.default_rng(2)
    basis = spark.createDataFrame([(i, rng.random(3).tolist()) for i in range(5)], "idx long, vec array<double>")
    u = np.array([r.vec for r in basis.orderBy("idx").collect()])
    rows = [("amod", 1, 0, 1.0), ("amod", 3, 0, 2.0), ("acomp", 1, 0, 1.0), ("amod", 0, 2, 1.0)]
    got = {(r.label, r.idx): r.vec for r in lowrank.dense_phrase_vectors(
        spark.createDataFrame(rows, "label string, row long, col long, val double"), basis, 3).collect()}
    np.testing.assert_allclose(got["amod", 0], u[1] + 2 * u[3])
    np.testing.assert_allclose(got["acomp", 0], u[1])
    np.testing.assert_allclose(got["amod", 2], u[0])


@pytest.mark.parametrize("rows_per_salt", [3, 1000])
def test_ridge_matches_direct_form(spark, rows_per_salt):
    rng = np.random.default_rng(7)
    data, groups = [], {}
    for key, n in (("a", 40), ("b", 2), ("c", 9)):
        p, a = rng.standard_normal((n, 3)), rng.standard_normal((n, 3))
        groups[key] = (p.T, a.T)
        data += [(key, i, p[i].tolist(), a[i].tolist()) for i in range(n)]
    samples = spark.createDataFrame(data, "k string, i long, p array<double>, a array<double>")
    fits = ridge.ridge_fits(samples, ["k"], ["i"], rows_per_salt=rows_per_salt).collect()
    assert len(fits) == 9
    for r in fits:
        p, a = groups[r.k]
        smoother = a.T @ np.linalg.inv(a @ a.T + r.lam * np.eye(3))
        want = p @ smoother
        np.testing.assert_allclose(r.mat, want, atol=1e-10)
        np.testing.assert_allclose(r.residual, np.linalg.norm(want @ a - p), atol=1e-6)
        np.testing.assert_allclose(r.s_trace, (a.T * smoother).sum(), atol=1e-10)
    best = {r.k: r for r in ridge.ridge_fits(samples, ["k"], ["i"], best_only=True).collect()}
    for key, row in best.items():
        errors = {r.lam: r.err for r in fits if r.k == key}
        assert row.lam == min(errors, key=lambda lam: (errors[lam], lam))


def test_few_samples_of_many_dimensions_stay_samples(spark):
    rng = np.random.default_rng(11)
    dim, data, groups = 60, [], {}
    for key, n in (("few", 10), ("one", 1), ("as many", 60), ("many", 150)):
        p, a = rng.standard_normal((n, dim)), rng.standard_normal((n, dim))
        groups[key] = (p, a)
        data += [(key, i, p[i].tolist(), a[i].tolist()) for i in range(n)]
    samples = spark.createDataFrame(data, "k string, i long, p array<double>, a array<double>")
    stats = {r.k: r for r in ridge.sufficient_statistics(samples, ["k"], ["i"]).collect()}
    assert {k: (r.summed, len(r.g) + len(r.h)) for k, r in stats.items()} == {
        "few": (False, 2 * 10 * dim), "one": (False, 2 * dim), "as many": (True, 2 * dim * dim), "many": (True, 2 * dim * dim),
    }
    # Samples of one modifier split over salts: some parts are sums, some are samples.
    for rows_per_salt in (5, 70, 4096):
        for r in ridge.ridge_fits(samples, ["k"], ["i"], rows_per_salt=rows_per_salt).collect():
            p, a = groups[r.k]
            inverse = np.linalg.inv(a.T @ a + r.lam * np.eye(dim))
            want = p.T @ a @ inverse
            np.testing.assert_allclose(r.mat, want, atol=1e-9)
            np.testing.assert_allclose(r.residual, np.linalg.norm(p - a @ want.T), rtol=1e-6, atol=1e-6)
            np.testing.assert_allclose(r.s_trace, np.trace(a @ inverse @ a.T), atol=1e-9)


def test_gcv_carries_error_over_zero_denominator():
    errors = ridge.gcv_errors([1.0, 2.0, 3.0], [5.0, 1.0, 5.0], 5)
    assert errors[0] == np.finfo(float).max and errors[2] == errors[1] == 4.0 / (5 * 0.8**2)


def test_training(spark):
    vec = lambda *v: [float(x) for x in v]
    words = spark.createDataFrame(
        [("red-jj", vec(1, 0)), ("car-nn", vec(0, 1)), ("dog-nn", vec(0.6, 0.8)), ("lone-jj", vec(1, 0)), ("run-vb", vec(0.8, 0.6))],
        "term string, vec array<double>",
    )
    kept = spark.createDataFrame(
        [("amod", "red-jj", "car-nn", 0), ("amod", "red-jj", "dog-nn", 1), ("amod", "red-jj", "gone-nn", 2), ("nsubj", "dog-nn", "run-vb", 0)],
        "label string, w1 string, w2 string, idx long",
    )
    vecs = spark.createDataFrame(
        [("amod", 0, vec(3, 4)), ("amod", 1, vec(0, 0)), ("amod", 2, vec(1, 1)), ("nsubj", 0, vec(0, 2))],
        "label string, idx long, vec array<double>",
    )
    train = spark.createDataFrame(
        [("amod", "red-jj"), ("amod", "lone-jj"), ("amod", "unknown-jj"), ("nsubj", "run-vb")], "label string, word string"
    )
    samples = ridge.training_samples(kept, vecs, words, train)
    got = {(r.label, r.word, r.arg): (r.p, r.a) for r in samples.collect()}
    # The zero phrase and the argument without a vector are left out.
    assert set(got) == {("amod", "red-jj", "car-nn"), ("nsubj", "run-vb", "dog-nn")}
    np.testing.assert_allclose(got["amod", "red-jj", "car-nn"][0], [-0.4, 0.8])
    np.testing.assert_allclose(got["nsubj", "run-vb", "dog-nn"][0], [-0.8, 0.4])
    mods = {(r.label, r.word): r for r in ridge.train_modifiers(samples, train, words, 2).collect()}
    assert set(mods) == {("amod", "red-jj"), ("amod", "lone-jj"), ("nsubj", "run-vb")}
    empty = mods["amod", "lone-jj"]
    assert (empty.lam, empty.n_samples, empty.mat) == (0.1, 0, [[0.0, 0.0], [0.0, 0.0]])
    listed = ridge.training_list(kept, 2).collect()
    assert [(r.label, r.word) for r in listed] == [("amod", "red-jj")]


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, -3.0]), ([0.0, 0.0], [1.0, 0.0]), ([-1.0, 0.0], [2.0, 0.0])], "x array<double>, y array<double>")
    got = df.select(
        vectors.normalise(F.col("x")).alias("n"),
        vectors.signed_cosine(F.col("x"), F.col("y")).alias("s"),
        vectors.absolute_cosine(F.col("x"), F.col("y")).alias("a"),
        vectors.usable(F.col("x")).alias("u"),
    ).collect()
    assert [r.n for r in got] == [[0.6, 0.8], None, [-1.0, 0.0]]
    assert [r.s for r in got] == [0.0, None, -1.0] and got[2].a == 1.0
    assert [r.u for r in got] == [True, False, True]
