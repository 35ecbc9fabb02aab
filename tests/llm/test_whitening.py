"""Whitening against exact rational arithmetic and numpy."""

from fractions import Fraction

import numpy as np

from lexweave.llm import whitening


def whole(vectors):
    """The vectors that take part, as lists of Python numbers; None for the others."""
    dim = max((len(v) for v in vectors if v is not None), default=0)
    out = []
    for v in vectors:
        if v is None or any(c is None or not np.isfinite(c) for c in v):
            out.append(None)
        else:
            out.append([int(np.floor(64.0 * c)) + 1_000_000 for c in v] + [1_000_000] * (dim - len(v)))
    return out


def covariance(fit_list):
    """Exact, divisor n, centred before multiplying."""
    n, dim = len(fit_list), len(fit_list[0])
    mean = [Fraction(sum(v[i] for v in fit_list), n) for i in range(dim)]
    centred = [[v[i] - mean[i] for i in range(dim)] for v in fit_list]
    return np.array([[float(sum(r[i] * r[j] for r in centred) / n) for j in range(dim)] for i in range(dim)]), mean


def run(spark, rows, **options):
    table = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<double>, n int, x string").repartition(3)
    return whitening.whitened(table, **options).collect()


def check(spark, rows, wanted=16):
    xs = whole([v for _, v in rows])
    kept = [(i, x) for (i, _), x in zip(rows, xs, strict=True) if x is not None]
    fit_list = [list(t) for t in sorted({tuple(x) for _, x in kept})]
    expected, mean = covariance(fit_list)
    values, vectors = np.linalg.eigh(expected)
    values, vectors = values[::-1], vectors[:, ::-1]
    width = min(wanted, len(values))
    got = run(spark, rows, wanted=wanted)
    assert len(got) == len(kept) * width and {r["component"] for r in got} == set(range(1, width + 1))
    n, sums = len(fit_list), [sum(v[i] for v in fit_list) for i in range(len(fit_list[0]))]
    own = {}
    for i, x in kept:
        own.setdefault(i, []).append(x)
    sign = {}
    for r in got:
        c = r["component"] - 1
        choices = []
        for x in own[r["vec_id"]]:
            z = sum(float(a - m) * b for a, m, b in zip(x, mean, vectors[:, c], strict=True)) / np.sqrt(values[c])
            choices.append((z, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))))
        z = min((z for z, d in choices if d == r["deviation"]), key=lambda z: abs(abs(z) - abs(r["whitened"])))
        assert abs(abs(z) - abs(r["whitened"])) < 1e-8 and r["n"] == n
        if abs(z) > 1e-6:
            assert sign.setdefault(c, z * r["whitened"] > 0) == (z * r["whitened"] > 0)
        assert abs(r["explained"] - values[c] / np.trace(expected)) < 1e-10
        assert r["identity_error"] < 1e-8


def test_rows_of_all_kinds(spark):
    rng = np.random.default_rng(1)
    mixing = rng.normal(size=(7, 7))
    rows = [(i, (rng.normal(size=7) @ mixing).tolist()) for i in range(200)]
    rows += [(500 + i, rows[3][1]) for i in range(90)] + [(500, rows[4][1]), (None, rows[5][1]), (None, None)]
    rows += [(700, [1.0, None] + [0.0] * 5), (701, [float("nan")] * 7), (702, [float("inf")] + [0.0] * 6), (703, None), (704, [0.5, -0.5]), (705, [])]
    check(spark, rows)
    check(spark, rows, wanted=3)


def test_covariance_equals_exact_fractions(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 5)) * [1e-1, 1, 1, 1e3, 1e10] + [0, 5, 5, -1e4, 1e9])]
    fit_list = [list(t) for t in {tuple(x) for x in whole([v for _, v in rows])}]
    table = spark.createDataFrame([(x,) for x in fit_list], "x array<long>")
    fitted = whitening.fit(table)
    assert fitted.n == len(fit_list)
    np.testing.assert_array_equal(fitted.covariance, covariance(fit_list)[0])
    n, sums = fitted.n, [sum(v[i] for v in fit_list) for i in range(5)]
    assert fitted.single == [sum((n * v[i] - sums[i]) ** 2 for v in fit_list) for i in range(5)]
    assert fitted.paired[1, 3] == sum((n * (v[1] + v[3]) - sums[1] - sums[3]) ** 2 for v in fit_list)


def test_small_and_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, [float("nan")])]) == []
    assert run(spark, [(1, [])]) == []
    one = run(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, 0.0, None)] * 4
    # Two dimensions of which one never changes: one component has no variance.
    flat = run(spark, [(i, [i / 8, 3.0]) for i in range(9)])
    assert len(flat) == 18 and all((r["whitened"] is None) == (r["component"] == 2) for r in flat)
    assert max(r["identity_error"] for r in flat) < 1e-12


def test_huge_entries(spark):
    rows = run(spark, [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [1e9, 3.0])])
    assert {r["deviation"] for r in rows if r["vec_id"] != 3} == {None} and all(np.isfinite(r["whitened"]) for r in rows if r["whitened"] is not None)
