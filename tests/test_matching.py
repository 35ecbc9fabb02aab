"""Matching by rounds against the matching of one task."""

import numpy as np
import pytest

from lexweave.operators import matching, rules

SCHEMA = "rule_id long, side string, frag int, vec array<double>"


def table(spark, sides):
    rows = [
        (rule, side, 3 * at + 1, [float(x) for x in vec])
        for rule, (left, right) in sides.items()
        for side, vectors in (("L", left), ("R", right))
        for at, vec in enumerate(vectors)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def by_rounds(spark, sides, **bounds):
    found = matching.match_by_rounds(table(spark, sides), **bounds).collect()
    return sorted((r.rule_id, r.place, r.l_frag, r.r_frag, round(r.sim, 9)) for r in found)


def in_one_task(sides):
    return [
        (rule, place, 3 * i + 1, 3 * j + 1, round(sim, 9))
        for rule, (left, right) in sorted(sides.items())
        if len(left) and len(right)
        for place, (sim, i, j) in enumerate(rules.greedy_pairs(left, right))
    ]


@pytest.mark.parametrize(("held", "block"), [(0, 16), (12, 1000)])
def test_rounds_equal_the_greedy_order(spark, held, block):
    gen = np.random.default_rng(5)
    words = gen.standard_normal((4, 5))
    sides = {
        1: (gen.standard_normal((60, 6)), gen.standard_normal((45, 6))),
        # Copies, a third of a side of one direction, and opposite vectors.
        2: (np.concatenate([words[gen.integers(0, 4, 20)] * 2, np.repeat(words[:1], 10, 0)]), np.concatenate([-words[gen.integers(0, 4, 25)], gen.standard_normal((5, 5))])),
        # Signs only: very many equal similarities.
        3: (gen.choice([-1.0, 1.0], (9, 3)), gen.choice([-1.0, 0.0, 1.0], (8, 3)) + [0, 0, 2]),
        4: (gen.standard_normal((2, 3)), np.zeros((0, 3))),
        5: (np.eye(3), np.eye(3)[::-1]),
    }
    assert by_rounds(spark, sides, held=held, block=block) == in_one_task(sides)


def test_nothing_to_match(spark):
    assert by_rounds(spark, {}) == []
    assert by_rounds(spark, {1: (np.zeros((0, 2)), np.ones((3, 2)))}, held=0) == []


def test_few_vectors_are_matched_at_once(spark, monkeypatch):
    """all similarities of a small rule are made at once, and its vectors are shuffled once for both scores."""
    gen = np.random.default_rng(9)
    rows, want = [], {}
    for rule in range(40):
        pool = np.vstack([gen.standard_normal((4, 5)), np.ones((1, 5)), -np.ones((1, 5))])
        left, right = (pool[gen.integers(0, 6, gen.integers(1, 8))] for _ in "lr")
        want[rule] = rules.greedy_pairs(left, right, 1)
        assert [p[1:] for p in rules.greedy_pairs(left, right)] == [p[1:] for p in want[rule]]
        rows += [(rule, side, 3 * i, v.tolist()) for side, vecs in (("L", left), ("R", right)) for i, v in enumerate(vecs)]
    monkeypatch.setattr(rules, "_distinct", None)  # nothing is left to the way of large rules
    frags = spark.createDataFrame([*rows, (99, "L", 1, [1.0] * 5)], "rule_id long, side string, frag int, vec array<double>")
    got = {r.rule_id: r for r in rules.matched_rules(frags).collect()}
    assert set(got) == set(want)
    means = {r.rule_id: r.mean_sim for r in rules.mean_similarity(frags).collect()}
    for rule, pairs in want.items():
        assert [(m.place, m.l_frag, m.r_frag) for m in got[rule].matches] == [(k, 3 * i, 3 * j) for k, (_, i, j) in enumerate(pairs)]
        np.testing.assert_allclose([m.sim for m in got[rule].matches], [p[0] for p in pairs], atol=1e-12)
        np.testing.assert_allclose(got[rule].mean_sim, means[rule], atol=1e-12)
