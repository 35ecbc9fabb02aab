"""Salting of hot and missing keys, checked broadcasts and products beyond them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave import scale
from lexweave.operators import lowrank


def test_null_keys_are_spread(spark):
    rows = spark.range(5000).select(F.lit(None).cast("string").alias("k"), "id")
    salted = scale.add_salt(rows, scale.hot_keys(rows, ["k"], 10), ["k"], ["id"])
    assert salted.select("_salt").distinct().count() > 500


@pytest.mark.parametrize("hottest", [50_000, 1])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_lookup_join_equals_a_plain_join(spark, monkeypatch, hottest, how):
    monkeypatch.setattr(scale, "HOTTEST", hottest)
    monkeypatch.setattr(scale, "ROWS_PER_SALT", 50)
    facts = spark.range(3000).select(
        F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 5 == 0, "warm").otherwise(F.concat(F.lit("k"), F.col("id") % 97)).alias("k"), "id"
    )
    lookup = spark.createDataFrame([("hot", 1), ("hot", 2), ("warm", 3), ("k4", 4), (None, 5)], "k string, v int")
    got = scale.lookup_join(facts, lookup, ["k"], ["id"], how, max_broadcast_rows=0)
    want = facts.join(lookup, "k", how)
    columns = sorted(want.columns)
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def test_every_key_over_the_bar_is_split(spark):
    rows = spark.range(900).select((F.col("id") % 9).alias("k"), "id")
    hot = scale.hot_keys(rows, ["k"], 20)
    assert {r.k: r._salts for r in hot.collect()} == dict.fromkeys(range(9), 5)


def test_broadcast_checks_rows_and_bytes(spark):
    few = spark.createDataFrame([("x" * 1000, [1.0] * 50)] * 20, "a string, b array<double>")
    assert scale.fits_broadcast(few, 20, 30_000)
    assert not scale.fits_broadcast(few, 19, 30_000)
    assert not scale.fits_broadcast(few, 20, 20_000)


def test_both_products_agree(spark, monkeypatch):
    gen = np.random.default_rng(0)
    dense = gen.standard_normal((40, 3))
    cells = [(int(i), int(j), float(v)) for i, j, v in zip(gen.integers(0, 30, 200), gen.integers(0, 45, 200), gen.standard_normal(200), strict=True)]
    matrix = spark.createDataFrame(cells, "row long, col long, val double").groupBy("row", "col").agg(F.sum("val").alias("val"))
    factor = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(dense)], "idx long, vec array<double>")
    want = np.zeros((30, 3))
    for i, j, v in cells:
        if j < 40:
            want[i] += v * dense[j]
    for limit in (1 << 20, 0):
        monkeypatch.setattr(lowrank, "FACTOR_BYTES", limit)
        got = {r.idx: r.vec for r in lowrank.product(matrix, "row", "col", factor, 3).collect()}
        for i, row in got.items():
            np.testing.assert_allclose(row, want[i], atol=1e-12)
        assert {i for i in range(30) if np.abs(want[i]).max() > 0} <= set(got)
