"""Saved counts and matrices in buckets."""

import pytest

from lexweave.operators import store


def exchanges(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan.count("BroadcastExchange")


def counted(spark, rows):
    return spark.createDataFrame(rows, "a string, b string, n long")


def test_parts_add_up_to_the_whole(spark):
    old = counted(spark, [(f"w{i}", f"v{i % 7}", i + 1) for i in range(200)])
    new = counted(spark, [(f"w{i}", f"v{i % 7}", 1000) for i in range(150, 260)])
    saved = store.save(old, ["a", "b"], 8)
    merged = store.merge_counts(saved, new, ["a", "b"], "n", 8)
    want = {(f"w{i}", f"v{i % 7}"): (i + 1 if i < 200 else 0) + (1000 if i >= 150 else 0) for i in range(260)}
    assert {(r.a, r.b): r.n for r in merged.collect()} == want and merged.count() == len(want)
    # The saved table is as it was, and a merged one can be merged again.
    assert saved.count() == 200
    again = store.merge_counts(merged, counted(spark, [("w0", "v0", 5), ("z", "z", 6)]), ["a", "b"], "n", 8)
    assert {(r.a, r.b): r.n for r in again.collect()} == want | {("w0", "v0"): 6, ("z", "z"): 6}


@pytest.mark.parametrize("first", [[], [("x", "y", 2)]])
def test_empty_sides(spark, first):
    saved = store.save(counted(spark, first), ["a", "b"], 4)
    assert [tuple(r) for r in store.merge_counts(saved, counted(spark, []), ["a", "b"], "n", 4).collect()] == first
    more = store.merge_counts(saved, counted(spark, [("p", "q", 1)]), ["a", "b"], "n", 4)
    assert sorted(tuple(r) for r in more.collect()) == sorted([*first, ("p", "q", 1)])


def test_saved_tables_are_not_shuffled(spark):
    saved = store.save(counted(spark, [(f"w{i}", "v", i) for i in range(500)]), ["a", "b"], 8)
    fresh = store.save(counted(spark, [(f"w{i}", "v", 1) for i in range(300, 900)]), ["a", "b"], 8)
    assert exchanges(store.updated(saved, fresh, ["a", "b"], "n")) == (0, 0)
    assert exchanges(store.added(saved, fresh, ["a", "b"])) == (0, 0)
    again = store.merge_counts(saved, counted(spark, [("w1", "v", 1)]), ["a", "b"], "n", 8)
    assert exchanges(store.updated(again, fresh, ["a", "b"], "n")) == (0, 0)


def test_matrix_by_column(spark):
    cells = [(i % 11, i % 7, float(i % 5 + 1)) for i in range(77)]
    stored = store.save(spark.createDataFrame(cells, "row long, col long, val double"), ["col"], 4)
    columns = store.columns(stored)
    assert exchanges(columns) == (0, 0)
    norms = {r.col: (r.nnz, round(r.norm, 9)) for r in columns.collect()}
    assert norms == {c: (11, round(sum(v * v for _, k, v in cells if k == c) ** 0.5, 9)) for c in range(7)}
    dense = spark.createDataFrame([(c, float(c)) for c in range(7)], "col long, x double")
    found = {r.row: round(r.val, 9) for r in store.product(stored, dense).collect()}
    assert found == {r: round(sum(v * c for k, c, v in cells if k == r), 9) for r in range(11)}
