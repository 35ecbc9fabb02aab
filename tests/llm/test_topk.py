"""Exact search against all scores."""

import numpy as np

from lexweave.llm import topk


def brute(rows, k, every):
    """Results as sorted tuples; every row is a candidate but the query's own."""
    whole = [(i, np.floor(np.array(v, float) * 64).astype(object)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all()]
    out = []
    for at, (query, own) in enumerate(whole):
        if query % every == 0:
            scored = sorted((-sum(int(a) * int(b) for a, b in zip(own, v, strict=False)), i) for j, (i, v) in enumerate(whole) if j != at)
            out += [(query, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def search(spark, rows, **options):
    table = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<double>, row int, norm2 string").repartition(4)
    return sorted(map(tuple, topk.search(table, **options).collect()))


def test_scores_with_clusters_and_ties(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(5, 12))
    rows = [(i, (centres[i % 5] * rng.choice([0.2, 1, 3]) + rng.normal(size=12) / 9).round(2).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]
    want = brute(rows, 20, 20)
    assert search(spark, rows) == want
    assert search(spark, rows, block=7) == want


def test_null_odd_and_large_vectors(spark):
    rows = [(0, [1.0, 2.0]), (20, [1.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, []), (0, [1.0, 2.0]), (None, [5.0, 5.0]), (7, [-1e7, 3.0]), (40, [2e7, 1.0])]
    assert search(spark, rows, k=3) == brute(rows, 3, 20)
    assert search(spark, [(1, [1.0])]) == []
    assert search(spark, []) == []
    assert search(spark, [(20, [1.0])]) == []


def test_most_pairs_are_skipped():
    rng = np.random.default_rng(2)
    exact = (rng.normal(size=(4000, 16)) * np.linspace(8, 0.05, 4000)[:, None] * 64).astype(np.int64)

    class Row(dict):
        pass

    rows = [Row(row=i, vec_id=i, vec=exact[i].tobytes()) for i in range(0, 4000, 200)]
    queries = topk.Queries(rows, 16, np.eye(16), 5, 8)
    found = topk.Found(queries)
    steps = 0
    for at in range(0, 4000, 100):
        steps += 1
        if not found.step(np.arange(at, at + 100), np.arange(at, at + 100), exact[at : at + 100]):
            break
    assert steps < 40
    scores = exact @ exact[::200].T
    for query in range(20):
        own = np.delete(scores[:, query], query * 200)
        assert found.score[query].tolist() == sorted(own.tolist(), reverse=True)[:5]


def test_one_task_reads_short_ranges_before_long_ones(spark):
    """Files are packed by size: many different short vectors make larger files than long ones that repeat."""
    rng = np.random.default_rng(5)
    long_rows = [(i, [float(300 + i % 3 if j == i % 8 else 0) for j in range(8)]) for i in range(600)]
    short_rows = [(1000 + i, (rng.normal(size=8) / 4).tolist()) for i in range(5400)]
    settings = {
        "spark.sql.shuffle.partitions": "10",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.files.minPartitionNum": "1",
        "spark.sql.files.openCostInBytes": "1m",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        ours, rows = [], long_rows + short_rows
        monitor = topk.cut_lineage
        topk.cut_lineage = lambda df: ours.append(monitor(df)) or ours[-1]
        try:
            found = search(spark, rows, k=5, every=200)
        finally:
            topk.cut_lineage = monitor
        lengths = ours[0].select("norm2").toPandas()["norm2"].to_numpy()
        assert ours[0].rdd.getNumPartitions() == 1 and (np.diff(lengths) > 0).any()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert found == brute(rows, 5, 200)
