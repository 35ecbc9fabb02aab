"""Hash-tree shards against a plain recomputation."""

import math
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from lexweave.llm import sharding

MASK = (1 << 64) - 1


def text_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode(), 42)


def uniform(key, *numbers):
    for number in numbers:
        data = number.to_bytes(4, "little")
        key = xxhash.xxh64_intdigest(data, key)
    return ((key >> 11) + 0.5) / (1 << 53)


def key_of(doc_id):
    key = text_hash("\x00null" if doc_id is None else str(doc_id))
    return xxhash.xxh64_intdigest(key.to_bytes(8, "little"), 42)


def reached(doc_id, tree):
    """Level by level, each child of the node with its summed weight."""
    key, below = key_of(doc_id), [n for n in tree if n.weight > 0]
    for number, level in enumerate(("region", "rack", "shard")):
        weights = Counter()
        for node in below:
            weights[getattr(node, level)] += node.weight
        draws = [(-math.log(uniform(key, number, child)) / weight, child) for child, weight in weights.items()]
        below = [n for n in below if getattr(n, level) == min(draws)[1]]
    return below[0].shard


def flat(doc_id, tree):
    return min((-math.log(uniform(key_of(doc_id), 2, n.shard)) / n.weight, n.shard) for n in tree)[1]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, shard string, slot string, _n int")


def test_places_match_and_growth_moves_only_to_the_new_shard(spark):
    rows = [(i, f"text {i} é", "x", "y", 1) for i in range(400)]
    tree = sharding.topology(12)
    grown = sharding.grown(tree, 12)
    found = sharding.assign(docs(spark, rows), tree, grown).collect()
    assert len(found) == 400
    for row in found:
        assert row.shard == reached(row.doc_id, tree)
        assert row.grown_shard == reached(row.doc_id, grown)
        assert row.grown_shard in (row.shard, 12)
        text = f"text {row.doc_id} é".encode()
        assert (row.size, row.text_crc32) == (len(text) + 16, zlib.crc32(text))
    assert any(r.grown_shard == 12 for r in found)
    # Levels draw apart: the result is not that of one draw over all shards.
    assert sum(r.shard != flat(r.doc_id, tree) for r in found) > 100


def test_the_production_tree_grows_into_the_new_shard_only(spark):
    rows = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    tree = sharding.topology(40)
    found = sharding.assign(rows, tree, sharding.grown(tree, 40)).collect()
    assert all(r.grown_shard in (r.shard, 40) for r in found)
    assert abs(sum(r.grown_shard == 40 for r in found) - 20000 / 41) < 120
    counts = Counter(r.shard for r in found)
    assert len(counts) == 40 and max(abs(n - 500) for n in counts.values()) < 120


def test_slots_are_gapless_with_nulls_and_repeats(spark):
    rows = [(None, None, None, None, None)] * 3 + [(7, "", "a", "b", 2)] * 70 + [(i, "x" * i, "", "", 0) for i in range(50)]
    found = sharding.assign(docs(spark, rows), sharding.topology(3)).collect()
    assert len(found) == len(rows)
    for shard, n in Counter(r.shard for r in found).items():
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(n))
    null = next(r for r in found if r.doc_id is None)
    assert (null.size, null.text_crc32) == (16, 0)


def test_weights_draw_in_proportion_and_confine_movement(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    even = [sharding.Shard(s // 4, s // 2, s, 1.0) for s in range(8)]
    heavy = sharding.grown(even, 5, 2.0)
    found = sharding.assign(rows, even, heavy).collect()
    assert all(r.grown_shard in (r.shard, 5) for r in found)
    share = sum(r.grown_shard == 5 for r in found) / 6000
    assert abs(share - 0.3) < 0.03


@pytest.mark.parametrize("weight", [3.0, 0.25, 0.0])
def test_a_weight_changed_in_place_moves_rows_through_changed_subtrees_only(spark, weight):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    even = [sharding.Shard(s // 4, s // 2, s, 1.0) for s in range(8)]
    changed = [sharding.Shard(n.region, n.rack, n.shard, weight if n.shard == 5 else 1.0) for n in even]
    found = sharding.assign(rows, even, changed).collect()
    share = sum(r.grown_shard == 5 for r in found) / 6000
    assert abs(share - weight / (7 + weight)) < 0.03
    moved = [(r.shard, r.grown_shard) for r in found if r.shard != r.grown_shard]
    assert moved
    for old, new in moved if weight > 1 else [(b, a) for a, b in moved]:
        # Region 1, rack 2 and shard 5 grow (or, read backwards, shrink): each gains at its own level only.
        assert new // 4 == 1
        if old // 4 == 1:
            assert new // 2 == 2
        if old // 2 == 2:
            assert new == 5
    outside = [(r.shard, r.grown_shard) for r in found if r.shard // 4 == r.grown_shard // 4 == 0]
    assert all(a == b for a, b in outside)


def test_unequal_weights_at_every_level(spark):
    rows = spark.range(12000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    tree = [sharding.Shard(r, r * 2 + k, (r * 2 + k) * 2 + s, (r + 1) * (k + 2) * (s + 0.5)) for r in range(3) for k in range(2) for s in range(2)]
    counts = Counter(r.shard for r in sharding.assign(rows, tree).collect())
    total = sum(n.weight for n in tree)
    for node in tree:
        assert abs(counts[node.shard] / 12000 - node.weight / total) < 0.02


def test_empty_table(spark):
    assert sharding.assign(docs(spark, []), sharding.topology(4)).count() == 0
