"""Helpers shared by the training-data operators: text buffers, word hashes, dense numbers, components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.session import cut_lineage

# Bytes of text that one numpy pass works on; a longer text is one piece of its own.
PIECE_BYTES = 2 << 20
# About so many distinct rows are numbered by one task.
ROWS_PER_BUCKET = 50_000


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_key(name: str = "doc_id") -> Column:
    """A hash of any id, null included; ids of equal text form have equal keys."""
    return F.xxhash64(F.coalesce(F.col(name).cast("string"), F.lit("\x00null")))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    places = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if len(places) == 0:
        places = np.zeros(1, np.int64)
    content = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return content, places


def pieces(batches: Iterator[pa.RecordBatch], n_bytes: int = PIECE_BYTES, at: int = -1) -> Iterator[pa.RecordBatch]:
    """The batches cut so that column ``at`` has about ``n_bytes`` of text in each, or one long text."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, places = utf8(batch.column(at % batch.num_columns))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(places, places[begin] + n_bytes, "right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of SplitMix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def streams(n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers; a longer list begins like a shorter one."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Words:
    """Words of a piece of texts: ``starts``, ``ends`` in ``data``, ``doc`` of each, ``first`` per text."""

    def __init__(self, data: np.ndarray, places: np.ndarray, inside: np.ndarray):
        base, n = int(places[0]), int(places[-1] - places[0])
        self.data = data[base : base + n]
        self.places = places - base
        self.inside = inside[self.data]
        before = np.empty(n, np.bool_)
        after = np.empty(n, np.bool_)
        before[1:], after[:-1] = self.inside[:-1], self.inside[1:]
        edges = self.places[:-1][self.places[:-1] < n]
        before[edges] = False
        after[self.places[1:][self.places[1:] > 0] - 1] = False
        self.starts = np.flatnonzero(self.inside & ~before)
        self.ends = np.flatnonzero(self.inside & ~after) + 1
        self.doc = np.searchsorted(self.places, self.starts, "right") - 1
        self.first = np.searchsorted(self.starts, self.places)

    def hashes(self, table: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each word, whose bytes are first put through ``table``."""
        if len(self.starts) == 0:
            return np.zeros(0, np.uint64)
        lengths = self.ends - self.starts
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        content = table[self.data[self.inside]].astype(np.uint64) + np.uint64(1)
        place = np.arange(len(content)) - np.repeat(begin, lengths)
        total = np.add.reduceat(content * streams(int(lengths.max()))[place], begin)
        return mix(total + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def ascii_lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def numbered(df: DataFrame, within: Sequence[str], name: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``df`` with a gapless 0-based long ``name`` in each group of ``within``.

    Equal rows are first counted, so that a row repeated any number of times is one row until the
    end. Groups are split into buckets by a hash of the whole row; buckets are numbered apart and
    moved by the running sum of the buckets before. No task sorts more than a bucket.
    """
    columns = df.columns
    counted = cut_lineage(df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")))
    n_buckets = max(1, -(-counted.count() // rows_per_bucket))
    key = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    placed = counted.withColumn("_bucket", F.pmod(key, F.lit(n_buckets)))
    own = [*within, "_bucket"]
    before = Window.partitionBy(*within).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*own).agg(F.sum("_n").alias("_rows"))
    offsets = offsets.select(*own, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*own).orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("_local", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"o.{c}")) for c in own]
    joined = local.alias("l").join(offsets.alias("o"), same)
    first = joined.select(*[f"l.{c}" for c in columns], "_n", (F.col("_local") + F.col("_offset")).alias("_first"))
    # Two steps, so that no list of repeats is longer than the square root of a very large count.
    step = 1 << 16
    blocks = first.withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / step))))
    rest = F.least(F.lit(step).cast("long"), F.col("_n") - F.col("_block") * step)
    repeats = blocks.withColumn("_repeat", F.explode(F.sequence(F.lit(0).cast("long"), rest - 1)))
    number = F.col("_first") + F.col("_block") * step + F.col("_repeat")
    return repeats.select(*columns, number.cast("long").alias(name))


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (a, b: long); root: the smallest node reachable.

    Each round lets every node point to its smallest neighbour, follows pointers to their ends by
    doubling, and keeps the edges between different ends. Rounds are written to the shared folder,
    nothing is collected. Loops, doubles and an empty table are allowed; null ends are left out.
    """
    both = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    nodes = both.select(F.col("a").alias("node")).union(both.select("b")).distinct()
    roots = cut_lineage(nodes.select("node", F.col("node").alias("root")))
    left = cut_lineage(both.where("a != b").distinct())
    while not left.isEmpty():
        arcs = left.union(left.select("b", "a"))
        lowest = arcs.groupBy("a").agg(F.min("b").alias("low"))
        parents = cut_lineage(lowest.select(F.col("a").alias("node"), F.least("a", "low").alias("up")))
        while True:
            above = parents.select(F.col("node").alias("up"), F.col("up").alias("top"))
            doubled = cut_lineage(parents.join(above, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            moved = not doubled.where("moved").isEmpty()
            parents = doubled.select("node", "up")
            if not moved:
                break
        to = parents.select(F.col("node").alias("root"), "up")
        roots = cut_lineage(roots.join(to, "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        at_a = parents.select(F.col("node").alias("a"), F.col("up").alias("x"))
        at_b = parents.select(F.col("node").alias("b"), F.col("up").alias("y"))
        moved_edges = left.join(at_a, "a").join(at_b, "b").where("x != y")
        left = cut_lineage(moved_edges.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return roots
