"""Near-duplicates by SimHash fingerprints, pivot distance tables and exact verification.

A fingerprint bit is 1 where over half of a text's shingle hashes have it. Fingerprints link when at
most ``RADIUS`` bits differ. Candidates: 64 bits cut into ``b`` blocks leave at least ``b - RADIUS``
blocks equal in every link, so distinct fingerprints meet under each choice of so many blocks (``b``
grows with their number, to keep chance meetings rare; every choice of ``b`` is exact). In a meeting,
each fingerprint has its precomputed Hamming distances to ``N_PIVOTS`` reference fingerprints; by the
triangle inequality a pair whose largest coordinate difference is over the radius cannot link and is
discarded. Survivors are verified bit by bit. A meeting over ``CHUNK`` fingerprints is cut into
chunks, and each pair of chunks is a task of its own. A task returns a spanning forest of its links,
not the links, so copies of copies stay linear.

A null text has no words; texts without words share fingerprint zero, which links like any other.
Null ids never become a component's name unless the whole component has none. Repeated rows each get
a row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lexweave.llm.common import Words, ascii_lower, components, pieces, streams, utf8
from lexweave.session import cut_lineage

SHINGLE, SEED, RADIUS, N_PIVOTS = 4, 42, 4, 16
CHUNK = 2048
# Groups up to this size are compared by shifting, larger ones as a matrix.
SHIFTED = 48
PIVOTS = streams(N_PIVOTS)


def _inside() -> np.ndarray:
    table = np.ones(256, np.bool_)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def fingerprints_of(data: np.ndarray, places: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text."""
    words = Words(data, places, _inside())
    n_docs, n_words = len(places) - 1, np.diff(words.first)
    out = np.zeros(n_docs, np.uint64)
    if len(words.starts) == 0:
        return out
    lengths = words.ends - words.starts
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])
    joined = np.full(begin[-1], 0x20, np.uint8)
    space = np.zeros(begin[-1], np.bool_)
    space[begin[1:] - 1] = True
    joined[~space] = ascii_lower()[words.data[words.inside]]
    content = joined.tobytes()
    n_shingles = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
    doc = np.repeat(np.arange(n_docs), n_shingles)
    at = np.concatenate([[0], np.cumsum(n_shingles)])
    head = words.first[:-1][doc] + np.arange(at[-1]) - at[:-1][doc]
    last = np.minimum(head + shingle, words.first[1:][doc]) - 1
    begins, ends = begin[head].tolist(), (begin[last] + lengths[last]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(content[a:b], SEED) for a, b in zip(begins, ends, strict=True)], np.uint64)
    # Eight counters of eight bits add up in one word; runs of 255 cannot overflow them.
    full = np.flatnonzero(n_shingles)
    runs = -(-n_shingles[full] // 255)
    first_run = np.concatenate([[0], np.cumsum(runs)])
    of = np.repeat(np.arange(len(full)), runs)
    run_at = at[:-1][full][of] + 255 * (np.arange(first_run[-1]) - first_run[:-1][of])
    lanes = np.uint64(0x0101010101010101)
    for bit in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & lanes, run_at)
        counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first_run[:-1], axis=0)
        set_bits = counts * 2 > n_shingles[full][:, None]
        for byte in range(8):
            out[full] |= set_bits[:, byte].astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` but ``text``, and the long ``fp`` of every row's text."""
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(*others, "text")
    schema = StructType([*rows.schema.fields[:-1], StructField("fp", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            found = fingerprints_of(*utf8(piece.column(len(others))))
            yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(found.view(np.int64))], names=[*others, "fp"])

    return rows.mapInArrow(run, schema)


def masks(n_distinct: int, radius: int = RADIUS) -> list[int]:
    """Bit masks of which one at least is equal in any two fingerprints that link."""
    n_blocks = radius + 1
    while n_distinct > 1 << (64 * (n_blocks - radius) // n_blocks) and n_blocks < 2 * radius + 4:
        n_blocks += 1
    edges = [round(64 * i / n_blocks) for i in range(n_blocks + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(blocks, n_blocks - radius)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _lowest(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Labels lowered until both ends of every pair agree."""
    while len(a):
        low = np.minimum(labels[a], labels[b])
        before = labels.copy()
        for ends in (a, b):
            np.minimum.at(labels, before[ends], low)
            np.minimum.at(labels, ends, low)
        labels = labels[labels]
        if (labels == before).all():
            break
    return labels


def forest(group: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of each run of equal ``group`` numbers (sorted) as two arrays of fingerprints."""
    n = len(fps)
    labels = np.arange(n)
    table = np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if n else np.zeros(1, np.int64)
    sizes = np.diff(edges)
    end = np.repeat(edges[1:], sizes)
    small = np.repeat(sizes <= SHIFTED, sizes)
    heads, tails = [], []
    rows = np.flatnonzero(small)
    for shift in range(1, SHIFTED):
        rows = rows[rows + shift < end[rows]]
        if not len(rows):
            break
        other = rows + shift
        near = (np.abs(table[rows] - table[other]) <= radius).all(axis=1)
        a, b = rows[near], other[near]
        linked = np.bitwise_count(fps[a] ^ fps[b]) <= radius
        heads.append(a[linked])
        tails.append(b[linked])
    if heads:
        labels = _lowest(n, np.concatenate(heads), np.concatenate(tails), labels)
    for begin, size in zip(edges[:-1][sizes > SHIFTED], sizes[sizes > SHIFTED], strict=True):
        for low in range(begin, begin + size, 256):
            own, rest = slice(low, min(low + 256, begin + size)), slice(low, begin + size)
            near = np.ones((own.stop - own.start, rest.stop - rest.start), np.bool_)
            for pivot in range(table.shape[1]):
                near &= np.abs(table[own, pivot][:, None] - table[rest, pivot][None, :]) <= radius
            a, b = np.nonzero(near)
            a, b = a + low, b + low
            linked = np.bitwise_count(fps[a] ^ fps[b]) <= radius
            labels = _lowest(n, a[linked], b[linked], labels)
    moved = np.flatnonzero(labels != np.arange(n))
    return fps[moved], fps[labels[moved]]


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of whole groups from a stream sorted by group; a group never spans two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(i).to_numpy() for i in range(4)]
        last = np.ones(batch.num_rows, np.bool_)
        for k in keys:
            last &= k == k[-1]
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if held:
            previous = held[-1]
            same = all(previous.column(i)[-1] == batch.column(i)[0] for i in range(4))
            if not same:
                yield pa.Table.from_batches(held)
                held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def links(distinct: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Links ``(a, b)`` that connect exactly the distinct fingerprints ``fp`` within the radius."""
    chosen = masks(distinct.count(), radius)
    meetings = F.array(
        *[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(chosen)]
    )
    keyed = distinct.select("fp", F.explode(meetings).alias("m")).select("fp", "m.*")
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = keyed.join(sizes, ["t", "key"]).withColumn("_chunks", F.ceil(F.col("n") / chunk))
    own = met.withColumn("_own", F.pmod(F.xxhash64("fp"), F.col("_chunks")))
    dealt = own.withColumn("_with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1))).select(
        "t", "key", F.least("_own", "_with").alias("i"), F.greatest("_own", "_with").alias("j"), "fp"
    )
    group = ["t", "key", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches):
            keys = [table.column(i).to_numpy() for i in range(4)]
            changed = np.zeros(table.num_rows, np.int64)
            for k in keys:
                changed[1:] |= k[1:] != k[:-1]
            a, b = forest(np.cumsum(changed), table.column(4).to_numpy().view(np.uint64), radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    sorted_rows = dealt.repartition(*group).sortWithinPartitions(*group)
    return sorted_rows.mapInArrow(run, "a bigint, b bigint").distinct()


def assign(docs: DataFrame, passed: Sequence[str] = ()) -> DataFrame:
    """``doc_id`` and the columns ``passed``, with ``fp``, ``root`` and ``component_id``."""
    found = cut_lineage(fingerprints(docs.select("doc_id", *passed, "text")))
    smallest = cut_lineage(found.groupBy("fp").agg(F.min("doc_id").alias("own")))
    roots = components(cut_lineage(links(smallest.select("fp"))))
    named = smallest.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "own", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("own").alias("component_id"))
    of = named.join(names, "root").select("fp", "root", "component_id")
    return found.join(of, "fp")


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each component one whole row: the smallest ``doc_id``, then the smallest text hash."""
    hashed = docs.select("doc_id", F.xxhash64("text").alias("_hash"), F.struct(*docs.columns).alias("_row"))
    found = assign(hashed.select("doc_id", "_hash", F.col("_row.text").alias("text")), ["_hash"])
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_hash")
    best = found.groupBy("root").agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k._hash").alias("_text"))
    rows = found.groupBy("doc_id", "_hash").agg(F.count(F.lit(1)).alias("_rows"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text"))
    best = cut_lineage(best.join(rows, same).select("_id", "_text", "_rows"))
    single = hashed.join(best.where("_rows = 1"), same, "left_semi")
    repeated = best.where("_rows > 1")
    if not repeated.isEmpty():
        once = hashed.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "_hash"])
        single = single.unionByName(once)
    return single.select("_row.*")
