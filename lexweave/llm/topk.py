"""Exact top-k inner products over norm-sorted, SVD-rotated vectors.

Vectors become integers, are rotated by the right singular vectors of the whole table (from its
distributed Gram matrix), and are range-partitioned by falling length. Queries come in blocks of at most
``QUERY_BLOCK``. The ``SEEDS`` longest vectors give each query a first threshold; every task then walks its
vectors from long to short and skips a pair when ``|q| |v|``, and after that the partial sum over the
leading rotated components plus the product of the residual lengths, stays below the query's threshold
(Cauchy-Schwarz). Survivors are scored exactly on the integers and thresholds rise with what a task has
found. A step whose longest vector fails the first bound for all queries is skipped by the lengths alone;
later steps are still looked at, as a task may read several ranges in any order. Equal scores are never
skipped.

A vector that is null or holds a null or non-finite component takes no part, nor does a null id as a
query; missing trailing components count as zero. Every row but the query's own is a candidate, repeated
rows included; a repeated query row is a query of its own. Fewer than ``k`` candidates give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.session import cut_lineage

K, SCALE, QUERY_BLOCK, SEEDS, LEADING, STEP = 20, 64, 4096, 4096, 24, 1024


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``row, vec_id, vec`` (64-bit integers as bytes) and ``norm2`` of the vectors that take part."""
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, vec_id, vec in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if not vec.is_valid or vec.values.null_count:
                    continue
                values = vec.values.to_numpy(zero_copy_only=False)
                if np.isfinite(values).all():
                    whole = np.floor(values * scale).astype("<i8")
                    out.append((row, vec_id, whole.tobytes(), float((whole.astype(np.float64) ** 2).sum())))
            if out:
                columns = zip(*out, strict=True)
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["row", "vec_id", "vec", "norm2"])

    return rows.mapInArrow(run, "row bigint, vec_id bigint, vec binary, norm2 double")


def _matrix(blobs: list[bytes], dim: int) -> np.ndarray:
    if all(len(b) == dim * 8 for b in blobs):
        return np.frombuffer(b"".join(blobs), "<i8").reshape(len(blobs), dim)
    return np.frombuffer(b"".join(b.ljust(dim * 8, b"\0") for b in blobs), "<i8").reshape(len(blobs), dim)


def rotation(table: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of the table, largest singular value first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            own = _matrix(batch.column(0).to_pylist(), dim).astype(np.float64)
            total += own.T @ own
        i, j = np.indices((dim, dim)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "s"])

    gram = np.zeros((dim, dim))
    for row in table.select("vec").mapInArrow(run, "i bigint, j bigint, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        gram[row["i"], row["j"]] = row["s"]
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    return vectors[:, ::-1]


class Queries:
    """A block of queries with thresholds."""

    def __init__(self, rows: list, dim: int, turn: np.ndarray, k: int, leading: int):
        self.row = np.array([r["row"] for r in rows], np.int64)
        self.ids = np.array([r["vec_id"] for r in rows], np.int64)
        self.dim, self.turn, self.k = dim, turn, k
        self.leading = min(leading, dim)
        self.exact = _matrix([bytes(r["vec"]) for r in rows], dim)
        self.norm, self.head, self.rest = self.parts(self.exact)
        self.least = np.full(len(rows), -np.inf)

    def parts(self, exact: np.ndarray):
        """Length, leading rotated components and length of the rest."""
        turned = exact.astype(np.float64) @ self.turn
        tail = turned[:, self.leading :]
        return np.sqrt((exact.astype(np.float64) ** 2).sum(axis=1)), turned[:, : self.leading], np.sqrt((tail**2).sum(axis=1))

    def scores(self, exact: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Integer inner products of all rows of ``exact`` with the queries ``at``."""
        own = self.exact[at]
        largest = np.abs(exact).max(initial=0).astype(np.float64) * np.abs(own).max(initial=0) * self.dim
        if largest < 2**52:
            return (exact.astype(np.float64) @ own.astype(np.float64).T).astype(np.int64)
        return exact @ own.T


class Found:
    """The best ``k`` of each query so far, by score and then smaller id."""

    def __init__(self, queries: Queries):
        self.queries, self.k = queries, queries.k
        n = len(queries.row)
        self.score = [np.zeros(0, np.int64)] * n
        self.ids = [np.zeros(0, np.int64)] * n
        self.least = queries.least.copy()

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.append(self.score[query], scores), np.append(self.ids[query], ids)
        order = np.lexsort((ids, -scores))[: self.k]
        self.score[query], self.ids[query] = scores[order], ids[order]
        if len(order) == self.k:
            self.least[query] = max(self.least[query], scores[order[-1]])

    def reach(self, longest: float):
        """Allowance for rounding, and the queries for which a vector of this length can matter."""
        slack = 1e-9 * self.queries.norm * longest + 1e-6
        return slack, np.flatnonzero(self.queries.norm * longest + slack >= self.least)

    def step(self, rows: np.ndarray, ids: np.ndarray, exact: np.ndarray) -> bool:
        """Take vectors of any lengths; False when neither these nor shorter ones can matter."""
        queries = self.queries
        norm, head, rest = queries.parts(exact)
        slack, active = self.reach(norm.max(initial=0))
        if not len(active):
            return False
        bound = head @ queries.head[active].T + rest[:, None] * queries.rest[active][None, :]
        bound = np.minimum(bound, norm[:, None] * queries.norm[active][None, :])
        alive = bound + slack[active] >= self.least[active]
        columns = np.flatnonzero(alive.any(axis=0))
        if len(columns):
            lines = np.flatnonzero(alive[:, columns].any(axis=1))
            scores = queries.scores(exact[lines], active[columns])
            good = alive[np.ix_(lines, columns)] & (scores >= self.least[active[columns]]) & (rows[lines][:, None] != queries.row[active[columns]][None, :])
            for column in np.flatnonzero(good.any(axis=0)):
                own = good[:, column]
                self.add(int(active[columns[column]]), scores[own, column], ids[lines][own])
        return True


def search(vectors: DataFrame, k: int = K, every: int = 20, block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` best rows of ``vectors`` for each row whose id ``every`` divides."""
    table = cut_lineage(integers(vectors).repartitionByRange(F.desc("norm2")).sortWithinPartitions(F.desc("norm2"), "vec_id"))
    spark = table.sparkSession
    dim = (table.agg(F.max(F.octet_length("vec")).alias("n")).first()["n"] or 0) // 8
    wanted = table.where(F.col("vec_id") % every == 0)
    n_blocks = max(1, -(-wanted.count() // block))
    turn = rotation(table, dim) if dim else np.zeros((0, 0))
    # At most SEEDS rows.
    seeds = table.where("vec_id IS NOT NULL").orderBy(F.desc("norm2"), "vec_id").limit(SEEDS).collect()
    found = None
    for number in range(n_blocks):
        # At most about ``block`` rows, a hash of the row deals them evenly.
        rows = wanted.where(F.pmod(F.xxhash64("row"), F.lit(n_blocks)) == number).collect()
        own = Queries(rows, dim, turn, k, LEADING)
        first = Found(own)
        for at in range(0, len(seeds), STEP):
            part = seeds[at : at + STEP]
            first.step(*[np.array([r[c] for r in part], np.int64) for c in ("row", "vec_id")], _matrix([bytes(r["vec"]) for r in part], dim))
        own.least = first.least
        shared = spark.sparkContext.broadcast(own)

        part = table.select("row", "vec_id", "norm2", "vec").mapInArrow(_walk(shared), "row bigint, query_id bigint, vec_id bigint, score bigint")
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _walk(shared):
    """A task over ranges of vectors, in each of which they fall in length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Found(shared.value)
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                _, active = best.reach(float(np.sqrt(part.column(2).to_numpy().max())))
                if len(active):
                    best.step(part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(3).to_pylist(), shared.value.dim))
        sizes = np.array([len(s) for s in best.score], np.int64)
        if sizes.sum():
            of = np.repeat(np.arange(len(sizes)), sizes)
            columns = [shared.value.row[of], shared.value.ids[of], np.concatenate(best.ids), np.concatenate(best.score)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["row", "query_id", "vec_id", "score"])

    return run
