"""Randomized low-rank factorisation of a sparse coordinate matrix, and dense projections.

Tall factors stay DataFrames ``(idx, vec)``. Only rank-by-rank matrices reach the driver. The first
pass multiplies whole sparse columns by a sparse sign matrix that every task derives from a seed.
Tall factors are orthonormalised by a tree of QR factorisations, which, unlike their Gram matrix,
keeps directions far below the largest. A factor too large for every worker meets segments of
bounded length in a co-grouped product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.functions.tokens import PHRASE_LABELS
from lexweave.functions.vectors import normalise
from lexweave.operators.matrix import SEGMENT, segments
from lexweave.scale import ROWS_PER_SALT, add_salt, hot_keys, replicate
from lexweave.session import cut_lineage

# Fixed value: a column whose residual falls below this is dropped, with all later ones.
RESIDUAL_EPS = 1e-4

# Entries of each row of the sign matrix, and inner indices that one task may hold of a column.
SIGNS, SIGN_ROWS = 8, 1 << 22
# Triangles that one QR step stacks, and the share of the largest column that counts as rounding.
FAN_IN, ROUNDING = 16, 1e-13

# A factor up to this size is sent whole to the workers; cells gathered at once in a product.
FACTOR_BYTES = 128 << 20
GATHERED_CELLS = 200_000

VECTOR_SCHEMA = "idx bigint, vec array<double>"


@dataclass
class Factors:
    """``left`` and ``right`` are ``(idx, vec)`` tables, ``values`` the r middle numbers."""

    left: DataFrame
    values: np.ndarray
    right: DataFrame


def vectors_of(column: pa.ListArray) -> np.ndarray:
    """Rows of a list column as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def lists_of(matrix: np.ndarray) -> pa.ListArray:
    """A matrix as a list column."""
    rows, width = matrix.shape
    if rows * width >= 1 << 31:
        raise ValueError(f"{rows} rows of {width} numbers exceed one Arrow list column")
    offsets = np.arange(rows + 1, dtype=np.int32) * width
    return pa.ListArray.from_arrays(offsets, np.ascontiguousarray(matrix).ravel())


def sum_vectors(df: DataFrame, *keys: str) -> DataFrame:
    """Element-wise sum of ``vec`` per key, combined before the shuffle."""
    total = Summarizer.sum(array_to_vector("vec"))
    return df.groupBy(*keys).agg(vector_to_array(total).alias("vec"))


def _segment_products(
    entries: pa.ListArray, width: int, blocks: Callable[[int], tuple[np.ndarray, int]]
) -> np.ndarray:
    """One row per sparse segment: its weights times the block rows they name.

    ``blocks(i)`` gives the block of the i-th segment and the index of its first row.
    """
    starts, inner, weight = _cells(entries)
    out = np.empty((len(entries), width))
    for i in range(len(entries)):
        lo, hi = starts[i], starts[i + 1]
        block, first = blocks(i)
        out[i] = weight[lo:hi] @ block[inner[lo:hi] - first]
    return out


def _cells(entries: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, inner indices and weights of a column of sparse rows."""
    cells = entries.values
    inner = cells.field("inner").to_numpy(zero_copy_only=False)
    return entries.offsets.to_numpy(), inner, cells.field("val").to_numpy(zero_copy_only=False)


def _gathered(entries: pa.ListArray, matrix: np.ndarray) -> np.ndarray:
    """Sparse rows times one dense matrix: gather, weigh and add up, some rows at a time."""
    starts, inner, weight = _cells(entries)
    sizes = np.diff(starts)
    out = np.zeros((len(entries), matrix.shape[1]))
    at = 0
    while at < len(entries):
        end = int(np.searchsorted(starts, starts[at] + GATHERED_CELLS, "right")) - 1
        end = min(max(end, at + 1), len(entries))
        lo, hi = starts[at], starts[end]
        full = at + np.flatnonzero(sizes[at:end])
        if len(full):
            products = matrix[inner[lo:hi]] * weight[lo:hi, None]
            out[full] = np.add.reduceat(products, starts[full] - lo, axis=0)
        at = end
    return out


def _signs(inner: np.ndarray, width: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of ``SIGNS`` stripes of the columns: place and value of the entry of every row ``inner``."""
    stripes = min(SIGNS, width)
    for stripe in range(stripes):
        bits = _mixed(inner.astype(np.uint64) * np.uint64(SIGNS) + np.uint64(stripe), seed)
        low, high = stripe * width // stripes, (stripe + 1) * width // stripes
        place = low + ((bits >> np.uint64(40)) % np.uint64(high - low)).astype(np.int64)
        size = 0.5 + ((bits >> np.uint64(8)) & np.uint64(0xFFFFFFFF)) / float(1 << 32)
        yield place, np.where(bits & np.uint64(1), size, -size)


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """Well spread bits of each number and the seed."""
    x = x + np.uint64(2 * seed + 1) * np.uint64(0x9E3779B97F4A7C15 & 0xFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def times_signs(matrix: DataFrame, outer: str, inner: str, n_inner: int, width: int, seed: int) -> DataFrame:
    """The sparse matrix by ``outer`` times a sparse sign matrix over ``inner``, as ``(idx, vec)``.

    A row of the sign matrix has one entry in each of a few stripes of its columns, so that a sparse
    row of any length yields one dense row at a cost of its own entries, and nothing dense is shuffled.
    Beyond ``SIGN_ROWS`` inner indices a row comes in blocks, whose dense rows are added up.
    """
    block = F.floor(F.col(inner) / SIGN_ROWS)
    entry = F.struct(F.col(inner).alias("inner"), F.col("val").alias("val"))
    keys = [F.col(outer).alias("idx")] + ([block.alias("block")] if n_inner > SIGN_ROWS else [])
    rows = matrix.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("entries"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            starts, at, weight = _cells(batch.column("entries"))
            at, weight = at[starts[0] : starts[-1]], weight[starts[0] : starts[-1]]
            owner = np.repeat(np.arange(batch.num_rows), np.diff(starts)) * width
            out = np.zeros(batch.num_rows * width)
            for place, value in _signs(at, width, seed):
                out += np.bincount(owner + place, weight * value, len(out))
            yield pa.RecordBatch.from_arrays([batch.column("idx"), lists_of(out.reshape(-1, width))], names=["idx", "vec"])

    products = rows.mapInArrow(run, VECTOR_SCHEMA)
    return sum_vectors(products, "idx") if n_inner > SIGN_ROWS else products


def times_factor(rows: DataFrame, factor: DataFrame, width: int) -> DataFrame:
    """Sparse rows ``(idx, segment, entries)`` times a factor ``(idx, vec)``, as ``(idx, vec)``.

    Sparse segments and factor rows are co-grouped by segment number; a segment number shared
    by many sparse rows is salted and only its own factor rows are repeated. Rows a factor
    lacks count as zero.
    """
    rows = cut_lineage(rows)
    hot = cut_lineage(hot_keys(rows, ["segment"], ROWS_PER_SALT))
    left = add_salt(rows, hot, ["segment"], ["idx"])
    number = F.floor(F.col("idx") / SEGMENT).cast("bigint")
    right = replicate(factor.select(number.alias("segment"), "idx", "vec"), hot, ["segment"])

    def multiply(sparse: pa.Table, block: pa.Table) -> pa.Table:
        if not sparse.num_rows:
            return pa.table({"idx": pa.array([], pa.int64()), "vec": lists_of(np.zeros((0, width)))})
        sparse = sparse.combine_chunks()
        first = sparse.column("segment")[0].as_py() * SEGMENT
        local = np.zeros((SEGMENT, width))
        if block.num_rows:
            at = block.column("idx").to_numpy() - first
            local[at] = vectors_of(block.column("vec").combine_chunks())
        entries = sparse.column("entries").combine_chunks()
        out = _segment_products(entries, width, lambda _i: (local, first))
        return pa.table({"idx": sparse.column("idx"), "vec": lists_of(out)})

    group = ["segment", "_salt"]
    products = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(
        multiply, VECTOR_SCHEMA
    )
    return sum_vectors(products, "idx")


def product(matrix: DataFrame, outer: str, inner: str, factor: DataFrame, width: int) -> DataFrame:
    """The sparse matrix by ``outer`` times the factor by ``inner``, as ``(idx, vec)``.

    A factor whose bytes were checked to be within ``FACTOR_BYTES`` goes to every worker: a whole
    sparse row meets it at once and yields one dense row, so nothing dense is shuffled. A larger
    one is co-grouped with segments of the rows.
    """
    shape = factor.agg(F.count(F.lit(1)).alias("n"), F.max("idx").alias("last")).first()
    if not shape.n or (shape["last"] + 1) * width * 8 > FACTOR_BYTES:
        return times_factor(_by(matrix, outer, inner), factor, width)
    dense = np.zeros((shape["last"] + 1, width))
    for row in factor.toLocalIterator():
        dense[row.idx] = row.vec
    shared = matrix.sparkSession.sparkContext.broadcast(dense)
    # Rows a factor lacks count as zero, also those after its last.
    entry = F.struct(F.col(inner).alias("inner"), F.col("val").alias("val"))
    present = matrix.where(F.col(inner) <= shape["last"])
    rows = present.groupBy(F.col(outer).alias("idx")).agg(F.array_sort(F.collect_list(entry)).alias("entries"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = _gathered(batch.column("entries"), shared.value)
                yield pa.RecordBatch.from_arrays([batch.column("idx"), lists_of(out)], names=["idx", "vec"])

    return rows.mapInArrow(run, VECTOR_SCHEMA)


def times_small(df: DataFrame, right: np.ndarray) -> DataFrame:
    """Every ``vec`` times a small matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = vectors_of(batch.column("vec")) @ right
                yield pa.RecordBatch.from_arrays(
                    [batch.column("idx"), lists_of(out)], names=["idx", "vec"]
                )

    return df.select("idx", "vec").mapInArrow(run, VECTOR_SCHEMA)


def gram(
    df: DataFrame,
    left: np.ndarray,
    right: np.ndarray,
    left_col: str = "vec",
    right_col: str = "vec",
) -> np.ndarray:
    """(X L)'(Y R) for the two vector columns X and Y, as a small matrix on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((left.shape[1], right.shape[1]))
        for batch in batches:
            if batch.num_rows:
                x = vectors_of(batch.column(left_col)) @ left
                total += x.T @ (vectors_of(batch.column(right_col)) @ right)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(total))), lists_of(total)], names=["idx", "vec"]
        )

    columns = [left_col] if left_col == right_col else [left_col, right_col]
    partial = df.select(*columns).mapInArrow(run, VECTOR_SCHEMA)
    rows = sum_vectors(partial, "idx").collect()
    result = np.zeros((left.shape[1], right.shape[1]))
    for row in rows:
        result[row.idx] = row.vec
    return result


def _triangle(stack: np.ndarray) -> np.ndarray:
    """The triangular factor of a stack of rows, square, with a diagonal that is not negative."""
    upper = np.linalg.qr(stack, mode="r")
    upper = np.vstack([upper, np.zeros((max(stack.shape[1] - len(upper), 0), stack.shape[1]))])
    return upper * np.where(np.diag(upper) < 0, -1.0, 1.0)[:, None]


def tall_triangle(df: DataFrame, before: np.ndarray) -> np.ndarray:
    """R of X ``before`` = Q R: every task reduces its rows to a triangle, then triangles are stacked and reduced.

    Each step of the tree stacks at most ``FAN_IN`` triangles; the driver does the last one.
    """
    width = before.shape[1]

    def reduced(blocks: Iterator[np.ndarray]) -> np.ndarray:
        upper = np.zeros((0, width))
        for block in blocks:
            upper = _triangle(np.vstack([upper, block]))
        return upper

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = reduced(vectors_of(b.column("vec")) @ before for b in batches if b.num_rows)
        if len(upper):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), lists_of(upper.reshape(1, -1))], names=["idx", "vec"])

    def merge(table: pa.Table) -> pa.Table:
        number = table.column("idx")[0].as_py() // FAN_IN
        blocks = vectors_of(table.column("vec").combine_chunks()).reshape(-1, width, width)
        return pa.table({"idx": pa.array([number]), "vec": lists_of(reduced(iter(blocks)).reshape(1, -1))})

    parts = df.select("vec")
    triangles, n = parts.mapInArrow(run, VECTOR_SCHEMA), parts.rdd.getNumPartitions()
    while n > FAN_IN:
        group = F.floor(F.col("idx") / FAN_IN)
        triangles, n = triangles.groupBy(group).applyInArrow(merge, VECTOR_SCHEMA), -(-n // FAN_IN)
    rows = sorted(triangles.collect(), key=lambda r: r.idx)
    return reduced(np.array(r.vec).reshape(width, width) for r in rows)


def _inverted(upper: np.ndarray, floor: float) -> np.ndarray:
    """T with orthonormal X T for X = Q ``upper``, cut at the first residual within ``floor``."""
    small = np.flatnonzero(np.diag(upper) <= floor)
    kept = int(small[0]) if len(small) else len(upper)
    result = np.zeros((upper.shape[1], kept))
    if kept:
        result[:kept] = np.linalg.inv(upper[:kept, :kept])
    return result


def _floor(upper: np.ndarray) -> float:
    """Residuals up to this size count as none."""
    return max(RESIDUAL_EPS, ROUNDING * float(np.sqrt((upper * upper).sum(axis=0)).max(initial=0.0)))


def orthonormal(df: DataFrame, before: np.ndarray, floor: float | None = None) -> tuple[DataFrame, np.ndarray]:
    """A table Y and a T near the identity, such that Y T has orthonormal columns that span those of X ``before``.

    Done twice: the second pass removes what rounding left in the first. Y is written in between, as
    products with a badly scaled matrix do not round alike when they are made again.
    """
    first = tall_triangle(df, before)
    to = before @ _inverted(first, _floor(first) if floor is None else floor) if len(first) else np.zeros((len(before), 0))
    once = cut_lineage(times_small(df, to))
    return once, _inverted(tall_triangle(once, np.eye(to.shape[1])), 0.5) if to.shape[1] else np.zeros((0, 0))


def _by(matrix: DataFrame, outer: str, inner: str) -> DataFrame:
    return segments(matrix, outer, inner).withColumnRenamed(outer, "idx")


def _basis(matrix: DataFrame, rank: int, seed: int) -> tuple[DataFrame, np.ndarray]:
    """A table Y and a T: the orthonormal columns of Y T span A' times a sparse sign matrix."""
    shape = matrix.agg(F.max("row") + 1, F.max("col") + 1).first()
    width = min(rank, *(n or 0 for n in shape))
    if width < 1:
        raise ValueError("the matrix is empty")
    sample = cut_lineage(times_signs(matrix, "col", "row", shape[0], width, seed))
    return orthonormal(sample, np.eye(width))


def randomized_svd(matrix: DataFrame, rank: int, seed: int = 0) -> Factors:
    """Truncated SVD of ``(row, col, val)``: U over rows, singular values, V over columns.

    Two passes over the matrix. The effective rank may be below ``rank``. The values are those of the
    triangular factor of A times the basis; a second QR pass removes what rounding left in U.
    """
    start, to_basis = _basis(matrix, rank, seed)
    k = to_basis.shape[1]
    image = cut_lineage(product(matrix, "row", "col", times_small(start, to_basis), k))
    upper = tall_triangle(image, np.eye(k))
    _, values, vt = np.linalg.svd(upper)
    kept = int((values > _floor(upper)).sum())
    left, to_left = orthonormal(image, vt[:kept].T / values[:kept], 0.0)
    return Factors(times_small(left, to_left), values[:kept], times_small(start, to_basis @ vt[:kept].T))


def randomized_eigen(matrix: DataFrame, rank: int, seed: int = 0) -> Factors:
    """Eigenvalues (ascending) and vectors of a symmetric matrix; left and right are the same."""
    start, to_basis = _basis(matrix, rank, seed)
    k = to_basis.shape[1]
    basis = times_small(start, to_basis)
    image = product(matrix, "row", "col", basis, k)
    both = basis.join(image.withColumnRenamed("vec", "image"), "idx")
    core = gram(both, np.eye(k), np.eye(k), "vec", "image")
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    out = times_small(start, to_basis @ vectors)
    return Factors(out, values, out)


def randomized_pca(matrix: DataFrame, rank: int, seed: int = 0) -> Factors:
    """Scores U*S (left) and components V (right) of the uncentred matrix."""
    svd = randomized_svd(matrix, rank, seed)
    return Factors(times_small(svd.left, np.diag(svd.values)), svd.values, svd.right)


def dense_word_vectors(matrix: DataFrame, basis: DataFrame, width: int) -> DataFrame:
    """``(idx, vec)``: projected columns, normalised; a zero column has no row."""
    projected = product(matrix, "col", "row", basis, width)
    return projected.select("idx", normalise(F.col("vec")).alias("vec")).where(
        F.col("vec").isNotNull()
    )


def dense_phrase_vectors(matrix: DataFrame, basis: DataFrame, width: int) -> DataFrame:
    """``(label, idx, vec)``: projected phrase columns, not normalised.

    ``matrix`` is ``(label, row, col, val)``; all labels go through in one pass.
    """
    names = F.array(*[F.lit(x) for x in PHRASE_LABELS])
    code = F.array_position(names, F.col("label")) - 1
    keyed = matrix.select("row", "val", (F.col("col") * len(PHRASE_LABELS) + code).alias("idx"))
    rows = product(keyed, "idx", "row", basis, width)
    return rows.select(
        F.get(names, F.pmod("idx", F.lit(len(PHRASE_LABELS))).cast("int")).alias("label"),
        F.floor(F.col("idx") / len(PHRASE_LABELS)).cast("bigint").alias("idx"),
        "vec",
    )
