"""Whitening of embeddings with covariances recovered by polarisation.

Entries become whole numbers ``x = floor(64 c) + 1000000``. The fit list holds each distinct ``x`` vector
once. ``n`` and the sums ``S`` of its dimensions come first; then every fit vector is centred on the
whole part of the mean, and exact integer sums of squares are aggregated for each dimension, ``y_i**2``, and
for each sum of two dimensions, ``(y_i + y_j)**2``. What is left of the mean is taken off these totals
exactly, so that ``D_i = sum (n x_i - S_i)**2`` and ``P_ij = sum (n x_i - S_i + n x_j - S_j)**2``; no product of
two dimensions is ever summed. ``cov(x_i, x_j) = (P_ij - D_i - D_j) / (2 n**3)``, the only rounding. The
driver holds ``dim * (dim + 1) / 2`` totals and their eigenvectors, whatever the number of rows; tasks add
up their rows before anything is shuffled.

A vector that is null or holds a null or non-finite entry takes no part. Vectors shorter than the longest
have zeros at their end. Entries beyond ``LIMIT`` are taken as ``LIMIT``, where doubles no longer hold every whole
number. A deviation that a long cannot hold is null. Components without variance (as many as the vectors do
not span; all, where one vector is distinct) have ``explained`` 0 and a null ``whitened``, and do not
count in ``identity_error``, which is null without any other component. Equal eigenvalues have
some orthonormal basis of their own. Null and repeated ids each get their rows; an empty table gives no
rows; columns other than ``vec_id`` and ``embedding`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.session import cut_lineage

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
LIMIT = float(1 << 53)
# A component below this share of the largest eigenvalue has no variance but rounding.
NO_VARIANCE = 1e-13
SUMS = "i int, j int, total decimal(38,0)"


def integers(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and the whole numbers ``x`` (array of longs, all of one length) of the vectors that take part."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("c"))
    whole = rows.where(F.col("c").isNotNull() & F.forall("c", lambda c: c.isNotNull() & (F.abs(c) < float("inf"))))
    dim = whole.agg(F.coalesce(F.max(F.size("c")), F.lit(0)).alias("dim")).first()["dim"]
    held = F.transform("c", lambda c: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), c * SCALE)))
    x = F.transform(held, lambda c: F.floor(c) + F.lit(SHIFT).cast("long"))
    short = F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(dim) - F.size("c"))
    return whole.select("vec_id", F.concat(x, short).alias("x"))


def matrix_of(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as a matrix of longs."""
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def square_totals(y: np.ndarray) -> list[np.ndarray]:
    """For each ``i`` the exact totals of ``y_i**2`` and of ``(y_i + y_j)**2`` for ``j > i``; ``y`` is small enough."""
    totals = []
    for i in range(y.shape[1]):
        sums = y[:, i:] + y[:, i : i + 1]
        sums[:, 0] = y[:, i]
        totals.append(np.einsum("rj,rj->j", sums, sums))
    return totals


def _exact(y: np.ndarray) -> Iterator[list[np.ndarray]]:
    """``square_totals`` of slices of ``y`` whose totals a long holds, or of Python numbers where one row exceeds it."""
    largest = 4 * int(np.abs(y).max(initial=0)) ** 2
    if largest >= 1 << 62:
        y, step = y.astype(object), 64
    else:
        step = min(4096, (1 << 62) // max(largest, 1))
    for at in range(0, len(y), step):
        part = y[at : at + step]
        if part.dtype == object:
            yield [np.array([sum(v * v for v in (part[:, j] + part[:, i] if j > i else part[:, i])) for j in range(i, part.shape[1])], object) for i in range(part.shape[1])]
        else:
            yield square_totals(part)


@dataclass
class Fit:
    """``n`` vectors; ``centre`` and ``rest``: whole part of the mean, and the sums left by it; exact centred totals."""

    n: int
    centre: np.ndarray
    rest: np.ndarray
    single: list[int]
    paired: dict[tuple[int, int], int]

    @property
    def covariance(self) -> np.ndarray:
        dim = len(self.single)
        out = np.zeros((dim, dim))
        for i in range(dim):
            out[i, i] = self.single[i] / self.n**3
        for (i, j), total in self.paired.items():
            out[i, j] = out[j, i] = (total - self.single[i] - self.single[j]) / (2 * self.n**3)
        return out


def fit(distinct: DataFrame) -> Fit:
    """Counts, sums and exact centred squares of the distinct vectors ``x``."""
    places = distinct.select(F.posexplode("x").alias("i", "x"))
    sums = {r["i"]: (int(r["n"]), int(r["s"])) for r in places.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("s")).collect()}
    dim = len(sums)
    n = sums[0][0] if dim else 0
    centre = np.array([sums[i][1] // n for i in range(dim)], np.int64)
    rest = [sums[i][1] - n * int(centre[i]) for i in range(dim)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: list[np.ndarray] | None = None
        for batch in batches:
            for part in _exact(matrix_of(batch.column(0)) - centre) if batch.num_rows else ():
                own = [p.astype(object) for p in part]
                totals = own if totals is None else [t + p for t, p in zip(totals, own, strict=True)]
        if totals:
            i, j = np.triu_indices(dim)
            values = pa.array([Decimal(int(v)) for row in totals for v in row], pa.decimal128(38))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), values], names=["i", "j", "total"])

    found = distinct.select("x").mapInArrow(run, SUMS).groupBy("i", "j").agg(F.sum("total").alias("total")).collect() if dim else []
    # sum (n y - rest)**2 = n**2 sum y**2 - n rest**2, for a dimension and for a sum of two.
    single, paired = [0] * dim, {}
    for r in found:
        i, j, total = r["i"], r["j"], int(r["total"])
        left = rest[i] if i == j else rest[i] + rest[j]
        exact = n * n * total - n * left * left
        if i == j:
            single[i] = exact
        else:
            paired[i, j] = exact
    return Fit(n, centre, np.array(rest, object), single, paired)


def components(fitted: Fit, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvectors (columns), eigenvalues and explained shares, largest first; without variance the value is 0."""
    covariance = fitted.covariance
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    values = np.where(values > NO_VARIANCE * max(float(values.max(initial=0.0)), 0.0), values, 0.0)[:wanted]
    trace = float(np.trace(covariance))
    return vectors[:, :wanted], values, values / trace if trace > 0 else values * 0.0


def whiten(y: np.ndarray, fitted: Fit, basis: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Rows of whole numbers less ``centre``, projected and scaled; not a number where a component has no variance."""
    mean = np.array([int(r) / fitted.n for r in fitted.rest])
    scale = np.where(values > 0, 1 / np.sqrt(np.where(values > 0, values, 1.0)), np.nan)
    return (y.astype(np.float64) - mean) @ basis * scale


def deviations(y: np.ndarray, fitted: Fit) -> list[int | None]:
    """The exact squared length of ``n x - S`` of each row; None where a long cannot hold it."""
    bound = fitted.n * int(np.abs(y).max(initial=0)) + fitted.n
    if y.shape[1] * bound * bound < 1 << 63:
        away = y * fitted.n - fitted.rest.astype(np.int64)
        return np.einsum("rj,rj->r", away, away).tolist()
    away = y.astype(object) * fitted.n - fitted.rest
    totals = [int(sum(v * v for v in row)) for row in away]
    return [t if t < 1 << 63 else None for t in totals]


def identity_error(distinct: DataFrame, fitted: Fit, basis: np.ndarray, values: np.ndarray) -> float | None:
    """The largest entry of (covariance of the whitened fit list - identity), measured on the vectors themselves."""
    width, centre = int((values > 0).sum()), fitted.centre
    if not width:
        return None
    chosen, scaled = basis[:, :width], values[:width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width))
        for batch in batches:
            if batch.num_rows:
                z = whiten(matrix_of(batch.column(0)) - centre, fitted, chosen, scaled)
                total += np.vstack([z.sum(axis=0), z.T @ z])
        i, j = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "total"])

    sums = distinct.select("x").mapInArrow(run, "i bigint, j bigint, total double").groupBy("i", "j").agg(F.sum("total").alias("total"))
    total = np.zeros((width + 1, width))
    for r in sums.collect():
        total[r["i"], r["j"]] = r["total"]
    mean = total[0] / fitted.n
    return float(np.abs(total[1:] / fitted.n - np.outer(mean, mean) - np.eye(width)).max())


ROWS = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, wanted: int = COMPONENTS) -> DataFrame:
    """Per vector that takes part and component: its whitened value, with the fit's figures beside it."""
    rows = cut_lineage(integers(vectors))
    distinct = cut_lineage(rows.select("x").distinct())
    fitted = fit(distinct)
    basis, values, explained = components(fitted, wanted)
    error, centre, width = identity_error(distinct, fitted, basis, values), fitted.centre, len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not width:
                continue
            y = matrix_of(batch.column(1)) - centre
            z, size = whiten(y, fitted, basis, values), len(y) * width
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(len(y)), width))),
                pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(y))),
                pa.array(np.full(size, fitted.n)),
                pa.array(deviations(y, fitted), pa.int64()).take(pa.array(np.repeat(np.arange(len(y)), width))),
                pa.array(z.ravel(), from_pandas=True),
                pa.array(np.tile(explained, len(y))),
                pa.array([error] * size, pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", *[c.split()[0] for c in ROWS.split(", ")]])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, {ROWS}")
