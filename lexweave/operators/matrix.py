"""Coordinate matrices: loading weights, symmetry, statistics, sparse columns, cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from lexweave.functions.batches import changes, integers, is_set, list_array
from lexweave.gather import Part, gathered
from lexweave.scale import BROADCAST_ROWS, lookup_join
from lexweave.session import cut_lineage

# Sparse columns are kept in segments of this many consecutive indices, so that no group grows
# with the vocabulary.
SEGMENT = 1024


def load_matrix(
    coo: DataFrame, weight: str = "binary", extra: tuple[str, ...] = ()
) -> DataFrame:
    """``(*extra, row, col, val)`` with duplicate cells summed.

    ``binary`` gives each entry the weight 1, so a doubled diagonal becomes 2; ``ppmi`` keeps
    the values.
    """
    if weight not in ("binary", "ppmi"):
        raise ValueError(f"unknown weight: {weight}")
    value = F.lit(1.0) if weight == "binary" else F.col("val")
    return coo.groupBy(*extra, "row", "col").agg(F.sum(value).alias("val"))


def load_symmetric(ppmi: DataFrame) -> DataFrame:
    """Weight-1 matrix from unordered pairs: off-diagonal entries go both ways."""
    pair = F.struct(F.col("min_idx").alias("row"), F.col("max_idx").alias("col"))
    swapped = F.struct(F.col("max_idx").alias("row"), F.col("min_idx").alias("col"))
    cells = F.when(F.col("min_idx") == F.col("max_idx"), F.array(pair)).otherwise(
        F.array(pair, swapped)
    )
    return load_matrix(ppmi.select(F.inline(cells)))


def matrix_stats(matrix: DataFrame) -> DataFrame:
    """Rows, columns and stored entries, by highest index as a loader sizes the matrix."""
    return matrix.agg(
        F.coalesce(F.max("row") + 1, F.lit(0)).alias("n_rows"),
        F.coalesce(F.max("col") + 1, F.lit(0)).alias("n_cols"),
        F.count(F.lit(1)).alias("nnz"),
    )


def sparse_vectors(ppmi: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``(idx, segment, entries)``: the mirrored pair matrix, one sorted piece per segment.

    ``entries`` is ``array<struct<ctx, val>>`` ascending by ``ctx``; the segments of a word in
    order give its whole vector.
    """
    there = F.struct(F.col("min_idx").alias("idx"), F.col("max_idx").alias("ctx"))
    back = F.struct(F.col("max_idx").alias("idx"), F.col("min_idx").alias("ctx"))
    both = F.when(F.col("min_idx") == F.col("max_idx"), F.array(there)).otherwise(
        F.array(there, back)
    )
    cells = ppmi.select(F.inline(both), F.round("val", 6).alias("val"))
    return segments(cells, "idx", "ctx", segment).select(
        "idx",
        "segment",
        F.transform(
            "entries", lambda e: F.struct(e.inner.alias("ctx"), e.val.alias("val"))
        ).alias("entries"),
    )


def segments(cells: DataFrame, outer: str, inner: str, segment: int = SEGMENT) -> DataFrame:
    """``(outer, segment, entries array<struct<inner, val>>)``, at most ``segment`` entries each."""
    piece = F.floor(F.col(inner) / segment).cast("bigint")
    rows = cells.select(outer, piece.alias("segment"), F.col(inner).alias("inner"), F.col("val").alias("val"))
    fields = [rows.schema[c] for c in (outer, "segment", "inner", "val")]
    schema = StructType([*fields[:2], StructField("entries", ArrayType(StructType(fields[2:])))])

    def listed(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        owner, part, place, val = (tables[0].column(c).combine_chunks() for c in rows_of)
        order = np.lexsort((val.to_numpy(zero_copy_only=False), integers(place), integers(part), integers(owner), is_set(owner)))
        table = tables[0].take(pa.array(order)).combine_chunks()
        starts = np.flatnonzero(changes(table, rows_of[:2]))
        entries = pa.StructArray.from_arrays([table.column(c).combine_chunks() for c in rows_of[2:]], names=["inner", "val"])
        own = table.select(rows_of[:2]).take(pa.array(starts))
        columns = [*(c.combine_chunks() for c in own.columns), list_array(np.append(starts, table.num_rows), entries)]
        yield from pa.table(columns, names=names).to_batches(max_chunksize=10_000)

    rows_of, names = rows.columns, schema.names
    return gathered([Part(rows)], [outer, "segment"], listed, schema)


def word_cosine(
    pairs: DataFrame,
    matrix: DataFrame,
    vocab: DataFrame,
    max_broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``(w1, w2, cosine)``, signed, over sparse columns.

    -1 when a word is not in the vocabulary, NULL when a column is empty.
    """
    coded = pairs.select("w1", "w2").distinct()
    for part, other in (("w1", "w2"), ("w2", "w1")):
        code = vocab.select(F.col("term").alias(part), F.col("idx").alias(f"{part}_idx"))
        coded = lookup_join(coded, code, [part], [other], "left", max_broadcast_rows)

    norms = matrix.groupBy("col").agg(F.sqrt(F.sum(F.col("val") * F.col("val"))).alias("norm"))
    # Pairs with an unknown word are done here: no join below sees a missing index.
    coded = cut_lineage(coded)
    missing = F.col("w1_idx").isNull() | F.col("w2_idx").isNull()
    known = coded.where(~missing)
    left = matrix.select(F.col("col").alias("w1_idx"), "row", F.col("val").alias("x"))
    right = matrix.select(F.col("col").alias("w2_idx"), "row", F.col("val").alias("y"))
    cells = lookup_join(
        known.select("w1_idx", "w2_idx"), left, ["w1_idx"], ["w2_idx"],
        max_broadcast_rows=max_broadcast_rows,
    )
    products = lookup_join(
        cells, right, ["w2_idx", "row"], ["w1_idx"], max_broadcast_rows=max_broadcast_rows
    )
    dots = products.groupBy("w1_idx", "w2_idx").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    scored = known.join(dots, ["w1_idx", "w2_idx"], "left")
    for part, other in (("w1", "w2"), ("w2", "w1")):
        side = norms.select(
            F.col("col").alias(f"{part}_idx"), F.col("norm").alias(f"{part}_norm")
        )
        scored = lookup_join(
            scored, side, [f"{part}_idx"], [f"{other}"], "left", max_broadcast_rows
        )
    cosine = F.coalesce("dot", F.lit(0.0)) / F.col("w1_norm") / F.col("w2_norm")
    unknown = coded.where(missing).select("w1", "w2", F.lit(-1.0).alias("cosine"))
    return scored.select("w1", "w2", cosine.alias("cosine")).unionByName(unknown)
