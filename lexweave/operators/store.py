"""Counts and matrices kept in hash buckets of their keys.

Counts of a new part of a corpus are merged with saved ones without reading the old part again, and without a
shuffle of the saved table: only the new counts move, into the buckets of the saved ones. Keys are not
NULL and occur once in each of the two tables; a key has one row, so no bucket depends on how often it was counted.

A matrix is kept by column. A column has at most as many entries as there are rows, so a frequent word makes
no bucket larger than the vocabulary does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.session import bucketed

# At the sizes of a large corpus a bucket of 1/4096 of the distinct pairs fits one task; small corpora take fewer.
BUCKETS = 64
MOST_BUCKETS = 4096


def save(rows: DataFrame, keys: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """``rows`` in ``buckets`` files by the hash of ``keys``."""
    return bucketed([rows.repartition(buckets, *keys)], keys, buckets)


def updated(saved: DataFrame, fresh: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Saved counts plus the fresh ones of the same key."""
    more = fresh.withColumnRenamed(value, "_more").hint("merge")
    sums = saved.join(more, list(keys), "left").withColumn(value, F.col(value) + F.coalesce("_more", F.lit(0)))
    return sums.select(*saved.columns)


def added(saved: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fresh counts of keys that were not seen before."""
    return fresh.join(saved.select(*keys).hint("merge"), list(keys), "left_anti").select(*saved.columns)


def merge_counts(
    saved: DataFrame, counts: DataFrame, keys: Sequence[str], value: str, buckets: int = BUCKETS
) -> DataFrame:
    """A new table with the sums of both; ``saved`` was written by ``save`` or here, and stays as it is."""
    fresh = save(counts.select(*saved.columns), keys, buckets)
    return bucketed([updated(saved, fresh, keys, value), added(saved, fresh, keys)], keys, buckets)


def columns(stored: DataFrame) -> DataFrame:
    """``(col, nnz, norm)`` of a matrix kept by ``col``."""
    return stored.groupBy("col").agg(
        F.count(F.lit(1)).alias("nnz"), F.sqrt(F.sum(F.col("val") * F.col("val"))).alias("norm")
    )


def product(stored: DataFrame, dense: DataFrame) -> DataFrame:
    """``(row, val)``: the matrix kept by ``col`` times a column ``(col, x)``; only ``dense`` is dealt anew.

    Rows are summed within each bucket before they are exchanged.
    """
    cells = stored.join(dense.hint("merge"), "col")
    return cells.groupBy("row").agg(F.sum(F.col("val") * F.col("x")).alias("val"))
