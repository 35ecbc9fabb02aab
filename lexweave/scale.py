"""Helpers that keep joins, groups and indices safe for skewed or very large inputs.

Everything here is exact: rows are spread, salted or replicated, never dropped or capped.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.session import cut_lineage

# A side is broadcast only when it was checked to have at most this many rows and bytes.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
# A vocabulary read by its numbers has two small columns: within the same bytes more rows of it may be broadcast.
NUMBERED_ROWS = 4_000_000
# Hot keys are split so that one salted group holds about this many rows.
ROWS_PER_SALT = 4096
# Rows without a key match nothing; they are spread over this many salts.
NULL_SALTS = 1024
# Of very many hot keys the hottest get their salts first, from a table of this size.
HOTTEST = 50_000


def spread(df: DataFrame, partitions: int | None) -> DataFrame:
    """``df`` dealt over ``partitions``, or as it is read where none are asked for."""
    return df.repartition(partitions) if partitions else df


def _row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes."""
    total = F.lit(0).cast("bigint")
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        if kind in ("string", "binary"):
            size = F.octet_length(field.name)
        elif kind == "array":
            inner = field.dataType.elementType.typeName()
            flat = F.flatten(field.name) if inner == "array" else F.col(field.name)
            size = F.size(flat) * 8
        else:
            size = F.lit(8)
        total = total + F.coalesce(size, F.lit(0))
    return total


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` has at most ``max_rows`` rows and ``max_bytes`` bytes; reads one row beyond at most."""
    head = df.limit(max_rows + 1)
    seen = head.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(_row_bytes(df)), F.lit(0)).alias("size")).first()
    return seen.n <= max_rows and seen.size <= max_bytes


def hot_keys(df: DataFrame, keys: Sequence[str], rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Keys with more than ``rows_per_salt`` rows and the number of salts each one needs."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    present = [F.col(k).isNotNull() for k in keys]
    return counts.where(reduce(Column.__and__, present, F.col("_n") > rows_per_salt)).select(
        *keys, F.ceil(F.col("_n") / rows_per_salt).cast("int").alias("_salts")
    )


def _with_salts(df: DataFrame, hot: DataFrame, keys: Sequence[str], spread_on: Sequence[str]) -> DataFrame:
    """Add ``_salts``, NULL for ordinary keys.

    A hot-key table of checked size is broadcast. Of a larger one only the hottest keys are; their
    rows are spread before the rest is joined by a shuffle, in which a key then has no more rows
    than the least hot of the broadcast ones.
    """
    if fits_broadcast(hot, HOTTEST):
        return df.join(F.broadcast(hot), list(keys), "left")
    top = cut_lineage(hot.orderBy(F.desc("_salts"), *keys).limit(HOTTEST))
    others = hot.join(F.broadcast(top), list(keys), "left_anti").withColumn("_dealt", F.lit(0))
    first = df.join(F.broadcast(top.withColumnRenamed("_salts", "_top")), list(keys), "left")
    away = F.pmod(F.xxhash64(*spread_on), F.coalesce("_top", F.lit(1)).cast("bigint")).cast("int")
    dealt = first.withColumn("_dealt", F.when(F.col("_top").isNull(), 0).otherwise(away + 1))
    joined = dealt.join(others, [*keys, "_dealt"], "left")
    return joined.withColumn("_salts", F.coalesce("_top", "_salts")).drop("_top", "_dealt")


def add_salt(
    df: DataFrame, hot: DataFrame, keys: Sequence[str], spread_on: Sequence[str]
) -> DataFrame:
    """Add ``_salt``: 0 for ordinary keys, a hash of ``spread_on`` for hot ones and for NULL keys."""
    tagged = _with_salts(df, hot, keys, spread_on)
    missing = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    salts = F.when(missing, NULL_SALTS).otherwise(F.coalesce("_salts", F.lit(1))).cast("bigint")
    return tagged.withColumn("_salt", F.pmod(F.xxhash64(*spread_on), salts).cast("int")).drop("_salts")


def replicate(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Copy each row once per salt of its key."""
    tagged = _with_salts(df, hot, keys, [c for c in df.columns if df.schema[c].dataType.typeName() != "map"])
    salts = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    return tagged.withColumn("_salt", F.explode(salts)).drop("_salts")


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    spread_on: Sequence[str],
    how: str = "inner",
    max_broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join a large, possibly skewed side with a lookup.

    A lookup of checked small size is broadcast; beyond that the join is shuffled with the keys
    that are hot in ``facts`` salted, so that no task receives all rows of one key. The lookup may
    repeat a key: its rows are copied to each salt.
    """
    if fits_broadcast(lookup, max_broadcast_rows):
        return facts.join(F.broadcast(lookup), list(keys), how)
    # Hot keys and the join both read the facts: of a chain of lookups none is computed again by the next.
    facts = cut_lineage(facts)
    hot = cut_lineage(hot_keys(facts, keys))
    left = add_salt(facts, hot, keys, spread_on)
    right = replicate(lookup, hot, keys)
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def sorted_index(
    df: DataFrame, order: Sequence[Column | str], index: str = "idx", within: str | None = None
) -> DataFrame:
    """Dense 0-based position in the total order (optionally restarting per ``within``).

    The rows are range-partitioned and sorted, then written once so that the ranges stay fixed;
    each partition counts its rows and the offsets are a running sum over the partitions. No
    task ever sorts more than its own range.
    """
    keys = [within, *order] if within else list(order)
    staged = cut_lineage(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftrightunsigned("_mid", 33).cast("int"))
        .withColumn("_local", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_mid")
    )
    # One row per partition (and value of ``within``): bounded by the partition count.
    sizes = staged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_off"))
    placed = staged.join(F.broadcast(offsets), "_part").withColumn(
        index, (F.col("_local") + F.col("_off")).cast("bigint")
    )
    if within:
        starts = placed.groupBy(within).agg(F.min(index).alias("_start"))
        placed = (
            placed.join(F.broadcast(starts), within)
            .withColumn(index, F.col(index) - F.col("_start"))
            .drop("_start")
        )
    return placed.drop("_part", "_local", "_off")
