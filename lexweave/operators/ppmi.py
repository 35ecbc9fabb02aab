"""Positive PMI matrices as coordinate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.pmi import pmi
from lexweave.scale import NUMBERED_ROWS, lookup_join


def _with_counts(
    pairs: DataFrame, vocab: DataFrame, sides: tuple[str, ...], max_broadcast_rows: int
) -> DataFrame:
    for side in sides:
        counts = vocab.select(F.col("idx").alias(side), F.col("cnt").alias(f"{side}_cnt"))
        other = [c for c in pairs.columns if c not in (side, "n")]
        pairs = lookup_join(pairs, counts, [side], other, max_broadcast_rows=max_broadcast_rows)
    return pairs


def plain_word_ppmi(
    index_pairs: DataFrame,
    vocab: DataFrame,
    word_total: Column,
    pair_total: Column,
    max_broadcast_rows: int = NUMBERED_ROWS,
) -> DataFrame:
    """``(min_idx, max_idx, val)``, one row per unordered pair."""
    counted = _with_counts(index_pairs, vocab, ("a", "b"), max_broadcast_rows)
    value = pmi(
        F.col("n"), pair_total, F.col("a_cnt"), word_total, F.col("b_cnt"), word_total
    )
    return (
        counted.select(
            F.least("a", "b").alias("min_idx"), F.greatest("a", "b").alias("max_idx"),
            value.alias("val"),
        )
        .where(F.col("val") > 0)
    )


def context_word_ppmi(
    index_pairs: DataFrame,
    vocab: DataFrame,
    word_total: Column,
    pair_total: Column,
    dim: int,
    max_broadcast_rows: int = NUMBERED_ROWS,
) -> DataFrame:
    """``(col, row, val)``: targets are columns, contexts with an index below ``dim`` are rows.

    Each pair is emitted in both directions; a self pair therefore appears twice. Pairs without
    any context below ``dim`` are dropped before the joins.
    """
    reachable = index_pairs.where((F.col("a") < dim) | (F.col("b") < dim))
    counted = _with_counts(reachable, vocab, ("a", "b"), max_broadcast_rows)
    value = pmi(
        F.col("n"), pair_total, F.col("a_cnt"), word_total, F.col("b_cnt"), word_total
    )
    positive = counted.select("a", "b", value.alias("val")).where(F.col("val") > 0)
    both = F.array(
        F.struct(F.col("a").alias("col"), F.col("b").alias("row")),
        F.struct(F.col("b").alias("col"), F.col("a").alias("row")),
    )
    return positive.select(F.inline(both), "val").where(F.col("row") < dim)


def phrase_ppmi(
    context_counts: DataFrame,
    phrase_vocab: DataFrame,
    vocab: DataFrame,
    word_total: Column,
    totals: DataFrame,
    dim: int,
) -> DataFrame:
    """``(label, col, row, val)``: kept phrases are columns, words below ``dim`` are rows.

    ``context_counts`` is keyed by ``(label, w1, w2, ctx)`` with ``ctx`` a vocabulary index;
    ``totals`` is ``(label, p_total, c_total)``, one row for each of the five labels.
    """
    kept = phrase_vocab.select(
        "label", "w1", "w2", F.col("idx").alias("col"), F.col("cnt").alias("p_cnt")
    )
    words = vocab.where(F.col("idx") < dim).select(
        F.col("idx").alias("ctx"), F.col("cnt").alias("w_cnt")
    )
    counted = lookup_join(
        context_counts.where(F.col("ctx") < dim), words, ["ctx"], ["label", "w1", "w2"]
    )
    # The totals have one row per label.
    counted = counted.join(kept, ["label", "w1", "w2"]).join(F.broadcast(totals), "label")
    value = pmi(
        F.col("n"), F.col("c_total"), F.col("p_cnt"), F.col("p_total"), F.col("w_cnt"), word_total
    )
    return counted.select("label", "col", F.col("ctx").alias("row"), value.alias("val")).where(
        F.col("val") > 0
    )
