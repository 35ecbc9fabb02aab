"""Word counts, corpus totals, filters and vocabularies with explicit indices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.functions.tokens import plain_tokens
from lexweave.scale import lookup_join, sorted_index
from lexweave.session import cut_lineage
from lexweave.sources.corpus import valid_terms

PLAIN_MIN_COUNT = 10
PHRASE_MIN_COUNT = 20
VOCAB_SIZE = 50_000
# Bits of a count that one pass of the selection looks at.
CUTOFF_BITS = 10


def plain_token_arrays(lines: DataFrame, keep_empty: bool = False) -> DataFrame:
    return lines.select(
        "doc_id", "line_no", plain_tokens(F.col("text"), keep_empty).alias("tokens")
    )


def plain_token_rows(lines: DataFrame) -> DataFrame:
    """``(doc_id, line_no, pos, term)``; positions count the empty tokens that are left out."""
    return lines.select(
        "doc_id", "line_no", F.posexplode(F.split(F.lower("text"), " ")).alias("pos", "term")
    ).where(F.col("term") != "")


# The outer form of explode keeps the optimizer from adding a filter on the array's size, which
# would tokenise every line a second time.


def plain_word_counts(token_arrays: DataFrame) -> DataFrame:
    words = token_arrays.select(F.explode_outer("tokens").alias("term"))
    words = words.where(F.col("term").isNotNull())
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("cnt"))


def tagged_word_counts(parsed: DataFrame) -> DataFrame:
    """Counts of the valid terms."""
    words = parsed.select(F.explode_outer("terms").alias("term")).where(F.col("term").isNotNull())
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("cnt"))


def plain_total(token_arrays: DataFrame) -> DataFrame:
    """All tokens, before any threshold, without exploding them."""
    return token_arrays.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("total"))


def tagged_total(parsed: DataFrame) -> DataFrame:
    """All valid terms, before any cut."""
    return parsed.agg(
        F.coalesce(F.sum(F.size(valid_terms(F.col("terms")))), F.lit(0)).alias("total")
    )


def at_least(counts: DataFrame, threshold: int) -> DataFrame:
    return counts.where(F.col("cnt") >= threshold)


def lexicographic_vocab(counts: DataFrame) -> DataFrame:
    """``(term, cnt, idx)``: idx is the 0-based position in term order, at any vocabulary size."""
    return sorted_index(counts, ["term"])


def cutoff(counts: DataFrame, k: int) -> tuple[int, int, int]:
    """The count of the k-th most frequent row, how many rows have more, and how many have just as much.

    Digit by digit from the highest on: each pass makes a histogram of one digit of ``CUTOFF_BITS`` bits
    among the counts whose higher digits are those of the answer, so the driver sees no more rows than
    a digit has values. ``(0, n, 0)`` where there are fewer than k rows.
    """
    seen = counts.agg(F.count(F.lit(1)).alias("n"), F.max("cnt").alias("most")).first()
    if seen.n < k or k < 1:
        return (0, seen.n, 0) if k > 0 else (seen.most or 0, 0, 0)
    shift = max(int(seen.most).bit_length() - 1, 0) // CUTOFF_BITS * CUTOFF_BITS
    prefix, above = 0, 0
    while True:
        digits = counts.where(F.shiftright("cnt", shift + CUTOFF_BITS) == prefix)
        digit = F.shiftright("cnt", shift).bitwiseAND(F.lit((1 << CUTOFF_BITS) - 1)).alias("digit")
        histogram = digits.groupBy(digit).agg(F.count(F.lit(1)).alias("n")).collect()
        for row in sorted(histogram, key=lambda r: -r.digit):
            if above + row.n >= k:
                break
            above += row.n
        prefix = (prefix << CUTOFF_BITS) + row.digit
        if not shift:
            return prefix, above, row.n
        shift -= CUTOFF_BITS


def top_k(counts: DataFrame, k: int = VOCAB_SIZE) -> DataFrame:
    """The k most frequent terms; equal counts are broken by the larger term.

    A selection, not a sort: rows above the cut-off count pass a filter, and only the rows at it are
    sorted, over all partitions, where some of them must go.
    """
    counts = cut_lineage(counts)
    count, above, equal = cutoff(counts, k)
    if above + equal <= k:
        return counts.where(F.col("cnt") >= count) if k > 0 else counts.limit(0)
    placed = sorted_index(counts.where(F.col("cnt") == count), [F.desc("term")], "_place")
    tied = placed.where(F.col("_place") < k - above).select(*counts.columns)
    return counts.where(F.col("cnt") > count).unionByName(tied)


def frequency_vocab(counts: DataFrame, k: int = VOCAB_SIZE) -> DataFrame:
    """``(term, cnt, idx)``: index 0 is the most frequent. The order is that of a distributed sort."""
    return sorted_index(top_k(counts, k), [F.desc("cnt"), F.desc("term")])


def phrases_in_vocab(phrase_counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Phrases whose two words are both in a (top-k) vocabulary."""
    words = vocab.select("term")
    for part, other in (("w1", "w2"), ("w2", "w1")):
        side = words.withColumnRenamed("term", part)
        phrase_counts = lookup_join(phrase_counts, side, [part], ["label", other], "left_semi")
    return phrase_counts


def phrase_vocab(kept: DataFrame) -> DataFrame:
    """``(label, w1, w2, phrase, cnt, idx)``: idx restarts per label, in phrase order."""
    named = kept.withColumn("phrase", F.concat_ws("+", "w1", "w2"))
    return sorted_index(named, ["phrase"], within="label").select(
        "label", "w1", "w2", "phrase", "cnt", "idx"
    )
