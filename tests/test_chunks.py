"""Words of chunks of lines are looked up, not their tokens, and pairs meet a vocabulary of many rows without a shuffle."""

import pytest
from pyspark.sql import functions as F

from lexweave.operators import cooc, ppmi, vocab
from lexweave.scale import BROADCAST_ROWS
from test_counts import LINES, random_lines


def built(spark, rows):
    tokens = vocab.plain_token_arrays(spark.createDataFrame(rows, LINES))
    return tokens, vocab.lexicographic_vocab(vocab.at_least(vocab.plain_word_counts(tokens), 40))


@pytest.mark.parametrize("chunk", [1, 50, 1 << 20])
def test_chunks_give_the_pairs_of_the_broadcast(spark, monkeypatch, chunk):
    """whatever the chunks, and with lines of no known word, empty and null ones."""
    monkeypatch.setattr(cooc, "CHUNK_TOKENS", chunk)
    tokens, words = built(spark, [*((i, 0, t) for i, t in enumerate(random_lines(5))), (90, 0, "zz yy"), (91, 0, ""), (None, 0, "w0 w1"), (92, 0, None)])
    got, want = (
        sorted(map(tuple, cooc.plain_index_pair_counts(cooc.plain_sequences(tokens, words, 3, 4, max_broadcast_rows=limit)).collect()))
        for limit in (0, 1000)
    )
    assert got == want


def test_a_chunk_lists_a_word_once(spark):
    """what is shuffled for the lookup follows the words of a chunk, not its tokens."""
    rows = spark.createDataFrame([(i, 0, 0, False, [(p, f"w{p % 3}") for p in range(50)]) for i in range(20)], "doc_id long, line_no int, piece int, long boolean, words array<struct<pos: int, term: string>>").coalesce(1)
    chunks = cooc._chunked(rows)
    assert sorted(r.term for r in chunks.where("term IS NOT NULL").collect()) == ["w0", "w1", "w2"]
    assert chunks.where("code IS NULL").agg(F.sum(F.size("codes"))).first()[0] == 1000


def test_rows_of_one_line_stand_together(spark):
    rows = [(1, 0, " ".join(["a", "b"] * 40)), (1, 0, " ".join(["a", "b"] * 40))]
    tokens, words = built(spark, rows)
    seqs = cooc.plain_sequences(tokens, words, 3, max_broadcast_rows=0).collect()
    assert [list(r["items"]) for r in seqs] == [[0, 0, 1, 1] * 40]


def test_numbered_words_are_broadcast_by_their_bytes(spark):
    """The counts of over 500,000 words are 16 bytes each; pairs are not shuffled for them."""
    words = spark.range(BROADCAST_ROWS + 1).select(F.col("id").alias("idx"), (F.col("id") + 10).alias("cnt"), F.col("id").cast("string").alias("term"))
    pairs = spark.range(100).select(F.col("id").alias("a"), (F.col("id") + BROADCAST_ROWS - 99).alias("b"), F.lit(5).alias("n"))
    valued = ppmi.plain_word_ppmi(pairs, words, F.lit(10**9), F.lit(10**6))
    for df in (valued, cooc.spell_pairs(pairs, words)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("strategy=broadcast") == 2 and "_salt" not in plan
        assert df.count() == 100
