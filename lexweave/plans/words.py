"""Word jobs: plain text (threshold, lexicographic index) and tagged text (top-k)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from lexweave.operators import cooc, ppmi, vocab
from lexweave.session import cut_lineage


@dataclass
class PlainWords:
    """Lazily planned results of the plain-text job; the vocabulary is already written."""

    tokens: DataFrame
    vocab: DataFrame
    window: int

    def sequences(self) -> DataFrame:
        return cooc.plain_sequences(self.tokens, self.vocab, self.window)

    def index_pairs(self) -> DataFrame:
        return cooc.plain_index_pair_counts(self.sequences(), self.window)

    def ppmi(self) -> DataFrame:
        # Pairs and their total both read the encoded corpus: written once.
        sequences = cut_lineage(self.sequences())
        return ppmi.plain_word_ppmi(
            cooc.plain_index_pair_counts(sequences, self.window),
            self.vocab,
            vocab.plain_total(self.tokens).scalar(),
            cooc.plain_pair_total(sequences, self.window).scalar(),
        )


def plain_words(
    lines: DataFrame,
    window: int = cooc.WINDOW,
    min_count: int = vocab.PLAIN_MIN_COUNT,
    keep_empty: bool = False,
) -> PlainWords:
    """The tokens are written once: counts, totals and pairs each read them again."""
    tokens = cut_lineage(vocab.plain_token_arrays(lines, keep_empty))
    kept = vocab.at_least(vocab.plain_word_counts(tokens), min_count)
    return PlainWords(tokens, vocab.lexicographic_vocab(kept), window)


@dataclass
class TaggedWords:
    """Lazily planned results of the tagged job; the top-k vocabulary is already written."""

    parsed: DataFrame
    vocab: DataFrame
    dim: int
    window: int

    def index_pairs(self) -> DataFrame:
        return cooc.tagged_index_pair_counts(self.parsed, self.vocab, self.window)

    def ppmi(self) -> DataFrame:
        return ppmi.context_word_ppmi(
            self.index_pairs(),
            self.vocab,
            vocab.tagged_total(self.parsed).scalar(),
            cooc.tagged_pair_total(self.parsed, self.window).scalar(),
            self.dim,
        )


def tagged_words(
    parsed: DataFrame,
    window: int = cooc.WINDOW,
    vocab_size: int = vocab.VOCAB_SIZE,
    dim: int = vocab.VOCAB_SIZE,
) -> TaggedWords:
    """``dim`` is clamped to the vocabulary size. The parsed corpus is written once, by column:
    counts, totals, pairs and the phrase job each read it again.
    """
    parsed = cut_lineage(parsed)
    words = vocab.frequency_vocab(vocab.tagged_word_counts(parsed), vocab_size)
    return TaggedWords(parsed, cut_lineage(words), min(dim, vocab_size), window)
