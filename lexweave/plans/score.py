"""Decomposition and scoring jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lexweave.operators import compose, rules, trees
from lexweave.session import cut_lineage


def decompose(
    rule_table: DataFrame, sentences: DataFrame, include_last: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Node table and expression texts of all rules."""
    placed = trees.phrase_sentences(rule_table, sentences, include_last)
    nodes = cut_lineage(trees.phrase_nodes(placed))
    return nodes, trees.expression_texts(rule_table, nodes)


def score(
    rule_table: DataFrame, nodes: DataFrame, word_vectors: DataFrame, modifiers: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Score rows and the composed fragments they rest on."""
    fragments = cut_lineage(compose.compose(nodes, word_vectors, modifiers))
    return rules.rule_scores(rule_table, fragments), fragments
