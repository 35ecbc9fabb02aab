"""Parsing that reports what it drops, in the pass that writes the parsed corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lexweave.session import cut_lineage
from lexweave.sources.decoding import decode_lines


def parse_observed(lines: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, int]]:
    """The written table of ``corpus.parse_lines``, and how many tokens and edges were seen and kept.

    ``tokens_kept`` have a valid tag and lemma, ``edges_kept`` a wanted label and two such tokens. Nothing is read
    twice: the sums are observed while the table is written. A task that runs again after a lost executor may be
    counted again, so these are figures for reports, not for results.
    """
    counted = decode_lines(lines, text, seen=True)
    sums = {"tokens": "_tokens", "tokens_kept": "_valid", "edges": "_edges", "edges_kept": "_usable"}
    seen = Observation("parsed")
    watched = counted.observe(seen, *[F.sum(column).alias(name) for name, column in sums.items()])
    table = cut_lineage(watched.drop(*sums.values()))
    return table, {name: int(seen.get.get(name) or 0) for name in sums}
