"""A deterministic stand-in for a tagger and a dependency parser.

The engine starts from tagged, parsed text. These rules derive such text from an untagged
table so that every operator can run over it; they make no linguistic claim.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from lexweave.functions.batches import bounds, is_set, list_array, text_bytes, texts_of
from lexweave.functions.tokens import EDGE_MARK

# The stand-in tag classes and the tag pairs that yield an edge.
TAGS = ("nn", "vb", "jj", "rb", "in", "dt")
EDGE_RULES = {
    "jjnn": ("amod", "right"),
    "nnvb": ("nsubj", "right"),
    "vbnn": ("dobj", "left"),
    "innn": ("pobj", "left"),
    "vbjj": ("acomp", "left"),
}
EDGE_REACH = 4
SENTENCES_PER_SIDE = 2
# An array of lines has under 2^31 elements, so a text has at most 2^29 blocks of four.
RULE_STRIDE = 1 << 29


class _Lines:
    """The tagged words of a batch of texts, one text after the other; null texts have none.

    The texts are in lower case already. ``lemmas`` are split at blanks with all but a-z taken out of them, ``tags``
    are places in ``TAGS`` (-1 for an empty lemma), ``bounds`` tell the texts apart.
    """

    def __init__(self, texts: pa.Array):
        self.valid = is_set(texts)
        data, at = text_bytes(texts)
        kept = ((data >= ord("a")) & (data <= ord("z"))) | (data == ord(" "))
        data, at = data[kept], bounds(kept)[at]
        blanks = bounds(data == ord(" "))[at]
        # Each text ends with a blank more, so that every word ends at one.
        data = np.insert(data, at[1:], ord(" "))
        ends = np.flatnonzero(data == ord(" "))
        last = blanks[1:] + np.arange(len(texts))
        missing = last[~self.valid]
        sizes = np.delete(np.diff(ends, prepend=-1) - 1, missing)
        letters = data[data != ord(" ")]
        self.offsets = bounds(sizes)
        self.lemmas = texts_of(letters, self.offsets)
        self.bounds = bounds(np.where(self.valid, np.diff(blanks) + 1, 0))
        self.of = np.repeat(np.arange(len(texts)), np.diff(self.bounds))
        first = np.concatenate([letters, np.zeros(1, np.uint8)])[self.offsets[:-1]]
        self.tags = np.where(sizes > 0, (first + sizes) % len(TAGS), -1)

    def beside(self, offset: int) -> np.ndarray:
        """Tag of the word ``offset`` places on in the same text, -1 where there is none."""
        found = np.full(len(self.tags), -1)
        n = len(self.tags) - abs(offset)
        if n > 0:
            here, there = (slice(0, n), slice(offset, None)) if offset > 0 else (slice(-offset, None), slice(0, n))
            found[here] = np.where(self.of[here] == self.of[there], self.tags[there], -1)
        return found

    def named(self) -> pa.Array:
        return pa.array([*TAGS, "--"]).take(pa.array(np.where(self.tags < 0, len(TAGS), self.tags)))

    def listed(self, values: pa.Array) -> pa.ListArray:
        return list_array(self.bounds, values, self.valid)


def _numbers(most: int) -> pa.Array:
    return pa.array(np.arange(most + 1)).cast(pa.string())


def _parsed(texts: pa.Array) -> pa.Array:
    lines = _Lines(texts)
    words = pc.binary_join_element_wise(lines.lemmas, lines.named(), "/")
    rule = np.full((len(TAGS) + 1, len(TAGS) + 1), -1)
    for k, tags in enumerate(EDGE_RULES):
        rule[TAGS.index(tags[:2]), TAGS.index(tags[2:])] = k
    found = []
    for d in range(1, EDGE_REACH + 1):
        kinds = rule[lines.tags, lines.beside(d)]
        i = np.flatnonzero(kinds >= 0)
        found.append((i, kinds[i], np.full(len(i), d)))
    i, kinds, d = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(lines.of[i], kind="stable")  # in a line by distance, then place
    i, kinds, d = i[order], kinds[order], d[order]
    right = np.array([governor == "right" for _, governor in EDGE_RULES.values()])[kinds]
    place = i - lines.bounds[lines.of[i]]
    spelled = _numbers(int(np.diff(lines.bounds).max(initial=0)))
    ends = (spelled.take(pa.array(place + np.where(right, d, 0))), spelled.take(pa.array(place + np.where(right, 0, d))))
    labels = pa.array([label for label, _ in EDGE_RULES.values()]).take(pa.array(kinds))
    edges = list_array(bounds(np.bincount(lines.of[i], minlength=len(texts))), pc.binary_join_element_wise(labels, *ends, "-"))
    return pc.binary_join_element_wise(pc.binary_join(lines.listed(words), " "), pc.binary_join(edges, " "), EDGE_MARK)


# Tag, and where its governor may stand: tags, places from near to far, relation.
HEAD_RULES = {
    "jj": [(("nn",), range(1, 4), "amod"), (("vb",), range(-1, -4, -1), "acomp")],
    "nn": [
        (("in",), range(-1, -4, -1), "pobj"),
        (("vb",), range(-1, -5, -1), "dobj"),
        (("vb",), range(1, 5), "nsubj"),
    ],
    "in": [(("nn", "vb"), range(-1, -4, -1), "prep")],
}
RELATIONS = ("root", "amod", "acomp", "pobj", "dobj", "nsubj", "prep")


def _headed(texts: pa.Array) -> pa.ListArray:
    """Tokens with a governor (1-based, 0 for a root) and a relation each."""
    lines = _Lines(texts)
    gov, rel = np.zeros(len(lines.tags), np.int32), np.zeros(len(lines.tags), np.int64)
    place = np.arange(len(lines.tags)) - lines.bounds[lines.of] + 1
    near = {offset: lines.beside(offset) for offset in (*range(-4, 0), *range(1, 5))}
    for own, rules in HEAD_RULES.items():
        free = lines.tags == TAGS.index(own)
        for governors, offsets, name in rules:
            for offset in offsets:
                hit = free & np.isin(near[offset], [TAGS.index(g) for g in governors])
                gov[hit], rel[hit] = place[hit] + offset, RELATIONS.index(name)
                free &= ~hit
    columns = [lines.lemmas, lines.named(), pa.array(gov), pa.array(RELATIONS).take(pa.array(rel))]
    return lines.listed(pa.StructArray.from_arrays(columns, names=["lemma", "tag", "gov", "rel"]))


def _placed_words(texts: pa.Array) -> pa.Array:
    """Every word of the valid tags as ``word-idx``."""
    lines = _Lines(texts)
    held = np.flatnonzero((lines.tags >= 0) & (lines.tags != TAGS.index("dt")))
    place = held - lines.bounds[lines.of[held]] + 1
    spelled = _numbers(int(np.diff(lines.bounds).max(initial=0)))
    rows = pa.array(held)
    words = pc.binary_join_element_wise(lines.lemmas.take(rows), spelled.take(pa.array(place)), "-")
    kept = bounds(np.bincount(lines.of[held], minlength=len(texts)))
    return pc.binary_join(list_array(kept, words, lines.valid), " ")


def _derived(df: DataFrame, name: str, kind: DataType, made: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """``df`` with the column ``name`` that ``made`` gives for batches of the lower-cased ``text``, in place of it."""
    kept = [c for c in df.columns if c != "text"]
    schema = StructType([df.schema[c] for c in kept]).add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), made(batch.column("_lower"))], names=schema.names)

    return df.select(*kept, F.lower("text").alias("_lower")).mapInArrow(run, schema)


def parsed_text(lines: DataFrame) -> DataFrame:
    """``(doc_id, line_no, text)`` in the parsed-line format."""
    return _derived(lines.select("doc_id", "line_no", "text"), "text", StringType(), _parsed)


def headed(lines: DataFrame) -> DataFrame:
    """Add ``tokens array<struct<lemma, tag, gov, rel>>``: one governor per token."""
    token = StructType.fromDDL("lemma string, tag string, gov int, rel string")
    return _derived(lines, "tokens", ArrayType(token), _headed)


def rule_sentences(docs: DataFrame) -> DataFrame:
    """``(rule_id, side, sent_no, tokens)``: blocks of four lines, two sentences per side."""
    from lexweave.sources.corpus import lines_of

    block = 2 * SENTENCES_PER_SIDE
    return headed(lines_of(docs)).select(
        (F.col("doc_id") * RULE_STRIDE + F.floor(F.col("line_no") / block)).alias("rule_id"),
        F.when(F.col("line_no") % block < SENTENCES_PER_SIDE, "L").otherwise("R").alias("side"),
        (F.col("line_no") % SENTENCES_PER_SIDE).alias("sent_no"),
        "tokens",
    )


def rule_phrases(docs: DataFrame) -> DataFrame:
    """``(rule_id, side, phrase)``: every tagged word of a side as ``word-idx``.

    The index runs over the whole text of the side. Both sides are always present.
    """
    block = 2 * SENTENCES_PER_SIDE
    lines = F.split("text", "\n")
    starts = F.sequence(F.lit(0), F.size(lines) - 1, F.lit(block))
    blocks = docs.select("doc_id", lines.alias("lines"), F.posexplode(starts).alias("b", "at"))
    sides = blocks.select(
        (F.col("doc_id") * RULE_STRIDE + F.col("b")).alias("rule_id"),
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(side).alias("side"),
                        F.array_join(
                            F.slice("lines", F.col("at") + 1 + shift, F.lit(SENTENCES_PER_SIDE)),
                            " ",
                        ).alias("text"),
                        F.size(
                            F.slice("lines", F.col("at") + 1 + shift, F.lit(SENTENCES_PER_SIDE))
                        ).alias("n_lines"),
                    )
                    for side, shift in (("L", 0), ("R", SENTENCES_PER_SIDE))
                ]
            )
        ).alias("s"),
    ).select("rule_id", "s.*")
    phrase = F.when(F.col("n_lines") > 0, F.col("phrase"))
    return _derived(sides, "phrase", StringType(), _placed_words).select("rule_id", "side", F.coalesce(phrase, F.lit("")).alias("phrase"))
