"""Decoding of parsed lines: terms and edges of whole batches, each distinct token and edge looked at once.

The results are those of the column functions ``tokens.parsed_terms`` and ``tokens.parsed_edges``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexweave.functions.batches import bounds, integers, is_set, list_array, list_bounds
from lexweave.functions.tokens import EDGE_MARK, PHRASE_LABELS, VALID_TAGS

PARSED_COLUMNS = "terms array<string>, edges array<struct<label string, gov int, dep int>>"
# What the pass over a line can count: tokens and edges, all of them and those of use.
SEEN_COLUMNS = ("_tokens", "_valid", "_edges", "_usable")

_VALID = re.compile(rf"([a-z]+)/({'|'.join(VALID_TAGS)})([^/]*)")
# A column's regular expression stops at these, unless one of them ends the text.
_LINE_END = re.compile("\r\n|[\n\r\u0085\u2028\u2029]")
_INDEX = re.compile(r"0*([0-9]{1,10})(?:\r\n|\n|\r)?")
_MOST = (1 << 31) - 1


def _term(token: str) -> str | None:
    """``lemma-tt`` of a lower-cased token, None for an invalid one."""
    found = _VALID.fullmatch(token)
    if not found:
        return None
    end = _LINE_END.search(found[3])
    if end and end.end() < len(found[3]):
        return token
    return f"{found[1]}-{found[2]}{end[0] if end else ''}"


def _index(text: str) -> int | None:
    found = _INDEX.fullmatch(text)
    return int(found[1]) if found and int(found[1]) <= _MOST else None


def _edge(text: str, labels: tuple[str, ...]) -> tuple[str, int, int] | None:
    """Label before the first dash, indices from the last two fields; None for an edge that is left out."""
    fields = text.split("-")
    if len(fields) < 3 or fields[0] not in labels:
        return None
    gov, dep = _index(fields[-2]), _index(fields[-1])
    return None if gov is None or dep is None else (fields[0], gov, dep)


def _each(values: pa.Array, made: Callable) -> tuple[pa.Array, list]:
    """Place of each value among the distinct ones, and what ``made`` gives for these."""
    coded = values.dictionary_encode()
    return coded.indices, [made(value) for value in coded.dictionary.to_pylist()]


def decoded(tokens: pa.Array, edges: pa.Array, labels: tuple[str, ...]) -> list[pa.Array]:
    """Terms and edges of lines from their lower-cased token parts and their edge parts, then ``SEEN_COLUMNS``."""
    words = pc.split_pattern(tokens.cast(pa.string()), " ")
    line = list_bounds(words)
    at, spelled = _each(words.flatten(), _term)
    terms = pa.array(spelled, pa.string()).take(at)

    raw = pc.split_pattern(edges.cast(pa.string()), " ")
    at, read = _each(raw.flatten(), lambda text: (text != "", _edge(text, labels)))
    at = np.asarray(at, np.int64)
    of = np.repeat(np.arange(len(edges)), np.diff(list_bounds(raw)))
    there, kept = (np.array(x, np.bool_)[at] for x in ([r[0] for r in read], [r[1] is not None for r in read]))
    fields = [[r[1] and r[1][i] for r in read] for i in range(3)]
    places = pa.array(at[kept])
    label, gov, dep = (pa.array(x, kind).take(places) for x, kind in zip(fields, (pa.string(), pa.int32(), pa.int32()), strict=True))

    valid = np.append(is_set(terms), False)
    owner, size = of[kept], np.diff(line)
    ends = (np.where(x < size[owner], line[owner] + x, len(valid) - 1) for x in (integers(gov), integers(dep)))
    usable = np.logical_and(*(valid[x] for x in ends))

    def count(lines: np.ndarray) -> pa.Array:
        return pa.array(np.bincount(lines, minlength=len(edges)))

    return [
        list_array(line, terms, is_set(tokens)),
        list_array(bounds(np.bincount(owner, minlength=len(edges))), pa.StructArray.from_arrays([label, gov, dep], names=["label", "gov", "dep"])),
        pa.array(size),
        pa.array(np.diff(bounds(valid[:-1])[line])),
        count(of[there]),
        count(owner[usable]),
    ]


def decode_lines(lines: DataFrame, text: str = "text", seen: bool = False, labels: tuple[str, ...] = PHRASE_LABELS) -> DataFrame:
    """``(doc_id, line_no, terms, edges)`` from parsed lines, with ``seen`` also ``SEEN_COLUMNS``."""
    keys = ["doc_id", "line_no"]
    # Only the tokens are compared in lower case.
    tokens = F.lower(F.substring_index(F.col(text), EDGE_MARK, 1)).alias("_words")
    marks = F.get(F.split(F.col(text), EDGE_MARK), F.lit(1)).alias("_marks")
    kinds = PARSED_COLUMNS + "".join(f", {c} bigint" for c in SEEN_COLUMNS if seen)
    schema = StructType([*(lines.schema[c] for c in keys), *StructType.fromDDL(kinds).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = decoded(batch.column("_words"), batch.column("_marks"), labels)
            own = [batch.column(c) for c in keys]
            yield pa.RecordBatch.from_arrays([*own, *columns[: len(schema) - len(own)]], names=schema.names)

    return lines.select(*keys, tokens, marks).mapInArrow(run, schema)
