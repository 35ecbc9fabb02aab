"""Periodic runs of words by a dictionary of basic factors.

Level ``k`` of the dictionary names every factor of ``2**k`` words: equal factors of a text have one
name, and a name of level ``k + 1`` is the rank of the two names of level ``k`` that it is made of. The
successor of a place is the next place with its name. Occurrences of a factor within twice its length
are an arithmetic progression whose step is the factor's period, so three places with equal steps of at
most ``2**k`` propose that step as a period; following places that propose the same one are one proposal.
Proposals are extended to both sides while words a period apart are equal, and the same run found at
several levels is kept once. A run of period ``q`` and ``4 q`` words is proposed at the level with
``q <= 2**k < 2 q``, so ``exponent`` may not be below 4.

A factor that occurs once lies in no progression, nor does any longer factor that it begins or ends: only
the places of repeated factors rise to the next level, and the dictionary shrinks quickly in plain text.
All texts of a piece share the levels; a number of its own after each text keeps factors inside it. A
text is worked on whole by one task; there is no shuffle. Words are known by 64-bit hashes.

A null or empty text has no words and no runs; a null id rewrites nothing; repeated rows each get a row;
of equally long runs the first is reported, then the one with the smallest period; an empty table gives
no rows; columns other than ``doc_id`` and ``text`` are passed through by ``find`` and ignored by
``digest``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lexweave.llm.common import Words, pieces, utf8

MIN_LENGTH, EXPONENT = 6, 4
PLAIN = np.arange(256, dtype=np.uint8)


def _inside() -> np.ndarray:
    table = np.ones(256, np.bool_)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


INSIDE = _inside()


@dataclass
class Runs:
    """Runs of a piece: ``doc``, ``start`` in it, ``length`` and ``period``, ordered by these but length."""

    doc: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def _named(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places whose key repeats, their names, and the next place with the same name (-1: none)."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(keys) else np.zeros(0, np.bool_)
    last = np.concatenate([first[1:], [True]]) if len(keys) else first
    name, following = np.empty(len(keys), np.int64), np.full(len(keys), -1)
    name[order] = np.cumsum(first) - 1
    following[order[:-1]] = np.where(last[:-1], -1, places[order[1:]])
    repeated = np.empty(len(keys), np.bool_)
    repeated[order] = ~(first & last)
    return places[repeated], name[repeated], following[repeated]


def _extended(symbols: np.ndarray, begin: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches ``begin`` to ``end`` grown word by word while the words a period apart are equal."""
    begin, end, n = begin.copy(), end.copy(), len(symbols)
    left = right = np.arange(len(begin))
    while len(left):
        left = left[begin[left] > 0]
        left = left[symbols[begin[left] - 1] == symbols[begin[left] - 1 + period[left]]]
        begin[left] -= 1
    while len(right):
        right = right[end[right] < n]
        right = right[symbols[end[right]] == symbols[end[right] - period[right]]]
        end[right] += 1
    return begin, end


def runs_of(words: np.ndarray, first: np.ndarray, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> Runs:
    """All runs of the texts whose words are ``words[first[d]:first[d + 1]]`` (any integers)."""
    if exponent < EXPONENT:
        raise ValueError(f"exponents below {EXPONENT} have runs that no level proposes")
    n_docs, sizes = len(first) - 1, np.diff(first)
    # One more symbol after each text, different from all others.
    shift = np.repeat(np.arange(n_docs), sizes)
    _, symbols = np.unique(words, return_inverse=True)
    line = np.full(len(words) + n_docs, -1, np.int64)
    line[np.arange(len(words)) + shift] = symbols
    line[first[1:] + np.arange(n_docs)] = len(words) + np.arange(n_docs)
    found = [np.zeros((3, 0), np.int64)]
    places, name, following = _named(line, np.arange(len(line)))
    longest, size = int(sizes.max(initial=0)), 1
    while len(places):
        at = np.full(len(line), -1, np.int64)
        at[places] = np.arange(len(places))
        step = following - places
        near = (following >= 0) & (step <= size)
        again = np.flatnonzero(near)
        onward = at[following[again]]
        again = again[near[onward] & (step[onward] == step[again])]
        # Following places with one step are one proposal.
        p, d = places[again], step[again]
        edge = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1] + 1) | (d[1:] != d[:-1])])) if len(p) else np.zeros(0, np.int64)
        ending = np.append(edge[1:], len(p))[: len(edge)] - 1
        begin, end = _extended(line, p[edge], p[ending] + 2 * d[edge] + size, d[edge])
        found.append(np.stack([begin, end, d[edge]]))
        # The next level serves periods above ``size``.
        if exponent * (size + 1) > longest:
            break
        other = np.where(places + size < len(line), at[np.minimum(places + size, len(line) - 1)], -1)
        kept = np.flatnonzero(other >= 0)
        keys = name[kept] * (len(line) + 1) + name[other[kept]]
        places, name, following = _named(keys, places[kept])
        size *= 2
    begin, end, period = np.unique(np.concatenate(found, axis=1), axis=1)
    kept = end - begin >= np.maximum(min_length, exponent * period)
    begin, end, period = begin[kept], end[kept], period[kept]
    doc = np.searchsorted(first[1:] + np.arange(n_docs), begin, "left") if n_docs else begin
    order = np.lexsort((period, begin))
    start = begin - (first[doc] + doc)
    return Runs(doc[order], start[order], (end - begin)[order], period[order])


def rewritten(n: np.ndarray, ids: list[str | None]) -> np.ndarray | None:
    """Which original word stands at each place once the texts chosen by their ids repeat a part; None: no text."""
    first = np.concatenate([[0], np.cumsum(n)])
    source = None
    for doc, own in enumerate(ids):
        h = zlib.crc32(own.encode()) if own is not None else 1
        size = int(n[doc])
        if h % 10 or not size:
            continue
        if source is None:
            source = np.arange(first[-1])
        g = h // 10
        a = g % size
        p = 1 + (size - a) // (3 + g % 8)
        source[first[doc] + a : first[doc + 1]] = first[doc] + a + np.arange(size - a) % p
    return source


def _dropped(runs: Runs, first: np.ndarray) -> np.ndarray:
    """Whether a run holds each word after the run's first period."""
    change = np.zeros(int(first[-1]) + 1, np.int64)
    begin = first[runs.doc] + runs.start
    np.add.at(change, begin + runs.period, 1)
    np.add.at(change, begin + runs.length, -1)
    return np.cumsum(change)[:-1] > 0


def _texts(words: Words, chosen: np.ndarray, counts: np.ndarray) -> Iterator[bytes]:
    """For each text its ``counts`` words of ``chosen`` (numbers of words), joined by one space."""
    sizes = (words.ends - words.starts)[chosen]
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    joined = np.full(int(begin[-1]), 0x20, np.uint8)
    inner = np.arange(int(sizes.sum())) - np.repeat(begin[:-1] - np.arange(len(chosen)), sizes)
    joined[np.repeat(begin[:-1], sizes) + inner] = words.data[np.repeat(words.starts[chosen], sizes) + inner]
    content, at = memoryview(joined), 0
    for count in counts.tolist():
        yield bytes(content[begin[at] : begin[at + count] - 1]) if count else b""
        at += count


NAMES = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def _summary(piece: pa.RecordBatch, min_length: int, exponent: int) -> list[pa.Array]:
    words = Words(*utf8(piece.column(1)), INSIDE)
    n, first = np.diff(words.first), words.first
    source = rewritten(n, piece.column(0).to_pylist())
    source = np.arange(int(first[-1])) if source is None else source
    runs = runs_of(words.hashes(PLAIN).view(np.int64)[source], first, min_length, exponent)
    kept = ~_dropped(runs, first)
    left = np.add.reduceat(np.append(kept, False).astype(np.int64), first[:-1]) * (n > 0) if len(n) else n
    collapsed = [hashlib.sha256(text).hexdigest() for text in _texts(words, source[kept], left)]
    bounds = np.searchsorted(runs.doc, np.arange(len(n) + 1)).tolist()
    best = np.lexsort((runs.period, runs.start, -runs.length, runs.doc))
    rows = []
    starts, lengths, periods = runs.start.tolist(), runs.length.tolist(), runs.period.tolist()
    for a, b in zip(bounds, bounds[1:], strict=False):
        listed = "".join(f"{starts[i]},{lengths[i]},{periods[i]}\n" for i in range(a, b))
        digest = hashlib.sha256(listed.encode()).hexdigest()
        top = best[a] if b > a else None
        report = (None,) * 4 if top is None else (starts[top], lengths[top], periods[top], 1000 * lengths[top] // periods[top])
        rows.append((b - a, *report, digest))
    columns = [pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True))[:5]]
    return [*columns, pa.array([r[5] for r in rows]), pa.array(collapsed)]


def digest(docs: DataFrame, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, number of runs, the longest one, digests of all and of the text without repeats.

    The texts that ``rewritten`` chooses by their ids are made periodic first.
    """
    rows = docs.select("doc_id", F.col("doc_id").cast("string").alias("_name"), "text")
    kinds = [LongType()] * 5 + [StringType()] * 2
    schema = StructType([docs.schema["doc_id"], *map(StructField, NAMES, kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            found = _summary(piece.select(["_name", "text"]), min_length, exponent)
            yield pa.RecordBatch.from_arrays([piece.column(0), *found], names=["doc_id", *NAMES])

    return rows.mapInArrow(run, schema)


def find(docs: DataFrame, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """The columns of ``docs`` but ``text``, with one row for each run of a text: ``start, length, period`` in words.

    Columns of ``docs`` with these names are replaced.
    """
    names = ["start", "length", "period"]
    others = [c for c in docs.columns if c not in ("text", *names)]
    schema = StructType([*[docs.schema[c] for c in others], *[StructField(c, LongType()) for c in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            words = Words(*utf8(piece.column(len(others))), INSIDE)
            runs = runs_of(words.hashes(PLAIN).view(np.int64), words.first, min_length, exponent)
            own = [piece.column(i).take(pa.array(runs.doc)) for i in range(len(others))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(runs.start), pa.array(runs.length), pa.array(runs.period)], names=[*others, *names])

    return docs.select(*others, "text").mapInArrow(run, schema)
