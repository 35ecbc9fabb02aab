"""Vector best-fit packing of documents into sequences.

A piece has three demands: tokens, one document, and attention cost (length squared). A sequence has a
capacity of each. Pieces go by falling length into the open sequence that fits under every constraint
and is best by ``rule``: ``norm``, the smallest weighted residual norm afterwards, or ``dot``, the
largest weighted dot product of demand and residual; a new sequence opens when none fits.

Pieces of one length have one demand vector and are interchangeable, so best-fit runs on the counts per
length: sequences with equal residuals are one state with a number, and a step places as many pieces as
would be placed there one after another. The plan therefore sees at most ``max_tokens`` counts, however
many documents there are, and gives what best-fit over all pieces in one place gives. Spark does the
rest: tokens, counts, a dense rank per length, and the lookup of (length, rank) in the plan.

A null or empty text is the end id alone. Texts with very long runs of blanks are encoded by a second
library that has no limit on them. Longer documents are cut into full pieces, the first of which
may be shorter; repeated rows and null ids are packed like others; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lexweave.llm.common import numbered, pieces
from lexweave.session import cut_lineage

MAX_TOKENS, END_ID = 1024, 2
VOCABULARY, PLAIN_VOCABULARY = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
# ``encoder`` gives up on runs of a million blanks; texts with shorter ones leave it already.
BLANKS = 100_000
SPECIAL = {"<|endoftext|>": 50256}


@lru_cache(maxsize=1)
def encoder(path: str | None = None):
    """The byte-level vocabulary; its ids are those of ``byte_bpe_50k.json`` (see the tests)."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


@lru_cache(maxsize=1)
def plain_encoder(path: str | None = None):
    """The same vocabulary in the library that takes blanks of any number."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path or public_tokenizers.path(PLAIN_VOCABULARY))


def token_ids(text: str | None) -> np.ndarray:
    """Ids of a text and the end id, as little-endian unsigned 32-bit numbers."""
    if text and len(text) >= BLANKS and max((m.end() - m.start() for m in re.finditer(r"\s+", text)), default=0) >= BLANKS:
        ids = plain_encoder().encode(text, add_special_tokens=False).ids
    else:
        ids = encoder().encode_to_numpy(text, allowed_special="all") if text else []
    return np.append(np.asarray(ids, "<u4"), np.array([END_ID], "<u4"))


def cut(docs: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32``."""
    names = ["piece", "start", "length", "ids_crc32"]
    schema = StructType([docs.schema["doc_id"], *[StructField(n, LongType()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows: list[tuple[int, int, int, int, int]] = []
            for at, text in enumerate(batch.column(1)):
                ids = token_ids(text.as_py())
                first = len(ids) % max_tokens or max_tokens
                begins = [0, *range(first, len(ids), max_tokens)]
                for piece, (a, b) in enumerate(zip(begins, [*begins[1:], len(ids)], strict=True)):
                    rows.append((at, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            at, *columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *map(pa.array, columns)], names=["doc_id", *names])

    cut_rows = docs.select("doc_id", "text").mapInArrow(run, schema)
    return cut_rows.withColumn("piece", F.col("piece").cast("int"))


class Plan:
    """Best-fit over counts per length: segments of ranks and where their pieces go."""

    def __init__(self, counts: dict[int, int], capacity: tuple[int, int, int], weights=(1.0, 1.0, 1.0), rule: str = "norm"):
        self.capacity = np.array(capacity, np.float64)
        self.scale = np.array(weights, np.float64) / self.capacity
        self.rule = rule
        self.segments: list[tuple[int, int, int, int, int]] = []
        self.n_sequences = 0
        # State: residual (tokens, documents, attention) and the runs of sequences that have it.
        self.residuals = np.zeros((0, 3))
        self.runs: list[list[tuple[int, int]]] = []
        self.at: dict[tuple[int, int, int], int] = {}
        for length in sorted(counts, reverse=True):
            if counts[length]:
                self._place(length, counts[length])

    def _scores(self, residuals: np.ndarray, demand: np.ndarray) -> np.ndarray:
        """Smaller is better; infinite where the demand does not fit."""
        if self.rule == "norm":
            score = (((residuals - demand) * self.scale) ** 2).sum(axis=1)
        else:
            score = -((residuals * self.scale) * (demand * self.scale)).sum(axis=1)
        return np.where((residuals >= demand).all(axis=1), score, np.inf)

    def _add(self, residual: tuple[int, int, int], run: tuple[int, int]) -> None:
        if residual not in self.at:
            self.at[residual] = len(self.runs)
            self.runs.append([])
            self.residuals = np.vstack([self.residuals, residual])
        self.runs[self.at[residual]].append(run)

    def _place(self, length: int, n: int) -> None:
        demand = np.array([length, 1, length * length], np.float64)
        if (demand > self.capacity).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacity of an empty sequence")
        rank = 0
        while rank < n:
            best, others, residual, begin, open_run = self._best(demand, n - rank)
            fill, left = 0, residual.copy()
            # A sequence goes on taking pieces while it is better than every other open one.
            while (left >= demand).all() and fill < n - rank and (not fill or self._scores(left[None], demand)[0] < others):
                left = left - demand
                fill += 1
            count = min(open_run, (n - rank) // fill)
            self.segments.append((length, rank, fill, begin, int(self.capacity[0] - residual[0])))
            if best is None:
                self.n_sequences += count
            elif count < open_run:
                self.runs[best].append((begin + count, open_run - count))
            self._add(tuple(int(x) for x in left), (begin, count))
            rank += count * fill

    def _best(self, demand: np.ndarray, wanted: int):
        """State, best score of all other open sequences, residual and run of the sequences to use."""
        if self.runs:
            held = np.array([bool(r) for r in self.runs], np.bool_)
            scores = np.where(held, self._scores(self.residuals, demand), np.inf)
            best = int(scores.argmin())
            if np.isfinite(scores[best]):
                begin, count = self.runs[best].pop()
                alone = count == 1 and not self.runs[best]
                others = np.partition(np.append(scores, np.inf), 1)[1] if alone else scores[best]
                return best, others, self.residuals[best], begin, count
        return None, np.inf, self.capacity, self.n_sequences, wanted


def pack(cut_rows: DataFrame, capacity: tuple[int, int, int] | None = None, weights=(1.0, 0.1, 0.1), rule: str = "norm") -> DataFrame:
    """``sequence_id`` and ``offset`` beside the columns of ``cut_rows``, which has a long ``length``."""
    capacity = capacity or (MAX_TOKENS, MAX_TOKENS, MAX_TOKENS * MAX_TOKENS)
    ranked = cut_lineage(numbered(cut_rows, ["length"], "_rank"))
    # At most ``capacity[0]`` rows: one for each length.
    counts = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = Plan(counts, capacity, weights, rule)
    segments = np.array(plan.segments, np.int64).reshape(-1, 5)
    # A piece's key: its rank after all pieces of smaller length.
    known = np.array(sorted(counts), np.int64)
    base = np.cumsum([0, *(counts[n] for n in known.tolist())], dtype=np.int64)
    keys = base[np.searchsorted(known, segments[:, 0])] + segments[:, 1]
    order = np.argsort(keys)
    shared = ranked.sparkSession.sparkContext.broadcast((known, base, keys[order], segments[order]))
    names = [c for c in ranked.columns if c != "_rank"]
    fields = [ranked.schema[c] for c in names]
    schema = StructType([*fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, base, keys, segments = shared.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            of = segments[np.searchsorted(keys, base[np.searchsorted(known, length)] + rank, "right") - 1]
            inside = rank - of[:, 1]
            sequence, offset = of[:, 3] + inside // of[:, 2], of[:, 4] + inside % of[:, 2] * length
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)
