"""Sliding-window co-occurrence counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from lexweave.functions.arrays import pairs_at_distance, windows_with_halo
from lexweave.functions.batches import bounds, integers, is_set, list_array, list_bounds
from lexweave.gather import Part, gathered
from lexweave.operators import membership
from lexweave.scale import BROADCAST_ROWS, NUMBERED_ROWS, fits_broadcast, lookup_join
from lexweave.session import cut_lineage
from lexweave.sources.corpus import valid_terms

WINDOW = 3
# Tokens per piece of a line. Longer lines are cut into pieces that see the next ones' start.
PIECE = 4096
# Tokens of the lines that share one dictionary while they are looked up.
CHUNK_TOKENS = 1 << 20
# Counts of pairs of numbered words that a task holds.
PAIR_CELLS = 1 << 22


def _window_pairs(pieces: DataFrame, items: str, window: int, own: int) -> DataFrame:
    pairs = F.concat(*[pairs_at_distance(F.col(items), d, own) for d in range(1, window + 1)])
    return pieces.select(F.inline(pairs).alias("a", "b"))


def _ordered(pairs: DataFrame) -> DataFrame:
    """Canonical order, smaller first; equal elements are allowed."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _count(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def pair_volume(size: Column, window: int) -> Column:
    """Number of pairs a sequence yields, by arithmetic."""
    parts = [F.greatest(size - d, F.lit(0)).cast("bigint") for d in range(1, window + 1)]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total


# Tagged corpus: windows run over the valid terms, in or out of the vocabulary.


def tagged_pairs(parsed: DataFrame, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """Every pair of valid terms at distance 1..window, unordered rows ``(a, b)``."""
    pieces = parsed.select(
        F.explode(windows_with_halo(valid_terms(F.col("terms")), piece, window)).alias("items")
    )
    return _window_pairs(pieces, "items", window, piece)


def tagged_pair_counts(parsed: DataFrame, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    return _count(_ordered(tagged_pairs(parsed, window, piece)))


def tagged_pair_total(parsed: DataFrame, window: int = WINDOW) -> DataFrame:
    size = F.size(valid_terms(F.col("terms")))
    return parsed.agg(F.coalesce(F.sum(pair_volume(size, window)), F.lit(0)).alias("total"))


def _number_pairs(numbers: np.ndarray, of: np.ndarray, window: int, n: int) -> np.ndarray:
    """``low * n + high`` of every pair of numbers below ``n`` at distance 1..window on the same line ``of``; -1 has no pairs."""
    found = []
    for d in range(1, window + 1):
        left, right = numbers[:-d], numbers[d:]
        both = (of[:-d] == of[d:]) & (left >= 0) & (right >= 0)
        left, right = left[both], right[both]
        found.append(np.minimum(left, right) * n + np.maximum(left, right))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _counted(parsed: DataFrame, words: DataFrame, window: int) -> DataFrame:
    """Rows ``(a, b, n)`` of parts of the corpus over the indices of ``words``, which were checked to be small.

    Words are numbered in term order inside the task. While all pairs of numbers have a cell of ``PAIR_CELLS`` a task
    keeps one table of counts; otherwise it sorts the pairs it holds whenever they are that many.
    """
    rows = sorted((r.term.encode(), r.idx) for r in words.collect())
    n, index = len(rows), np.array([idx for _, idx in rows], np.int64)
    shared = parsed.sparkSession.sparkContext.broadcast(({term.decode(): place for place, (term, _) in enumerate(rows)}, index))
    schema = "a bigint, b bigint, n bigint"

    def counts(keys: np.ndarray, number: np.ndarray, index: np.ndarray) -> Iterator[pa.RecordBatch]:
        table = pa.table([index[keys // n], index[keys % n], number], names=["a", "b", "n"])
        yield from table.to_batches(max_chunksize=100_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, index = shared.value
        dense = n * n <= PAIR_CELLS
        total, held, size = np.zeros(n * n if dense else 0, np.int64), [], 0
        for batch in batches:
            lists = batch.column(0)
            flat, starts = lists.flatten(), list_bounds(lists)
            there = is_set(flat)
            coded = flat.drop_null().dictionary_encode()
            places = np.array([known.get(term, -1) for term in coded.dictionary.to_pylist()], np.int64)
            of = np.repeat(np.arange(len(lists)), np.diff(starts))[there]
            keys = _number_pairs(places[np.asarray(coded.indices)], of, window, n)
            if dense:
                total += np.bincount(keys, minlength=len(total))
                continue
            held.append(keys)
            size += len(keys)
            if size >= PAIR_CELLS:
                yield from counts(*np.unique(np.concatenate(held), return_counts=True), index)
                held, size = [], 0
        if held:
            yield from counts(*np.unique(np.concatenate(held), return_counts=True), index)
        if total.any():
            seen = np.flatnonzero(total)
            yield from counts(seen, total[seen], index)

    return parsed.select("terms").mapInArrow(run, schema)


def tagged_index_pair_counts(
    parsed: DataFrame,
    vocab: DataFrame,
    window: int = WINDOW,
    piece: int = PIECE,
    vocab_bound: int = BROADCAST_ROWS,
) -> DataFrame:
    """``(a, b, n)`` over vocabulary indices, ``a`` holding the smaller *term*.

    ``vocab`` must be a top-k vocabulary; while k is within ``vocab_bound`` the pairs are counted as
    numbers over whole batches, and the only shuffle moves one count for each pair and task, or part of one. Beyond that the
    terms are counted first, so that the joins see each pair once.
    """
    words = vocab.select("term", "idx")
    if fits_broadcast(words, vocab_bound):
        return _counted(parsed, words, window).groupBy("a", "b").agg(F.sum("n").alias("n"))
    counted = _count(_ordered(tagged_pairs(parsed, window, piece)))
    for side, other in (("a", "b"), ("b", "a")):
        coded = words.select(F.col("term").alias(side), F.col("idx").alias(f"{side}_idx"))
        counted = lookup_join(counted, coded, [side], [other], max_broadcast_rows=vocab_bound)
    return counted.select(F.col("a_idx").alias("a"), F.col("b_idx").alias("b"), "n")


# Plain corpus: words outside the vocabulary vanish first, so the window spans over them.


def _encoded(token_arrays: DataFrame, words: DataFrame) -> DataFrame:
    """``items``: the vocabulary indices of each line. ``words`` was checked to be small."""
    rows = words.collect()
    table = pa.array([r.term for r in rows], pa.string()), np.array([r.idx for r in rows], np.int64)
    shared = token_arrays.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, numbers = shared.value
        for batch in batches:
            lines = batch.column(0)
            found = pc.index_in(lines.flatten(), value_set=terms)
            known = found.is_valid().to_numpy(zero_copy_only=False)
            before = np.concatenate([[0], np.cumsum(known)])
            sizes = pc.fill_null(pc.list_value_length(lines), 0).to_numpy(zero_copy_only=False)
            offsets = before[np.concatenate([[0], np.cumsum(sizes)])].astype(np.int32)
            values = numbers[found.drop_null().to_numpy(zero_copy_only=False)]
            items = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([items], names=["items"])

    return token_arrays.select("tokens").mapInArrow(run, "items array<bigint>")


def _chunked(pieces: DataFrame) -> DataFrame:
    """Chunks of lines with a dictionary each: rows ``(chunk, codes, ...)`` of the pieces and ``(chunk, code, term)`` of its words.

    A word is listed once for each chunk of about ``CHUNK_TOKENS`` tokens, so that a lookup shuffles the words of
    the chunks and not all tokens.
    """
    keys = ["doc_id", "line_no", "piece", "long"]
    kinds = StructType([pieces.schema[c] for c in keys])
    schema = StructType.fromDDL("chunk bigint, code int, term string, codes array<int>, at array<int>")
    schema = StructType([*schema.fields, *(StructField(f.name, f.dataType) for f in kinds.fields)])

    def chunk(number: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        lists = table.column("words").combine_chunks()
        flat = lists.flatten()
        coded = pc.struct_field(flat, "term").dictionary_encode()
        own = [table.column(c).combine_chunks() for c in keys]
        codes, at = (list_array(list_bounds(lists), x) for x in (coded.indices.cast(pa.int32()), pc.struct_field(flat, "pos")))
        sizes = len(coded.dictionary), table.num_rows
        numbers = [pa.array(np.full(n, number)) for n in sizes]
        code = pa.array(np.arange(sizes[0], dtype=np.int32))
        nothing = [pa.nulls(sizes[0], column.type) for column in (codes, at, *own)]
        yield pa.RecordBatch.from_arrays([numbers[0], code, coded.dictionary, *nothing], names=schema.names)
        none = [pa.nulls(sizes[1], pa.int32()), pa.nulls(sizes[1], pa.string())]
        for part in pa.table([numbers[1], *none, codes, at, *own], names=schema.names).to_batches(max_chunksize=10_000):
            yield part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Tasks number their own chunks; what is written is what counts, so a task that runs again changes nothing.
        number, held, tokens = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            held.append(batch)
            tokens += len(batch.column(batch.schema.get_field_index("words")).flatten())
            if tokens >= CHUNK_TOKENS:
                yield from chunk(number, held)
                number, held, tokens = number + 1, [], 0
        if held:
            yield from chunk(number, held)

    return pieces.select(*keys, "words").mapInArrow(run, schema)


def _looked_up(chunks: DataFrame, words: DataFrame, max_broadcast_rows: int) -> DataFrame:
    """``(doc_id, line_no, piece, long, items)``: the indices of each piece's words, those outside ``words`` left out."""
    keys = ["doc_id", "line_no", "piece", "long"]
    listed = chunks.where(F.col("term").isNotNull()).select("chunk", "code", "term")
    found = lookup_join(listed, words, ["term"], ["chunk"], max_broadcast_rows=max_broadcast_rows)
    lines = chunks.where(F.col("code").isNull()).select("chunk", "codes", "at", *keys)
    # Rows of one document number, line and piece are one piece: their words stand together by place.
    again = not lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    kept = [*keys, *(["at"] if again else [])]
    schema = StructType([*(lines.schema[c] for c in kept), StructField("items", ArrayType(LongType()))])

    def encode(rows: pa.Table, known: pa.Table) -> pa.Table:
        lists = rows.column("codes").combine_chunks()
        codes = np.asarray(lists.flatten(), np.int64)
        at = known.column("code").to_numpy()
        index = np.full(max(codes.max(initial=-1), at.max(initial=-1)) + 1, -1, np.int64)
        index[at] = known.column("idx").to_numpy()
        items = index[codes]
        there = items >= 0
        ends = bounds(there)[list_bounds(lists)]
        columns = [rows.column(c) for c in keys]
        if again:
            places = np.asarray(rows.column("at").combine_chunks().flatten(), np.int32)
            columns.append(list_array(ends, pa.array(places[there])))
        columns.append(list_array(ends, pa.array(items[there])))
        # A piece without a word of the vocabulary has no pairs and no row.
        return pa.table(columns, names=schema.names).filter(pa.array(np.diff(ends) > 0))

    coded = lines.groupBy("chunk").cogroup(found.select("chunk", "code", "idx").groupBy("chunk")).applyInArrow(encode, schema)
    if not again:
        return coded
    placed = F.flatten(F.collect_list(F.arrays_zip("at", "items")))
    merged = coded.groupBy(*keys).agg(F.array_sort(placed).alias("placed"))
    return merged.select(*keys, F.col("placed.items").alias("items"))


def plain_sequences(
    token_arrays: DataFrame,
    vocab: DataFrame,
    window: int = WINDOW,
    piece: int = PIECE,
    max_broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``(own, items)``: vocabulary indices of each piece, followed by the next ``window`` ones.

    ``own`` elements of ``items`` belong to the piece. With a vocabulary of checked size the words
    of a line are encoded inside the row, and nothing is shuffled. Beyond that the words of chunks of lines
    meet the vocabulary in a shuffled join and their indices come back to the chunk, so no group exceeds a chunk; only
    the few leading indices of each piece of a long line go through a window over that line.
    """
    words = vocab.select("term", "idx")
    if fits_broadcast(words, max_broadcast_rows):
        encoded = _encoded(token_arrays, words)
        cut = encoded.select(F.explode(windows_with_halo(F.col("items"), piece, window)).alias("items"))
        return cut.select(F.least(F.size("items"), F.lit(piece)).alias("own"), "items")
    pieces = token_arrays.select(
        "doc_id",
        "line_no",
        F.posexplode(windows_with_halo(F.col("tokens"), piece, 0)).alias("piece", "words"),
        (F.size("tokens") > piece).alias("long"),
    )
    # Most words outside the vocabulary leave inside the row, before anything is shuffled.
    likely = membership.keep_likely(pieces, "words", words)
    # Read twice, for the words of the chunks and for their lines, and several times by the totals: written once each.
    grouped = cut_lineage(_looked_up(cut_lineage(_chunked(likely)), words, max_broadcast_rows))
    short = grouped.where(~F.col("long")).select(F.size("items").alias("own"), "items")

    cut = grouped.where(F.col("long"))
    heads = cut.select("doc_id", "line_no", "piece", F.slice("items", 1, window).alias("head"))
    ahead = (
        Window.partitionBy("doc_id", "line_no").orderBy("piece").rowsBetween(1, max(window, 1))
    )
    tails = heads.select(
        "doc_id",
        "line_no",
        "piece",
        F.slice(F.flatten(F.collect_list("head").over(ahead)), 1, window).alias("tail"),
    )
    long = cut.join(tails, ["doc_id", "line_no", "piece"]).select(
        F.size("items").alias("own"), F.concat("items", "tail").alias("items")
    )
    return short.unionByName(long)


def _owned(size: Column, own: Column, distance: int) -> Column:
    """Pairs at a distance whose left element belongs to the piece."""
    return F.greatest(F.least(size - distance, own), F.lit(0))


def _pair_counts(a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """``(a, b, n)`` of pairs of indices, each pair once, with ``a <= b``; without ``n`` each one counts 1."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    names = None
    if len(low) and (low.min() < 0 or high.max() >= 1 << 31):
        names, codes = np.unique(np.concatenate([low, high]), return_inverse=True)
        low, high = np.split(codes.ravel(), 2)
    width = int(high.max(initial=0)) + 1
    keys = low * width + high
    if n is None:
        found, total = np.unique(keys, return_counts=True)
    else:
        order = np.argsort(keys, kind="stable")
        starts = np.flatnonzero(np.diff(keys[order], prepend=-1))
        found, total = keys[order][starts], np.add.reduceat(n[order], starts) if len(starts) else n
    ends = [found // width, found % width]
    columns = [*(x if names is None else names[x] for x in ends), total]
    yield from pa.table([pa.array(x, pa.int64()) for x in columns], names=["a", "b", "n"]).to_batches(max_chunksize=100_000)


def plain_index_pair_counts(sequences: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(a, b, n)`` with a <= b; index order is term order for a lexicographic vocabulary.

    A task counts the pairs it holds, sorted as numbers, and the counts are shuffled packed.
    """
    schema = StructType([StructField(c, LongType()) for c in "abn"])

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            lists = batch.column("items")
            flat, at = integers(lists.flatten()), list_bounds(lists)
            sizes = np.diff(at)
            of = np.repeat(np.arange(len(lists)), sizes)
            place, own = np.arange(len(flat)) - at[of], integers(batch.column("own"))
            for d in range(1, window + 1):
                left = np.flatnonzero(place < np.minimum(sizes - d, own)[of])
                held.append((flat[left], flat[left + d]))
                size += len(left)
            if size >= PAIR_CELLS:
                yield from _pair_counts(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, size = [], 0
        if size:
            yield from _pair_counts(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def summed(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        yield from _pair_counts(*(tables[0].column(c).to_numpy() for c in "abn"))

    partial = sequences.select("items", "own").mapInArrow(partly, schema)
    return gathered([Part(partial)], ["a", "b"], summed, schema)


def plain_pair_total(sequences: DataFrame, window: int = WINDOW) -> DataFrame:
    """Number of pairs of the encoded corpus, by arithmetic on the piece sizes."""
    volume = F.lit(0).cast("bigint")
    for d in range(1, window + 1):
        volume = volume + _owned(F.size("items"), F.col("own"), d)
    return sequences.agg(F.coalesce(F.sum(volume), F.lit(0)).alias("total"))


def spell_pairs(
    index_pairs: DataFrame, vocab: DataFrame, max_broadcast_rows: int = NUMBERED_ROWS
) -> DataFrame:
    """Replace the two indices by their terms."""
    for side, other in (("a", "b"), ("b", "a")):
        names = vocab.select(F.col("idx").alias(side), F.col("term").alias(f"{side}_term"))
        index_pairs = lookup_join(
            index_pairs, names, [side], [other], max_broadcast_rows=max_broadcast_rows
        )
    return index_pairs.select(F.col("a_term").alias("a"), F.col("b_term").alias("b"), "n")
