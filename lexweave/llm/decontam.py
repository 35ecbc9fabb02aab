"""Benchmark decontamination as a prefix-filtered set join with exact verification.

An item gives one window per 13 consecutive words (an item of fewer words is one window). A window is
a set of placed shingles of five words (a shorter window: itself), all of which a text must contain for
the window to occur, so at the containment threshold of one the necessary prefix is a single shingle:
the one rarest over all documents. Documents meet windows only through that shingle; its place in the
window then bounds the place of the window in the text, which must fit in (length and position), and
the window's words are compared exactly. A window with a shingle that no document holds is dropped
before the join.

The benchmark is taken in blocks of about ``BLOCK_BYTES`` of text, so what a task holds is bounded;
results of several blocks are joined per document. Windows with the same items are one class, and documents
carry classes; the items of a set of classes are looked up once for each set that occurs. Null texts and items without words have no windows;
equal windows of several items are one; null item ids count as the text ``null``; repeated rows each
get a row, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from lexweave.llm.common import Words, ascii_lower, mix, pieces, utf8
from lexweave.scale import lookup_join
from lexweave.session import cut_lineage

WINDOW, SHINGLE = 13, 5
BLOCK_BYTES = 4 << 20
LOWER = ascii_lower()


def _inside() -> np.ndarray:
    table = np.zeros(256, np.bool_)
    table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = True
    table[0x80:] = True
    return table


INSIDE = _inside()


def _shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of ``size`` words from each place on; places too near the end are left out."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, size, np.uint64)
    for i in range(size):
        total = mix(total * np.uint64(0x100000001B3) + hashes[i : i + n])
    return total


class Block:
    """Windows of some items, their shingles, and after ``choose`` the prefix of each window."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW, shingle: int = SHINGLE):
        texts = pa.array([text or "" for _, text in items], pa.large_string())
        words = Words(*utf8(texts), INSIDE)
        self.hashes = words.hashes(LOWER)
        content = LOWER[words.data].tobytes()
        self.words = [content[a:b] for a, b in zip(words.starts.tolist(), words.ends.tolist(), strict=True)]
        known: dict[tuple[bytes, ...], int] = {}
        self.starts: list[int] = []
        self.sizes: list[int] = []
        owners: list[set[str]] = []
        for item, (name, _) in enumerate(items):
            first, end = int(words.first[item]), int(words.first[item + 1])
            size = min(window, end - first)
            for start in range(first, end - size + 1) if size else ():
                at = known.setdefault(tuple(self.words[start : start + size]), len(self.starts))
                if at == len(self.starts):
                    self.starts.append(start)
                    self.sizes.append(size)
                    owners.append(set())
                owners[at].add(name)
        numbers: dict[frozenset[str], int] = {}
        self.classes = np.array([numbers.setdefault(frozenset(names), len(numbers)) for names in owners], np.int64)
        self.members = list(numbers)
        self.shingle_sizes = sorted({min(shingle, s) for s in self.sizes})
        by_size = {k: _shingles(self.hashes, k) for k in self.shingle_sizes}
        placed = [(by_size[k], s, n - k + 1) for s, n in zip(self.starts, self.sizes, strict=True) for k in (min(shingle, n),)]
        self.parts = [of[s : s + n] for of, s, n in placed]
        self.known = np.unique(np.concatenate(self.parts)) if self.parts else np.zeros(0, np.uint64)

    def choose(self, counts: np.ndarray) -> None:
        """The rarest shingle of each window becomes its prefix; ``counts`` belong to ``known``."""
        prefix, window, offset = [], [], []
        for at, part in enumerate(self.parts):
            seen = counts[np.searchsorted(self.known, part)]
            if seen.min() > 0:
                best = int(np.lexsort((part, seen))[0])
                prefix.append(part[best])
                window.append(at)
                offset.append(best)
        order = np.argsort(np.array(prefix, np.uint64), kind="stable")
        self.prefix, self.first = np.unique(np.array(prefix, np.uint64)[order], return_index=True)
        self.first = np.append(self.first, len(order))
        self.window = np.array(window, np.int64)[order]
        self.offset = np.array(offset, np.int64)[order]
        self.starts, self.sizes = np.array(self.starts, np.int64), np.array(self.sizes, np.int64)
        del self.parts

    def take_members(self, first: int) -> pa.Table:
        """``class, item_id`` of the classes, numbered from ``first``; the block keeps the numbers only."""
        of = np.repeat(np.arange(len(self.members)) + first, [len(m) for m in self.members])
        names = pa.array([name for m in self.members for name in sorted(m)], pa.string())
        self.classes = self.classes + first
        self.members = []
        return pa.table({"class": pa.array(of, pa.int64()), "item_id": names})

    @staticmethod
    def _places(hashes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where ``hashes`` are among the sorted ``wanted``, and which of them."""
        if not len(wanted) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        marks = np.zeros(1 << 16, np.bool_)
        marks[wanted >> np.uint64(48)] = True
        rows = np.flatnonzero(marks[hashes >> np.uint64(48)])
        at = np.minimum(np.searchsorted(wanted, hashes[rows]), len(wanted) - 1)
        same = wanted[at] == hashes[rows]
        return rows[same], at[same]

    def _fits(self, words: Words, rows: np.ndarray, size: int) -> np.ndarray:
        return rows + size <= words.first[words.doc[rows] + 1]

    def count(self, words: Words) -> np.ndarray:
        """How often each of ``known`` occurs."""
        hashes, total = words.hashes(LOWER), np.zeros(len(self.known), np.int64)
        for size in self.shingle_sizes:
            rows, at = self._places(_shingles(hashes, size), self.known)
            total += np.bincount(at[self._fits(words, rows, size)], minlength=len(total))
        return total

    def occurrences(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """First word (in ``words``) and window of every occurrence of a window."""
        hashes = words.hashes(LOWER)
        found = [self._places(_shingles(hashes, size), self.prefix) for size in self.shingle_sizes]
        rows = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        at = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
        reps = self.first[at + 1] - self.first[at]
        inner = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        entry = np.repeat(self.first[at], reps) + inner
        rows = np.repeat(rows, reps)
        window = self.window[entry]
        start = rows - self.offset[entry]
        doc = words.doc[rows]
        size = self.sizes[window]
        fits = (start >= words.first[doc]) & (start + size <= words.first[doc + 1])
        start, window, size = start[fits], window[fits], size[fits]
        for place in range(int(size.max()) if len(size) else 0):
            inside = place < size
            same = np.ones(len(start), np.bool_)
            same[inside] = hashes[start[inside] + place] == self.hashes[self.starts[window[inside]] + place]
            start, window, size = start[same], window[same], size[same]
        exact = [self._equal(words, a, w) for a, w in zip(start.tolist(), window.tolist(), strict=True)]
        exact = np.array(exact, np.bool_)
        return start[exact], window[exact]

    def _equal(self, words: Words, start: int, window: int) -> bool:
        own, size = int(self.starts[window]), int(self.sizes[window])
        begin, end = words.starts[start : start + size], words.ends[start : start + size]
        return all(LOWER[words.data[a:b]].tobytes() == self.words[own + i] for i, (a, b) in enumerate(zip(begin, end, strict=True)))


def _merged(start: np.ndarray, size: np.ndarray) -> list[int]:
    """Starts and ends of the union of the spans, in one list."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate((start + size)[order])
    fresh = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    return np.stack([start[fresh], end[np.append(fresh[1:], len(start)) - 1]], 1).ravel().tolist()


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    octets = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))
    total = benchmark.agg(octets.alias("n")).first()["n"] or 0
    n_blocks = max(1, -(-int(total) // block_bytes))
    key = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text", key.alias("_block"))
    for number in range(n_blocks):
        yield [(r["item_id"], r["text"]) for r in rows.where(F.col("_block") == number).drop("_block").distinct().collect()]


def _rarity(docs: DataFrame, block: Block) -> np.ndarray:
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        counts = np.zeros(len(shared.value.known), np.int64)
        for piece in pieces(batches):
            counts += shared.value.count(Words(*utf8(piece.column(0)), INSIDE))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["at", "n"])

    counts = np.zeros(len(block.known), np.int64)
    for row in docs.select("text").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts[row["at"]] = row["n"]
    return counts


def _matches(docs: DataFrame, block: Block, every: bool) -> DataFrame:
    """Word counts, hit spans and window classes; ``every``: also of texts without hits."""
    names = [*[c for c in docs.columns if c != "text"]]
    shared = docs.sparkSession.sparkContext.broadcast(block)
    kinds = {"n_words": LongType(), "spans": ArrayType(LongType()), "classes": ArrayType(LongType())}
    schema = StructType([*[docs.schema[c] for c in names], *[StructField(n, t) for n, t in kinds.items()]])

    def run(batches):
        block = shared.value
        for piece in pieces(batches):
            words = Words(*utf8(piece.column(len(names))), INSIDE)
            start, window = block.occurrences(words)
            doc = words.doc[start]
            spans: list[list[int]] = [[] for _ in range(piece.num_rows)]
            classes: list[list[int]] = [[] for _ in range(piece.num_rows)]
            for d in np.unique(doc).tolist():
                own = doc == d
                spans[d] = _merged(start[own] - words.first[d], block.sizes[window[own]])
                classes[d] = np.unique(block.classes[window[own]]).tolist()
            columns = [*piece.columns[:-1], pa.array(np.diff(words.first)), pa.array(spans, pa.list_(pa.int64())), pa.array(classes, pa.list_(pa.int64()))]
            out = pa.RecordBatch.from_arrays(columns, names=[*names, *kinds])
            yield out if every else out.filter(pa.array([bool(s) for s in spans]))

    return docs.select(*names, "text").mapInArrow(run, schema)


def _covered(spans: str) -> Column:
    """Words in the union of spans given as starts and ends in one list."""
    pairs = F.array_sort(F.transform(F.sequence(F.lit(1), F.floor(F.size(spans) / 2)), lambda i: F.array(F.get(spans, (i * 2 - 2).cast("int")), F.get(spans, (i * 2 - 1).cast("int")))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def step(done: Column, span: Column) -> Column:
        end = F.greatest(done["end"], span[1])
        return F.struct((done["n"] + end - F.greatest(done["end"], F.least(span[0], end))).alias("n"), end.alias("end"))

    return F.when(F.size(spans) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(pairs, start, step, lambda done: done["n"]))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """``doc_id``, a hash ``_text``, ``n_words``, ``spans`` (starts and ends) and ``classes`` of every row; ``class, item_id``."""
    docs = docs.select("doc_id", "text")
    found, members, first = None, None, 0
    for items in _blocks(benchmark, block_bytes):
        block = Block(items, window)
        block.choose(_rarity(docs, block))
        n_classes = len(block.members)
        table = cut_lineage(docs.sparkSession.createDataFrame(block.take_members(first)))
        members = table if members is None else members.unionByName(table)
        first += n_classes
        if found is None:
            found = _matches(docs.withColumn("_text", F.xxhash64("text")), block, every=True)
            continue
        more = _matches(docs.select("doc_id", F.xxhash64("text").alias("_text"), "text"), block, every=False).distinct()
        others = [c for c in found.columns if c not in ("spans", "classes")]
        more = cut_lineage(more.select(F.col("doc_id").alias("_id"), F.col("_text").alias("_t"), F.col("spans").alias("_s"), F.col("classes").alias("_c")))
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_t"))
        both = [F.concat(a, F.coalesce(b, F.array())).alias(a) for a, b in (("spans", "_s"), ("classes", "_c"))]
        found = cut_lineage(found.join(more, same, "left").select(*others, *both))
    return found, members


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``matches`` with the number of items and the hash of their sorted ids, comma-joined."""
    found, members = matches(docs, benchmark, window, block_bytes)
    key = F.when(F.size("classes") > 0, F.array_join(F.transform("classes", lambda c: c.cast("string")), ","))
    found = cut_lineage(found.withColumn("_set", key))
    sets = found.where("_set IS NOT NULL").select("_set", "classes").distinct()
    named = sets.select("_set", F.explode("classes").alias("class")).join(members, "class")
    items = named.groupBy("_set").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    digests = items.select("_set", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    judged = lookup_join(found, cut_lineage(digests), ["_set"], ["doc_id", "_text"], "left")
    nothing = {"n_items": F.coalesce("n_items", F.lit(0).cast("long")), "items_sha256": F.coalesce("items_sha256", F.sha2(F.lit(""), 256))}
    return judged.withColumns(nothing).drop("_set")


def digest(found: DataFrame) -> DataFrame:
    """Hit words, and whether they are five per cent of all."""
    counted = found.withColumn("n_hit", _covered("spans"))
    return counted.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The whole rows of ``docs`` that are not contaminated."""
    hashed = docs.select("doc_id", F.xxhash64("text").alias("_hash"), F.struct(*docs.columns).alias("_row"))
    dirty = digest(matches(docs, benchmark)[0]).where("contaminated").select(F.col("doc_id").alias("_id"), "_text").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text"))
    return hashed.join(cut_lineage(dirty), same, "left_anti").select("_row.*")
