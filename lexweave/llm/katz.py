"""Katz backoff language model: Good-Turing counts, exactly normalised backoff, scored per token.

A training n-gram seen ``r`` times in its context has probability ``d_r r / total``; ``d_r`` is Katz's
Good-Turing discount for ``r`` up to ``LARGEST`` (from the counts of counts of all n-grams of that
order) and 1 above. What a context's discounts leave is spread over words it was not seen with, in
proportion to the next lower order: ``left / (1 - sum of lower probabilities of the seen)``, so the
probabilities of a context add up to one. A context whose counts are all large gives up one count; an
unseen context has the lower order's probabilities. Below the unigrams, unknown words are one type
that holds the mass the unigram discounts leave. If a discount falls outside (0, 1] the order uses
absolute discounting, ``D = n1 / (n1 + 2 n2)``.

How it runs: texts become chunks of token numbers, written once. For each order, chunks send their
distinct n-grams with training counts to count partitions (by a hash of the context), which add them
up, write the table, and answer each chunk with the totals and its contexts' sums. A context with over
``SPLIT_COUNT`` occurrences is spread over partitions by a hash of the n-gram, its sums are added by a
grouping and joined back. Every table is partitioned; the driver sees only counts of counts. What is
sent grows with the distinct n-grams of the input. Words, and contexts of two or more, are known by 64-bit hashes.

A null text is empty and holds only the end token; a null id counts as the empty text of an id.
Repeated rows each train and get a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from lexweave.llm.common import Words, ascii_lower, mix, pieces, utf8
from lexweave.session import cut_lineage

ORDER, LARGEST = 2, 5
CHUNK_TOKENS, PART_TOKENS, SPLIT_COUNT = 1_100_000, 2_000_000, 500_000
FOLDS, HELD_OUT = 7, 2
# The end token's hash, and the number that stands before a text; words are numbered from 1.
END, BEGIN = np.uint64(1), np.uint64(0)
LOWER = ascii_lower()
#: Per context: occurrences, continuations seen 1 to ``LARGEST`` times, summed lower probability.
N_SUMS = LARGEST + 2


def _inside() -> np.ndarray:
    table = np.ones(256, np.bool_)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


INSIDE = _inside()


def packed(values: np.ndarray) -> bytes:
    """Type, length and the bytes of ``values``, byte planes apart, compressed."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    head = f"{values.dtype.str}:{len(planes)}:".encode()
    return head + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(blob: bytes) -> np.ndarray:
    kind, size, content = blob.split(b":", 2)
    kind = np.dtype(kind.decode())
    planes = np.frombuffer(pa.decompress(content, int(size), codec="zstd"), np.uint8) if int(size) else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).ravel()


def coded(values: np.ndarray) -> bytes:
    """``packed`` for values that repeat: the distinct ones, then a number for each."""
    distinct, number = np.unique(values, return_inverse=True)
    first = packed(distinct)
    return len(first).to_bytes(8, "little") + first + packed(number.astype(np.uint32))


def decoded(blob: bytes) -> np.ndarray:
    size = int.from_bytes(blob[:8], "little")
    return unpacked(blob[8 : 8 + size])[unpacked(blob[8 + size :])]


def discounts(n: list[int]) -> np.ndarray:
    """Factors for counts 1 to ``LARGEST`` from ``n[r - 1]`` n-grams seen r times."""
    n = np.array(n, np.float64)
    r = np.arange(1, LARGEST + 1)
    if (n > 0).all():
        common = (LARGEST + 1) * n[LARGEST] / n[0]
        if common < 1:
            factors = ((r + 1) * n[1:] / (r * n[:-1]) - common) / (1 - common)
            if ((factors > 0) & (factors <= 1)).all():
                return factors
    taken = n[0] / (n[0] + 2 * n[1]) if n[0] > 0 and n[1] > 0 else 0.5
    return (r - taken) / r


def probabilities(count, sums, lower, factors) -> np.ndarray:
    """Katz probability of each n-gram from its count, its context's sums and its lower probability."""
    total, seen, low = sums[:, 0], sums[:, 1 : LARGEST + 1], sums[:, -1]
    r = np.arange(1, LARGEST + 1)
    left = (seen * (r * (1 - factors))).sum(axis=1)
    kept = total - left
    whole = np.where(left > 0, total, total + 1)
    left = np.where(left > 0, left, 1.0)
    closed = 1 - low < 1e-9
    whole = np.where(closed, np.maximum(kept, 1e-300), whole)
    factor = np.append(np.insert(factors, 0, 0.0), 1.0)[np.minimum(count, LARGEST + 1).astype(np.int64)]
    backed = np.where(closed, 0.0, left / whole / np.where(closed, 1.0, 1 - low)) * lower
    return np.where(total > 0, np.where(count > 0, factor * count / np.maximum(whole, 1e-300), backed), lower)


def _chunk(number: int, ids: list, held: list, firsts: list, hashes: list, names: list[str]) -> pa.RecordBatch:
    words = np.concatenate(hashes)
    distinct, tokens = np.unique(words, return_inverse=True)
    sizes = np.concatenate(firsts)
    blobs = [packed(sizes), packed(distinct), packed(tokens.astype(np.uint32))]
    ids = pa.concat_arrays(ids)
    listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    held = pa.concat_arrays(held)
    columns = [pa.array([number]), listed, pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held), pa.array([len(words)])]
    return pa.RecordBatch.from_arrays([*columns, *[pa.array([b], pa.binary()) for b in blobs]], names=names)


def chunks(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Rows of about ``chunk_tokens`` tokens: ids, held-out marks, tokens per text, distinct words, tokens."""
    names = ["chunk", "ids", "held", "n", "sizes", "words", "tokens"]
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select("doc_id", (crc % FOLDS == HELD_OUT).alias("held"), "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], []]
        count = 0
        # No two chunks share a number: the partition, then a counter.
        numbers = itertools.count(TaskContext.get().partitionId() << 32)
        for piece in pieces(batches):
            words = Words(*utf8(piece.column(2)), INSIDE)
            sizes = np.diff(words.first)
            hashes = np.insert(words.hashes(LOWER), words.first[1:], END)
            for into, part in zip(held, (piece.column(0), piece.column(1), sizes + 1, hashes), strict=True):
                into.append(part)
            count += len(hashes)
            if count >= chunk_tokens:
                yield _chunk(next(numbers), *held, names)
                held, count = [[], [], [], []], 0
        if count:
            yield _chunk(next(numbers), *held, names)

    schema = f"chunk bigint, ids array<{id_type}>, held array<boolean>, n bigint, sizes binary, words binary, tokens binary"
    return rows.mapInArrow(run, schema)


REPLY = "chunk bigint, level int, part bigint, counts binary, sums binary, ctx bigint, hot array<double>, stats array<bigint>"
REPLY_NAMES = ["chunk", "level", "part", "counts", "sums", "ctx", "hot", "stats"]
REPLY_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64())]
SENT = "part bigint, chunk bigint, level int, ctx binary, runs binary, split binary, grams binary, lower binary, counts binary"


def _reply(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in REPLY_NAMES]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, REPLY_TYPES, strict=True)], names=REPLY_NAMES)


class Texts:
    """One chunk and what is known of its n-grams from the replies."""

    def __init__(self, row: dict, n_parts: int):
        self.n_parts = n_parts
        self.sizes, self.number = unpacked(row["sizes"]), unpacked(row["tokens"])
        self.held = np.array(row["held"], np.bool_)
        self.begin = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        self.train = np.repeat(~self.held, self.sizes)
        # Context of each token at each level: level 1 has none, level n the n - 1 tokens before.
        self.place = np.arange(len(self.number)) - np.repeat(self.begin, self.sizes)
        self.context = np.zeros(len(self.number), np.uint64)
        self.level = 1

    def words_sent(self, chunk: int, words: np.ndarray) -> Iterator[tuple]:
        """Sorted distinct words with training counts; a partition takes a range of hashes."""
        counts = np.bincount(self.number[self.train], minlength=len(words)).astype(np.uint32)
        part = (words >> np.uint64(32)) * np.uint64(self.n_parts) >> np.uint64(32)
        edges = np.searchsorted(part, np.arange(self.n_parts + 1))
        for at, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            if b > a:
                yield (at, chunk, 1, b"", b"", b"", packed(words[a:b]), b"", packed(counts[a:b]))

    def learn_words(self, replies: list[dict], model: dict) -> np.ndarray:
        """Numbers, counts and unigram probabilities of the tokens, from the replies in order of hash."""
        replies = sorted(replies, key=lambda r: r["part"])
        count = np.concatenate([unpacked(r["counts"]).astype(np.int64) for r in replies])
        place = np.concatenate([np.cumsum(unpacked(r["sums"]).astype(np.int64)) * self.n_parts + r["part"] for r in replies])
        self.token = (place + 1).astype(np.uint64)[self.number]
        self.known = self.context_count = count[self.number]
        sums = np.array([[model["n"], *model["n_r"][0][:LARGEST], 0.0]])
        share = probabilities(count, np.repeat(sums, len(count), 0), np.ones(len(count)), discounts(model["n_r"][0]))
        return (share if model["n"] else np.ones(len(count)))[self.number]

    def next_level(self, n_train: int) -> None:
        """Distinct n-grams of the next level and where they are sent."""
        # A context's training count is known from the level below, or is the number of texts.
        moved = np.full(len(self.token), n_train, np.int64)
        moved[1:] = np.where(self.place[1:] >= 1, self.context_count[:-1], n_train)
        lag = self.level
        self.level += 1
        before = np.full(len(self.token), BEGIN, np.uint64)
        before[lag:] = np.where(self.place[lag:] >= lag, self.token[:-lag], BEGIN)
        self.context = before if lag == 1 else mix(self.context * np.uint64(0x100000001B3) + before + np.uint64(self.level))
        gram = mix(mix(self.context) + self.token)
        self.grams, first, self.of = np.unique(gram, return_index=True, return_inverse=True)
        self.counts = np.bincount(self.of[self.train], minlength=len(self.grams))
        self.ctx, self.word = self.context[first], self.token[first]
        salts = 1 + moved[first] // SPLIT_COUNT
        self.split = salts > 1
        salt = self.grams % salts.astype(np.uint64)
        part = (mix(self.ctx + mix(salt)) % np.uint64(self.n_parts)).astype(np.int64)
        order = np.lexsort((self.word, self.ctx, part))
        edges = np.searchsorted(part[order], np.arange(self.n_parts + 1))
        self.rows = [order[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        self.first_of = first

    def sent(self, chunk: int, lower: np.ndarray) -> Iterator[tuple]:
        """The distinct n-grams with their lower probabilities and training counts, by partition."""
        for part, rows in enumerate(self.rows):
            if len(rows):
                ctx = self.ctx[rows]
                at = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]]))
                runs = np.diff(np.append(at, len(rows))).astype(np.uint32)
                low, counts = coded(lower[self.first_of[rows]]), packed(self.counts[rows].astype(np.uint32))
                yield (part, chunk, self.level, packed(ctx[at]), packed(runs), packed(self.split[rows][at]), packed(self.word[rows]), low, counts)

    def learn(self, replies: list[dict], model: dict, lower: np.ndarray) -> np.ndarray:
        """Probabilities of the tokens at this level; ``lower`` are those of the level below."""
        count = np.zeros(len(self.grams), np.int64)
        sums = np.zeros((len(self.grams), N_SUMS))
        hot = {}
        for reply in replies:
            if reply["hot"] is not None:
                hot[np.int64(reply["ctx"]).view(np.uint64)] = reply["hot"]
                continue
            rows = self.rows[reply["part"]]
            count[rows] = unpacked(reply["counts"])
            fresh = np.concatenate([[True], self.ctx[rows][1:] != self.ctx[rows][:-1]])
            sums[rows] = self._sums(reply["sums"], int(fresh.sum()))[np.cumsum(fresh) - 1]
        if hot:
            keys = np.array(sorted(hot), np.uint64)
            table = np.array([hot[k] for k in keys])
            at = np.flatnonzero(self.split)
            sums[at] = table[np.searchsorted(keys, self.ctx[at])]
        self.context_count = count[self.of]
        share = probabilities(count, sums, lower[self.first_of], discounts(model["n_r"][self.level - 1]))
        return share[self.of]

    @staticmethod
    def _sums(blob: bytes, n: int) -> np.ndarray:
        size = int.from_bytes(blob[:8], "little")
        whole, low = unpacked(blob[8 : 8 + size]).reshape(LARGEST + 1, n).T, decoded(blob[8 + size :])
        return np.column_stack([whole, low])


def _known(row: dict, listed: list[dict], model: dict, levels: int, n_parts: int) -> tuple[Texts, np.ndarray]:
    """A chunk with the probabilities of its tokens at the last of ``levels``."""
    texts = Texts(row, n_parts)
    share = texts.learn_words([r for r in listed if r["level"] == 1], model)
    for level in range(2, levels + 1):
        texts.next_level(model["texts"])
        share = texts.learn([r for r in listed if r["level"] == level], model, share)
    return texts, share


def _sent_batch(rows: list[tuple]) -> pa.Table:
    names = [f.split()[0] for f in SENT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 6]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _merge(table: pa.Table) -> pa.Table:
    """Totals of a count partition, as replies to the chunks that sent to it."""
    sent = table.to_pylist()
    level, part = sent[0]["level"], sent[0]["part"]
    runs = [unpacked(r["runs"]).astype(np.int64) if level > 1 else None for r in sent]
    ctxs = [unpacked(r["ctx"]) if level > 1 else None for r in sent]
    grams = [unpacked(r["grams"]) for r in sent]
    if level > 1:
        contexts = np.concatenate([np.repeat(c, r) for c, r in zip(ctxs, runs, strict=True)])
        keys = mix(mix(contexts) + np.concatenate(grams))
    else:
        keys = np.concatenate(grams)
    distinct, first, number = np.unique(keys, return_index=True, return_inverse=True)
    counts = np.bincount(number, np.concatenate([unpacked(r["counts"]) for r in sent]), len(distinct)).astype(np.int64)
    sizes = np.array([len(g) for g in grams])
    numbers = np.split(number, np.cumsum(sizes)[:-1])
    n_r = np.bincount(np.minimum(counts, LARGEST + 2), minlength=LARGEST + 3)[1 : LARGEST + 2]
    stats = [int(counts.sum()), int((counts > 0).sum()), *map(int, n_r)]
    out: list[tuple] = []
    if level > 1:
        ctx = contexts[first]
        low = np.concatenate([decoded(r["lower"]) for r in sent])[first]
        known, of = np.unique(ctx, return_inverse=True)
        seen = counts > 0
        whole = [np.bincount(of, counts, len(known))]
        whole += [np.bincount(of[counts == r], minlength=len(known)) for r in range(1, LARGEST + 1)]
        sums = np.column_stack([np.stack(whole, 1).astype(np.int64), np.bincount(of[seen], low[seen], len(known))])
        split = np.unique(np.concatenate([c[unpacked(r["split"])] for c, r in zip(ctxs, sent, strict=True)]))
        for c in split:
            own = sums[np.searchsorted(known, c)]
            out.append((None, level, part, None, None, int(c.view(np.int64)), [float(x) for x in own], None))
    for row, own, ctx in zip(sent, numbers, ctxs, strict=True):
        # A word's number is its place among the sorted words of its partition.
        blob = packed(np.diff(own, prepend=0).astype(np.uint32)) if level == 1 else b""
        if level > 1:
            found = sums[np.searchsorted(known, ctx)]
            first_part = packed(found[:, :-1].astype(np.uint32 if found[:, 0].max(initial=0) < 1 << 32 else np.int64).T.ravel())
            blob = len(first_part).to_bytes(8, "little") + first_part + coded(found[:, -1])
            wanted = ctx[unpacked(row["split"])]
            out += [(row["chunk"], level, part, None, None, int(c.view(np.int64)), None, None) for c in wanted]
        total = counts[own]
        out.append((row["chunk"], level, part, packed(total.astype(np.uint32 if total.max(initial=0) < 1 << 32 else np.int64)), blob, None, None, stats))
        stats = None
    return _reply(out)


def _replies(merged: DataFrame) -> DataFrame:
    """Replies by chunk: totals as they are, and the sums of split contexts added up and joined."""
    plain = merged.where("counts IS NOT NULL")
    partial = merged.where("hot IS NOT NULL")
    if partial.isEmpty():
        return plain
    added = [F.sum(F.get("hot", F.lit(i))).alias(f"h{i}") for i in range(N_SUMS)]
    whole = partial.groupBy("ctx").agg(*added).select("ctx", F.array(*[f"h{i}" for i in range(N_SUMS)]).alias("hot"))
    wanted = merged.where("counts IS NULL AND hot IS NULL").select("chunk", "level", "ctx").distinct()
    joined = wanted.join(whole, "ctx")
    nothing = {c: F.lit(None).cast(merged.schema[c].dataType) for c in ("part", "counts", "sums", "stats")}
    return plain.unionByName(joined.select("chunk", "level", "ctx", "hot", *[v.alias(c) for c, v in nothing.items()]))


def score(docs: DataFrame, order: int = ORDER, chunk_tokens: int = CHUNK_TOKENS, part_tokens: int = PART_TOKENS) -> DataFrame:
    """Counts, base score and model score of every text."""
    id_type = docs.schema["doc_id"].dataType
    cut = cut_lineage(chunks(docs, chunk_tokens))
    texts = F.aggregate(F.transform("held", lambda h: F.when(h, 0).otherwise(1)), F.lit(0), lambda a, b: a + b)
    size = cut.agg(F.sum("n").alias("n"), F.sum(texts).alias("texts")).first()
    n_parts = max(4, -(-int(size["n"] or 0) // part_tokens))
    model: dict = {"n": 0, "v": 0, "texts": int(size["texts"] or 0), "n_r": []}
    replies: DataFrame | None = None

    def joined(run, schema):
        return cut.drop("words", "n").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, schema)

    def send_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _sent_batch(list(Texts(row, n_parts).words_sent(row["chunk"], unpacked(row["words"])))).to_batches()

    def send_grams(model: dict, level: int):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            row = left.to_pylist()[0]
            texts, share = _known(row, right.to_pylist(), model, level - 1, n_parts)
            texts.next_level(model["texts"])
            return _sent_batch(list(texts.sent(row["chunk"], share)))

        return run

    for level in range(1, order + 1):
        sent = cut.mapInArrow(send_words, SENT) if replies is None else joined(send_grams(dict(model), level), SENT)
        merged = cut_lineage(sent.groupBy("part").applyInArrow(_merge, REPLY))
        stats = merged.where("stats IS NOT NULL").agg(*[F.sum(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(LARGEST + 3)]).first()
        values = [int(x or 0) for x in stats]
        if level == 1:
            model["n"], model["v"] = values[:2]
        model["n_r"] = [*model["n_r"], values[2:]]
        own = _replies(merged)
        replies = own if replies is None else replies.unionByName(own)

    names = ["n_tokens", "n_known", "train_tokens"]
    schema = StructType(
        [
            StructField("doc_id", id_type),
            StructField("held_out", BooleanType()),
            *[StructField(n, LongType()) for n in names],
            StructField("base_score", DoubleType()),
            StructField("score", DoubleType()),
        ]
    )

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        texts, share = _known(row, right.to_pylist(), model, order, n_parts)
        base = np.log10((texts.known + 1) / (model["n"] + model["v"] + 1))
        sums = [np.add.reduceat(x, texts.begin) for x in ((texts.known > 0).astype(np.int64), base, np.log10(share))]
        ids = left.column("ids").combine_chunks().flatten()
        columns = [ids, pa.array(texts.held), pa.array(texts.sizes.astype(np.int64)), pa.array(sums[0]), pa.array(np.full(len(ids), model["n"]))]
        return pa.Table.from_arrays([*columns, pa.array(sums[1]), pa.array(sums[2])], names=schema.names)

    return joined(finish, schema)
