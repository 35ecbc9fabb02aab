"""Similarity join of n-gram sets by prefix trees.

A text's set holds its distinct word n-grams; two sets link when ``100 |A & B| >= percent |A | B|``.

Which sets meet. Linked sets, the smaller of size ``a``, differ in at most ``d = a (100 - percent) / percent``
n-grams. Sizes fall into bands; all sets of a band deal their n-grams by a hash over the same parts, more
than ``d``, and a set near a band's lower end does so in the band below too. Linked sets differ in at most
``d`` parts, so the largest part (of equal ones the first) that is the same in both is among the ``d + 1`` largest
of each: the hashes of these are a set's keys. Sets that share a key, directly or through others, meet. Most
texts meet nothing and leave here; only the sets of the others travel, once. A second dealing with other
hashes splits the meetings further. No step drops a possible link.

How a meeting is joined. Its n-grams get one order, most frequent first; those of one set only are left
out and count as length alone. The ordered sets are stored in a tree whose common beginnings are common
paths. One traversal serves all sets of the meeting: at a node the partial overlaps of all of them with the
path are raised by the node's own n-grams, once for all sets below it. A set leaves a subtree when its
overlap, plus what is left of it and of the longest path below, cannot reach the overlap that the smallest
set below would need; it also leaves when all below are already linked to it through others. What is left
at the end of a path is exact. Meetings above ``CHUNK_TOKENS`` n-grams or ``CHUNK_SETS`` sets are cut into
chunks: first each chunk joins itself and the first one, then those pairs of chunks that are not yet one
component. A task returns a spanning forest of its links.

N-grams and equal sets are known by 64 and 128-bit hashes. A text with fewer words than ``ngram`` is one
n-gram; a null text or one without words has an empty set, links with nothing and is named by its own id.
Null ids never name a component that has another. Repeated rows each get a row; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import PIECE_BYTES, Words, ascii_lower, components, mix, pieces, utf8
from lexweave.scale import ROWS_PER_SALT, add_salt, lookup_join, replicate
from lexweave.session import cut_lineage

NGRAM, PERCENT = 3, 90
# Parts are this many times as many as keys, so that small ones are left out; sizes of a band grow by ``BAND``.
SLACK, BAND = 1.3, 1.5
CHUNK_TOKENS, CHUNK_SETS = 1 << 19, 1024
LOWER = ascii_lower()


def _inside() -> np.ndarray:
    table = np.ones(256, np.bool_)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


INSIDE = _inside()


def ngram_sets(data: np.ndarray, places: np.ndarray, ngram: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, ascending, end to end, and where each text's begin."""
    words = Words(data, places, INSIDE)
    hashes, n_words = words.hashes(LOWER), np.diff(words.first)
    size = np.minimum(n_words, ngram)
    n_grams = np.where(n_words > 0, n_words - size + 1, 0)
    doc = np.repeat(np.arange(len(n_words)), n_grams)
    at = np.concatenate([[0], np.cumsum(n_grams)])
    head = words.first[:-1][doc] + np.arange(at[-1]) - at[:-1][doc]
    gram = mix(size[doc].astype(np.uint64))
    for i in range(ngram):
        has = size[doc] > i
        gram[has] = mix(gram[has] + hashes[head[has] + i])
    order = np.lexsort((gram, doc))
    doc, gram = doc[order], gram[order]
    kept = np.ones(len(doc), np.bool_)
    kept[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
    return gram[kept], np.concatenate([[0], np.cumsum(np.bincount(doc[kept], minlength=len(n_words)))])


def _sums(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    np.add.at(out, doc, values)
    return out


def _bands(percent: int, largest: int) -> np.ndarray:
    """Sizes at which bands begin, the first size with room for a difference first."""
    edges = [1 if percent < 50 else -(-percent // (100 - percent))] if percent < 100 else [largest + 1]
    while edges[-1] <= largest:
        edges.append(max(edges[-1] + 1, int(np.ceil(edges[-1] * BAND))))
    return np.array([*edges, int(edges[-1] * BAND) + 1], np.int64)


def part_keys(grams: np.ndarray, first: np.ndarray, percent: int = PERCENT, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Set number and key of each part under which a set meets others; linked, different sets share one."""
    sizes = np.diff(first)
    edges = _bands(percent, int(sizes.max(initial=0)))
    own = np.searchsorted(edges, sizes, "right") - 1
    below = (own > 0) & (100 * (edges[np.maximum(own, 0)] - 1) >= percent * sizes)
    out_set, out_key = [], []
    for chosen, band in ((own >= 0, own), (below, own - 1)):
        sets = np.flatnonzero(chosen)
        if not len(sets):
            continue
        band = band[sets]
        differ = (edges[band + 1] - 1) * (100 - percent) // percent
        parts = np.ceil(SLACK * (differ + 1)).astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(parts)])
        of = np.repeat(np.arange(len(sets)), sizes[sets])
        inner = np.arange(len(of)) - np.repeat(np.cumsum(sizes[sets]) - sizes[sets], sizes[sets])
        gram = grams[first[sets][of] + inner]
        dealt = mix(gram + mix(np.array([seed + 1], np.uint64))) >> np.uint64(32)
        slot = begin[of] + ((dealt * parts[of].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        total = _sums(mix(gram ^ np.uint64(0x5851F42D4C957F2D)), slot, int(begin[-1]))
        held = np.bincount(slot, minlength=int(begin[-1]))
        owner = np.repeat(np.arange(len(sets)), parts)
        number = np.arange(begin[-1]) - begin[:-1][owner]
        order = np.lexsort((number, -held, owner))
        used = order[np.arange(len(order)) - begin[:-1][owner] <= differ[owner]]
        name = mix(total + mix((number + 1).astype(np.uint64) + (band[owner].astype(np.uint64) << np.uint64(40))))
        out_set.append(sets[owner[used]])
        out_key.append(name[used])
    return (np.concatenate(out_set), np.concatenate(out_key)) if out_set else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _lists(numbers: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """``values`` as ``n`` lists by their list ``numbers``."""
    order = np.argsort(numbers, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(numbers, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, values[order].view(np.int64))


def _digests(grams: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return tuple(_sums(mix(grams ^ np.uint64(salt)), doc, len(first) - 1).view(np.int64) for salt in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47))


def sketches(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, size and digest of every row's set, and the keys under which it meets others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            grams, first = ngram_sets(*utf8(piece.column(1)), ngram)
            low, high = _digests(grams, first)
            keys = _lists(*part_keys(grams, first, percent), len(first) - 1)
            columns = [piece.column(0), pa.array(np.diff(first)), pa.array(low), pa.array(high), keys]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "low", "high", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n bigint, low bigint, high bigint, keys array<bigint>")


def meetings(keyed: DataFrame) -> DataFrame:
    """``(node, root)`` of the sets ``id`` that share a ``key`` with another, directly or through others."""
    counted = keyed.groupBy("key").agg(F.min("id").alias("with"), F.count(F.lit(1)).alias("n"))
    shared = cut_lineage(counted.where("n > 1"))
    # Keys of very many sets are salted; every size goes through this one shuffle.
    hot = cut_lineage(shared.where(F.col("n") > ROWS_PER_SALT).select("key", F.ceil(F.col("n") / ROWS_PER_SALT).cast("int").alias("_salts")))
    met = add_salt(keyed, hot, ["key"], ["id"]).join(replicate(shared.select("key", "with"), hot, ["key"]), ["key", "_salt"])
    return components(cut_lineage(met.where("id != with").select(F.col("id").alias("a"), F.col("with").alias("b")).distinct()))


def _id_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00null"))


def candidate_sets(docs: DataFrame, classes: DataFrame, met: DataFrame, ngram: int = NGRAM) -> DataFrame:
    """``id, root, n, grams`` (sorted 64-bit hashes) of the sets in ``met``, computed anew from one text of each."""
    wanted = cut_lineage(lookup_join(met.select(F.col("node").alias("id"), "root"), classes.select("id", "doc_id", "low", "high"), ["id"], ["root"]))
    by_key = wanted.select(_id_key().alias("_key"), "id", "root", "low", "high")
    texts = docs.select(_id_key().alias("_key"), "text", F.monotonically_increasing_id().alias("_row"))
    rows = lookup_join(texts, by_key, ["_key"], ["_row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            grams, first = ngram_sets(*utf8(piece.column(4)), ngram)
            low, high = _digests(grams, first)
            # Rows may share an id; only a row with the set itself stands for it.
            same = np.flatnonzero((low == piece.column(2).to_numpy()) & (high == piece.column(3).to_numpy()))
            blobs = pa.array([grams[first[i] : first[i + 1]].tobytes() for i in same], pa.large_binary())
            columns = [piece.column(0).take(pa.array(same)), piece.column(1).take(pa.array(same)), pa.array(np.diff(first)[same]), blobs.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "root", "n", "grams"])

    found = cut_lineage(rows.select("id", "root", "low", "high", "text").mapInArrow(run, "id bigint, root bigint, n bigint, grams binary"))
    if found.count() > wanted.count():
        found = cut_lineage(found.dropDuplicates(["id"]))
    return found


def _unpacked(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a binary column end to end, and where each set's begin."""
    sets = [np.frombuffer(b.as_buffer(), np.uint64) for b in blobs]
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.cumsum([0, *map(len, sets)])


def refined(sets: DataFrame, percent: int = PERCENT, seed: int = 1) -> DataFrame:
    """``sets`` with new roots: meetings dealt once more by other hashes; sets that now meet nothing leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = np.cumsum(pc.binary_length(batch.column(2)).to_numpy()) // PIECE_BYTES
            edges = [0, *(np.flatnonzero(held[1:] != held[:-1]) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for a, b in zip(edges, edges[1:], strict=False):
                piece = batch.slice(a, b - a)
                number, key = part_keys(*_unpacked(piece.column(2)), percent, seed)
                root = piece.column(1).to_numpy().view(np.uint64)[number]
                ids = piece.column(0).take(pa.array(number))
                yield pa.RecordBatch.from_arrays([ids, pa.array(mix(key + mix(root)).view(np.int64))], names=["id", "key"])

    keyed = cut_lineage(sets.select("id", "root", "grams").mapInArrow(run, "id bigint, key bigint"))
    roots = meetings(keyed).withColumnRenamed("node", "id")
    return cut_lineage(lookup_join(sets.drop("root"), roots, ["id"], ["n"]))


class Tree:
    """Ordered sets of one meeting as a tree, whose traversal lists links between different labels."""

    def __init__(self, grams: np.ndarray, first: np.ndarray, labels: np.ndarray, percent: int = PERCENT):
        n, self.percent = len(first) - 1, percent
        owner = np.repeat(np.arange(n), np.diff(first))
        _, inverse, counts = np.unique(grams, return_inverse=True, return_counts=True)
        rank = np.empty(len(counts), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
        shared = counts[inverse] > 1
        self.width = int((counts > 1).sum()) + 1
        owner, ranks = owner[shared], rank[inverse[shared]]
        order = np.lexsort((ranks, owner))
        owner, ranks = owner[order], ranks[order]
        bounds = np.searchsorted(owner, np.arange(n + 1))
        # Sets in the order of their paths.
        paths = [ranks[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        self.place = np.array(sorted(range(n), key=lambda i: paths[i].astype(">u4").tobytes()), np.int64)
        self.paths = [paths[i] for i in self.place]
        self.sizes = np.diff(first)[self.place]
        self.lengths = np.array([len(p) for p in self.paths], np.int64)
        self.labels = labels[self.place]
        # Ascending (set, rank), and the sets of each rank.
        self.begin = np.concatenate([[0], np.cumsum(self.lengths)])
        own = np.repeat(np.arange(n), self.lengths)
        flat = np.concatenate([*self.paths, np.zeros(0, np.int64)])
        self.cells = own * self.width + flat
        self.sets_of = own[np.argsort(flat, kind="stable")]
        self.rank_at = np.searchsorted(np.sort(flat), np.arange(self.width + 1))

    def _overlap(self, ranks: np.ndarray) -> np.ndarray:
        """How many of ``ranks`` each set has."""
        begin, size = self.rank_at[ranks], self.rank_at[ranks + 1] - self.rank_at[ranks]
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        return np.bincount(self.sets_of[np.repeat(begin, size) + inner], minlength=len(self.paths))

    def _left(self, probes: np.ndarray, last: int) -> np.ndarray:
        """How many n-grams after rank ``last`` each probe has."""
        return self.begin[probes + 1] - np.searchsorted(self.cells, probes * self.width + last, "right")

    def _join(self, ending: np.ndarray, probes: np.ndarray, overlap: np.ndarray, links: list[tuple[int, int]]) -> None:
        for y in ending:
            union = self.sizes[probes] + self.sizes[y] - overlap
            for x in probes[(100 * overlap >= self.percent * union) & (self.labels[probes] != self.labels[y])]:
                a, b = self.labels[x], self.labels[y]
                if a != b:
                    links.append((int(self.place[x]), int(self.place[y])))
                    self.labels[self.labels == max(a, b)] = min(a, b)

    def links(self) -> list[tuple[int, int]]:
        """Pairs of set numbers that connect what links connect, and labels did not."""
        out: list[tuple[int, int]] = []
        n = len(self.paths)
        everyone = np.arange(n)
        stack = [(0, n, 0, everyone, np.zeros(n, np.int64))] if n else []
        while stack:
            low, high, depth, probes, overlap = stack.pop()
            own = self.labels[low:high]
            if (own == own[0]).all():
                apart = self.labels[probes] != own[0]
                probes, overlap = probes[apart], overlap[apart]
            if not len(probes):
                continue
            head, tail = self.paths[low], self.paths[high - 1]
            size = min(len(head), len(tail))
            differ = np.flatnonzero(head[depth:size] != tail[depth:size])
            end = depth + int(differ[0]) if len(differ) else size
            if end > depth:
                overlap = overlap + self._overlap(head[depth:end])[probes]
            left = self._left(probes, int(head[end - 1]) if end else -1)
            best = overlap + np.minimum(left, int(self.lengths[low:high].max()) - end)
            least = self.sizes[probes] + int(self.sizes[low:high].min())
            possible = (100 + self.percent) * best >= self.percent * least
            probes, overlap = probes[possible], overlap[possible]
            if not len(probes):
                continue
            first = low + int(np.searchsorted(self.lengths[low:high] > end, True))
            self._join(everyone[low:first], probes, overlap, out)
            if first < high:
                following = np.array([self.paths[i][end] for i in range(first, high)])
                edges = first + np.concatenate([[0], np.flatnonzero(following[1:] != following[:-1]) + 1, [high - first]])
                stack += [(int(a), int(b), end, probes, overlap) for a, b in zip(edges[:-1], edges[1:], strict=True)][::-1]
        return out


GROUP = ["root", "i", "j"]


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole groups of a stream sorted by its first three columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy() for i in range(3)])
        edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if held and any(held[-1].column(i)[0] != batch.column(i)[a] for i in range(3)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def block_links(dealt: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links ``(a, b)`` of rows ``root, i, j, id, label, grams``, group by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches):
            table = table.combine_chunks()
            ids = table.column("id").to_numpy()
            grams, first = _unpacked(pa.concat_arrays(table.column("grams").chunks))
            found = Tree(grams, first, table.column("label").to_numpy().copy(), percent).links()
            if found:
                a, b = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

    sorted_rows = dealt.select(*GROUP, "id", "label", "grams").repartition(*GROUP).sortWithinPartitions(*GROUP)
    return sorted_rows.mapInArrow(run, "a bigint, b bigint")


def links(sets: DataFrame, percent: int = PERCENT, chunk_tokens: int = CHUNK_TOKENS, chunk_sets: int = CHUNK_SETS) -> DataFrame:
    """Links ``(a, b)`` that connect exactly what links within the meetings (``root``) of ``sets`` connect."""
    sizes = sets.groupBy("root").agg(F.greatest(F.ceil(F.sum("n") / chunk_tokens), F.ceil(F.count(F.lit(1)) / chunk_sets)).alias("chunks"))
    large = cut_lineage(sizes.where("chunks > 1"))
    placed = lookup_join(sets, large, ["root"], ["id"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))
    # A chunk with itself and with the first one; the first one with all.
    zero = F.lit(0).cast("long")
    own = F.array(F.struct(zero.alias("i"), F.col("chunk").alias("j")), F.struct(F.col("chunk").alias("i"), F.col("chunk").alias("j")))
    first = F.transform(F.sequence(zero, F.col("chunks") - 1), lambda c: F.struct(zero.alias("i"), c.alias("j")))
    blocks = F.explode(F.when(F.col("chunk") == 0, first).otherwise(own)).alias("block")
    dealt = placed.select("root", "id", F.col("id").alias("label"), "grams", blocks).select("*", "block.*")
    found = cut_lineage(block_links(dealt, percent))
    if large.isEmpty():
        return found
    # Pairs of the other chunks, but for those that are one component by now.
    roots = components(found).select(F.col("node").alias("id"), F.col("root").alias("label"))
    rest = lookup_join(placed.where("chunks > 1 AND chunk > 0"), roots, ["id"], ["root"], "left")
    rest = cut_lineage(rest.withColumn("label", F.coalesce("label", "id")))
    span = rest.groupBy("root", "chunk").agg(F.min("label").alias("least"), F.max("label").alias("most"))
    left, right = (span.select("root", *[F.col(c).alias(f"{c}_{side}") for c in ("chunk", "least", "most")]) for side in "ij")
    apart = (F.least("least_i", "least_j") != F.greatest("most_i", "most_j")) & (F.col("chunk_i") < F.col("chunk_j"))
    pairs = left.join(right, "root").where(apart).select("root", F.col("chunk_i").alias("i"), F.col("chunk_j").alias("j"))
    sides = pairs.select("*", F.explode(F.array("i", "j")).alias("chunk"))
    again = lookup_join(rest.drop("chunks"), cut_lineage(sides), ["root", "chunk"], ["id"])
    return found.unionByName(block_links(again, percent))


def assign(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT, **chunks: int) -> DataFrame:
    """``doc_id``, the size of its set ``n`` and ``component_id``, the smallest id reachable by links."""
    seen = cut_lineage(sketches(docs, ngram, percent))
    full = seen.where("n > 0")
    # One row for each different set.
    grouped = full.groupBy("low", "high").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows"), F.first("keys").alias("keys"))
    classes = cut_lineage(grouped.withColumn("id", F.monotonically_increasing_id()))
    met = meetings(classes.select("id", F.explode("keys").alias("key")))
    sets = refined(candidate_sets(docs, classes, met, ngram), percent)
    roots = components(links(sets, percent, **chunks))
    linked = lookup_join(classes.select("id", "doc_id"), roots.withColumnRenamed("node", "id"), ["id"], ["id"])
    names = cut_lineage(linked.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    of = cut_lineage(lookup_join(linked.select("id", "root"), names, ["root"], ["id"]).drop("root"))
    own = lookup_join(classes.drop("keys", "n"), of, ["id"], ["id"], "left")
    own = own.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    # A text alone in its component is named by its own id.
    own = own.where((F.col("rows") > 1) | ~F.col("component_id").eqNullSafe(F.col("doc_id")))
    rows = seen.select("doc_id", "n", "low", "high", F.monotonically_increasing_id().alias("_row"))
    found = lookup_join(rows, cut_lineage(own.select("low", "high", "component_id")), ["low", "high"], ["_row"], "left")
    return found.select("doc_id", "n", F.coalesce("component_id", "doc_id").alias("component_id"))
