"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's own measures (length, shares of character classes, repeats) and
those of its neighbours feed the state weights; two transition weights link following lines. The field
is fitted on a bounded sample of labelled documents, whose lines all carry the document's label, by
maximising the exact conditional likelihood (forward-backward) with L-BFGS steps. A document's score
is the mean of its lines' marginals for good, weighted by line length plus one.

Bound of the fit, a parameter: ``SAMPLE`` documents, taken by the smallest hash of id among the labelled.
Fit and scoring both read whole texts. A sample of more than ``FIT_LINES`` lines stays in a table, and
every step sums likelihood and gradient over it in Spark; a smaller one is fitted by the same steps in the
driver. Only the text enters a score.
A null or empty text is one empty line; ids that are null have no label. Repeated rows each get a row.
Of several labels of an id the largest counts. Without labels every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lexweave.llm.common import mix, pieces, streams, utf8
from lexweave.session import cut_lineage

SAMPLE = 4000
# Lines of a sample that the driver fits by itself, and about so many that a task works on at once.
FIT_LINES, TASK_LINES = 250_000, 16_384
# Bytes of text measured at once: a text of line breaks alone has as many lines as bytes.
LINE_PIECE = 512 << 10
RIDGE, STEPS = 1e-3, 120
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3


def _classes() -> np.ndarray:
    """0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 stop, 6 mark, 7 symbol, 8 beyond ASCII."""
    table = np.zeros(256, np.uint8)
    table[97:123], table[65:91], table[48:58] = 1, 2, 3
    table[[32, 9, 10, 13]] = 4
    table[list(b".,;:'\"-()")] = 5
    table[list(b"!?")] = 6
    table[list(b"|#$%&*{}[]<>=_/\\@+~^`")] = 7
    table[128:] = 8
    return table


CLASSES = _classes()
N_CLASSES = 9
#: Own measures of a line; neighbours add theirs, and a constant comes last.
N_OWN = N_CLASSES + 7
N_FEATURES = 3 * N_OWN + 3


def widened(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Features of lines: their own measures, those of their neighbours in the text, its edges."""
    n = len(own)
    nothing = np.zeros((1, N_OWN), np.float32)
    before = np.vstack([nothing, own[:-1]])
    after = np.vstack([own[1:], nothing])
    opens, closes = np.zeros(n, np.bool_), np.zeros(n, np.bool_)
    opens[first[:-1]], closes[first[1:] - 1] = True, True
    before[opens], after[closes] = 0, 0
    edges = np.column_stack([opens, closes, np.ones(n)]).astype(np.float32)
    return np.hstack([own, before, after, edges])


class Lines:
    """Lines of a piece of texts: ``first`` line per text, byte ``lengths``, ``own`` measures and ``features``."""

    def __init__(self, data: np.ndarray, places: np.ndarray):
        base = int(places[0])
        data, places = data[base : int(places[-1])], places - base
        breaks = np.flatnonzero(data == 10)
        # A text of n line breaks has n + 1 lines; a break belongs to the line before it.
        begin = np.sort(np.concatenate([places[:-1], breaks + 1]), kind="stable")
        kept = np.searchsorted(places[:-1], breaks, "right") - 1
        self.first = np.arange(len(places)) + np.concatenate([[0], np.cumsum(np.bincount(kept, minlength=len(places) - 1))])
        end = np.append(begin[1:], len(data))
        doc = np.repeat(np.arange(len(places) - 1), np.diff(self.first))
        # Equal starts sort stably, so each line's text ends at its break or its text's end.
        self.lengths = np.maximum(np.minimum(end, places[doc + 1]) - begin, 0)
        self.lengths -= (self.lengths > 0) & (data[np.minimum(begin + self.lengths - 1, max(len(data) - 1, 0))] == 10) if len(data) else 0
        self.own = self._own(data, begin, doc)
        self.features = widened(self.own, self.first)

    def _own(self, data: np.ndarray, begin: np.ndarray, doc: np.ndarray) -> np.ndarray:
        kinds, lengths = CLASSES[data], self.lengths
        n = len(begin)
        shares = np.zeros((n, N_CLASSES), np.float32)
        for kind in range(N_CLASSES):
            total = np.concatenate([[0], np.cumsum(kinds == kind)])
            shares[:, kind] = total[begin + lengths] - total[begin]
        size = np.maximum(lengths, 1)[:, None]
        words = shares[:, 4] + 1
        letters = shares[:, 1] + shares[:, 2] + shares[:, 8]
        same = np.concatenate([[False], (data[1:] == data[:-1]) & (kinds[1:] >= 5)]) if len(data) else np.zeros(0, np.bool_)
        runs = np.concatenate([[0], np.cumsum(same)])
        hashed = self._hashes(data, begin, lengths, doc)
        order = np.argsort(hashed, kind="stable")
        again = np.zeros(n, np.bool_)
        again[order[1:]] = hashed[order[1:]] == hashed[order[:-1]]
        again[order[:-1]] |= hashed[order[1:]] == hashed[order[:-1]]
        return np.column_stack(
            [
                shares / size,
                np.log1p(lengths) / 5,
                np.minimum(lengths / words / 10, 3),
                (runs[begin + lengths] - runs[begin]) / size[:, 0],
                again & (lengths > 0),
                np.minimum(letters / words / 8, 3),
                self._repeats(data, kinds, begin, lengths),
                lengths == 0,
            ]
        ).astype(np.float32)

    @staticmethod
    def _hashes(data, begin, lengths, doc) -> np.ndarray:
        """A hash of each line within its text."""
        full = np.flatnonzero(lengths)
        out = np.zeros(len(begin), np.uint64)
        if len(full):
            reps = lengths[full]
            place = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            content = data[np.repeat(begin[full], reps) + place].astype(np.uint64) + np.uint64(1)
            sums = np.add.reduceat(content * streams(int(reps.max()))[place], np.cumsum(reps) - reps)
            out[full] = mix(sums)
        empty = lengths == 0
        out[empty] = np.arange(int(empty.sum()), dtype=np.uint64)
        return out + mix(doc.astype(np.uint64) + np.uint64(1))

    @staticmethod
    def _repeats(data, kinds, begin, lengths) -> np.ndarray:
        """Share of words that equal the word before them."""
        inside = kinds != 4
        if not inside.any():
            return np.zeros(len(begin))
        starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
        ends = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1
        reps = ends - starts
        place = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        content = data[inside].astype(np.uint64) + np.uint64(1)
        hashed = np.add.reduceat(content * streams(int(reps.max()))[place], np.cumsum(reps) - reps)
        again = np.concatenate([[False], hashed[1:] == hashed[:-1]])
        count, total = np.concatenate([[0], np.cumsum(again)]), np.arange(len(starts) + 1)
        a, b = np.searchsorted(starts, begin), np.searchsorted(starts, begin + lengths)
        return (count[b] - count[a]) / np.maximum(total[b] - total[a], 1)


class Field:
    """Weights of the good state per feature, and of transitions bad-bad, bad-good, good-bad, good-good."""

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = np.zeros(N_FEATURES + 4) if weights is None else weights

    def marginals(self, features: np.ndarray, first: np.ndarray, own: np.ndarray | None = None):
        """Probability of good per line, expected transitions, and each text's log partition function.

        All texts of the piece step together: step ``t`` takes line ``t`` of every text that has one.
        """
        score = features @ self.weights[:N_FEATURES]
        link = self.weights[N_FEATURES:].reshape(2, 2)
        sizes = np.diff(first)
        order = np.argsort(-sizes, kind="stable")
        begin, sizes = first[:-1][order], sizes[order]
        states = np.column_stack([np.zeros(len(score)), score])
        forward, backward = states.copy(), np.zeros_like(states)
        running = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), "left")
        for step in range(1, len(running)):
            rows = begin[: running[step]] + step
            forward[rows] = states[rows] + np.logaddexp(forward[rows - 1][:, :1] + link[0], forward[rows - 1][:, 1:] + link[1])
        for step in range(len(running) - 1, 0, -1):
            rows = begin[: running[step]] + step
            ahead = states[rows] + backward[rows]
            backward[rows - 1] = np.logaddexp(link[:, 0][None] + ahead[:, :1], link[:, 1][None] + ahead[:, 1:])
        last = first[1:] - 1
        total = np.logaddexp(forward[last, 0], forward[last, 1])
        whole = np.repeat(total, np.diff(first))
        good = np.exp(np.minimum(forward[:, 1] + backward[:, 1] - whole, 0))
        inner = np.ones(len(score), np.bool_)
        inner[first[:-1]] = False
        rows = np.flatnonzero(inner)
        ahead = states[rows] + backward[rows]
        pairs = np.exp(forward[rows - 1][:, :, None] + link[None] + ahead[:, None, :] - whole[rows][:, None, None])
        return good, pairs, total

    def loss(self, features, first, labels, ridge: float = RIDGE):
        """Mean negative log-likelihood per text with the penalty, and its gradient; ``labels`` per line."""
        return self.penalised(*self.sums(features, first, labels), len(first) - 1, ridge)

    def penalised(self, value, gradient, n: int, ridge: float = RIDGE):
        """Means over ``n`` texts with the penalty, from their sums."""
        n = max(n, 1)
        return value / n + ridge / 2 * (self.weights**2).sum(), gradient / n + ridge * self.weights

    def sums(self, features, first, labels):
        """Negative log-likelihood of the texts, each divided by its lines, and its gradient."""
        good, pairs, total = self.marginals(features, first)
        link = self.weights[N_FEATURES:].reshape(2, 2)
        inner = np.ones(len(labels), np.bool_)
        inner[first[:-1]] = False
        rows = np.flatnonzero(inner)
        a, b = labels[rows - 1], labels[rows]
        score = features @ self.weights[:N_FEATURES]
        sizes = np.diff(first)
        weight = 1.0 / sizes
        line_weight = np.repeat(weight, sizes)
        own = (score * labels * line_weight).sum() + (link[a, b] * line_weight[rows]).sum()
        value = (total * weight).sum() - own
        observed = np.zeros((2, 2))
        np.add.at(observed, (a, b), line_weight[rows])
        expected = (pairs * line_weight[rows][:, None, None]).sum(axis=0)
        return value, np.concatenate([features.T @ ((good - labels) * line_weight), (expected - observed).ravel()])


def fit(features: np.ndarray, first: np.ndarray, labels: np.ndarray, steps: int = STEPS) -> Field:
    """The field of lines in memory."""
    if not len(labels) or labels.min() == labels.max():
        return Field()
    return descend(lambda field: field.loss(features, first, labels), steps)


def descend(loss, steps: int = STEPS) -> Field:
    """L-BFGS with a halving line search from zero weights; ``loss`` gives value and gradient of a field."""
    field = Field()
    x = field.weights
    value, gradient = loss(field)
    history: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        step, used = gradient.copy(), []
        for s, y in reversed(history):
            used.append(s @ step / (s @ y))
            step -= used[-1] * y
        if history:
            s, y = history[-1]
            step *= (s @ y) / (y @ y)
        for (s, y), alpha in zip(history, reversed(used), strict=True):
            step += (alpha - y @ step / (s @ y)) * s
        length = 1.0 if history else min(1.0, 1 / np.abs(gradient).sum())
        for _ in range(30):
            trial = Field(x - length * step)
            trial_value, trial_gradient = loss(trial)
            if trial_value <= value - 1e-4 * length * (gradient @ step):
                break
            length /= 2
        else:
            break
        s, y = trial.weights - x, trial_gradient - gradient
        if s @ y > 1e-12:
            history = [*history[-9:], (s, y)]
        done = value - trial_value < 1e-7
        x, value, gradient = trial.weights, trial_value, trial_gradient
        if done:
            break
    return Field(x)


def scores(field: Field, data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The length-weighted mean marginal of each text."""
    lines = Lines(data, places)
    good, _, _ = field.marginals(lines.features, lines.first)
    weight = lines.lengths + 1.0
    at = lines.first[:-1]
    return np.add.reduceat(good * weight, at) / np.add.reduceat(weight, at)


def held_out(name: str = "doc_id"):
    """Whether a row is kept from the fit: crc32 of the id's text modulo ``FOLDS``."""
    crc = F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))
    return crc % FOLDS == HELD_OUT


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fit_lines: int = FIT_LINES) -> Field:
    """The field fitted on the whole texts of the sample."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rank = F.xxhash64("doc_id", F.lit("sample"))
    chosen = known.where(~held_out()).orderBy(rank, "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    texts = rows.select("doc_id", (F.col("quality") > 0).cast("int").alias("good"), "text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, LINE_PIECE):
            lines = Lines(*utf8(piece.column(2)))
            blob = [lines.own[a:b].astype("<f4").tobytes() for a, b in zip(lines.first, lines.first[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(blob, pa.binary())], names=["doc_id", "good", "lines"])

    id_type = texts.schema["doc_id"].dataType.simpleString()
    measured = texts.mapInArrow(measure, f"doc_id {id_type}, good int, lines binary")
    table = cut_lineage(measured.groupBy("doc_id").agg(F.min(F.struct("lines", "good")).alias("m")).select("m.good", "m.lines"))
    size = table.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("lines")).alias("bytes"), F.min("good").alias("low"), F.max("good").alias("high")).first()
    if not size["n"] or size["low"] == size["high"]:
        return Field()
    if size["bytes"] > fit_lines * 4 * N_OWN:
        return descend(_summed(table, size["n"]))
    # At most ``sample`` texts with ``fit_lines`` lines together.
    found = sorted(table.collect(), key=lambda r: r["lines"])
    return fit(*_sample([r["lines"] for r in found], [r["good"] for r in found]))


def _sample(blobs: list[bytes], good: list[int]):
    """Features, first lines and a label per line of whole texts."""
    own = [np.frombuffer(b, "<f4").reshape(-1, N_OWN) for b in blobs]
    sizes = np.array([len(o) for o in own])
    first = np.concatenate([[0], np.cumsum(sizes)])
    return widened(np.vstack(own), first).astype(np.float64), first, np.repeat(np.array(good), sizes)


def _summed(table: DataFrame, n: int):
    """The loss of a field over ``table``: every task sums its texts, the driver adds one row per task."""

    def loss(field: Field):
        weights = field.weights

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, total = Field(weights), np.zeros(1 + len(weights))
            for batch in batches:
                good, lines = batch.column(0).to_pylist(), batch.column(1)
                # Texts of like size step together.
                sizes = np.array([len(lines[i].as_buffer()) // (4 * N_OWN) for i in range(len(good))], np.int64)
                order, begin = np.argsort(sizes, kind="stable"), 0
                while begin < len(order):
                    end = begin + max(1, int(np.searchsorted(np.cumsum(sizes[order[begin:]]), TASK_LINES, "right")))
                    at = order[begin:end]
                    value, gradient = own.sums(*_sample([lines[int(i)].as_py() for i in at], [good[i] for i in at]))
                    total += np.concatenate([[value], gradient])
                    begin = end
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

        parts = [np.frombuffer(r["total"]) for r in table.select("good", "lines").mapInArrow(run, "total binary").collect()]
        total = np.sum(parts, axis=0)
        return field.penalised(total[0], total[1:], n)

    return loss


def score(docs: DataFrame, field: Field) -> DataFrame:
    """``doc_id`` and a double ``score`` of the whole text."""
    others = ["doc_id"]
    rows = docs.select("doc_id", "text")
    schema = StructType([*rows.schema.fields[:-1], StructField("score", DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(field.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(shared.value)
        for piece in pieces(batches, LINE_PIECE):
            found = scores(field, *utf8(piece.column(len(others))))
            yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(found)], names=[*others, "score"])

    return rows.mapInArrow(run, schema)


def keep(docs: DataFrame, field: Field, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold."""
    shared, at = docs.sparkSession.sparkContext.broadcast(field.weights), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(shared.value)
        for piece in pieces(batches, LINE_PIECE, at):
            yield piece.filter(pa.array(scores(field, *utf8(piece.column(at))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
