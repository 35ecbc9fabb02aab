"""Toxicity by a chain of linear models over words.

Categories are label columns in a fixed order. Each category has a logistic model over the words a text
holds and the log-odds of all earlier categories in the chain. Those log-odds are out-of-fold while
fitting: the sample is dealt into ``FITS`` folds by a hash of the id, the model for a fold is fitted
on the others, so a later model learns from earlier predictions as they are on unseen texts. At scoring
the models fitted on the whole sample run one after another.

Bounds of the fit, parameters: ``SAMPLE`` labelled documents, by the smallest hash of id, whole texts;
``WORDS`` words and word shapes per category, those whose presence separates the sample best of all in
``LEAST`` texts or more, with a chi-square of ``CLEAR`` at least. A feature counts by its smoothed log-ratio
between the classes, so that rare but clear words are not flattened by the penalty. Scoring reads whole texts, nothing but the text enters. A null or empty text
has no words and gets the chain's prior. Null ids and null labels are not learned from; of several
labels of an id the largest counts; an id with several texts lends all of them to the fit. Without
labels every probability is 0.5. Repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lexweave.llm.common import Words, ascii_lower, pieces, utf8
from lexweave.llm.decontam import INSIDE
from lexweave.llm.katz import INSIDE as VISIBLE
from lexweave.llm.quality import CLASSES, held_out

SAMPLE, WORDS, LEAST, FITS, CLEAR = 6000, 4096, 4, 5, 20.0
RIDGE, STEPS = 2e-4, 200
LOWER = ascii_lower()


@dataclass
class Model:
    """Sorted word hashes, a weight of each, weights of earlier log-odds, and the constant."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    chain: np.ndarray = field(default_factory=lambda: np.zeros(0))
    constant: float = 0.0

    def odds(self, doc: np.ndarray, hashes: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        """Log-odds of each text; ``doc, hashes``: distinct words of the texts."""
        total = np.full(len(earlier), self.constant)
        if earlier.shape[1]:
            total += earlier @ self.chain[: earlier.shape[1]]
        if len(self.words) and len(hashes):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            same = self.words[at] == hashes
            total += np.bincount(doc[same], self.weights[at[same]], len(total))
        return total


def distinct_words(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of each distinct word, and word shape (its character classes), of each text."""
    words, shapes = Words(data, places, INSIDE), Words(data, places, VISIBLE)
    doc = np.concatenate([words.doc, shapes.doc])
    hashes = np.concatenate([words.hashes(LOWER), ~shapes.hashes(CLASSES)])
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    fresh = np.ones(len(doc), np.bool_)
    fresh[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[fresh], hashes[fresh]


def _separating(doc: np.ndarray, hashes: np.ndarray, label: np.ndarray, most: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The words whose presence goes most with or against the label, and their log-ratios."""
    words, number = np.unique(hashes, return_inverse=True)
    n, positive = len(label), label.sum()
    seen = np.bincount(number, minlength=len(words)).astype(float)
    both = np.bincount(number, label[doc], len(words))
    expected = seen * positive / max(n, 1)
    spread = np.maximum(expected * (1 - seen / max(n, 1)) * (n - positive) / max(n, 1), 1e-12)
    value = np.where((seen >= least) & (seen < n), (both - expected) ** 2 / spread, -1)
    best = np.argsort(-value, kind="stable")[:most]
    best = np.sort(best[value[best] >= CLEAR])
    ratio = np.log((both + 0.5) / (positive + 1)) - np.log((seen - both + 0.5) / (n - positive + 1))
    return words[best], ratio[best]


def fit(doc: np.ndarray, hashes: np.ndarray, label: np.ndarray, earlier: np.ndarray, rows: np.ndarray, most: int = WORDS, least: int = LEAST) -> Model:
    """Logistic regression on the texts ``rows`` (a mask), by accelerated gradient steps."""
    keep = rows[doc]
    number = np.cumsum(rows) - 1
    doc, hashes, label, earlier = number[doc[keep]], hashes[keep], label[rows].astype(float), earlier[rows]
    n, n_chain = len(label), earlier.shape[1]
    if not n or label.min() == label.max():
        prior = (label.sum() + 0.5) / (n + 1)
        return Model(chain=np.zeros(n_chain), constant=float(np.log(prior / (1 - prior))) if n else 0.0)
    words, size = _separating(doc, hashes, label, most, least)
    at = np.minimum(np.searchsorted(words, hashes), max(len(words) - 1, 0)) if len(words) else np.zeros(len(hashes), np.int64)
    same = words[at] == hashes if len(words) else np.zeros(len(hashes), np.bool_)
    doc, at = doc[same], at[same]
    scale = np.maximum(np.abs(earlier).max(axis=0, initial=1.0), 1.0)
    dense = np.column_stack([earlier / scale, np.ones(n)])
    n_words = len(words)
    # The largest curvature is at most a quarter of the largest row length squared.
    value = size[at] if n_words else np.zeros(0)
    longest = np.bincount(doc, value**2, n).max(initial=0) + (dense**2).sum(axis=1).max()
    curvature = _largest(doc, at, value, dense, n, n_words, longest) / (4 * n) + RIDGE
    theta = np.zeros(n_words + n_chain + 1)
    theta[-1] = np.log(label.mean() / (1 - label.mean()))
    ahead, momentum = theta.copy(), 1.0
    for _ in range(STEPS):
        odds = np.bincount(doc, value * ahead[at], n) + dense @ ahead[n_words:]
        error = 1 / (1 + np.exp(-np.clip(odds, -60, 60))) - label
        gradient = np.concatenate([np.bincount(at, value * error[doc], n_words), dense.T @ error]) / n
        gradient[:-1] += RIDGE * ahead[:-1]
        fresh = ahead - gradient / curvature
        grown = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = fresh + (momentum - 1) / grown * (fresh - theta)
        theta, momentum = fresh, grown
    return Model(words, theta[:n_words] * size, theta[n_words:-1] / scale, float(theta[-1]))


def _largest(doc, at, value, dense, n, n_words, bound: float) -> float:
    """Largest eigenvalue of the squared design by power steps, a little above, and never over ``bound * n``."""
    vector = np.ones(n_words + dense.shape[1])
    length = 1.0
    for _ in range(20):
        out = np.bincount(doc, value * vector[at], n) + dense @ vector[n_words:]
        vector = np.concatenate([np.bincount(at, value * out[doc], n_words), dense.T @ out])
        length = float(np.linalg.norm(vector))
        vector /= max(length, 1e-12)
    return min(1.1 * length, bound * n)


def fit_chain(doc: np.ndarray, hashes: np.ndarray, labels: np.ndarray, folds: np.ndarray, most: int = WORDS, least: int = LEAST) -> list[Model]:
    """One model per column of ``labels``, each fed the out-of-fold log-odds of the columns before."""
    earlier = np.zeros((len(labels), 0))
    chain = []
    for column in range(labels.shape[1]):
        label = labels[:, column]
        unseen = np.zeros(len(label))
        for fold in np.unique(folds):
            own = fit(doc, hashes, label, earlier, folds != fold, most, least)
            unseen = np.where(folds == fold, own.odds(doc, hashes, earlier), unseen)
        chain.append(fit(doc, hashes, label, earlier, np.ones(len(label), np.bool_), most, least))
        earlier = np.column_stack([earlier, unseen])
    return chain


def train(docs: DataFrame, labels: DataFrame, categories: Sequence[str], sample: int = SAMPLE) -> list[Model]:
    """The chain over the 0/1 columns ``categories`` of ``labels``."""
    known = labels.where("doc_id IS NOT NULL").dropna(subset=list(categories))
    known = known.groupBy("doc_id").agg(*[F.max(F.col(c).cast("int")).alias(c) for c in categories])
    rank = F.xxhash64("doc_id", F.lit("chain"))
    chosen = known.where(~held_out()).orderBy(rank, "doc_id").limit(sample)
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FITS)).cast("int")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.select("doc_id", fold.alias("fold"), F.array(*categories).alias("labels"), F.coalesce("text", F.lit("")).alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            doc, hashes = distinct_words(*utf8(piece.column(3)))
            edges = np.searchsorted(doc, np.arange(piece.num_rows + 1))
            blobs = [hashes[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*piece.columns[:3], pa.array(blobs, pa.binary())], names=["doc_id", "fold", "labels", "words"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    measured = rows.mapInArrow(measure, f"doc_id {id_type}, fold int, labels array<int>, words binary")
    # The cap on rows only matters where ids repeat; the order makes the choice the same each time.
    found = measured.orderBy(F.xxhash64("doc_id", F.lit("chain")), "doc_id", "words").limit(sample).collect()
    if not found:
        return [Model(chain=np.zeros(i)) for i in range(len(categories))]
    parts = [np.frombuffer(r["words"], np.uint64) for r in found]
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    targets = np.array([[int(x > 0) for x in r["labels"]] for r in found])
    return fit_chain(doc, np.concatenate(parts), targets, np.array([r["fold"] for r in found]))


def score(docs: DataFrame, chain: list[Model], categories: Sequence[str]) -> DataFrame:
    """``doc_id`` and ``p_<category>`` of each category."""
    others = ["doc_id"]
    names = [f"p_{c}" for c in categories]
    rows = docs.select("doc_id", "text")
    schema = StructType([*rows.schema.fields[:-1], *[StructField(n, DoubleType()) for n in names]])
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            doc, hashes = distinct_words(*utf8(piece.column(len(others))))
            odds = np.zeros((piece.num_rows, 0))
            for model in shared.value:
                odds = np.column_stack([odds, model.odds(doc, hashes, odds)])
            shares = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
            yield pa.RecordBatch.from_arrays([*piece.columns[:-1], *map(pa.array, shares.T)], names=[*others, *names])

    return rows.mapInArrow(run, schema)
