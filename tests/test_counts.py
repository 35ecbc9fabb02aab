"""Vocabularies, co-occurrence, phrases and PPMI against small Python statements."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexweave.operators import cooc, matrix, phrases, ppmi, vocab
from lexweave.plans.phrases import build_phrases
from lexweave.plans.words import plain_words, tagged_words
from lexweave.scale import hot_keys, lookup_join, sorted_index

LINES = "doc_id long, line_no int, text string"
PARSED = (
    "doc_id long, line_no int, terms array<string>, "
    "edges array<struct<label:string,gov:int,dep:int>>"
)


def random_lines(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)]
    return [" ".join(rng.choice(words[: rng.randint(1, 12)]) for _ in range(rng.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("piece,limit", [(4096, 1000), (3, 1000), (2, 0), (1, 0)])
def test_plain_pairs_span_missing_words(spark, piece, limit):
    lines = random_lines(piece)
    rows = spark.createDataFrame([(i, 0, t) for i, t in enumerate(lines)], LINES)
    tokens = vocab.plain_token_arrays(rows)
    words = vocab.lexicographic_vocab(vocab.at_least(vocab.plain_word_counts(tokens), 40))
    seqs = cooc.plain_sequences(tokens, words, 3, piece, max_broadcast_rows=limit)
    pairs = cooc.plain_index_pair_counts(seqs, 3)
    got = {(r.a, r.b): r.n for r in cooc.spell_pairs(pairs, words, limit).collect()}

    counts = Counter(t for line in lines for t in line.split())
    kept = {t for t, c in counts.items() if c >= 40}
    assert 0 < len(kept) < len(counts)
    want = Counter()
    for line in lines:
        seq = [t for t in line.split() if t in kept]
        for d in range(1, 4):
            for x, y in zip(seq, seq[d:]):
                want[min(x, y), max(x, y)] += 1
    assert got == dict(want)
    assert {r.term: r.idx for r in words.collect()} == {t: i for i, t in enumerate(sorted(kept))}


@pytest.mark.parametrize("piece,bound", [(4096, 10_000), (2, 10_000), (3, 0)])
def test_tagged_pairs(spark, piece, bound):
    rng = random.Random(piece)
    lines = [[rng.choice(["a-nn", "b-vb", "c-jj", "d-in", None]) for _ in range(rng.randint(1, 15))] for _ in range(50)]
    parsed = spark.createDataFrame([(i, 0, t, []) for i, t in enumerate(lines)], PARSED)
    want = Counter()
    for line in lines:
        seq = [t for t in line if t]
        for d in range(1, 4):
            for x, y in zip(seq, seq[d:]):
                want[min(x, y), max(x, y)] += 1
    got = {(r.a, r.b): r.n for r in cooc.tagged_pair_counts(parsed, 3, piece).collect()}
    assert got == dict(want)
    assert cooc.tagged_pair_total(parsed, 3).first().total == sum(want.values())

    words = vocab.frequency_vocab(vocab.tagged_word_counts(parsed), 3)
    index = {r.term: r.idx for r in words.collect()}
    coded = cooc.tagged_index_pair_counts(parsed, words, 3, piece, bound)
    assert {(r.a, r.b): r.n for r in coded.collect()} == {
        (index[x], index[y]): n for (x, y), n in want.items() if x in index and y in index
    }


def test_top_k_breaks_ties_by_larger_term(spark):
    counts = spark.createDataFrame([("a", 2), ("b", 2), ("c", 5), ("d", 1), ("e", 2)], "term string, cnt long")
    got = vocab.frequency_vocab(counts, 3).orderBy("idx").collect()
    assert [(r.term, r.idx) for r in got] == [("c", 0), ("e", 1), ("b", 2)]


def test_sorted_index_within(spark):
    rows = [(l, f"p{i:03d}") for l in ("x", "y", "z") for i in range(50)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "label string, phrase string").repartition(7)
    got = {(r.label, r.phrase): r.idx for r in sorted_index(df, ["phrase"], within="label").collect()}
    assert got == {(l, f"p{i:03d}"): i for l in ("x", "y", "z") for i in range(50)}


def test_salted_join_keeps_every_row(spark):
    facts = spark.range(5000).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"),
        "id",
    )
    lookup = facts.select("k").distinct().withColumn("v", F.length("k")).where("k <> 'k0'")
    hot = {r.k: r._salts for r in hot_keys(facts, ["k"], 100).collect()}
    assert hot == {"hot": 34}
    for how in ("inner", "left", "left_semi"):
        plain = facts.join(lookup, ["k"], how)
        salted = lookup_join(facts, lookup, ["k"], ["id"], how, max_broadcast_rows=0)
        assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, salted.collect()))


def contexts(terms, i1, i2, ws):
    """Outward on both sides, then inward from both ends of the phrase."""
    left = [t for t in reversed(terms[:i1]) if t][:ws]
    right = [t for t in terms[i2 + 1 :] if t][:ws]
    inner = [t for t in terms[i1 + 1 : i2] if t]
    picked = [t for k, t in enumerate(inner) if k < ws or k >= len(inner) - ws]
    return left + right + picked


@pytest.mark.parametrize("ws", [1, 2, 3, 4])
def test_phrase_contexts(spark, ws):
    rng = random.Random(ws)
    data = []
    for i in range(60):
        n = rng.randint(1, 14)
        terms = [rng.choice(["a-nn", "b-vb", "c-jj", "d-in", "e-rb", None]) for _ in range(n)]
        edges = [(rng.choice(["amod", "nsubj", "dobj", "pobj", "acomp"]), rng.randint(0, n), rng.randint(0, n)) for _ in range(6)]
        data.append((i, 0, terms, edges))
    parsed = spark.createDataFrame(data, PARSED)
    want, totals = Counter(), Counter()
    for _, _, terms, edges in data:
        for label, gov, dep in edges:
            if gov >= len(terms) or dep >= len(terms) or not terms[gov] or not terms[dep]:
                continue
            w1, w2 = (terms[dep], terms[gov]) if label in ("amod", "nsubj") else (terms[gov], terms[dep])
            totals[label] += 1
            for c in contexts(terms, min(gov, dep), max(gov, dep), ws):
                want[label, w1, w2, c] += 1
    rows = phrases.phrase_rows(parsed, ws)
    got = {(r.label, r.w1, r.w2, r.ctx): r.n for r in phrases.context_counts(rows).collect()}
    assert got == dict(want)
    assert {r.label: r.total for r in phrases.phrase_totals(phrases.phrase_rows(parsed)).collect()} == dict(totals)


def test_word_ppmi_diagonal_and_cut(spark):
    vocab_rows = spark.createDataFrame([("a", 50, 0), ("b", 30, 1), ("c", 20, 2)], "term string, cnt long, idx long")
    pairs = spark.createDataFrame([(0, 0, 40), (2, 2, 9), (1, 2, 12), (0, 1, 1)], "a long, b long, n long")
    got = ppmi.context_word_ppmi(pairs, vocab_rows, F.lit(100), F.lit(62), dim=2).collect()
    cells = Counter((r.col, r.row) for r in got)
    # The self pair below the cut twice, the one above it never, one direction of (1, 2).
    assert cells == {(0, 0): 2, (2, 1): 1}
    value = next(r.val for r in got if (r.col, r.row) == (2, 1))
    assert math.isclose(value, math.log((12 / 62) / (0.3 * 0.2)))
    loaded = {(r.row, r.col): r.val for r in matrix.load_matrix(spark.createDataFrame(got)).collect()}
    assert loaded == {(0, 0): 2.0, (1, 2): 1.0}


def test_symmetric_and_sparse_vectors(spark):
    pairs = spark.createDataFrame([(0, 0, 1.5), (0, 2, 0.25), (1, 2, 0.5), (0, 3, 0.75)], "min_idx long, max_idx long, val double")
    cells = {(r.row, r.col): r.val for r in matrix.load_symmetric(pairs).collect()}
    assert cells == {k: 1.0 for k in [(0, 0), (0, 2), (2, 0), (1, 2), (2, 1), (0, 3), (3, 0)]}
    got = {(r.idx, r.segment): [tuple(e) for e in r.entries] for r in matrix.sparse_vectors(pairs, 2).collect()}
    assert got[0, 0] == [(0, 1.5)] and got[0, 1] == [(2, 0.25), (3, 0.75)]
    assert got[2, 0] == [(0, 0.25), (1, 0.5)]


@pytest.mark.parametrize("limit", [1000, 0])
def test_word_cosine(spark, limit):
    mat = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0), (0, 1, 1.0), (2, 2, 1.0)], "row long, col long, val double")
    words = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("empty", 3)], "term string, idx long")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "zz"), ("a", "empty"), ("b", "b")], "w1 string, w2 string")
    got = {(r.w1, r.w2): r.cosine for r in matrix.word_cosine(pairs, mat, words, limit).collect()}
    assert math.isclose(got["a", "b"], 1 / math.sqrt(5))
    assert got["a", "c"] == 0.0 and got["a", "zz"] == -1.0
    assert got["a", "empty"] is None and math.isclose(got["b", "b"], 1.0)


def test_jobs_share_totals(spark):
    rows = spark.createDataFrame([(i, 0, t) for i, t in enumerate(random_lines(9))], LINES)
    job = plain_words(rows, min_count=5)
    values = job.ppmi().collect()
    assert values and all(r.val > 0 and r.min_idx <= r.max_idx for r in values)

    rng = random.Random(4)
    data = []
    for i in range(80):
        n = rng.randint(4, 12)
        terms = [rng.choice(["a-nn", "b-nn", "c-jj", "d-jj"]) for _ in range(n)]
        data.append((i, 0, terms, [("amod", k + 1, k) for k in range(n - 1)]))
    words = tagged_words(spark.createDataFrame(data, PARSED), vocab_size=3, dim=10)
    assert words.dim == 3
    built = build_phrases(words, min_count=2)
    kept = {r.term for r in words.vocab.collect()}
    assert len(kept) == 3
    assert all(r.w1 in kept and r.w2 in kept and r.cnt >= 2 for r in built.vocab.collect())
    assert built.ppmi().where("row >= 3 or val <= 0").count() == 0


def test_selection_of_the_most_frequent(spark):
    rng = random.Random(2)
    for top in (1, 3, 5_000, 1 << 41):
        rows = [(f"w{i}", rng.choice([1, 1, 2, rng.randint(1, top)])) for i in range(300)]
        table = spark.createDataFrame(rows, "term string, cnt long").repartition(5)
        order = sorted(rows, key=lambda r: (r[1], r[0]), reverse=True)
        for k in (0, 1, 40, 299, 300, 1000):
            assert sorted(vocab.top_k(table, k).collect()) == sorted(order[:k])
        placed = vocab.frequency_vocab(table, 40).collect()
        assert sorted((r.idx, r.term) for r in placed) == [(i, t) for i, (t, _) in enumerate(order[:40])]
    assert vocab.top_k(table.limit(0), 5).count() == 0


@pytest.mark.parametrize("cells", [1, 40, 1 << 22])
def test_tagged_pairs_are_counted_in_batches(spark, monkeypatch, cells):
    """vocabulary pairs leave a task counted, whether it keeps a table of all pairs or sorts those it holds."""
    monkeypatch.setattr(cooc, "PAIR_CELLS", cells)
    rng = random.Random(cells)
    names = ["a-nn", "é-vb", "z-vb", "Z-nn", "b-jj", "out-nn", "rare-rb", None]
    lines = [None, [], *([rng.choice(names) for _ in range(rng.randint(1, 15))] for _ in range(80))]
    parsed = spark.createDataFrame([(i, 0, t, []) for i, t in enumerate(lines)], PARSED).repartition(3)
    index = {t: i for i, t in enumerate(names[:5])}
    words = spark.createDataFrame(list(index.items()), "term string, idx long")
    want = Counter()
    for line in lines:
        seq = [t for t in line or [] if t]
        for d in range(1, 4):
            want.update(tuple(sorted(p, key=str.encode)) for p in zip(seq, seq[d:]) if set(p) <= set(index))
    got = cooc.tagged_index_pair_counts(parsed, words)
    assert got.dtypes == [("a", "bigint"), ("b", "bigint"), ("n", "bigint")]
    assert sorted(map(tuple, got.collect())) == sorted((index[x], index[y], n) for (x, y), n in want.items())
    assert cooc.tagged_index_pair_counts(parsed, words.limit(0)).isEmpty()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "lambdafunction" not in plan
