"""Packed shuffles: columns come back as they were, and sentences meet phrases in one of them."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from lexweave import session
from lexweave.gather import Part, gathered, pack, unpack
from lexweave.operators import compose, cooc, matrix, phrases, rules, trees
from lexweave.operators.sentences import trailing_indices

TOKEN = pa.struct([("lemma", pa.string()), ("tag", pa.string()), ("gov", pa.int32()), ("rel", pa.string())])
SENTENCES = "rule_id long, side string, sent_no int, tokens array<struct<lemma:string,tag:string,gov:int,rel:string>>"
RULES = "rule_id long, side string, phrase string"


def token(rng, far=False):
    if rng.random() < 0.1:
        return None
    gov = rng.choice([None, 0, 1, 2, 9, -3, *([2**31 - 1, -(2**31)] if far else [])])
    return {"lemma": rng.choice([None, "", "a\nb", "xyz" * rng.randrange(9), str(rng.random())]), "tag": rng.choice(["NN", None]), "gov": gov, "rel": rng.choice("abc")}


@pytest.mark.parametrize("n", [0, 1, 60, 2000])
def test_packets_keep_all_values(n):
    rng = random.Random(n)
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array([rng.choice([None, -(2**63), 2**63 - 1, 5]) for _ in range(n)], pa.int64()),
            pa.array([rng.choice([None, "L", "R"]) for _ in range(n)], pa.string()),
            pa.array([None if rng.random() < 0.1 else [token(rng) for _ in range(rng.randrange(4))] for _ in range(n)], pa.list_(TOKEN)),
            pa.array([rng.random() for _ in range(n)]),
            pa.array([rng.choice([None, True, False]) for _ in range(n)], pa.bool_()),
        ],
        names=list("abcde"),
    )
    for own in (batch, batch.slice(n // 3)):
        again, form = unpack(pack(own, 3), own.schema)
        assert again.to_pylist() == own.to_pylist() and form == 3


@pytest.mark.parametrize("far", [False, True])
def test_governors_come_back(far):
    rng = random.Random(2)
    lists = [None if rng.random() < 0.1 else [token(rng, far) for _ in range(rng.randrange(6))] for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(lists, pa.list_(TOKEN))], names=["k", "tokens"])
    small, form = trees.shrunk_tokens(batch)
    assert form == (not far) and trees.grown_tokens(small, form).to_pylist() == batch.to_pylist()


def test_rows_of_a_key_meet(spark):
    left = spark.range(2000).selectExpr("id % 97 AS k", "id AS v")
    right = spark.range(300).selectExpr("id % 101 AS k", "CAST(id AS string) AS name")

    def made(tables):
        keys = [t.column("k").to_pylist() for t in tables]
        for k in sorted(set(keys[0]) | set(keys[1])):
            yield pa.RecordBatch.from_pylist([{"k": k, "l": keys[0].count(k), "r": keys[1].count(k)}])

    schema = spark.createDataFrame([], "k long, l long, r long").schema
    got = sorted(map(tuple, gathered([Part(left), Part(right)], ["k"], made, schema).collect()))
    assert got == [(k, len(range(k, 2000, 97)) if k < 97 else 0, len(range(k, 300, 101))) for k in range(101)]


def test_numbers_after_the_last_dash(spark):
    words = ["a-1", "a--02", "7", "a-+5", "a-", "-", "a-1x", "x-\t8", "a-12345678901", "a-2147483647", "a-2147483648", "1-b", "é-3", ""]
    phrases = [" ".join(words), "", None, " a-1  b-2 "]
    table = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    want = table.selectExpr("filter(transform(split(phrase, ' '), t -> try_cast(substring_index(t, '-', -1) AS int)), i -> i IS NOT NULL) AS p")
    assert trailing_indices(pa.array(phrases)).to_pylist() == [r.p for r in want.collect()]


def slowly_placed(sents, table, inline):
    """Row by row: every short phrase with every sentence of its side, the long ones of a side together."""
    out = []
    for key in {r[:2] for r in sents if None not in r[:2]}:
        own = sorted((s for s in sents if s[:2] == key), key=lambda s: (s[2] is not None, s[2] or 0))
        phrases = [[int(w.split("-")[-1]) for w in r[2].split(" ") if w] for r in table if r[:2] == key]
        starts = [sum(len(s[3]) for s in own[:i]) for i in range(len(own))]
        forms = [([p], False) for p in phrases if len(p) <= inline]
        if long := [p for p in phrases if len(p) > inline]:
            forms.append((long, True))
        for s, start in zip(own, starts, strict=True):
            for places, wide in forms:
                ords = [None] * len(s[3])
                among = [(x, b) for x, b in zip(own, starts, strict=True) if x[2] == s[2] and s[2] is not None] if wide else [(s, start)]
                for x, begin in among:
                    for phrase in places:
                        for order, place in enumerate(phrase):
                            at = place - begin - 1
                            if 0 <= at < len(x[3]) - 1 and at < len(s[3]) - 1 and s[3][at][1] != "DT":
                                ords[at] = order if ords[at] is None else min(ords[at], order)
                out.append((*s[:3], start, str(ords)))
    return sorted(out, key=str)


@pytest.mark.parametrize("inline", [-1, 4, 256])
def test_repeated_and_missing_keys(spark, inline):
    """each phrase with each sentence of its side, whatever comes twice or is missing."""
    rng = random.Random(3)
    sents, listed = [], []
    for rule in [*range(30), None]:
        for side in ("L", "R", None):
            for number in (None, 0, 1, 1) if rule == 5 else range(rng.randrange(4)):
                tokens = [(f"w{i}", rng.choice(["NN", "VB", "DT"]), 0, "root") for i in range(rng.choice([0, 1, 3, 8]) if rule != 5 else 6)]
                sents += [(rule, side, number, tokens)] * (2 if rule in (3, 4) else 1)
            for _ in range(rng.choice([0, 1, 1, 2])):
                listed.append((rule, side, " ".join(f"a-{rng.randint(-1, 25)}" .replace("--", "-") for _ in range(rng.choice([0, 2, 9])))))
    same = {r: t for r in (5,) for t in [next(s[3] for s in sents if s[0] == 5)]}
    sents = [(*s[:3], same.get(s[0], s[3])) for s in sents]
    placed = trees.phrase_sentences(spark.createDataFrame(listed, RULES), spark.createDataFrame(sents, SENTENCES), inline_places=inline)
    got = sorted(((r.rule_id, r.side, r.sent_no, r.offset, str(r.ords)) for r in placed.collect()), key=str)
    assert got == slowly_placed(sents, listed, inline) and len(got) > 40


def test_sentences_are_shuffled_once(spark):
    """one shuffle for placing and for nodes, no join, no window, and nothing written."""
    sents = spark.createDataFrame([(1, "L", 0, [("a", "NN", 0, "root")] * 3)], SENTENCES)
    table = spark.createDataFrame([(1, "L", "a-1 a-2")], RULES)
    before = len(session._staged)
    placed = trees.phrase_sentences(table, sents, inline_places=1)
    for found in (trees.rule_tokens(placed), trees.highest_nodes(placed), trees.phrase_nodes(placed, together=True)):
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert "Join" not in plan and "Window" not in plan and plan.count("Exchange") == 1
        assert found.count() > 0
    assert len(session._staged) == before


def test_texts_of_nodes_that_stand_together(spark):
    """the same texts, with no node shuffled."""
    rng = random.Random(9)
    sents, listed = [], []
    for rule in range(60):
        for side in "LR":
            for number in range(3):
                tokens = [(rng.choice("abcd"), rng.choice(["NN", "VB", "JJ", "IN", "RB"]), rng.randrange(i + 1), rng.choice(["amod", "nsubj", "dobj", "prep", "acomp"])) for i in range(9)]
                sents.append((rule, side, number, tokens))
            listed.append((rule, side, " ".join(f"w-{i}" for i in range(1, 28)) if rule % 7 else ""))
    table = spark.createDataFrame(listed, RULES)
    placed = trees.phrase_sentences(table, spark.createDataFrame(sents, SENTENCES))
    want = trees.expression_texts(table, trees.phrase_nodes(placed))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for size in ("3", before):
            spark.conf.set(key, size)
            got = trees.expression_texts(table, trees.phrase_nodes(placed, together=True), together=True)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    finally:
        spark.conf.set(key, before)
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()


def composition(spark, twice=False):
    rng = random.Random(4)
    sents, listed = [], []
    for rule in range(50):
        for side in "LR":
            for number in range(2):
                tokens = [(rng.choice("abcdx" if rule % 5 else "x"), rng.choice(["NN", "VB", "JJ", "IN", "RB"]), rng.randrange(i + 1), rng.choice(["amod", "nsubj", "dobj", "prep", "acomp"])) for i in range(7)]
                sents += [(rule, side, number, tokens)] * (2 if twice and rule % 10 == 3 else 1)
            listed.append((rule, side, " ".join(f"w-{i}" for i in range(1, 15)) if rule % 7 or side == "L" else ""))
    table = spark.createDataFrame(listed, RULES)
    terms = [f"{w}-{t}" for w in "abcd" for t in ("nn", "vb", "jj", "in", "rb")]
    words = [(t, [rng.gauss(0, 1) for _ in range(3)]) for t in terms]
    mats = [(t, label, [[rng.gauss(0, 1) for _ in range(3)] for _ in range(3)]) for t in terms for label in ("amod", "nsubj", "dobj", "acomp") if rng.random() < 0.9]
    placed = trees.phrase_sentences(table, spark.createDataFrame(sents, SENTENCES))
    return table, placed, spark.createDataFrame(words, "term string, vec array<double>"), spark.createDataFrame(mats, "word string, label string, mat array<array<double>>")


@pytest.mark.parametrize("twice", [False, True])
def test_rules_are_scored_where_they_stand(spark, twice):
    """F1, F2, F8: composed and matched without a shuffle of nodes or vectors, with the same scores."""
    table, placed, words, mats = composition(spark, twice)
    shuffled = compose.compose(trees.phrase_nodes(placed), words, mats)
    want = rules.rule_scores(table, session.cut_lineage(shuffled))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for size in ("4", before):
            spark.conf.set(key, size)
            parts = compose.composed(trees.phrase_nodes(placed, together=True), words, mats, together=True)
            assert [together for _, together in parts] == ([True, False] if twice else [True])
            got = rules.rule_scores(table, parts)
            assert scored(got) == scored(want)
            plan = parts[0][0]._jdf.queryExecution().sparkPlan().toString()
            assert "Exchange" not in plan
            vectors = [(r.rule_id, r.side, r.frag, r.status, r.vec and [round(x, 9) for x in r.vec]) for part, _ in parts for r in part.collect()]
            other = [(r.rule_id, r.side, r.frag, r.status, r.vec and [round(x, 9) for x in r.vec]) for r in shuffled.collect()]
            assert sorted(map(str, vectors)) == sorted(map(str, other))
    finally:
        spark.conf.set(key, before)
    assert {r.status for r in want.collect()} == {"failed", "no_vector", "scored"}


def scored(rows):
    return sorted(
        (r.rule_id, r.status, r.mean_sim and round(r.mean_sim, 9), r.matches and [(m.place, round(m.sim, 9), m.l_frag, m.r_frag) for m in r.matches])
        for r in rows.collect()
    )


def shuffles(df):
    return df._jdf.queryExecution().sparkPlan().toString().count("Exchange")


def test_contexts_are_counted_before_they_are_shuffled(spark, monkeypatch):
    """one row for each phrase of a task, not one for each of its context words."""
    monkeypatch.setattr(phrases, "CONTEXTS_HELD", 50)
    rng = random.Random(8)
    rows = [(rng.choice(["amod", None]), rng.choice("abc"), rng.choice("xyé"), [rng.choice("pqrs") for _ in range(rng.randrange(5))] or None) for _ in range(400)]
    df = spark.createDataFrame(rows, "label string, w1 string, w2 string, ctx array<string>").repartition(3)
    counts = phrases.context_counts(df)
    want = Counter((*r[:3], c) for r in rows for c in r[3] or [])
    assert sorted(map(str, map(tuple, counts.collect()))) == sorted(str((*k, n)) for k, n in want.items())
    assert counts.columns == ["label", "w1", "w2", "ctx", "n"]
    plan = counts._jdf.queryExecution().sparkPlan().toString()
    assert shuffles(counts) - shuffles(df) == 1 and "Aggregate" not in plan and "Generate" not in plan
    assert phrases.context_counts(df.limit(0)).count() == 0


@pytest.mark.parametrize("far", [0, 1 << 40])
def test_pairs_are_counted_before_they_are_shuffled(spark, monkeypatch, far):
    """pairs are numbers that a task counts; pieces of long lines own their first items only."""
    monkeypatch.setattr(cooc, "PAIR_CELLS", 40)
    rng = random.Random(5)
    rows = [(rng.randrange(7), [rng.randrange(6) + far for _ in range(rng.randrange(9))]) for _ in range(90)]
    counts = cooc.plain_index_pair_counts(spark.createDataFrame(rows, "own int, items array<bigint>"), 3)
    want = Counter(tuple(sorted((x[i], x[i + d]))) for own, x in rows for d in (1, 2, 3) for i in range(min(own, len(x) - d)))
    assert sorted(map(tuple, counts.collect())) == sorted((*k, n) for k, n in want.items())
    plan = counts._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" not in plan and "Generate" not in plan and plan.count("Exchange") == 1


def test_segments_are_packed(spark):
    """cells go packed to their segment, sorted there."""
    rng = random.Random(6)
    rows = [(rng.choice([None, *range(9)]), i % 40, rng.choice([1.5, 0.123457, float("nan"), -0.0, 1 / 3, None])) for i in range(600)]
    cells = spark.createDataFrame(rows, "o bigint, i bigint, val double")
    got = matrix.segments(cells, "o", "i", 16)
    assert "Aggregate" not in got._jdf.queryExecution().sparkPlan().toString()
    found = {(r.o, r.segment): [(e.inner, str(e.val)) for e in r.entries] for r in got.collect()}
    want = {}
    for o, i, val in rows:
        want.setdefault((o, i // 16), []).append((i, str(val)))
    assert found.keys() == want.keys() and all([x for x, _ in v] == sorted(x for x, _ in v) for v in found.values())
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
