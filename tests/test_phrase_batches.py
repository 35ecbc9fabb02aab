"""Phrases and their contexts of whole batches, against one edge at a time."""

import random

import pytest

from lexweave.operators import phrases
from lexweave.sources import corpus, standin
from test_counts import PARSED

LABELS = ["amod", "nsubj", "dobj", "pobj", "acomp"]


def slow_contexts(terms, gov, dep, window):
    valid = [i for i, t in enumerate(terms) if t]
    low, high = sorted((valid.index(gov), valid.index(dep)))
    inner = valid[low + 1 : high]
    places = valid[max(low - window, 0) : low] + valid[high + 1 : high + 1 + window] + inner[:window] + inner[window:][-window:]
    return sorted(terms[i] for i in places)


@pytest.mark.parametrize("window", [None, 1, 3])
def test_phrases_of_any_edges(spark, window):
    rng = random.Random(3)
    rows = [(1, 0, None, [("amod", 0, 1)]), (2, 0, ["a-nn", "b-nn"], None), (None, None, ["a-nn", "b-nn"], [("amod", 0, 1), None]), (3, 0, [], [])]
    for i in range(200):
        terms = [rng.choice([None, f"w{j}-nn"]) for j in range(rng.randrange(16))]
        edges = [(rng.choice(LABELS), rng.randrange(-1, 18), rng.randrange(-1, 18)) for _ in range(rng.randrange(20))]
        rows.append((10 + i, 0, terms, edges))
    want = []
    for doc, line, terms, edges in rows:
        for label, gov, dep in filter(None, edges or []):
            if terms and 0 <= gov < len(terms) and 0 <= dep < len(terms) and terms[gov] and terms[dep]:
                first, second = (dep, gov) if label in ("amod", "nsubj") else (gov, dep)
                found = (doc, line, label, terms[first], terms[second])
                want.append(found if window is None else (*found, slow_contexts(terms, gov, dep, window)))
    got = phrases.phrase_rows(spark.createDataFrame(rows, PARSED), window).collect()
    got = [tuple(r) if window is None else (*r[:5], sorted(r.ctx)) for r in got]
    assert len(want) > 50 and sorted(got, key=str) == sorted(want, key=str)


def test_no_edge_by_edge_lambdas(spark):
    """The parsed text, the phrases and their contexts are made for whole batches."""
    lines = spark.createDataFrame([(1, 0, "the dog sees a red cat"), (2, 0, None), (3, 0, "")], "doc_id bigint, line_no int, text string")
    text = standin.parsed_text(lines)
    parsed = spark.createDataFrame(corpus.parse_lines(text).collect(), PARSED)
    for df in (text, phrases.phrase_rows(parsed, 3)):
        assert "lambdafunction" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [r.text for r in text.orderBy("doc_id").collect()][1:] == [None, "/--\t#DEP#\t"]
