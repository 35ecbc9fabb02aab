"""Parsed lines decoded in batches, against the column functions."""

import random

from pyspark.sql import functions as F

from lexweave.functions import tokens as tk
from lexweave.sources import corpus, observed

ODD = [
    None, "", " ", "\t#DEP#\t", "a/nn", "Dog/NNS King/NN xİ/nn /nn a/ a//nn a/nn/vb 3/nn dog/nnxé",
    "a/nn\nb c/vb\r\n d/jj  e/in\u0085f g/rb\r", "a/nn\t#DEP#\tamod-0-0 amod-00-7\n nsubj-1\r-2 dobj-2147483647-2147483648 pobj-1-9 ",
    "a/nn b/vb\t#DEP#\tamod-1-0  -1-0 AMOD-1-0 acomp-x-1-0 nsubj--1 dobj-+1-0 amod-0-1-\t#DEP#\tamod-0-1", "a/nn\t#dep#\tamod-0-0",
    "a/nn\t#DEP#\tamod-0-" + "0" * 5000 + "1 amod-0-" + "9" * 5000,
]


def some_lines(spark):
    rng = random.Random(11)
    words = ["dog/NN", "runs/VBZ", "the/DT", "3rd/JJ", "", "a/nn/vb", "of/IN", "Red/jj"]
    edges = ["amod-1-0", "bad", "", "nsubj-x-10-2", "det-0-1", "dobj-1", "pobj-0-3", "acomp-2-a"]
    made = [" ".join(rng.choices(words, k=rng.randrange(9))) + "\t#DEP#\t" + " ".join(rng.choices(edges, k=rng.randrange(9))) for _ in range(300)]
    return spark.createDataFrame([(i, None, t) for i, t in enumerate(ODD + made)], "doc_id long, line_no int, text string")


def test_decoding_equals_the_column_functions(spark):
    lines = some_lines(spark)
    got = corpus.parse_lines(lines)
    want = lines.select("doc_id", "line_no", tk.parsed_terms(F.col("text")).alias("terms"), tk.parsed_edges(F.col("text")).alias("edges"))
    assert got.dtypes == want.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_no_token_by_token_lambdas(spark):
    """Tokens and edges are decoded for whole batches."""
    plan = corpus.parse_lines(some_lines(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan


def test_seen_and_kept(spark):
    lines = some_lines(spark)
    table, seen = observed.parse_observed(lines)
    rows = table.collect()
    terms = [r.terms or [] for r in rows]
    raw = [(r.text or "").split("\t#DEP#\t")[1:2] for r in lines.collect()]
    usable = [e for t, r in zip(terms, rows, strict=True) for e in r.edges if all(i < len(t) and t[i] for i in (e.gov, e.dep))]
    assert table.columns == ["doc_id", "line_no", "terms", "edges"]
    assert seen == {
        "tokens": sum(map(len, terms)), "tokens_kept": sum(x is not None for t in terms for x in t),
        "edges": sum(e != "" for part in raw for p in part for e in p.split(" ")), "edges_kept": len(usable),
    }
