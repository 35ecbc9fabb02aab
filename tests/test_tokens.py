from pyspark.sql import functions as F

from lexweave.functions import tokens as tk
from lexweave.functions.arrays import dense_by_key
from lexweave.sources import corpus


def test_plain_tokens(spark):
    rows = spark.createDataFrame([("A b  a",), ("",), ("  ",), ("x ",)], "text string")
    got = rows.select(
        tk.plain_tokens(F.col("text")).alias("t"), tk.plain_tokens(F.col("text"), True).alias("k")
    ).collect()
    assert [r.t for r in got] == [["a", "b", "a"], [], [], ["x"]]
    # Inner empty tokens stay, trailing ones go, a blank line is one empty token.
    assert [r.k for r in got] == [["a", "b", "", "a"], [""], [], ["x"]]


def test_tagged_terms_keep_positions(spark):
    line = "Dog/NNS runs/VBZ the/DT 3rd/JJ a/nn/vb noslash  of/IN x/v\t#DEP#\tamod-0-1"
    rows = spark.createDataFrame([(0, 0, line)], "doc_id long, line_no int, text string")
    terms = corpus.parse_lines(rows).first().terms
    assert terms == ["dog-nn", "runs-vb", None, None, None, None, None, "of-in", None]
    assert corpus.token_rows(rows).where("term is not null").count() == 3


def test_edges(spark):
    lines = [
        "a/nn\t#DEP#\tamod-1-0 Amod-1-0 nsubj-x-10-2 prep-1-2 dobj-1 pobj-a-b acomp-3-4",
        "a/nn",
        "a/nn\t#DEP#\t",
    ]
    rows = spark.createDataFrame(
        [(i, 0, t) for i, t in enumerate(lines)], "doc_id long, line_no int, text string"
    )
    got = {(r.doc_id, r.label, r.gov, r.dep) for r in corpus.edge_rows(rows).collect()}
    assert got == {(0, "amod", 1, 0), (0, "nsubj", 10, 2), (0, "acomp", 3, 4)}


def test_dense_by_key(spark):
    rows = spark.createDataFrame(
        [([(3, 7), (1, 5), (3, 2)], 4), ([], 2), ([(1, 9)], 1), ([], 0)],
        "e array<struct<key:int,val:int>>, n int",
    )
    got = [r.d for r in rows.select(dense_by_key(F.col("e"), F.col("n")).alias("d")).collect()]
    assert got == [[5, None, 2, None], [None, None], [9], []]
