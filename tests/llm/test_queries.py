"""Registered queries: names, whole tables, and the pipeline's stages."""

import __spark_entry__ as entry
import corpus_pipeline
from lexweave.llm import queries

SF = "/root/testdata/sf0.001"


def test_every_operator_has_its_query():
    names = [q.__name__ for q in queries.QUERIES]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(names) | {"pipeline"} <= set(entry.queries())
    assert set(queries.ORACLES) <= set(names)


def test_documents_queries_return_every_row(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for query in queries.QUERIES:
        if query.__name__.split("_")[0] in ("op1", "op2", "op5", "op6", "op8", "op9", "op10", "op12", "op13"):
            assert query(spark, SF).select("doc_id").count() == n, query.__name__


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, "", "", "", 0), (10**9, "", "", "", 0)], docs.schema)
    docs = docs.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert 0 < packed.select("doc_id").distinct().count() <= before + 2
    empty = spark.createDataFrame([], spark.read.parquet(f"{SF}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
