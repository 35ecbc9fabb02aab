"""Shared inputs are computed once, and what one task holds does not grow with the table."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lexweave.functions import tokens as tk
from lexweave.operators import cooc, store, trees
from lexweave.plans.words import plain_words
from lexweave.scale import lookup_join
from lexweave.sources import corpus, standin


def watched(df):
    """``df`` and the number of its rows that were computed so far."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema), seen


def documents(spark, n=40):
    text = F.concat_ws("\n", *[F.concat_ws(" ", *[F.concat(F.lit("w"), F.chr(97 + (F.col("id") * k + j) % 26)) for k in range(9)]) for j in range(5)])
    return spark.range(n, numPartitions=2).select(F.col("id").alias("doc_id"), text.alias("text"))


def test_totals_read_the_corpus_twice(spark, monkeypatch):
    """once for the plain words, once for the parsed ones."""
    lines, seen = watched(corpus.lines_of(documents(spark)))
    monkeypatch.setattr(entry, "_lines", lambda *_: lines)
    totals = {r.kind: r.total for r in entry.corpus_totals(spark, "").collect()}
    assert totals["plain_words"] == 40 * 5 * 9
    assert seen.value == 2 * 40 * 5


def test_plain_words_read_the_lines_once(spark):
    """F6 to F10."""
    lines, seen = watched(corpus.lines_of(documents(spark)))
    assert plain_words(lines).ppmi().count() > 0
    assert seen.value == 40 * 5


def test_lookups_compute_their_facts_once(spark):
    facts, seen = watched(spark.range(100).select((F.col("id") % 7).alias("a"), (F.col("id") % 5).alias("b"), "id"))
    names = spark.range(7).select(F.col("id").alias("a"), (F.col("id") * 2).alias("x"))
    other = spark.range(5).select(F.col("id").alias("b"), (F.col("id") * 3).alias("y"))
    both = lookup_join(lookup_join(facts, names, ["a"], ["id"], max_broadcast_rows=0), other, ["b"], ["id"], max_broadcast_rows=0)
    got = {(r.id, r.x, r.y) for r in both.collect()}
    assert got == {(i, i % 7 * 2, i % 5 * 3) for i in range(100)}
    assert seen.value == 100


@pytest.mark.parametrize("inline_places", [-1, 4, 256])
def test_sentences_and_phrases_are_read_once(spark, inline_places):
    """whatever part of the phrases is placed by ranges."""
    docs = documents(spark)
    sentences, seen = watched(standin.rule_sentences(docs))
    rules, asked = watched(standin.rule_phrases(docs))
    n = sentences.count(), rules.count()
    before = seen.value, asked.value
    assert trees.rule_tokens(trees.phrase_sentences(rules, sentences, inline_places=inline_places)).count() > 0
    assert (seen.value - before[0], asked.value - before[1]) == n


def test_large_tables_are_dealt_over_more_partitions(spark, tmp_path, monkeypatch):
    """A partition for so many stored bytes, and never fewer than were asked for."""
    documents(spark).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus.documents(spark, str(tmp_path), 2).rdd.getNumPartitions() == 2
    size = corpus.stored_bytes(spark, str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(corpus, "DEALT_BYTES", size // 6)
    dealt = corpus.documents(spark, str(tmp_path), 2)
    assert 6 <= dealt.rdd.getNumPartitions() <= 7
    assert dealt.count() == 40


def test_buckets_follow_the_corpus(spark, tmp_path, monkeypatch):
    """buckets of saved counts grow with the table, so that none of them does."""
    documents(spark).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    assert entry._buckets(spark, str(tmp_path)) == store.BUCKETS
    size = corpus.stored_bytes(spark, str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(corpus, "DEALT_BYTES", max(1, size // (2 * store.BUCKETS)))
    assert entry._buckets(spark, str(tmp_path)) >= 2 * store.BUCKETS
    merged = entry.pairs_merged(spark, str(tmp_path))
    counted = cooc.tagged_pair_counts(corpus.parse_lines(standin.parsed_text(corpus.lines_of(documents(spark)))))
    assert sorted(map(tuple, merged.select("a", "b", "n").collect())) == sorted(map(tuple, counted.collect()))


def test_decoding_keeps_its_forms(spark):
    lines = ["Dog/NNS runs/VBZ the/DT 3rd/JJ a/nn/vb x/ /nn noslash\t#DEP#\tamod-1-0 bad a-b-c x-1 dobj-0-1-2  nsubj-1-", "", "a/nn"]
    df = spark.createDataFrame([(t,) for t in lines], "text string").select(
        tk.parsed_terms(F.col("text")).alias("terms"), tk.parsed_edges(F.col("text")).alias("edges")
    )
    rows = df.collect()
    assert rows[0].terms == ["dog-nn", "runs-vb"] + [None] * 6
    assert [tuple(e) for e in rows[0].edges] == [("amod", 1, 0), ("dobj", 1, 2)]
    assert (rows[1].terms, rows[2].terms) == ([None], ["a-nn"])
