"""Text forms, the command line end to end, and the registered queries."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lexweave.__main__ import main
from lexweave.sources import text_formats
from lexweave.sources.sinks import write_text_forms

SMALL = "/root/testdata/sf0.001"


def test_text_forms(spark, tmp_path):
    counts = spark.createDataFrame([("a-nn", 3, 0), ("b-vb", 2, 1), ("c-jj", 1, 2)], "term string, cnt long, idx long")
    coo = spark.createDataFrame([(0, 1, 0.5), (2, 0, 1.25)], "col long, row long, val double")
    write_text_forms(counts.select("term", "cnt"), counts, coo, str(tmp_path))
    read = text_formats.read_counts(spark, f"{tmp_path}/wordcounts")
    assert sorted(map(tuple, read.collect())) == [("a-nn", 3), ("b-vb", 2), ("c-jj", 1)]
    words = text_formats.read_vocabulary(spark, f"{tmp_path}/wordvocab")
    assert {r.term: r.idx for r in words.collect()} == {"a-nn": 0, "b-vb": 1, "c-jj": 2}
    cells = text_formats.read_triplets(spark, f"{tmp_path}/wordpmi")
    assert sorted(map(tuple, cells.collect())) == [(0, 1, 0.5), (2, 0, 1.25)]


def test_line_numbers_run_over_files_by_name(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    want = []
    for k in range(5):
        lines = [f"f{k}-{i}" for i in range(k * 7 + 1)]
        (folder / f"part-{k:05d}").write_text("\n".join(lines) + "\n")
        want += lines
    got = text_formats.numbered_lines(spark, str(folder)).orderBy("idx").collect()
    assert [r.value for r in got] == want and [r.idx for r in got] == list(range(len(want)))


def test_rule_and_training_files(spark, tmp_path):
    fields = ["[r1]", "a-1 b-2", "c-1", *"345678", "A b .", "C d ."]
    (tmp_path / "rules.tsv").write_text("header\n" + "\t".join(fields) + "\n")
    got = {r.side: r for r in text_formats.read_rules(spark, str(tmp_path / "rules.tsv")).collect()}
    assert (got["L"].rule_id, got["L"].rule, got["L"].phrase, got["L"].sentence) == (1, "r1", "a-1 b-2", "A b .")
    assert (got["R"].phrase, got["R"].sentence) == ("c-1", "C d .")
    for label in ("amod", "nsubj", "dobj", "pobj", "acomp"):
        (tmp_path / f"list-{label}").write_text(f"w{label}\t12\nplain\n")
    listed = text_formats.read_training_list(spark, f"{tmp_path}/list-")
    assert listed.count() == 10 and listed.where("label = 'amod' and word = 'wamod'").count() == 1


def test_command_line(spark, tmp_path):
    rng = random.Random(3)
    nouns, verbs, adjs = [[f"{c}{x}" for x in "abcdef"] for c in ("n", "v", "j")]
    lines = []
    for _ in range(300):
        a, n, v, m = rng.choice(adjs), rng.choice(nouns), rng.choice(verbs), rng.choice(nouns)
        lines.append(f"{a}/JJ {n}/NN {v}/VBZ {m}/NN\t#DEP#\tamod-1-0 nsubj-2-1 dobj-2-3")
    corpus = tmp_path / "parsed.txt"
    corpus.write_text("\n".join(lines) + "\n")
    out = str(tmp_path / "out")
    base = ["--out", out, "--vocab-size", "30", "--dim", "30"]
    main(["words", "--input", str(corpus), *base])
    main(["phrases", "--input", str(corpus), "--min-count", "3", *base])
    main(["train", "--rank", "5", *base])
    assert spark.read.parquet(f"{out}/word_total").first().total == 1200
    assert spark.read.parquet(f"{out}/modifiers").where("label = 'amod'").count() > 0

    tree = [("ja", "JJ", 2, "amod"), ("na", "NN", 3, "nsubj"), ("va", "VBZ", 0, "root"), ("nb", "NN", 3, "dobj"), (".", ".", 3, "p")]
    tokens = "tokens array<struct<lemma:string,tag:string,gov:int,rel:string>>"
    spark.createDataFrame(
        [(1, s, 0, tree) for s in "LR"], f"rule_id long, side string, sent_no int, {tokens}"
    ).write.parquet(str(tmp_path / "sents"))
    fields = ["[r]", "x-1 x-2", "x-1 x-2 x-3 x-4", *"345678", "s", "t"]
    (tmp_path / "rules.tsv").write_text("h\n" + "\t".join(fields) + "\n")
    main(["decompose", "--input", str(tmp_path / "rules.tsv"), "--sentences", str(tmp_path / "sents"), *base])
    shown = spark.read.parquet(f"{out}/comparison").first()
    assert shown.l_text == "1 = ja-jj amod-#1# na-nn #1#"
    main(["score", *base])
    first = spark.read.parquet(f"{out}/scores").first()
    assert first.status == "scored" and 0 <= first.mean_sim <= 1
    assert spark.read.parquet(f"{out}/matched").count() == 2

    pairs = tmp_path / "pairs.txt"
    pairs.write_text(f"{shown.l_text}\t\t{shown.r_text}\n")
    main(["score", "--input", str(pairs), *base])
    again = spark.read.parquet(f"{out}/scores").first()
    assert abs(again.mean_sim - first.mean_sim) < 1e-9

    plain = tmp_path / "plain.txt"
    plain.write_text("\n".join("a b c a" for _ in range(12)) + "\n")
    main(["plain", "--input", str(plain), "--out", out])
    asked = tmp_path / "asked.tsv"
    asked.write_text("a\tb\na\tzz\n")
    main(["similarity", "--input", str(asked), "--out", out])
    got = {r.w2: r.cosine for r in spark.read.parquet(f"{out}/similarity").collect()}
    assert got["zz"] == -1.0 and set(got) == {"b", "zz"}


def test_registration():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names
    # Only results without a closed SQL form go without a statement.
    own = {q.__name__ for q in entry.QUERIES}
    assert own - set(entry.oracle_sql()) == {"rule_scores"}


@pytest.mark.parametrize("name", ["ppmi_plain", "ppmi_words", "ppmi_phrases", "phrase_nodes", "gcv_lambda", "greedy_match"])
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    got = entry.queries()[name](spark, SMALL)
    want = db.sql(entry.oracle_sql()[name]).to_arrow_table()
    columns = sorted(got.columns)
    assert columns == sorted(want.column_names)
    rows = [tuple(r) for r in got.select(columns).collect()]
    text = lambda row: tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in row)
    assert sorted(map(text, rows)) == sorted(text(tuple(r[c] for c in columns)) for r in want.to_pylist())


def test_entry(spark):
    top = entry.entry(spark).limit(3).collect()
    assert len(top) == 3 and top[0].val >= top[1].val >= top[2].val


def test_missing_shared_folder_is_an_error_on_a_cluster():
    from types import SimpleNamespace

    from lexweave import session

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="yarn")
    spark = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(spark)
    assert session.is_local("local[4]") and not session.is_local("local-cluster[2,1,512]")


def test_staged_tables_go_at_the_end(spark, tmp_path):
    import os

    from lexweave import session

    folder = session.shared_dir(spark).removeprefix("file:")
    session.cut_lineage(spark.range(3))
    assert any(n.startswith("staged-") for n in os.listdir(folder))
    session.remove_staged(spark)
    assert not any(n.startswith("staged-") for n in os.listdir(folder))
