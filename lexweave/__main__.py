"""Command line: ``python -m lexweave <job> ...`` or ``spark-submit`` with this module.

Jobs write parquet tables below ``--out`` and later jobs read them from there.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexweave.operators import cooc, matrix, ridge, rules, trees, vocab
from lexweave.plans.phrases import build_phrases
from lexweave.plans.score import decompose, score
from lexweave.plans.train import build_space, train
from lexweave.plans.words import TaggedWords, plain_words, tagged_words
from lexweave.session import cut_lineage, get_session, remove_staged
from lexweave.sources import corpus, text_formats
from lexweave.sources.sinks import comparison, read_table, write_scores, write_table


def plain(spark: SparkSession, args: argparse.Namespace) -> None:
    lines = corpus.read_text_lines(spark, args.input, args.partitions)
    job = plain_words(lines, args.window, args.min_count, keep_empty=args.keep_empty)
    write_table(job.vocab, args.out, "vocabulary")
    write_table(job.ppmi(), args.out, "pmi")


def similarity(spark: SparkSession, args: argparse.Namespace) -> None:
    """Cosine of given word pairs over the plain matrix."""
    loaded = cut_lineage(matrix.load_symmetric(read_table(spark, args.out, "pmi")))
    pairs = spark.read.csv(args.input, sep="\t", schema="w1 string, w2 string")
    words = read_table(spark, args.out, "vocabulary")
    write_table(matrix.word_cosine(pairs, loaded, words), args.out, "similarity")


def words(spark: SparkSession, args: argparse.Namespace) -> None:
    parsed = corpus.parse_lines(corpus.read_text_lines(spark, args.input, args.partitions))
    job = tagged_words(parsed, args.window, args.vocab_size, args.dim)
    write_table(vocab.tagged_total(job.parsed), args.out, "word_total")
    write_table(job.vocab, args.out, "words")
    write_table(job.ppmi(), args.out, "word_pmi")


def phrases(spark: SparkSession, args: argparse.Namespace) -> None:
    """All five labels at once, over the vocabulary of the word job."""
    parsed = cut_lineage(corpus.parse_lines(corpus.read_text_lines(spark, args.input, args.partitions)))
    known = vocab.frequency_vocab(
        read_table(spark, args.out, "words").select("term", "cnt"), args.vocab_size
    )
    job = TaggedWords(parsed, cut_lineage(known), min(args.dim, args.vocab_size), args.window)
    total = read_table(spark, args.out, "word_total").first()["total"]
    built = build_phrases(job, args.window, args.min_count, word_total=total)
    write_table(built.vocab, args.out, "phrases", ("label",))
    write_table(built.ppmi(), args.out, "phrase_pmi", ("label",))


def train_job(spark: SparkSession, args: argparse.Namespace) -> None:
    known = read_table(spark, args.out, "words")
    space = build_space(read_table(spark, args.out, "word_pmi"), known, args.rank, args.weight, args.seed)
    kept = read_table(spark, args.out, "phrases")
    listed = (
        text_formats.read_training_list(spark, args.train_list)
        if args.train_list
        else ridge.training_list(kept, args.min_phrases)
    )
    trained = train(kept, read_table(spark, args.out, "phrase_pmi"), space, listed, args.weight)
    write_table(space.word_vectors, args.out, "word_vectors")
    write_table(trained.modifiers, args.out, "modifiers", ("label",))


def decompose_job(spark: SparkSession, args: argparse.Namespace) -> None:
    """``--input`` holds the rule file, ``--sentences`` its sentences as a parquet table."""
    table = text_formats.read_rules(spark, args.input)
    nodes, texts = decompose(table, spark.read.parquet(args.sentences), args.include_last)
    write_table(nodes, args.out, "nodes")
    written = write_table(texts, args.out, "expressions")
    write_table(comparison(table, written), args.out, "comparison")


def score_job(spark: SparkSession, args: argparse.Namespace) -> None:
    """Scores the decomposed rules, or the expression-pair file given as ``--input``."""
    if args.input:
        pairs = rules.split_pairs(text_formats.read_phrase_pairs(spark, args.input))
        nodes = cut_lineage(rules.nodes_from_text(pairs))
        table = pairs.select("rule_id", "side")
        texts = rules.split_fragments(pairs)
    else:
        nodes = read_table(spark, args.out, "nodes")
        table = read_table(spark, args.out, "expressions")
        texts = trees.fragment_texts(nodes)
    scores, fragments = score(
        table,
        nodes,
        read_table(spark, args.out, "word_vectors"),
        read_table(spark, args.out, "modifiers"),
    )
    write_scores(cut_lineage(scores), texts, fragments, args.out)


JOBS = {
    "plain": plain,
    "similarity": similarity,
    "words": words,
    "phrases": phrases,
    "train": train_job,
    "decompose": decompose_job,
    "score": score_job,
}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lexweave", description=__doc__)
    parser.add_argument("job", choices=sorted(JOBS))
    parser.add_argument("--input")
    parser.add_argument("--out", required=True)
    parser.add_argument("--window", type=int, default=cooc.WINDOW)
    parser.add_argument("--min-count", type=int)
    parser.add_argument("--partitions", type=int, help="deal the input over so many partitions")
    parser.add_argument("--keep-empty", action="store_true", help="plain job: empty tokens count")
    parser.add_argument("--include-last", action="store_true", help="last tokens may be phrase words")
    parser.add_argument("--vocab-size", type=int, default=vocab.VOCAB_SIZE)
    parser.add_argument("--dim", type=int, default=vocab.VOCAB_SIZE)
    parser.add_argument("--rank", type=int, default=300)
    parser.add_argument("--weight", choices=["binary", "ppmi"], default="binary")
    parser.add_argument("--seed", type=int, default=0)
    parser.add_argument("--train-list", help="prefix of the five training list files")
    parser.add_argument("--min-phrases", type=int, default=3)
    parser.add_argument("--sentences", help="(rule_id, side, sent_no, tokens) parquet table")
    args = parser.parse_args(argv)
    if args.min_count is None:
        args.min_count = vocab.PHRASE_MIN_COUNT if args.job == "phrases" else vocab.PLAIN_MIN_COUNT
    spark = SparkSession.getActiveSession() or get_session()
    context = spark.sparkContext
    if context.getCheckpointDir() is None and not spark.conf.get("spark.checkpoint.dir", None):
        context.setCheckpointDir(f"{args.out}/_scratch")
    try:
        JOBS[args.job](spark, args)
    finally:
        remove_staged(spark)


if __name__ == "__main__":
    main()
