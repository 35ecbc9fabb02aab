"""Text forms of the tables: counts, vocabularies, triplets, training lists, rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.tokens import PHRASE_LABELS
from lexweave.scale import sorted_index


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(idx, value)``: 0-based line number over the files of ``path`` in name order."""
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_name").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )
    return sorted_index(lines, ["_file", "_block", "_row"]).select("idx", "value")


def parse_counts(lines: DataFrame) -> DataFrame:
    """``(term, cnt)`` from ``(term,cnt)`` lines."""
    inner = F.expr("substring(value, 2, length(value) - 2)")
    return lines.select(
        F.split_part(inner, F.lit(","), F.lit(1)).alias("term"),
        F.split_part(inner, F.lit(","), F.lit(2)).try_cast("bigint").alias("cnt"),
    )


def format_counts(counts: DataFrame) -> DataFrame:
    return counts.select(
        F.concat(F.lit("("), "term", F.lit(","), F.col("cnt").cast("string"), F.lit(")")).alias("value")
    )


def parse_triplets(lines: DataFrame) -> DataFrame:
    """``(col, row, val)`` from ``(col<TAB>row,val)`` lines."""
    inner = F.expr("substring(value, 2, length(value) - 2)")
    pair = F.split_part(inner, F.lit(","), F.lit(1))
    return lines.select(
        F.split_part(pair, F.lit("\t"), F.lit(1)).try_cast("bigint").alias("col"),
        F.split_part(pair, F.lit("\t"), F.lit(2)).try_cast("bigint").alias("row"),
        F.split_part(inner, F.lit(","), F.lit(2)).try_cast("double").alias("val"),
    )


def format_triplets(coo: DataFrame) -> DataFrame:
    cell = F.concat_ws("\t", F.col("col").cast("string"), F.col("row").cast("string"))
    return coo.select(
        F.concat(F.lit("("), cell, F.lit(","), F.col("val").cast("string"), F.lit(")")).alias("value")
    )


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    return parse_counts(spark.read.text(path))


def read_triplets(spark: SparkSession, path: str) -> DataFrame:
    return parse_triplets(spark.read.text(path))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``(term, idx)``: the line number is the index."""
    return numbered_lines(spark, path).select(F.col("value").alias("term"), "idx")


def first_field(value: Column) -> Column:
    """Text before the first tab."""
    return F.split_part(value, F.lit("\t"), F.lit(1))


def read_training_list(spark: SparkSession, prefix: str) -> DataFrame:
    """``(label, word)`` from one text file per label, named ``prefix`` + label."""
    parts = [
        spark.read.text(f"{prefix}{label}").select(
            F.lit(label).alias("label"), first_field(F.col("value")).alias("word")
        )
        for label in PHRASE_LABELS
    ]
    return reduce(DataFrame.unionByName, parts)


def rule_columns(fields: DataFrame) -> DataFrame:
    """``(rule_id, rule, side, phrase, sentence)`` from ``(rule_id, f array<string>)``.

    Field 0 is the rule's name between two marks, 1 and 2 are the phrases, 9 and 10 the
    sentences.
    """
    f = lambda i: F.get("f", F.lit(i))
    name = f(0)
    sides = F.array(
        F.struct(F.lit("L").alias("side"), f(1).alias("phrase"), f(9).alias("sentence")),
        F.struct(F.lit("R").alias("side"), f(2).alias("phrase"), f(10).alias("sentence")),
    )
    return fields.select(
        "rule_id", name.substr(F.lit(2), F.length(name) - 2).alias("rule"), F.inline(sides)
    )


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rule table of a tab-separated file with one header line; rules count from 1."""
    lines = numbered_lines(spark, path).where(F.col("idx") > 0)
    return rule_columns(
        lines.select(F.col("idx").alias("rule_id"), F.split("value", "\t").alias("f"))
    )


def read_phrase_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``(rule_id, line)`` of an expression-pair file; rules count from 1."""
    return numbered_lines(spark, path).select(
        (F.col("idx") + 1).alias("rule_id"), F.col("value").alias("line")
    )
