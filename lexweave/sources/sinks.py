"""Result tables. Spark decides the number of files; nothing is coalesced into one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.operators import rules as rule_ops
from lexweave.sources import text_formats


def write_table(df: DataFrame, path: str, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write one parquet table below ``path`` and return it as read back."""
    target = f"{path.rstrip('/')}/{name}"
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(target)
    return df.sparkSession.read.parquet(target)


def read_table(spark, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/{name}")


def write_text_forms(counts: DataFrame, vocab: DataFrame, coo: DataFrame, path: str) -> None:
    """Counts, vocabulary in index order, and triplets as text lines."""
    base = path.rstrip("/")
    text_formats.format_counts(counts).write.mode("overwrite").text(f"{base}/wordcounts")
    vocab.orderBy("idx").select("term").write.mode("overwrite").text(f"{base}/wordvocab")
    text_formats.format_triplets(coo).write.mode("overwrite").text(f"{base}/wordpmi")


def write_scores(
    scores: DataFrame, texts: DataFrame, fragments: DataFrame, path: str
) -> None:
    """Scores, and the matched phrases with their vectors."""
    write_table(scores, path, "scores")
    write_table(rule_ops.matched_vectors(scores, texts, fragments), path, "matched")


def comparison(rules: DataFrame, texts: DataFrame) -> DataFrame:
    """``(rule_id, l_phrase, l_text, r_phrase, r_text)``: phrases beside their expressions."""
    both = rules.select("rule_id", "side", "phrase").join(texts, ["rule_id", "side"])
    sides = [
        both.where(F.col("side") == side).select(
            "rule_id",
            F.col("phrase").alias(f"{side.lower()}_phrase"),
            F.col("text").alias(f"{side.lower()}_text"),
        )
        for side in "LR"
    ]
    return sides[0].join(sides[1], "rule_id")
