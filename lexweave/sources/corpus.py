"""Corpus scans: text lines and dependency-parsed lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.scale import spread
from lexweave.sources.decoding import decode_lines


# Stored bytes of a table for each partition it is dealt over; text is about twice as large once it is read.
DEALT_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    """The two columns of the ``documents`` table that carry a corpus.

    ``partitions`` is the least number asked for: a larger table is dealt over more, one for every
    ``DEALT_BYTES``, so that what a task holds does not grow with the table.
    """
    path = f"{sf_dir}/documents.parquet"
    if partitions:
        partitions = max(partitions, -(-stored_bytes(spark, path) // DEALT_BYTES))
    return spread(spark.read.parquet(path).select("doc_id", "text"), partitions)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of the files below a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def lines_of(docs: DataFrame) -> DataFrame:
    """``(doc_id, line_no, text)``, one row per newline-separated line."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


def read_text_lines(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Lines of plain text files; every file line is a document of one line."""
    rows = spread(spark.read.text(path), partitions)
    return rows.select(
        F.monotonically_increasing_id().alias("doc_id"),
        F.lit(0).alias("line_no"),
        F.col("value").alias("text"),
    )


def parse_lines(lines: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, line_no, terms, edges)`` from parsed lines, both parts in one row."""
    return decode_lines(lines, text)


def token_rows(lines: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, line_no, pos, lemma, tag, term)`` from parsed lines."""
    exploded = parse_lines(lines, text).select(
        "doc_id", "line_no", F.posexplode_outer("terms").alias("pos", "term")
    )
    return exploded.select(
        "doc_id",
        "line_no",
        "pos",
        F.substring_index("term", "-", 1).alias("lemma"),
        F.substring_index("term", "-", -1).alias("tag"),
        "term",
    )


def edge_rows(lines: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, line_no, label, gov, dep)`` from parsed lines."""
    return parse_lines(lines, text).select(
        "doc_id", "line_no", F.inline_outer("edges")
    ).where(F.col("label").isNotNull())


def valid_terms(terms: Column) -> Column:
    """Valid terms of a line, in order."""
    return F.filter(terms, lambda t: t.isNotNull())
