"""Tokenising, tagged-token and dependency-edge decoding as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.functions.arrays import let

# The tag classes that make a token valid, the separator between the token part
# and the edge part of a parsed line, and the five phrase labels.
VALID_TAGS = ("nn", "vb", "jj", "rb", "in")
EDGE_MARK = "\t#DEP#\t"
PHRASE_LABELS = ("amod", "nsubj", "dobj", "pobj", "acomp")
# Labels whose phrase reads "dependent governor"; the others read "governor dependent".
DEPENDENT_FIRST = ("amod", "nsubj")


def plain_tokens(text: Column, keep_empty: bool = False) -> Column:
    """Lower-cased tokens of a line, split at single spaces.

    Empty tokens are dropped. With ``keep_empty`` only trailing ones are, and a blank line
    counts as one empty token.
    """
    lowered = F.lower(text)
    if not keep_empty:
        return F.filter(F.split(lowered, " "), lambda t: t != "")
    stripped = F.regexp_replace(lowered, " +$", "")
    return (
        F.when(lowered == "", F.array(F.lit("")))
        .when(stripped == "", F.array().cast("array<string>"))
        .otherwise(F.split(stripped, " "))
    )


def normalise_tagged(token: Column) -> Column:
    """``lemma/TAG`` to ``lemma-tt`` for the five tag classes and alphabetic lemmas, else NULL."""
    return let(_valid_token(token), _spelled)


def _valid_token(token: Column) -> Column:
    """The lower-cased token, or an empty text where tag or lemma is not valid."""
    return F.regexp_extract(F.lower(token), rf"^([a-z]+)/({'|'.join(VALID_TAGS)})[^/]*$", 0)


def _spelled(token: Column) -> Column:
    return F.when(token != "", F.regexp_replace(token, r"^([a-z]+)/(..).*$", "$1-$2"))


def parsed_terms(line: Column) -> Column:
    """Terms of a parsed line by position; invalid tokens are NULL but keep their place."""
    found = F.transform(F.split(F.get(F.split(line, EDGE_MARK), F.lit(0)), " "), _valid_token)
    return F.transform(found, _spelled)


def parsed_edges(line: Column, labels: tuple[str, ...] = PHRASE_LABELS) -> Column:
    """``array<struct<label, gov, dep>>`` of the wanted labels; malformed edges are left out."""
    raw = F.coalesce(
        F.split(F.get(F.split(line, EDGE_MARK), F.lit(1)), " "), F.array().cast("array<string>")
    )
    decoded = F.transform(F.transform(raw, lambda e: F.split(e, "-")), _decode_fields)
    return F.filter(
        decoded, lambda e: e.label.isin(*labels) & e.gov.isNotNull() & e.dep.isNotNull()
    )


def decode_edge(edge: Column) -> Column:
    """``label-...-gov-dep``: label before the first dash, indices are the last two fields."""
    return let(F.split(edge, "-"), _decode_fields)


def _decode_fields(fields: Column) -> Column:
    size = F.size(fields)
    return F.struct(
        F.get(fields, F.lit(0)).alias("label"),
        F.when(size >= 3, _index(F.get(fields, size - 2))).alias("gov"),
        F.when(size >= 3, _index(F.get(fields, size - 1))).alias("dep"),
    )


def _index(text: Column) -> Column:
    return F.when(text.rlike(r"^\d+$"), text.try_cast("int"))


def tag_class(tag: Column) -> Column:
    """First two lower-cased characters of a tag."""
    return F.substring(F.lower(tag), 1, 2)


def valid_tag(tag: Column) -> Column:
    """The tag's class when it is a valid one, else NULL."""
    head = tag_class(tag)
    return F.when(head.isin(*VALID_TAGS), head)


def trailing_index(token: Column) -> Column:
    """Number after the last dash of ``word-idx``."""
    return F.substring_index(token, "-", -1).try_cast("int")
