"""Pointwise mutual information."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pmi(n: Column, n_total: Column, a: Column, a_total: Column, b: Column, b_total: Column) -> Column:
    """Natural log of p(a,b) / (p(a) p(b)); counts are positive by construction."""
    return F.log((n / n_total) / ((a / a_total) * (b / b_total)))
