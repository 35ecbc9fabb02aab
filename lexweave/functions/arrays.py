"""Array helpers that stay inside one row and cost O(n log n) at most."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``.

    A lambda re-evaluates outer expressions for each element; a bound variable is only read.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dense_by_key(entries: Column, n: Column) -> Column:
    """Turn ``array<struct<key int, val int>>`` into an array of length ``n``.

    Element ``k`` (1-based) holds the smallest ``val`` given for key ``k``, or NULL; all keys lie
    in 1..n. The sorted entries are laid out with NULLs filling the gaps. This replaces map
    look-ups, which Spark scans linearly.
    """
    nothing = F.lit(None).cast("int")

    def before(v: Column, k: Column) -> Column:
        return F.coalesce(F.get(v, k - 1).key, F.lit(0))

    def lay_out(v: Column) -> Column:
        pieces = F.transform(
            v,
            lambda x, k: F.concat(
                F.array_repeat(nothing, x.key - 1 - before(v, k)), F.array(x.val.cast("int"))
            ),
        )
        return F.concat(F.flatten(pieces), F.array_repeat(nothing, n - before(v, F.size(v))))

    distinct = let(
        F.array_sort(entries), lambda v: F.filter(v, lambda x, k: x.key != before(v, k))
    )
    return let(distinct, lay_out)


def windows_with_halo(items: Column, own: int, halo: int) -> Column:
    """Cut an array into pieces of ``own`` elements, each followed by the next ``halo``."""

    def pieces(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), F.lit(own))
        return F.transform(starts, lambda s: F.slice(v, s + 1, F.lit(own + halo)))

    return let(items, pieces)


def pairs_at_distance(items: Column, distance: int, own: int) -> Column:
    """``array<struct<0,1>>`` of the elements ``distance`` apart whose left one is owned."""
    count = F.greatest(F.least(F.size(items) - distance, F.lit(own)), F.lit(0))
    return F.arrays_zip(
        F.slice(items, F.lit(1), count).alias("a"),
        F.slice(items, F.lit(1 + distance), count).alias("b"),
    )
