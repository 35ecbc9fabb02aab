"""Greedy one-to-one matching of rules whose sides exceed one task, by rounds of mutually best pairs.

A pair that is the best remaining one of both its fragments is taken by the greedy order sooner or later,
whatever happens elsewhere, so every round takes all such pairs at once. Pairs are ordered as in
``rules.greedy_pairs``: by similarity, then the smaller left, then the smaller right position; the result is
the same. Fragments of one direction form one group; two groups that prefer each other to all others are
matched fragment by fragment in the same round. Only fragments whose best partner was used up ask again.

Rounds end when what is left of a rule fits one task. Their number is the longest chain of choices that wait
for each other: about the logarithm of the size for unlike vectors, up to the size where very many unlike
vectors are equally similar.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.operators import rules
from lexweave.scale import lookup_join, sorted_index
from lexweave.session import cut_lineage

# Fragments of both sides of a rule that one task matches, and vectors in one block of a comparison.
HELD = 4_000
BLOCK = 4_096
# Blocks are compared in strips of this many vectors. Products this near to the best are computed anew,
# one by one, so that equal similarities are equal in every block.
STRIP, NEAR = 256, 1e-9

KEY = ["rule_id", "side", "gid"]
BEST = "rule_id bigint, side string, gid int, sim double, other_head int, other int, tied boolean"


def _unit(fragments: DataFrame) -> DataFrame:
    """Directions instead of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(3).flatten().to_numpy(zero_copy_only=False).copy()
            first = np.concatenate([[0], np.cumsum(batch.column(3).value_lengths())]).astype(np.int32)
            sizes = np.diff(first)
            for size in np.unique(sizes):
                at = first[:-1][sizes == size][:, None] + np.arange(size)
                values[at] /= np.linalg.norm(values[at], axis=1, keepdims=True)
            # A negative zero is the same direction as zero.
            listed = pa.ListArray.from_arrays(pa.array(first), pa.array(values + 0.0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], listed], names=["rule_id", "side", "frag", "unit"])

    rows = fragments.select(F.col("rule_id").cast("bigint").alias("rule_id"), "side", F.col("frag").cast("int").alias("frag"), "vec")
    return rows.mapInArrow(run, "rule_id bigint, side string, frag int, unit array<double>")


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def _compare(asking: pa.Table, asked: pa.Table) -> pa.Table:
    """For each asking group its best partner in a block, and whether others are as good."""
    names = [f.split()[0] for f in BEST.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.bool_()]
    if not len(asking) or not len(asked):
        return pa.table([pa.array([], k) for k in kinds], names=names)
    a, b = _vectors(asking.column("unit").combine_chunks()), _vectors(asked.column("their_unit").combine_chunks())
    heads, groups = (asked.column(f"their_{c}").to_numpy() for c in ("head", "gid"))
    sims, at, tied = np.empty(len(a)), np.empty(len(a), np.int64), np.empty(len(a), np.bool_)
    for first in range(0, len(a), STRIP):
        rough = np.abs(a[first : first + STRIP] @ b.T)
        near_row, near_col = np.nonzero(rough >= rough.max(axis=1, keepdims=True) - NEAR)
        exact = np.round(np.abs((b[near_col] * a[first + near_row]).sum(axis=1)), rules.DIGITS)
        order = np.lexsort((heads[near_col], -exact, near_row))
        start = np.flatnonzero(np.diff(near_row[order], prepend=-1))
        best = order[start]
        rows = slice(first, first + len(rough))
        sims[rows], at[rows] = exact[best], near_col[best]
        equal = exact == sims[rows][near_row]
        tied[rows] = np.bincount(near_row[equal], minlength=len(rough)) > 1
    own = [asking.column(c) for c in KEY]
    return pa.table([*own, pa.array(sims), pa.array(heads[at], pa.int32()), pa.array(groups[at], pa.int32()), pa.array(tied)], names=names)


def _blocks(number: Column, block: int) -> Column:
    return F.ceil(number / block).cast("int")


def _ask(active: DataFrame, units: DataFrame, block: int) -> DataFrame:
    """The best partner of every asking group, from comparisons of blocks with blocks."""
    sizes = active.groupBy("rule_id").agg(
        *[F.sum(F.when(F.col("side") == s, 1)).alias(f"n_{s}") for s in "LR"],
        *[F.sum(F.when((F.col("side") == s) & F.col("ask"), 1)).alias(f"ask_{s}") for s in "LR"],
    )
    rows = lookup_join(active.join(units, KEY), cut_lineage(sizes), ["rule_id"], ["gid"])
    left = F.col("side") == "L"

    def of(kind: str, own: bool) -> Column:
        return F.coalesce(F.when(left == F.lit(own), F.col(f"{kind}_L")).otherwise(F.col(f"{kind}_R")), F.lit(0))

    def dealt(own: Column, others: Column, own_name: str, other_name: str) -> list[Column]:
        mine = F.pmod(F.xxhash64("gid"), _blocks(own, block).cast("bigint")).cast("int")
        return [mine.alias(own_name), F.explode(F.sequence(F.lit(0), _blocks(others, block) - 1)).alias(other_name)]

    asking = rows.where("ask").select(*KEY, "unit", F.col("side").alias("for"), *dealt(of("ask", True), of("n", False), "a", "b"))
    wanted = rows.where(of("ask", False) > 0)
    asked = wanted.select(*KEY, "head", "unit", F.when(left, "R").otherwise("L").alias("for"), *dealt(of("n", True), of("ask", False), "b", "a"))
    meet = ["rule_id", "for", "a", "b"]
    asked = asked.toDF(*[f"their_{c}" for c in asked.columns])
    theirs = asked.groupBy(*[f"their_{c}" for c in meet])
    found = asking.groupBy(*meet).cogroup(theirs).applyInArrow(_compare, BEST)
    # One number for each block.
    top = F.sort_array(F.collect_list("sim"), False)
    return found.groupBy(*KEY).agg(
        F.max(F.struct("sim", -F.col("other_head"), "other")).alias("best"),
        F.max(F.struct("sim", "tied"))["tied"].alias("_tied"),
        F.slice(top, 1, 2).alias("_top"),
    ).select(
        *KEY,
        F.col("best.sim").alias("new_sim"),
        F.col("best.other").alias("new_other"),
        (~F.col("_tied") & ((F.size("_top") < 2) | (F.get("_top", F.lit(0)) > F.get("_top", F.lit(1))))).alias("new_strict"),
    )


def _unfinished(active: DataFrame, held: int) -> DataFrame:
    """Rules with fragments left on both sides, and more of them than one task matches."""
    rest = F.col("size") - F.col("used")
    left = active.groupBy("rule_id").agg(*[F.sum(F.when(F.col("side") == s, rest)).alias(s) for s in "LR"])
    return left.where((F.col("L") > 0) & (F.col("R") > 0) & (F.col("L") + F.col("R") > held)).select("rule_id")


def match_by_rounds(fragments: DataFrame, held: int = HELD, block: int = BLOCK) -> DataFrame:
    """``(rule_id, place, sim, l_frag, r_frag)`` as ``rules.greedy_match`` gives it, at any size of a rule.

    ``fragments`` have usable vectors; a rule with an empty side has no rows. ``place`` is a bigint.
    """
    units = cut_lineage(_unit(fragments))
    direction = ["rule_id", "side", "unit"]
    groups = cut_lineage(units.groupBy(*direction).agg(F.min("frag").alias("gid"), F.count(F.lit(1)).alias("size")))
    named = lookup_join(units, groups.select(*direction, "gid"), direction, ["frag"]).select(*KEY, "frag")
    placed = cut_lineage(sorted_index(named, [*KEY, "frag"], "_at"))
    starts = placed.groupBy(*KEY).agg(F.min("_at").alias("_first"))
    ranked = cut_lineage(lookup_join(placed, starts, KEY, ["frag"]).select(*KEY, (F.col("_at") - F.col("_first")).alias("rank"), "frag"))
    units = groups.select(*KEY, "unit")
    # What a group knows: its next fragment, how many are used up, its best partner, whether it must ask.
    state = cut_lineage(
        groups.select(
            *KEY, "size", F.lit(0).cast("bigint").alias("used"), F.col("gid").alias("head"), F.lit(None).cast("double").alias("sim"),
            F.lit(None).cast("int").alias("other"), F.lit(False).alias("strict"), F.lit(True).alias("ask"),
        )
    )
    taken: list[DataFrame] = []
    while True:
        active = state.where("used < size")
        large = cut_lineage(_unfinished(active, held))
        if large.isEmpty():
            break
        parted = lookup_join(active, large.withColumn("_large", F.lit(True)), ["rule_id"], ["gid"], "left")
        parted = cut_lineage(parted.withColumn("_large", F.coalesce("_large", F.lit(False))))
        rows = parted.where("_large").drop("_large")
        asked = rows.join(_ask(rows, units, block), KEY, "left")
        fresh = {c: F.when(F.col("ask"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in ("sim", "other", "strict")}
        rows = cut_lineage(asked.withColumns(fresh).select(*state.columns))

        def side(name: str, own: str, partner: str) -> DataFrame:
            columns = [F.col(c).alias(f"{name}_{c}") for c in ("used", "size", "strict")]
            return rows.where(F.col("side") == name).select("rule_id", F.col("gid").alias(own), F.col("other").alias(partner), "sim", *columns)

        left, right = side("L", "l_gid", "r_gid"), side("R", "r_gid", "l_gid").drop("sim")
        both = F.least(F.col("L_size") - F.col("L_used"), F.col("R_size") - F.col("R_used"))
        mutual = left.join(right, ["rule_id", "l_gid", "r_gid"])
        pairs = cut_lineage(mutual.withColumn("n", F.when(F.col("L_strict") & F.col("R_strict"), both).otherwise(F.lit(1).cast("bigint"))))
        taken.append(pairs.select("rule_id", "sim", "n", *[c for s in "LR" for c in (f"{s.lower()}_gid", f"{s}_used")]))

        touched = pairs.select(
            "rule_id",
            F.inline(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s.lower()}_gid").alias("gid"), (F.col(f"{s}_used") + F.col("n")).alias("now"), F.col(f"{s}_size").alias("_size")) for s in "LR"])),
        )
        next_head = ranked.select(*KEY, F.col("rank").alias("now"), F.col("frag").alias("_head"))
        touched = cut_lineage(touched.join(next_head, [*KEY, "now"], "left"))
        moved = rows.join(touched.drop("_size"), KEY, "left")
        moved = moved.withColumn("used", F.coalesce("now", "used")).withColumn("head", F.coalesce("_head", "head")).select(*state.columns)
        # A partner that is used up is asked for again; so is one with a new position among equals.
        partner = touched.select(
            "rule_id", F.when(F.col("side") == "L", "R").otherwise("L").alias("side"), F.col("gid").alias("other"),
            F.lit(True).alias("_touched"), (F.col("now") >= F.col("_size")).alias("_gone"),
        )
        told = lookup_join(moved, partner, ["rule_id", "side", "other"], ["gid"], "left")
        again = F.coalesce("_touched", F.lit(False)) & (F.coalesce("_gone", F.lit(False)) | ~F.col("strict"))
        told = told.withColumn("ask", again).select(*state.columns)
        state = cut_lineage(told.unionByName(parted.where("NOT _large").select(*state.columns)))

    rest = lookup_join(ranked, state.where("used < size").select(*KEY, "used"), KEY, ["frag"]).where("rank >= used")
    rest = lookup_join(rest.select(*KEY, "frag"), units.withColumnRenamed("unit", "vec"), KEY, ["frag"])
    found = rules.greedy_match(rest).select("rule_id", "sim", "l_frag", "r_frag")
    for pairs in taken:
        steps = pairs.withColumn("_step", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
        for s in "LR":
            own = ranked.where(F.col("side") == s).select("rule_id", F.col("gid").alias(f"{s.lower()}_gid"), F.col("rank").alias(f"{s}_rank"), F.col("frag").alias(f"{s.lower()}_frag"))
            steps = steps.withColumn(f"{s}_rank", F.col(f"{s}_used") + F.col("_step")).join(own, ["rule_id", f"{s.lower()}_gid", f"{s}_rank"])
        found = found.unionByName(steps.select("rule_id", "sim", "l_frag", "r_frag"))
    return sorted_index(found, [F.desc("sim"), "l_frag", "r_frag"], "place", within="rule_id")
