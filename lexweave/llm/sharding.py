"""Sharding by a hierarchical weighted hash tree of regions, racks and shards.

A row descends level by level: the children of a node draw ``-ln(u) / weight`` each, ``u`` a uniform hash of
the row's key, the level and the child, and the smallest draw wins, so children are picked in proportion to
their weights. A rack or region weighs what its shards weigh together. Draws of one level say nothing about
those of another, and a row costs one hash for each child of the three nodes it passes. Equal draws go to the
smaller id.

A changed weight changes draws on the path above it only: rows enter or leave the regions, racks and shards
whose weights changed, and no row moves between two others of one node. Rows that a region gains this way
spread over all of it. Where growth must take rows only into one shard, ``grown`` gives the new shard, or
the new weight of an old one, a region of its own, and ``weight`` then counts against whole regions.

Rows with a null key share one key; a null text has no bytes; an empty table gives an empty result;
repeated rows each get a slot; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import numbered, text_key

SHARDS_PER_RACK, RACKS_PER_REGION = 2, 5
ROW_BYTES = 16


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(n_shards: int, per_rack: int = SHARDS_PER_RACK, per_region: int = RACKS_PER_REGION) -> list[Shard]:
    """Equal shards, filled rack by rack and region by region; a longer list begins like a shorter one."""
    return [Shard(s // per_rack // per_region, s // per_rack, s) for s in range(n_shards)]


def grown(tree: list[Shard], shard: int, weight: float = 1.0) -> list[Shard]:
    """``tree`` with more weight for ``shard``, new or not, from a region of its own: only this shard gains rows."""
    return [*tree, Shard(max(n.region for n in tree) + 1, max(n.rack for n in tree) + 1, shard, weight)]


def levels(tree: list[Shard]) -> Column:
    """Regions with their racks with their shards, as one constant; nodes without weight are left out."""

    def node(number: int, weight: float, below: Column | None = None) -> Column:
        own = [F.lit(number).alias("id"), F.lit(float(weight)).alias("weight")]
        return F.struct(*own, *([] if below is None else [below.alias("below")]))

    def grouped(nodes: list[Shard], level: str) -> list[tuple[int, list[Shard]]]:
        return [(k, [n for n in nodes if getattr(n, level) == k]) for k in sorted({getattr(n, level) for n in nodes})]

    def total(nodes: list[Shard]) -> float:
        return sum(n.weight for n in nodes)

    def rack(number: int, nodes: list[Shard]) -> Column:
        shards = [node(k, total(own)) for k, own in grouped(nodes, "shard")]
        return node(number, total(nodes), F.array(*shards))

    def region(number: int, nodes: list[Shard]) -> Column:
        return node(number, total(nodes), F.array(*[rack(k, own) for k, own in grouped(nodes, "rack")]))

    return F.array(*[region(k, own) for k, own in grouped([n for n in tree if n.weight > 0], "region")])


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def descend(key: Column, tree: list[Shard]) -> Column:
    """The shard reached through region and rack."""

    def pick(nodes: Column, level: int) -> Column:
        """The child of the smallest draw."""

        def draw(node: Column, at: Column) -> Column:
            bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), node["id"]), 11)
            uniform = (bits + F.lit(0.5)) / F.lit(float(1 << 53))
            return F.struct((-F.log(uniform) / node["weight"]).alias("draw"), node["id"].alias("id"), at.alias("at"))

        return F.get(nodes, F.array_min(F.transform(nodes, draw))["at"])

    def shard(rack: Column) -> Column:
        return pick(rack["below"], 2)["id"]

    def rack(region: Column) -> Column:
        return _bound(pick(region["below"], 1), shard)

    return _bound(pick(levels(tree), 0), rack).cast("int")


def assign(docs: DataFrame, tree: list[Shard], larger: list[Shard] | None = None) -> DataFrame:
    """Shard, size, checksum and a gapless slot in its shard for every row; ``larger``: another tree."""
    octets = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = docs.select(
        "doc_id",
        (octets + ROW_BYTES).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        text_key().alias("_key"),
    )
    placed = rows.withColumn("shard", descend(F.col("_key"), tree))
    if larger:
        placed = placed.withColumn("grown_shard", descend(F.col("_key"), larger))
    return numbered(placed.drop("_key"), ["shard"], "slot")
