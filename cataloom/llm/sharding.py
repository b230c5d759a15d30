"""Sharding by a hierarchical weighted hash tree.

A row descends from the root over region and rack to a shard. At each level every child draws -ln(u) / weight, u being
a hash of the row's key and the child's name, and the smallest draw wins, so that a child gets its share of the
weight. The draw of a child depends on that child alone: when weights change, rows move only into or out of subtrees
whose weight changed. Capacity added as a new subtree under the root takes rows only into itself; tree_for() adds
every shard beyond the base block in that way, so that one more shard than the base or more never moves a row between
old ones. The base block itself is fixed: there is no tree of fewer shards than its base.

Defined results: a null key hashes like any other value; equal keys go to one shard; a null or empty text has size 1;
an empty table gives an empty result; input columns named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cataloom.llm.common import fresh, replacing, unit_hash

#: Rows that one slot bucket holds on average; each bucket is numbered by one task.
ROWS_PER_BUCKET = 65_536


@dataclass(frozen=True)
class HashTree:
    """regions: region -> rack -> shard -> weight. Names are unique within their level."""

    regions: dict[int, dict[int, dict[int, float]]] = field(default_factory=dict)

    def levels(self) -> list[dict[int, list[tuple[int, float]]]]:
        """Per level: parent -> its children with their weights; a weight is the sum of those below."""
        racks = {r: {k: sum(s.values()) for k, s in ks.items()} for r, ks in self.regions.items()}
        top = {-1: [(r, sum(ks.values())) for r, ks in racks.items()]}
        middle = {r: list(ks.items()) for r, ks in racks.items()}
        low = {k: list(s.items()) for ks in self.regions.values() for k, s in ks.items()}
        return [top, middle, low]

    def with_shard(self, region: int, rack: int, shard: int, weight: float = 1.0) -> HashTree:
        regions = {r: {k: dict(s) for k, s in ks.items()} for r, ks in self.regions.items()}
        regions.setdefault(region, {}).setdefault(rack, {})[shard] = weight
        return HashTree(regions)


def tree_for(n_shards: int, base: int = 8, shards_per_rack: int = 2, racks_per_region: int = 2) -> HashTree:
    """The first base shards fill racks and regions; each further shard opens a region of its own."""
    if n_shards < base:
        raise ValueError(f"{n_shards} shards are fewer than the base block of {base}")
    tree = HashTree()
    for shard in range(n_shards):
        if shard < base:
            rack = shard // shards_per_rack
            tree = tree.with_shard(rack // racks_per_region, rack, shard)
        else:
            tree = tree.with_shard(1_000_000 + shard, 1_000_000 + shard, shard)
    return tree


def _children(level: dict[int, list[tuple[int, float]]]) -> Column:
    entries = []
    for parent, children in level.items():
        live = [F.struct(F.lit(c).cast("long").alias("name"), F.lit(float(w)).alias("weight")) for c, w in children if w > 0]
        if live:
            entries += [F.lit(parent).cast("long"), F.array(*live)]
    return F.create_map(*entries)


def _draw(key: Column, seed: int, depth: int) -> Callable[[Column], Column]:
    def draw(child: Column) -> Column:
        u = unit_hash(F.lit(seed), F.lit(depth), child["name"], key)
        return F.struct((-F.ln(u) / child["weight"]).alias("draw"), child["name"].alias("name"))

    return draw


def descend(key: Column, tree: HashTree, seed: int = 0) -> Column:
    """The shard of a key."""
    at = F.lit(-1).cast("long")
    for depth, level in enumerate(tree.levels()):
        at = F.array_min(F.transform(F.element_at(_children(level), at), _draw(key, seed, depth)))["name"]
    return at.cast("int")


def assign_shards(rows: DataFrame, key_col: str, tree: HashTree, grown: HashTree | None = None, seed: int = 0) -> DataFrame:
    """rows with shard and, given a grown tree, grown_shard."""
    key = F.coalesce(rows[f"`{key_col}`"].cast("string"), F.lit("\0"))
    columns = {"shard": descend(key, tree, seed)}
    if grown is not None:
        columns["grown_shard"] = descend(key, grown, seed)
    return replacing(rows, columns)


def number_slots(rows: DataFrame, order: list[str], shard_col: str = "shard", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """rows with slot, gapless from 0 in each shard. A shard is numbered in hash buckets, each by one task; a bucket starts where the counts of those before it end."""
    n_rows, n_shards = rows.agg(F.count("*"), F.count_distinct(shard_col)).first()
    n_buckets = max(1, -(-n_rows // max(1, n_shards * rows_per_bucket)))
    bucket, n, start, row = fresh(rows.columns, "bucket", "n", "start", "row")
    bucketed = rows.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(n_buckets)))
    counts = bucketed.groupBy(shard_col, bucket).agg(F.count("*").alias(n))
    before = Window.partitionBy(shard_col).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard_col, bucket, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    within = F.row_number().over(Window.partitionBy(shard_col, bucket).orderBy(*order))
    numbered = bucketed.withColumn(row, within).join(offsets, [shard_col, bucket])
    out = replacing(numbered, {"slot": (F.col(start) + F.col(row) - 1).cast("long")})
    return out.drop(bucket, start, row)


def write_shards(docs: DataFrame, path: str, tree: HashTree, key_col: str = "doc_id", seed: int = 0) -> None:
    """Write docs as Parquet, a folder a shard. Each task writes the rows that it has read; nothing is shuffled."""
    assign_shards(docs, key_col, tree, seed=seed).write.partitionBy("shard").parquet(path)
