"""Sharding by a hierarchical weighted hash tree (region, rack, shard), in DataFrame functions only.

At each level every child of the chosen node draws ``-ln(u) / weight`` with ``u`` from a hash of the key and the child, and the smallest
draw wins. A child's chance is its share of the weight, and a changed weight moves keys only between the subtree that changed and its
siblings, at every level of the path. ``tree_of`` fills racks and regions in order; ``grown_tree`` puts one more shard into a region of its own,
whatever the regions before hold, so keys move into it and nowhere else.

The key alone decides (law ``key``). Null keys are one key. Empty tables give empty results; repeated rows go to the same shard and get slots
of their own; other columns are not looked at. Rows are numbered within a shard by hash buckets of a row number that is written once, so
neither a hot key nor a large shard is one task, and a lost executor changes nothing.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from leafscan.llm import common as c
from leafscan.session import settle

Tree = Sequence[Sequence[Sequence[float]]]  # weights of shards in racks in regions
BUCKET_ROWS = 16384


def tree_of(shards: int, per_rack: int = 4, racks_per_region: int = 3, weights: Sequence[float] | None = None) -> list[list[list[float]]]:
    """A tree of ``shards`` leaves, racks and regions filled in order; ``weights`` of the leaves are 1 by default."""
    w = list(weights) if weights is not None else [1.0] * shards
    racks = [w[i:i + per_rack] for i in range(0, shards, per_rack)]
    return [racks[i:i + racks_per_region] for i in range(0, len(racks), racks_per_region)]


def grown_tree(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard as the only one of a new region: no weight of an older subtree changes, so only the new one wins keys."""
    return [*tree, [[weight]]]


def _draw(key: Column, level: str, children: list[tuple[int, float]]) -> Column:
    """The child with the smallest weighted draw; a child without weight never wins."""
    def race(child: int, weight: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(f"{level}/{child}")), 11)
        return F.struct((-F.log((bits + F.lit(0.5)) / F.lit(float(2 ** 53))) / F.lit(weight)).alias("draw"), F.lit(child).alias("child"))

    races = [race(k, w) for k, w in children if w > 0]
    return F.array_min(F.array(*races))["child"]


def shard_of(key: Column, tree: Tree) -> Column:
    """Shard number (leaves counted through the tree) of ``key``."""
    size = lambda node: sum(map(size, node)) if isinstance(node, (list, tuple)) else node
    region_draw = _draw(key, "region", [(r, size(region)) for r, region in enumerate(tree)])
    shard, rack_no, leaf_no = F.lit(None).cast("int"), 0, 0
    by_region = []
    for r, region in enumerate(tree):
        by_rack = []
        for rack in region:
            leaves = [(leaf_no + k, w) for k, w in enumerate(rack)]
            by_rack.append((rack_no, size(rack), _draw(key, "shard", leaves) if size(rack) else shard))
            rack_no, leaf_no = rack_no + 1, leaf_no + len(rack)
        if size(region):
            chosen = _draw(key, "rack", [(k, w) for k, w, _ in by_rack])
            leaf = F.lit(None).cast("int")
            for k, _, draw in by_rack:
                leaf = F.when(chosen == k, draw).otherwise(leaf)
            by_region.append((r, leaf))
    for r, leaf in by_region:
        shard = F.when(region_draw == r, leaf).otherwise(shard)
    return shard.cast("int")


def numbered(rows: DataFrame, group: str, into: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``rows`` with ``into``: a gapless number from 0 within each ``group``. Needs a settled, unique ``_row``.

    Groups are cut into hash buckets of about ``bucket_rows`` rows; a bucket's first number is the prefix sum of the counts before it.
    """
    groups = max(1, rows.select(group).distinct().count())
    buckets = max(1, math.ceil(rows.count() / groups / bucket_rows))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets)))
    counts = rows.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select(group, "_bucket", F.coalesce(before, F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy("_row")) - 1
    return rows.withColumn("_rank", rank).join(base, [group, "_bucket"]).withColumn(into, F.col("_base") + F.col("_rank")).drop("_bucket", "_rank", "_base", "_row")


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", weights: Sequence[float] | None = None) -> DataFrame:
    """Shard, slot and (with one more shard of weight 1) next shard of each document, with its size in bytes and the crc32 of its text."""
    tree = tree_of(shards, weights=weights)
    grown = grown_tree(tree)
    slim = docs.select(c.row_id(id_col).alias("doc_id"), c.text_of(text_col).alias("_text"))
    placed = settle(slim.select(
        "doc_id", (F.octet_length("_text") + 8).cast("long").alias("size"), F.crc32(F.encode("_text", "UTF-8")).alias("text_crc32"), F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), tree).alias("shard"), shard_of(F.col("doc_id"), grown).alias("grown_shard"),
        F.monotonically_increasing_id().alias("_row")), "placed")
    return numbered(placed, "shard", "slot")
