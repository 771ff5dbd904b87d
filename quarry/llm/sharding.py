"""Sharding by a hierarchical weighted hash tree.

A key descends the tree: among the regions, then among the racks of the chosen region, then among
the shards of the chosen rack. On each level every child draws an exponential variate from a hash of
the key and the child's name, at the rate of its subtree's weight, and the least draw wins, so a
child is chosen in proportion to its weight. The draws of different levels are independent, and a
key draws only for the children on its way. Changing a weight changes the draws of the nodes above
it alone: keys move between regions only into or out of that region, between its racks only into or
out of that rack, and between that rack's shards only into or out of that shard. All of it is
column arithmetic: no shuffle decides a shard.

A shard that is added later stands in a region of its own, so that no draw but its own is new and
keys move into it alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import common

SHARDS, SHARDS_PER_RACK, RACKS_PER_REGION = 16, 4, 2
#: Rows that are numbered in one piece.
SLOT_ROWS = 100_000

#: Regions of racks of (shard, weight).
Tree = list[list[list[tuple[int, float]]]]


def even_tree(shards: int) -> Tree:
    """Shards 0.. of weight 1, filled into racks and regions in order."""
    racks = [[(s, 1.0) for s in range(a, min(a + SHARDS_PER_RACK, shards))] for a in range(0, shards, SHARDS_PER_RACK)]
    return [racks[a : a + RACKS_PER_REGION] for a in range(0, len(racks), RACKS_PER_REGION)]


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard (the next number), in a region of its own."""
    return [*tree, [[(1 + max((s for region in tree for rack in region for s, _ in rack), default=-1), weight)]]]


def _chosen(key: list[Column], children: Column, level: int) -> Column:
    """The name of the child (struct of name and weight) with the least draw; of equal draws, the lower name."""

    def draw(child: Column) -> Column:
        uniform = (F.shiftrightunsigned(F.xxhash64(*key, F.lit(level), child["name"]), 11).cast("double") + 0.5) / float(1 << 53)
        return F.struct((-F.log(uniform) / child["weight"]).alias("draw"), child["name"].alias("name"))

    return F.array_min(F.transform(children, draw))["name"]


def _nodes(nodes: list[tuple[int, float]]) -> Column:
    return F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(w)).alias("weight")) for name, w in nodes])


def _apart(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of df as one struct beside their keys k0, k1, ..., so that no other name can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[F.col(f"`{k}`").alias(f"k{n}") for n, k in enumerate(keys)])


def with_shard(df: DataFrame, key: list[str], tree: Tree, name: str = "shard", levels: bool = False) -> DataFrame:
    """df with the shard of each key (and, with levels, its region and rack numbers, both counted over the tree).

    Null keys hash alike; equal keys, and so repeated rows, share a shard. Shards of weight 0 or
    less get nothing; a tree without any other is an error.
    """
    regions: list[tuple[int, float]] = []
    racks: list[list[tuple[int, float]]] = []
    shards: list[list[tuple[int, float]]] = []
    for region in tree:
        racks.append([])
        for rack in region:
            shards.append([(s, w) for s, w in rack if w > 0])
            if shards[-1]:
                racks[-1].append((len(shards) - 1, sum(w for _, w in shards[-1])))
        if racks[-1]:
            regions.append((len(racks) - 1, sum(w for _, w in racks[-1])))
    if not regions:
        raise ValueError("the tree has no shard of positive weight")
    keys = [F.col(f"k{n}") for n in range(len(key))]
    empty = F.array().cast("array<struct<name:int,weight:double>>")
    way = _apart(df, key).withColumn("region", _chosen(keys, _nodes(regions), 0))
    for level, (up, down, below) in enumerate((("region", "rack", racks), ("rack", "shard", shards)), 1):
        children = F.array(*[_nodes(x) if x else empty for x in below])
        way = way.withColumn(down, _chosen(keys, F.element_at(children, F.col(up) + 1), level))
    return way.select("row.*", F.col("shard").alias(name), *(["region", "rack"] if levels else []))


def with_slot(df: DataFrame, shard: str, order: list[str], slot_rows: int = SLOT_ROWS, name: str = "slot") -> DataFrame:
    """df with `slot`: numbers from 0 without gaps in each shard.

    Rows of a shard are numbered in pieces of about `slot_rows` (dealt by a hash of `order`), and each piece
    starts where the rows of the pieces before it end. Rows that tie in `order` are numbered in any order.
    """
    sizes = df.groupBy(F.col(f"`{shard}`").alias("k0")).agg(F.count("*").alias("n"))
    largest = sizes.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]
    keys = [F.col(f"k{n}") for n in range(1, len(order) + 1)]
    rows = _apart(df, [shard, *order]).withColumn("piece", F.pmod(F.xxhash64(*keys), F.lit(common.row_blocks(largest, slot_rows))))
    before = Window.partitionBy("k0").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = rows.groupBy("k0", "piece").agg(F.count("*").alias("n")).select("k0", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = rows.withColumn("at", F.row_number().over(Window.partitionBy("k0", "piece").orderBy(*keys))).alias("r")
    joined = numbered.join(pieces.alias("p"), F.col("r.k0").eqNullSafe(F.col("p.k0")) & (F.col("r.piece") == F.col("p.piece")))
    return joined.select("r.row.*", (F.col("p.before") + F.col("r.at") - 1).cast("long").alias(name))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law (`key`), shard, slot, grown_shard (with one more shard), region, rack.

    A null text has size 1 and the crc32 of nothing (0); a null doc_id is a key like any other, and
    rows that repeat an id share its shard. Only these columns are shuffled, for slots.
    """
    text = common.text_or_empty().cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    tree = even_tree(shards)
    placed = with_shard(with_shard(rows, ["doc_id"], tree, levels=True), ["doc_id"], grown(tree), "grown_shard")
    return with_slot(placed, "shard", ["doc_id", "size", "text_crc32"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack")
