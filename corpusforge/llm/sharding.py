"""Sharding by a weighted hash tree of regions, racks and shards, with DataFrame functions only.

A key goes down the tree level by level. At every node each child draws a number from the key and the
child's own path, exponential with the child's whole weight as rate, and the least draw is taken; so a
subtree is chosen in proportion to its weight, with one draw per child of the nodes on the way instead of
one per shard. A draw depends on nothing but the path and the weight of its child. Hence only where weights
change does anything move: a changed shard makes keys move into or out of its region at the root, into or
out of its rack for the keys that stay in the region, and between shards only inside its rack; keys that
stay in an unchanged subtree keep their shard. A shard that opens a region of its own only takes keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import even_pieces, let
from corpusforge.session import materialize

#: region -> racks -> (shard, weight)
Tree = Sequence[Sequence[Sequence[tuple[int, float]]]]


def even_tree(shards: int, per_rack: int = 5, racks_per_region: int = 4, weight: float = 1.0) -> Tree:
    """Shards 0, 1, ... in racks and regions that are filled one after the other."""
    racks = [[(s, weight) for s in range(lo, min(lo + per_rack, shards))] for lo in range(0, shards, per_rack)]
    return [racks[lo : lo + racks_per_region] for lo in range(0, len(racks), racks_per_region)]


def with_region(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    """The tree with one more shard in a region of its own, so that no key moves but into it."""
    return [*tree, [[(shard, weight)]]]


def _weigh(tree: Tree) -> Column:
    """The tree as a literal: arrays of (weight, path, children); subtrees without weight are left out."""

    def node(weight: float, path: int, *children: Column) -> Column:
        return F.struct(F.lit(float(weight)).alias("w"), F.lit(path).alias("path"), *[c.alias("below") for c in children])

    def level(nodes: list[tuple]) -> Column:
        return F.array(*[node(*n) for n in nodes if n[0] > 0])

    def rack(shards: Sequence[tuple[int, float]]) -> Column:
        return level([(w, s) for s, w in shards])

    def region(racks: Sequence[Sequence[tuple[int, float]]]) -> Column:
        return level([(sum(w for _, w in shards), j, rack(shards)) for j, shards in enumerate(racks)])

    return level([(sum(w for shards in racks for _, w in shards), i, region(racks)) for i, racks in enumerate(tree)])


def tree_shard(key: Column, tree: Tree, seed: int = 42) -> Column:
    """Shard of a key: its descent through the tree. A null key is a key like any other.

    A region or rack is named by its place among its siblings, a shard by its number: leave an empty list
    where a subtree is gone, so that the others keep their names.
    """
    name = key.cast("string")

    def least(children: Column, *path: Column) -> Column:
        def draw(child: Column) -> Column:
            bits = F.shiftrightunsigned(F.xxhash64(name, F.lit(seed), *path, child["path"]), 11)
            uniform = (bits.cast("double") + 0.5) / float(1 << 53)
            return F.struct((-F.log(uniform) / child["w"]).alias("draw"), child.alias("child"))

        return F.array_min(F.transform(children, draw))["child"]

    def in_region(region: Column) -> Column:
        return let(
            least(region["below"], region["path"]),
            lambda rack: least(rack["below"], region["path"], rack["path"])["path"],
        )

    return let(least(_weigh(tree)), in_region)


def assign(
    docs: DataFrame,
    tree: Tree,
    grown: Tree | None = None,
    key: str = "doc_id",
    text: str = "text",
    overhead: int = 16,
    seed: int = 42,
) -> DataFrame:
    """``key, size, text_crc32, shard, slot, grown_shard`` for every row.

    A size is the text's bytes and ``overhead``; a null text has no bytes (checksum 0). Only the key and
    the tree decide, so rows of one key share a shard, and each still has its own slot. Slots are gapless
    from 0 in a shard: a shard is counted by pieces of a hash order, and rows are numbered inside a piece.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(key).alias("_key"),
        (F.octet_length(content) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(content.cast("binary")).cast("long").alias("text_crc32"),
        tree_shard(F.col(key), tree, seed).alias("shard"),
        (tree_shard(F.col(key), grown, seed) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    narrow = materialize(narrow)
    pieces = even_pieces(narrow.count())
    # rows of one key may be many: the checksum and size spread them as well
    dealt = narrow.withColumn("_piece", F.pmod(F.xxhash64("_key", "size", "text_crc32"), F.lit(pieces)))
    counts = dealt.groupBy("shard", "_piece").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("shard").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_piece", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("shard", "_piece").orderBy("_key", "size", "text_crc32"))
    return (
        dealt.join(offsets, ["shard", "_piece"])
        .withColumn("slot", (F.col("_before") + within - 1).cast("long"))
        .select(F.col("_key").alias(key), "size", "text_crc32", "shard", "slot", "grown_shard")
    )
