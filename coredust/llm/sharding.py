"""Sharding by a hierarchical weighted hash tree (region / rack / shard).

At every level each child draws ``-ln(u) / weight`` with ``u`` a uniform hash of (doc_id, child); the smallest draw
wins, so a child is chosen in proportion to its weight, and changing one child's weight moves rows only to or from that
child. A shard added as a subtree of its own therefore takes rows only into itself; a weight changed deep inside a
region moves rows only as far as the weights above it change.

``tree_of`` derives the tree from the number of shards alone, so that doc_id and that number decide. The first ``BASE``
shards fill a fixed layout of regions and racks; every later one is a region of its own. With fewer shards than that the
layout is the same, and a row that descends to a shard which is not there draws again with another salt, at most
``ATTEMPTS`` times, then among the shards that are there. So one more shard takes rows only into itself at any number.

Edge cases: a null text has size 1 and the CRC-32 of no bytes (0); a null doc_id is a key like any other; repeated rows
go to the same shard and get slots of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import bucket_prefix_sums, materialize

#: Buckets in which slots are counted; rows of a shard are sorted within a bucket only.
SLOT_BUCKETS = 4096
#: Shards of the fixed layout (regions x racks x shards a rack), and descents before a flat draw.
REGIONS, RACKS, BASE, ATTEMPTS = 4, 2, 16, 16


@dataclass(frozen=True)
class Node:
    """A region or rack (with children) or a shard (a leaf with its number)."""

    name: str
    weight: float
    children: tuple["Node", ...] = ()
    shard: int | None = None


def balanced_tree(shards: int, regions: int = REGIONS, racks: int = RACKS) -> Node:
    """``regions * racks`` racks that share ``shards`` leaves evenly; every weight is the number of leaves below."""
    per = [shards // (regions * racks) + (i < shards % (regions * racks)) for i in range(regions * racks)]
    ids, out = iter(range(shards)), []
    for r in range(regions):
        below = []
        for k in range(racks):
            leaves = tuple(Node(f"s{i}", 1.0, shard=i) for i in (next(ids) for _ in range(per[r * racks + k])))
            if leaves:
                below.append(Node(f"r{r}k{k}", float(len(leaves)), leaves))
        if below:
            out.append(Node(f"r{r}", sum(x.weight for x in below), tuple(below)))
    return Node("root", float(shards), tuple(out))


def grown(tree: Node, shard: int) -> Node:
    """``tree`` with one more shard, in a region of its own: every other weight stays, so rows move only into it."""
    leaf = Node(f"s{shard}", 1.0, shard=shard)
    region = Node(f"g{shard}", 1.0, (Node(f"g{shard}k0", 1.0, (leaf,)),))
    return Node(tree.name, tree.weight + 1.0, (*tree.children, region))


def tree_of(shards: int) -> Node:
    """The tree for a number of shards, by one rule that only ever appends; below ``BASE`` it is that for ``BASE``."""
    tree = balanced_tree(BASE)
    for i in range(BASE, shards):
        tree = grown(tree, i)
    return tree


def placed(key: Column, shards: int) -> Column:
    """The shard, from 0 up, that key and number of shards decide."""
    tree = tree_of(shards)
    if shards >= BASE:
        return shard_of(key, tree)
    flat = Node("flat", float(shards), tuple(Node(f"s{i}", 1.0, shard=i) for i in range(shards)))
    salts = F.array(F.lit(""), *(F.lit(f"#{a}") for a in range(1, ATTEMPTS)))

    def descend(found: Column, salt: Column) -> Column:
        return F.when((found >= 0) & (found < shards), found).otherwise(shard_of(key, tree, salt))

    last = F.aggregate(salts, F.lit(-1), descend)
    return F.when(last < shards, last).otherwise(shard_of(key, flat, F.lit("#flat")))


def _levels(tree: Node) -> list[list[Node]]:
    levels, now = [], [tree]
    while any(n.children for n in now):
        levels.append(now)
        now = [c for n in now for c in n.children]
    return levels


def shard_of(key: Column, tree: Node, salt: Column | None = None) -> Column:
    """The shard of a key: descend level by level, keeping the child with the smallest weighted draw."""
    at = F.lit(0)
    for level in _levels(tree):
        first, kids = 0, []
        for node in level:
            if not node.children:
                raise ValueError("all shards must be at the same depth")
            kids.append((first, node.children))
            first += len(node.children)

        def draw(position: int, child: Node) -> Column:
            # 53 bits of the hash, moved off zero, as a number in (0, 1)
            u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(child.name) if salt is None else F.concat(F.lit(child.name), salt)), 11).cast("double") + 0.5) / float(1 << 53)
            return F.struct((-F.log(u) / child.weight).alias("draw"), F.lit(position).alias("at"))

        picks = [F.array_min(F.array(*(draw(start + i, c) for i, c in enumerate(children))))["at"] for start, children in kids]
        if len(picks) == 1:
            at = picks[0]
        else:
            chosen = F.when(at == 0, picks[0])
            for i, p in enumerate(picks[1:], 1):
                chosen = chosen.when(at == i, p)
            at = chosen
    leaves = [c.shard for n in _levels(tree)[-1] for c in n.children]
    return F.element_at(F.array(*(F.lit(x) for x in leaves)), at + 1).cast("int")


def shard_documents(docs: DataFrame, shards: int, law: str = "key") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; slots count from 0 without gaps in every shard.

    Rows equal in all of these but the slot are counted first and numbered together, so repeated rows are no hot key.
    """
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    key = ["doc_id", "size", "text_crc32"]
    rows = docs.select("doc_id", (F.length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.withColumns({
        "shard": placed(F.col("doc_id"), shards), "grown_shard": placed(F.col("doc_id"), shards + 1),
        "_bucket": F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(SLOT_BUCKETS)).cast("int"),
    })
    rows = materialize(rows, "shards")
    offsets = bucket_prefix_sums(rows, ["shard"], "_bucket", {"_off": F.col("_n")})
    before = Window.partitionBy("shard", "_bucket").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(offsets, ["shard", "_bucket"]).withColumn("_first", F.col("_off") + F.coalesce(F.sum("_n").over(before), F.lit(0)))
    out = out.withColumn("slot", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_n") - 1)))
    return out.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", F.col("slot").cast("long"), "grown_shard")


def write_shards(docs: DataFrame, tree: Node, path: str) -> None:
    """Write every row of ``docs`` as Parquet under ``path``, one folder a shard, several files a folder."""
    marked = docs.withColumn("_shard", shard_of(F.col("doc_id"), tree))
    marked.write.partitionBy("_shard").parquet(path)


def shard_sizes(sharded: DataFrame) -> DataFrame:
    """Rows and bytes of every shard, to compare with the tree's weights."""
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("n_bytes"))


__all__: Sequence[str] = ("Node", "balanced_tree", "grown", "tree_of", "placed", "shard_of", "shard_documents", "write_shards", "shard_sizes")
