"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard. At each node every child draws
``-ln(u) / weight`` with ``u`` hashed from the document's id and the child's
name, and the smallest draw wins, so a child wins in proportion to its weight
and a draw depends on nothing but the id, the name and the weight. If weights
change in one subtree, only documents that enter or leave that subtree move.
Growth adds a shard as a region of its own: the draws among all older nodes stay
as they were, so the new shard takes documents only into itself.

The law is ``key``: id and shard count decide. Slots are gapless in each shard;
they are counted by hash buckets of a shard (of id and text), so that no task has
a whole shard; texts are read once, and what is counted is stored.

Defined cases: a null id draws like the text "null"; a null text has no bytes;
repeated rows go to the same shard and get slots of their own, in any order;
equal draws go to the child whose name comes first; texts of any length count
whole; an empty table gives an empty result; only the id and text columns are
read, so other columns and their names do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

#: Bytes that a row takes besides its text.
ROW_BYTES = 16
#: Hash buckets of a shard in which slots are counted.
SLOT_BUCKETS = 64


@dataclass(frozen=True)
class Node:
    """A subtree; ``shard`` is set in leaves, whose weight is their own."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight

    @property
    def shards(self) -> int:
        return sum(c.shards for c in self.children) if self.children else 1

    def grown(self, weight: float = 1.0) -> Node:
        """The tree with one more shard, in a region and rack of its own."""
        n = self.shards
        name = f"region{len(self.children)}"
        leaf = Node(f"{name}/rack0/shard{n}", shard=n, own_weight=weight)
        return replace(self, children=(*self.children, Node(name, (Node(f"{name}/rack0", (leaf,)),))))


def hash_tree(regions: int = 2, racks: int = 4, shards: int = 5) -> Node:
    """An even tree; shards are numbered in order."""
    top = []
    for r in range(regions):
        inner = []
        for k in range(racks):
            base = (r * racks + k) * shards
            inner.append(Node(f"region{r}/rack{k}", tuple(Node(f"region{r}/rack{k}/shard{base + s}", shard=base + s) for s in range(shards))))
        top.append(Node(f"region{r}", tuple(inner)))
    return Node("root", tuple(top))


def uniform(key: Column, name: Column) -> Column:
    """A hash of key and node name, evenly in (0, 1)."""
    digits = F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), name)), 1, 13), 16, 10)
    return (digits.cast("double") + 0.5) / F.lit(float(1 << 52))


def inner_nodes(node: Node) -> list[Node]:
    return [node, *(x for c in node.children for x in inner_nodes(c))] if node.children else []


def depth(node: Node) -> int:
    return 1 + max(map(depth, node.children)) if node.children else 0


def descend(tree: Node, key: Column) -> Column:
    """The shard that ``key`` reaches; at each level only the children of the node reached draw."""
    child = lambda c: F.struct(F.lit(c.name).alias("name"), F.lit(float(c.weight)).alias("weight"), F.lit(-1 if c.shard is None else c.shard).alias("shard"))
    children = F.create_map(*[x for n in inner_nodes(tree) for x in (F.lit(n.name), F.array(*map(child, n.children)))])
    draw = lambda c: F.struct((-F.log(uniform(key, c["name"])) / c["weight"]).alias("draw"), c["name"].alias("name"), c["shard"].alias("shard"))
    winner = F.lit(tree.name)
    for level in range(depth(tree)):
        winner = F.array_min(F.transform(F.element_at(children, winner), draw))
        winner = winner["shard"] if level + 1 == depth(tree) else winner["name"]
    return winner


def shard_of(id_col: str, tree: Node) -> Column:
    return descend(tree, F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("int")


def assign_shards(docs: DataFrame, tree: Node, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, size, text_crc32, shard, slot, grown_shard)``, a row for each row of ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        shard_of(id_col, tree).alias("shard"),
        shard_of(id_col, tree.grown()).alias("grown_shard"),
    )
    # the text takes part in the bucket, so that rows without an id, or with the same one, do not meet in one
    key = F.concat(F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit("|"), F.col("text_crc32").cast("string"))
    rows = materialize(narrow.withColumn("bucket", F.conv(F.substring(F.md5(key), 1, 4), 16, 10).cast("int") % SLOT_BUCKETS))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # shards x SLOT_BUCKETS rows at most, whatever the input: small enough to send everywhere
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("id", "text_crc32", "size"))
    placed = rows.withColumn("place", place).join(F.broadcast(offsets), ["shard", "bucket"])
    return placed.select("id", "size", "text_crc32", "shard", (F.col("before") + F.col("place") - 1).cast("long").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, tree: Node, path: str, id_col: str = "doc_id") -> None:
    """Write ``docs`` as Parquet, a folder for each shard."""
    docs.withColumn("shard", shard_of(id_col, tree)).write.partitionBy("shard").parquet(path)
