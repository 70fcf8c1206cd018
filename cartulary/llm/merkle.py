"""Merkle manifest of a table: a tree for each group of rows, and one over the groups.

Rows become leaves, leaves of a group ascend by id, and every ``ARITY``
consecutive nodes become the digest of their digests until one is left, the
group's subroot; subroots in the order of their groups give the root the same
way. A proof is the siblings of a leaf, run by run up to the root.

Places are counted without gathering a group: rows are range partitioned by
group and id, and each partition's count is added to the places of those after
it. From then on a *superblock*, ``ARITY ** LEVELS`` consecutive nodes of a
group, is the unit of work, so that a group of any size is spread over tasks.
Going up, a superblock is reduced to one node, layer by layer. Going down, the
nodes of a layer and the outer path of their superblock are cogrouped by
superblock in ``applyInPandas``, which finishes the local reduction, joins the
proofs and folds them. Layers are written to the shared folder, digests and not
texts, so a lost executor repeats a layer at most.

Defined cases: a null field counts as ``-``, so that it differs from an empty
one; a null group comes before all others, a null id before all ids of its
group; rows with equal ids go by leaf and claim; repeated rows are leaves each
for itself; a group of one row is its own subroot, and a table of one group has
that group's subroot as its root; a claim that is null is the leaf itself; texts
of any length count whole; an empty table gives an empty result and has no root;
only the columns named are read, so others and their names do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

ARITY = 16
#: Levels of the tree that one superblock spans.
LEVELS = 2
BLOCK = ARITY**LEVELS
NODES = "group string, place long, nodes long, digest string"
PATHS = "group string, place long, path array<string>, subroot string"


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(*fields: Column) -> Column:
    """The leaf of a row: a digest of its fields, each ``-`` if null, else byte count, ``:`` and value."""
    coded = lambda value: F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))
    return F.sha2(F.concat(*[coded(f.cast("string")) for f in fields]), 256)


def climb(digests: list[str], nodes: int) -> list[list[str]]:
    """The levels of a superblock, from its nodes to the one they become; ``nodes``: how many the whole layer of the group has."""
    levels = [digests]
    for _ in range(LEVELS):
        if nodes == 1:
            break
        digests = [digest(digests[i : i + ARITY]) for i in range(0, len(digests), ARITY)]
        nodes = -(-nodes // ARITY)
        levels.append(digests)
    return levels


def layer_above(nodes: int) -> int:
    """How many nodes the layer above has."""
    return 1 if nodes <= ARITY else -(-nodes // BLOCK)


def path_of(levels: list[list[str]], i: int) -> list[str]:
    """For each level what stands left and right of the node's own in its run."""
    path = []
    for level in levels[:-1]:
        run, at = level[i // ARITY * ARITY :][:ARITY], i % ARITY
        path += ["".join(run[:at]), "".join(run[at + 1 :])]
        i //= ARITY
    return path


def fold(leaf: str, path: list[str]) -> str:
    """The root that a leaf and the siblings of a path give."""
    for left, right in zip(path[::2], path[1::2]):
        leaf = digest((left, leaf, right))
    return leaf


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``place`` (gapless from 0 in each group, by ``order``) and ``nodes`` (rows of the group), stored."""
    cols = [group, *order]
    stored = materialize(rows.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33).alias("__part")
    same = Window.partitionBy(group)
    # one row for each group and partition, so a group has as many as there are partitions at most
    runs = stored.groupBy(group, part).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(same.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(group, "__part", "__first", before.alias("__before"), F.sum("__n").over(same).alias("nodes"))
    placed = stored.withColumn("__part", part).join(runs, [group, "__part"])
    return materialize(placed.withColumn("place", F.col("__before") + F.col("__at") - F.col("__first")).drop("__at", "__part", "__first", "__before"))


def _block() -> Column:
    return F.floor(F.col("place") / BLOCK).cast("long").alias("block")


def _reduce(nodes: pd.DataFrame) -> pd.DataFrame:
    nodes = nodes.sort_values("place")
    group, place, count = nodes["group"].iloc[0], int(nodes["place"].iloc[0]), int(nodes["nodes"].iloc[0])
    return pd.DataFrame({"group": [group], "place": [place // BLOCK], "nodes": [layer_above(count)], "digest": [climb(nodes["digest"].tolist(), count)[-1][0]]})


def tower(leaves: DataFrame) -> list[DataFrame]:
    """The layers above ``leaves`` (columns of ``NODES``), itself first; in the last one each group has one node."""
    layers = [leaves]
    most = leaves.agg(F.max("nodes")).first()[0] or 0
    while most > 1:
        layers.append(materialize(layers[-1].select("group", "place", "nodes", "digest").groupBy("group", _block()).applyInPandas(_reduce, NODES)))
        most = layer_above(most)
    return layers


def _paths(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    nodes = nodes.sort_values("place")
    levels = climb(nodes["digest"].tolist(), int(nodes["nodes"].iloc[0]))
    above = list(outer["path"].iloc[0])
    return pd.DataFrame({"group": nodes["group"].tolist(), "place": nodes["place"].tolist(), "path": [path_of(levels, i) + above for i in range(len(nodes))], "subroot": outer["subroot"].iloc[0]})


def descend(layers: list[DataFrame], outer: DataFrame) -> DataFrame:
    """The outer paths of the superblocks of ``layers[0]``, from those of the one node that each group has in the last layer."""
    for layer in layers[-2:0:-1]:
        nodes = layer.select("group", "place", "nodes", "digest").groupBy("group", _block())
        outer = materialize(nodes.cogroup(outer.groupBy("group", F.col("place").alias("block"))).applyInPandas(_paths, PATHS))
    return outer


@dataclass(frozen=True)
class Manifest:
    """The layers of the groups' trees, those of the tree over the groups, and the root."""

    leaves: DataFrame
    groups: list[DataFrame]
    top: list[DataFrame]
    root: str | None

    def subroots(self) -> DataFrame:
        """``(group, rows, subroot)``: the small table to keep beside the data; ``group`` is the key of ``group_key``."""
        rows = self.groups[0].groupBy("group").agg(F.count("*").alias("rows"))
        return rows.join(self.groups[-1].select("group", F.col("digest").alias("subroot")), "group")


def group_key(group: Column) -> Column:
    """A text that sorts as groups do: null first, then by the bytes of the value."""
    return F.coalesce(F.concat(F.lit(">"), group.cast("string")), F.lit(""))


def manifest(rows: DataFrame, id_col: str, group_col: str, leaf_col: str, claim_col: str | None = None) -> Manifest:
    """The manifest of ``rows``, whose leaves are in ``leaf_col``; ``claim_col`` has what is folded instead of the leaf."""
    claim = F.col(claim_col) if claim_col else F.lit(None).cast("string")
    leaves = ranked(rows.select(group_key(F.col(group_col)).alias("group"), F.col(id_col).alias("id"), F.col(leaf_col).alias("digest"), claim.alias("claim")), "group", ["id", "digest", "claim"])
    groups = tower(leaves)
    subroots = groups[-1].select(F.lit("").alias("group"), F.col("group").alias("of"), "digest")
    top = tower(ranked(subroots, "group", ["of"]))
    found = top[-1].select("digest").first()
    return Manifest(leaves, groups, top, found[0] if found else None)


def prove(tree: Manifest) -> DataFrame:
    """``(id, leaf, subroot, root, proof_sha256, folded_root, verified)``, a row for each row of the manifest.

    ``proof_sha256`` digests the siblings, level by level and left to right;
    ``folded_root`` is what the claim and those siblings fold to.
    """
    id_type, root = tree.leaves.schema["id"].dataType, tree.root
    start = tree.top[-1].select("group", "place", F.array().cast("array<string>").alias("path"), F.lit("").alias("subroot"))
    above = descend(tree.top, start)
    names = tree.top[0].select("group", "place", "nodes", "digest", "of").groupBy("group", _block())

    def of_groups(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("place")
        return _paths(nodes, outer).assign(group=nodes["of"].tolist(), place=0, subroot=nodes["digest"].tolist())

    outer = materialize(names.cogroup(above.groupBy("group", F.col("place").alias("block"))).applyInPandas(of_groups, PATHS))
    outer = descend(tree.groups, outer)

    def finish(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("place")
        leaves = nodes["digest"].tolist()
        levels = climb(leaves, int(nodes["nodes"].iloc[0]))
        above = list(outer["path"].iloc[0])
        rows = []
        for i, (id_, leaf, claim) in enumerate(zip(nodes["id"], leaves, nodes["claim"])):
            path = path_of(levels, i) + above
            folded = fold(claim if isinstance(claim, str) else leaf, path)
            rows.append((id_, leaf, outer["subroot"].iloc[0], root, digest(path), folded, folded == root))
        return pd.DataFrame(rows, columns=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    result = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    # ids as texts: pandas would turn whole numbers beside nulls into floats
    nodes = tree.leaves.select("group", "place", "nodes", "digest", F.col("id").cast("string").alias("id"), "claim")
    found = nodes.groupBy("group", _block()).cogroup(outer.groupBy("group", F.col("place").alias("block"))).applyInPandas(finish, result)
    return found.withColumn("id", F.col("id").cast(id_type))
