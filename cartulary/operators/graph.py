"""Graph operators over edge tables: redirect closure, components, bounded search."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import drop_path, materialize, scratch_dir
from .ordered import running


def redirect_closure(hops: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """``(src, dst, cyclic)``: where each source ends; of several hops of a source the smallest target counts.

    Pointer doubling: each round joins the map with itself, so chains of length
    n take log n rounds. A chain has a source at every distance from its end, so
    while any chain is open the number of sources that still move falls each
    round; once it does not, what still rests on a source is in a cycle or leads
    into one.
    """
    one = materialize(hops.groupBy(F.col(source).alias("src")).agg(F.min(target).alias("dst")))
    moving, now = None, one
    while True:
        far = now.select(F.col("src").alias("via"), F.col("dst").alias("far"))
        now = materialize(now.join(far, F.col("dst") == F.col("via"), "left").select("src", F.coalesce("far", "dst").alias("dst"), F.col("via").isNotNull().alias("moved")))
        before, moving = moving, now.where("moved").count()
        now = now.drop("moved")
        if moving in (0, before):
            break
    known = one.select(F.col("src").alias("known"))
    return now.join(known, F.col("dst") == F.col("known"), "left").select("src", "dst", F.col("known").isNotNull().alias("cyclic"))


def reachable(edges: DataFrame, roots: DataFrame, depth: int, a: str = "src", b: str = "dst") -> DataFrame:
    """``(node, depth)``: breadth-first search from ``roots`` (column node), at most ``depth`` steps; each step stores what it finds alone."""
    levels = [roots.select("node", F.lit(0).alias("depth"))]
    for step in range(1, depth + 1):
        front = levels[-1].join(edges, F.col("node") == F.col(a)).select(F.col(b).alias("node")).distinct()
        for seen in levels:
            front = front.join(seen.select("node"), "node", "left_anti")
        levels.append(materialize(front.withColumn("depth", F.lit(step))))
    return reduce(DataFrame.unionByName, levels)


def budgeted_crawl(roots: DataFrame, links: DataFrame, pages: DataFrame, depth: int, max_pages: int, max_bytes: int) -> DataFrame:
    """``(node, depth, place, outcome)``: what a crawl in order of discovery reads before its budgets are spent.

    ``roots``: node, place. ``links``: src, pos, dst. ``pages``: node, bytes; a
    node without a page is missing and costs nothing. Nodes are met level by
    level, by the place of the page that names them first and the position of
    the link. A node is left out ("over the page limit", "over the byte limit")
    once the pages or bytes read before it reach the budget, and one named on
    the last level is "beyond depth"; only pages that were read name others.
    Places and budgets are running totals over range partitions, so that no
    task holds a level; the levels met so far are stored, and only new ones are
    written.
    """
    known = pages.groupBy("node").agg(F.max("bytes").alias("bytes"))
    front = roots.groupBy("node").agg(F.min(F.struct(F.lit(0).cast("long").alias("from"), F.col("place").cast("long").alias("pos"))).alias("by"))
    levels: list[DataFrame] = []
    places = spent_pages = spent_bytes = 0
    for level in range(depth + 1):
        met = front.select("node", "by.from", "by.pos").join(known, "node", "left").withColumns({"one": F.lit(1).cast("long"), "page": F.col("bytes").isNotNull().cast("long"), "size": F.coalesce("bytes", F.lit(0)).cast("long")})
        counted = running(met, [], ["from", "pos", "node"], {"rank": ("one", "sum"), "read": ("page", "sum"), "total": ("size", "sum")})
        before_pages, before_bytes = F.col("read") - F.col("page") + spent_pages, F.col("total") - F.col("size") + spent_bytes
        outcome = F.when(before_pages >= max_pages, "over the page limit").when(before_bytes >= max_bytes, "over the byte limit").when(F.col("page") == 0, "missing").otherwise("page")
        levels.append(materialize(counted.select("node", F.lit(level).alias("depth"), (F.col("rank") + places).alias("place"), outcome.alias("outcome"), F.when(outcome == "page", F.col("size")).otherwise(0).alias("size"))))
        now = levels[-1]
        done = now.agg(F.count("*"), F.count_if(F.col("outcome") == "page"), F.coalesce(F.sum("size"), F.lit(0))).first()
        places, spent_pages, spent_bytes = places + done[0], spent_pages + done[1], spent_bytes + done[2]
        named = now.where("outcome = 'page'").join(links, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min(F.struct(F.col("place").alias("from"), F.col("pos").cast("long").alias("pos"))).alias("by"))
        for seen in levels:
            named = named.join(seen.select("node"), "node", "left_anti")
        front = named
        if not done[1]:
            break
    met = front.select("node", "by.from", "by.pos").withColumn("one", F.lit(1).cast("long"))
    beyond = running(met, [], ["from", "pos", "node"], {"rank": ("one", "sum")}).select("node", F.lit(len(levels)).alias("depth"), (F.col("rank") + places).alias("place"), F.lit("beyond depth").alias("outcome"))
    return reduce(DataFrame.unionByName, [x.drop("size") for x in levels], beyond)


def contract_edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replace the edges of each Arrow batch by a star forest with the same components."""
    for batch in batches:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (up := parent.setdefault(root, root)) != root:
                root = up
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for a, b in zip(batch["hi"].tolist(), batch["lo"].tolist()):
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        pairs = [(x, find(x)) for x in parent]
        pairs = [(x, r) for x, r in pairs if x != r]
        yield pd.DataFrame(pairs, columns=["hi", "lo"], dtype="int64")


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 80) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; component is the smallest node reached.

    Alternating large-star and small-star steps: each is a grouped minimum
    (combined map-side) joined back to the edges, so a node with very many
    neighbours is never gathered, and Spark can split its join partition.
    Every round is written to the shared folder; a lost executor repeats one
    round at most.
    """
    spark = edges.sparkSession
    now = (
        edges.select(F.greatest(a, b).cast("long").alias("hi"), F.least(a, b).cast("long").alias("lo"))
        .where("hi <> lo")
        .mapInPandas(contract_edges, "hi long, lo long")
        .distinct()
    )
    path = scratch_dir(spark)
    now.write.parquet(path)
    before = None
    for _ in range(max_rounds):
        now = spark.read.schema("hi long, lo long").parquet(path)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if tuple(seen) == before or seen[0] == 0:
            break
        before = tuple(seen)
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(low, "hi")
            .select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
            .select("e.hi", "e.lo")
            .where("hi <> lo")
            .distinct()
        )
        new = scratch_dir(spark)
        small.write.parquet(new)
        drop_path(spark, path)
        path = new
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return stars.union(now.select(F.col("lo").alias("node"), F.col("lo").alias("component"))).distinct()
