"""Approximate nearest neighbours with learned partitions.

A neighbour graph over a bounded sample is partitioned in balance: k-means gives
the start, then points move to the partition where most of their neighbours are,
as long as it has room. A small network learns, for a vector, how its neighbours
are spread over the partitions. Every row of the table is indexed in the
partition that the network finds most probable; a query goes to several, the
most probable first, and all their rows are compared exactly.

Where the table is so large that partitions would be too, each is parted again
in the same way, by a network of its own, fitted in a task on a bounded sample
of its rows; the networks together are bounded by constants.

Queries and rows meet as blocks of bounded size, so a partition that holds very
many rows is cut into as many blocks as it needs.

Defined cases: vectors that are null, zero, or hold null or non-finite
components, and rows without an id, take no part; vectors of unequal length are
not compared; each query row is a query of its own and leaves out rows with its
id; ties go to the smaller id; fewer than k candidates are all returned; an empty
table gives an empty result; only the id and vector columns and those of the
query condition are read, so other columns and their names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize
from .vectors import kmeans, pack_blocks, sample_vectors, squared_distances, stack, unpack, usable

#: Distinct vectors on which graph, partition and network are fitted, by hash order.
SAMPLE = 12_000
#: Rows a partition should have, about; small tables have FEW_PARTS partitions of SMALL_PART rows or more, none more than MAX_PARTS.
PART_ROWS, MAX_PARTS, SMALL_PART, FEW_PARTS = 1600, 256, 100, 16
#: Where partitions would hold more than twice PART_ROWS, each is parted again, in INNER_PARTS at most, by a network
#: fitted on at most INNER_SAMPLE of its own distinct vectors.
INNER_PARTS, INNER_SAMPLE = 64, 4000
#: A query looks into further outer partitions until those are this probable.
OUTER_PROBABILITY = 0.98
GRAPH_DEGREE = 20
HIDDEN, EPOCHS, BATCH, RATE = 128, 40, 256, 3e-3
#: A query goes on to further partitions until those it has reached are this probable,
PROBABILITY = 0.95
#: and hold so many times k rows.
ENOUGH = 8
BLOCK_ROWS = 1024
#: Results that a task holds before it merges them by query.
MERGE_ROWS = 400_000


def graph(x: np.ndarray, degree: int) -> np.ndarray:
    """For each row of the sample, the rows with the largest inner product."""
    degree = min(degree, len(x) - 1)
    out = np.empty((len(x), degree), dtype=np.int64)
    for a in range(0, len(x), 256):
        s = x[a : a + 256] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 256] = np.argpartition(s, len(x) - degree, axis=1)[:, len(x) - degree :]
    return out


def balanced_partition(x: np.ndarray, near: np.ndarray, parts: int, slack: float = 1.1, rounds: int = 8) -> np.ndarray:
    """A partition of the neighbour graph in parts of at most ``slack`` times the mean size."""
    room = int(np.ceil(slack * len(x) / parts))
    d = squared_distances(x, kmeans(x, parts))
    part, size = np.full(len(x), -1), np.zeros(d.shape[1], dtype=np.int64)
    for i in np.argsort(d.min(axis=1), kind="stable"):
        free = np.where(size < room, d[i], np.inf)
        part[i] = free.argmin()
        size[part[i]] += 1
    votes = np.zeros((len(x), d.shape[1]))
    np.add.at(votes, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 1)
    np.add.at(votes, (near.ravel(), np.repeat(part, near.shape[1])), 1)
    for _ in range(rounds):
        gain = votes.max(axis=1) - votes[np.arange(len(x)), part]
        moved = 0
        for i in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())]:
            new, old = int(np.where(size < room, votes[i], -1).argmax()), part[i]
            if votes[i, new] > votes[i, old]:
                part[i] = new
                size[old] -= 1
                size[new] += 1
                np.add.at(votes, (near[i], old), -1)
                np.add.at(votes, (near[i], new), 1)
                moved += 1
        if not moved:
            break
    return part


@dataclass(frozen=True)
class Router:
    """A network with one hidden layer that gives the probability of each partition."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @property
    def parts(self) -> int:
        return len(self.b2)

    def place(self, x: np.ndarray) -> np.ndarray:
        return self.probabilities(x).argmax(axis=1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    @staticmethod
    def fit(x: np.ndarray, target: np.ndarray, seed: int = 11) -> Router:
        """Cross-entropy against soft targets, by Adam."""
        rng = np.random.default_rng(seed)
        scale = 1 / max(1e-12, float(np.sqrt((x * x).mean())))
        shapes = [(x.shape[1], HIDDEN), (HIDDEN,), (HIDDEN, target.shape[1]), (target.shape[1],)]
        p = [rng.normal(0, np.sqrt(2 / s[0]), s) if len(s) == 2 else np.zeros(s) for s in shapes]
        m, v, step = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes], 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(x))
            for a in range(0, len(x), BATCH):
                at = order[a : a + BATCH]
                xb = x[at] * scale
                h = np.maximum(xb @ p[0] + p[1], 0)
                z = h @ p[2] + p[3]
                z = np.exp(z - z.max(axis=1, keepdims=True))
                g = (z / z.sum(axis=1, keepdims=True) - target[at]) / len(at)
                back = (g @ p[2].T) * (h > 0)
                step += 1
                rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
                for i, grad in enumerate([xb.T @ back, back.sum(axis=0), h.T @ g, g.sum(axis=0)]):
                    m[i] = 0.9 * m[i] + 0.1 * grad
                    v[i] = 0.999 * v[i] + 0.001 * grad * grad
                    p[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        return Router(p[0] * scale, p[1], p[2], p[3])


@dataclass(frozen=True)
class Tree:
    """Two levels of partitions: partition ``i`` of the outer network is parted again by ``inner[i]``, where it has one, in ``width`` at most."""

    outer: Router
    inner: dict[int, Router]
    width: int

    @property
    def parts(self) -> int:
        return self.outer.parts * self.width

    def place(self, x: np.ndarray) -> np.ndarray:
        at = self.outer.place(x)
        out = at * self.width
        for p in np.unique(at):
            if p in self.inner:
                out[at == p] += self.inner[p].place(x[at == p])
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of all partitions; those in outer partitions that are too improbable to be looked into have none."""
        first = self.outer.probabilities(x)
        order = np.argsort(-first, axis=1, kind="stable")
        before = np.cumsum(np.take_along_axis(first, order, axis=1), axis=1) - np.take_along_axis(first, order, axis=1)
        wanted = np.zeros_like(first, dtype=bool)
        np.put_along_axis(wanted, order, before < OUTER_PROBABILITY, axis=1)
        out = np.zeros((len(x), self.parts))
        for p in np.flatnonzero(wanted.any(axis=0)):
            rows = np.flatnonzero(wanted[:, p])
            at = p * self.width
            if p in self.inner:
                inner = self.inner[p]
                out[rows, at : at + inner.parts] = first[rows, p][:, None] * inner.probabilities(x[rows])
            else:
                out[rows, at] = first[rows, p]
        return out


#: Queries whose probabilities are made together: a row has one for each partition.
ROUTED = 256


def routes(router: Router | Tree, x: np.ndarray, sizes: np.ndarray, need: int) -> list[list[int]]:
    return [r for a in range(0, len(x), ROUTED) for r in route(router.probabilities(x[a : a + ROUTED]), sizes, need)]


def learn(x: np.ndarray, parts: int) -> Router | None:
    if parts < 2:
        return None
    near = graph(x, GRAPH_DEGREE)
    part = balanced_partition(x, near, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 1.0)
    target[np.arange(len(x)), part] += 1.0
    return Router.fit(x, target / target.sum(axis=1, keepdims=True))


def route(probabilities: np.ndarray, sizes: np.ndarray, need: int) -> list[list[int]]:
    """The partitions each query visits: the most probable, until they are probable enough and hold ``need`` rows."""
    order = np.argsort(-probabilities, axis=1, kind="stable")
    sure = np.cumsum(np.take_along_axis(probabilities, order, axis=1), axis=1)
    held = np.cumsum(sizes[order], axis=1)
    stop = ((sure >= PROBABILITY) & (held >= need)).argmax(axis=1)
    stop[~((sure >= PROBABILITY) & (held >= need)).any(axis=1)] = order.shape[1] - 1
    return [o[: s + 1].tolist() for o, s in zip(order, stop)]


def parted_again(placed: DataFrame, routers: dict[int, Router | None], sizes: dict[int, np.ndarray]) -> dict[int, Router | Tree | None]:
    """The routers, those whose partitions are too large with networks for each of them: fitted in tasks, on bounded samples, and small enough to be held here."""
    large = {dim: r for dim, r in routers.items() if r and sizes[dim].max() > 2 * PART_ROWS}
    if not large:
        return dict(routers)
    # vectors by hash, so that copies count once; four times as many as a sample of each partition holds
    most = max(int(sizes[d].sum() / (4 * INNER_SAMPLE * r.parts)) for d, r in large.items())
    tried = placed.where(F.col("dim").isin(list(large))).withColumn("h", F.xxhash64("vec")).where(F.pmod(F.col("h"), F.lit(max(1, most))) == 0)
    first = F.row_number().over(Window.partitionBy("dim", "part").orderBy("h", "id"))
    sample = tried.dropDuplicates(["dim", "part", "h"]).withColumn("n", first).where(F.col("n") <= INNER_SAMPLE)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        dim, part = int(rows["dim"].iloc[0]), int(rows["part"].iloc[0])
        x = stack(rows.sort_values("h")["vec"])
        router = learn(x, int(min(INNER_PARTS, sizes[dim][part] // PART_ROWS, len(x) // 50)))
        found = [] if router is None else [(dim, part, router.parts, *[a.astype(np.float32).tobytes() for a in (router.w1, router.b1, router.w2, router.b2)])]
        return pd.DataFrame(found, columns=["dim", "part", "parts", "w1", "b1", "w2", "b2"])

    inner: dict[int, dict[int, Router]] = {dim: {} for dim in large}
    numbers = lambda raw: np.frombuffer(raw, dtype=np.float32).astype(np.float64)
    for r in sample.select("dim", "part", "h", "vec").groupBy("dim", "part").applyInPandas(fit, "dim int, part int, parts int, w1 binary, b1 binary, w2 binary, b2 binary").collect():
        inner[r.dim][r.part] = Router(numbers(r.w1).reshape(r.dim, -1), numbers(r.b1), numbers(r.w2).reshape(-1, r.parts), numbers(r.b2))
    return {dim: Tree(r, inner[dim], INNER_PARTS) if inner.get(dim) else r for dim, r in routers.items()}


def best(queries: list, candidates: list, k: int) -> list[tuple[int, int, int, float]]:
    """``(row, query_id, vec_id, score)``: the k best of a block for each query, scores summed in one fixed order."""
    row, query_id, q = queries[0], np.asarray(queries[1]), stack(queries[2])
    vec_id, y = np.asarray(candidates[0]), stack(candidates[1])
    rough = q @ y.T
    rough[query_id[:, None] == vec_id] = -np.inf
    out = []
    for i in range(len(q)):
        s = rough[i]
        if len(s) > k:
            edge = np.partition(s, len(s) - k)[len(s) - k]
            at = np.flatnonzero(s >= edge - 1e-9 * max(1.0, abs(edge))) if np.isfinite(edge) else np.flatnonzero(s > -np.inf)
        else:
            at = np.flatnonzero(s > -np.inf)
        exact = (y[at] * q[i]).sum(axis=1)
        for j in np.lexsort((vec_id[at], -exact))[:k]:
            out.append((int(row[i]), int(query_id[i]), int(vec_id[at[j]]), float(exact[j])))
    return out


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for the rows of ``vectors`` for which ``is_query`` holds."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & usable("vec"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("dim", F.size("vec")))
    dims = {d: n for d, n in rows.groupBy("dim").count().orderBy(F.desc("count")).limit(64).collect()}
    sample = sample_vectors(rows, SAMPLE)
    routers: dict[int, Router | Tree | None] = {}
    for dim, n in dims.items():
        x = [v for v in sample if len(v) == dim]
        parts = int(min(MAX_PARTS, max(n // PART_ROWS, min(FEW_PARTS, n // SMALL_PART)), len(x) // 50))
        routers[dim] = learn(stack(x), parts) if parts > 1 else None

    vec_type = rows.schema["vec"].dataType.simpleString()

    def indexed() -> DataFrame:
        now = dict(routers)

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for dim, part in batch.groupby("dim"):
                    router = now.get(dim)
                    yield part.assign(part=router.place(stack(part["vec"])) if router else 0)[["dim", "part", "id", "vec"]]

        return materialize(rows.select("dim", "id", "vec").mapInPandas(place, f"dim int, part int, id long, vec {vec_type}"))

    def counted(placed: DataFrame) -> dict[int, np.ndarray]:
        sizes = {dim: np.zeros(r.parts if r else 1, dtype=np.int64) for dim, r in routers.items()}
        for dim, part, n in placed.groupBy("dim", "part").count().where(F.col("dim").isin(list(sizes))).collect():
            sizes[dim][part] = n
        return sizes

    placed = indexed()
    sizes = counted(placed)
    deeper = parted_again(placed, routers, sizes)
    if any(isinstance(r, Tree) for r in deeper.values()):
        routers = deeper
        placed = indexed()
        sizes = counted(placed)

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                router = routers.get(dim)
                to = routes(router, stack(part["vec"]), sizes[dim], ENOUGH * k + 1) if router else [[0]] * len(part)
                yield part.assign(parts=to)[["dim", "row", "id", "vec", "parts"]]

    asked = rows.where("asks").select("dim", "row", "id", "vec").mapInPandas(visit, f"dim int, row long, id long, vec {vec_type}, parts array<int>")
    asked = asked.select("dim", F.explode("parts").alias("part"), "row", "id", "vec")
    keys = ["dim", "part"]
    questions = pack_blocks(asked, keys, "row", BLOCK_ROWS // 4).withColumnRenamed("payload", "asked").withColumnRenamed("block", "asked_block")
    met = questions.join(pack_blocks(placed, keys, "id", BLOCK_ROWS), keys).select("asked", "payload")

    def merged(parts: list[pd.DataFrame]) -> pd.DataFrame:
        ordered = pd.concat(parts).sort_values(["row", "score", "vec_id"], ascending=[True, False, True])
        return ordered.groupby("row", sort=False).head(k)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The k best of a query among all blocks that this task has seen, not among each."""
        kept: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            for q, c in zip(unpack(batch["asked"]), unpack(batch["payload"])):
                kept.append(pd.DataFrame(best(q, c, k), columns=["row", "query_id", "vec_id", "score"]))
                size += len(kept[-1])
                if size >= MERGE_ROWS:
                    kept = [merged(kept)]
                    size = len(kept[0])
                    if size > MERGE_ROWS // 2:  # so many queries meet here that holding them all would not be bounded
                        yield kept.pop()
                        size = 0
        if kept:
            yield merged(kept)

    found = met.mapInPandas(search, "row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
