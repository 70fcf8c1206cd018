"""Embedding near-duplicates by product quantisation.

Equal vectors of a label are one representative. Unit representatives go to the
nearest of some coarse centres, and the residual is coded in subspaces. Lists
are cut into blocks of bounded size; two blocks meet if a link can exist between
their lists: a vector within the threshold's chord of a query lies in a list
only if the difference of the query's squared distances to the two centres is at
most twice the chord times the centres' distance, so the probes suffice and none
is lost. In a pair of blocks, table look-ups give asymmetric distances; with the
kept coding error they bound the true distance, and what may be a link is
compared by exact cosine. A pair of blocks returns each vector's number of links
and a spanning star, never its pairs.

Defined cases: vectors that are null, zero, or hold null or non-finite
components, and vectors without a label, link with nothing; vectors of unequal
length are not compared; repeated rows link with each other; a null id counts as
larger than any; an empty table gives an empty result; only the id, label and
vector columns are read, so other columns and their names do not matter.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, materialize
from .vectors import kmeans, nearest_centres, pack_blocks, squared_distances, stack, unpack, usable

THRESHOLD = 0.98
#: Representatives on which the quantisers are fitted, by hash order: SAMPLE, more for many lists, at most MAX_SAMPLE.
SAMPLE, LIST_SAMPLE, MAX_SAMPLE = 8192, 16, 65536
#: Lists grow with the square root of the representatives; MAX_LISTS are reached at a thousand million of them.
LISTS_PER_ROOT, MAX_LISTS = 1 / 8, 4096
#: Vectors that are coded at a time.
CODE_ROWS = 1024
SUBSPACE_DIMS, CODES = 4, 64
BLOCK_ROWS = 512
SLACK = 1e-9


@dataclass(frozen=True)
class Quantiser:
    """Coarse centres, and code books of the residual's subspaces (column ranges ``cuts``)."""

    centres: np.ndarray
    cuts: tuple[tuple[int, int], ...]
    books: tuple[np.ndarray, ...]

    @staticmethod
    def fit(x: np.ndarray, lists: int) -> Quantiser:
        centres = kmeans(x, lists)
        rest = x - centres[nearest_centres(x, centres)[0]]
        at = list(range(0, x.shape[1], SUBSPACE_DIMS))
        cuts = tuple((a, min(a + SUBSPACE_DIMS, x.shape[1])) for a in at)
        return Quantiser(centres, cuts, tuple(kmeans(rest[:, a:b], CODES) for a, b in cuts))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and coding error of each vector."""
        cell = squared_distances(x, self.centres).argmin(axis=1)
        rest = x - self.centres[cell]
        codes = np.stack([squared_distances(rest[:, a:b], book).argmin(axis=1) for (a, b), book in zip(self.cuts, self.books)], axis=1).astype(np.uint8)
        back = np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], axis=1)
        return cell, codes, np.linalg.norm(rest - back, axis=1)

    def probes(self, x: np.ndarray, chord: float) -> np.ndarray:
        """For each vector, the lists that can hold one within ``chord`` of it (boolean matrix)."""
        d = squared_distances(x, self.centres)
        own = d.argmin(axis=1)
        between = np.sqrt(squared_distances(self.centres, self.centres))
        return d - d[np.arange(len(x)), own][:, None] <= 2 * chord * between[own] + SLACK

    def asymmetric(self, x: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Distances from each of ``x`` to the coded vectors of a list, by table look-up."""
        rest = x - self.centres[cell]
        total = np.zeros((len(x), len(codes)))
        for m, ((a, b), book) in enumerate(zip(self.cuts, self.books)):
            total += squared_distances(rest[:, a:b], book)[:, codes[:, m]]
        return np.sqrt(total)


def compare(a: list, b: list, same: bool, quantiser: Quantiser | None, cell_b: int, chord: float, threshold: float) -> list[tuple[int, int, int]]:
    """``(rid, links, root)`` of the linked vectors of two blocks."""
    (rid_a, n_a, vec_a, *_), (rid_b, n_b, vec_b, codes_b, error_b) = a, b
    x, y = stack(vec_a), stack(vec_b)
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    maybe = np.ones((len(x), len(y)), dtype=bool)
    if quantiser is not None:
        codes = np.stack([np.frombuffer(c, dtype=np.uint8) for c in codes_b])
        maybe = quantiser.asymmetric(x / nx[:, None], cell_b, codes) <= chord + np.asarray(error_b) + 1e-6
    rows, cols = np.flatnonzero(maybe.any(axis=1)), np.flatnonzero(maybe.any(axis=0))
    if not len(rows):
        return []
    link = ((x[rows] @ y[cols].T) / (nx[rows][:, None] * ny[cols]) >= threshold) & maybe[np.ix_(rows, cols)]
    rid_a, n_a, rid_b, n_b = np.asarray(rid_a)[rows], np.asarray(n_a)[rows], np.asarray(rid_b)[cols], np.asarray(n_b)[cols]
    if same:
        link &= rid_a[:, None] != rid_b
    big = np.iinfo(np.int64).max
    root_a, root_b = rid_a.copy(), rid_b.copy()
    while True:
        next_a = np.minimum(root_a, np.where(link, root_b, big).min(axis=1))
        next_b = np.minimum(root_b, np.where(link, next_a[:, None], big).min(axis=0))
        if np.array_equal(next_a, root_a) and np.array_equal(next_b, root_b):
            break
        root_a, root_b = next_a, next_b
    out = [(int(r), int(k), int(t)) for r, k, t in zip(rid_a, link @ n_b, root_a) if k]
    if not same:
        out += [(int(r), int(k), int(t)) for r, k, t in zip(rid_b, n_a @ link, root_b) if k]
    return out


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """``(id, n_links, component_id)``, a row for each row of ``vectors``."""
    chord = float(np.sqrt(2 - 2 * threshold))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    reps = rows.where(F.col("label").isNotNull() & usable("vec")).groupBy("label", "vec").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    reps = materialize(reps.withColumn("rid", F.monotonically_increasing_id()))
    lists = int(min(MAX_LISTS, max(1, LISTS_PER_ROOT * reps.count() ** 0.5)))
    by_dim = defaultdict(list)
    for (vec,) in reps.select("vec").orderBy(F.xxhash64("vec")).limit(min(MAX_SAMPLE, max(SAMPLE, LIST_SAMPLE * lists))).collect():
        by_dim[len(vec)].append(vec)
    quantisers = {}
    for dim, some in by_dim.items():
        x = stack(some)
        quantisers[dim] = Quantiser.fit(x / np.linalg.norm(x, axis=1)[:, None], min(lists, max(1, len(some) // 8)))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        alike = (group for batch in batches for group in batch.groupby(batch["vec"].map(len)))
        for dim, part in ((dim, rows[a : a + CODE_ROWS]) for dim, rows in alike for a in range(0, len(rows), CODE_ROWS)):
            out = part[["label", "rid", "n", "vec"]].assign(dim=dim, cell=0, codes=b"", error=0.0, probes=[[0]] * len(part))
            if dim in quantisers:
                x = stack(part["vec"])
                x /= np.linalg.norm(x, axis=1)[:, None]
                cell, codes, error = quantisers[dim].encode(x)
                near = quantisers[dim].probes(x, chord)
                out = out.assign(cell=cell, codes=[c.tobytes() for c in codes], error=error, probes=[np.flatnonzero(p).tolist() for p in near])
            yield out[["label", "dim", "cell", "rid", "n", "vec", "codes", "error", "probes"]]

    types = {f.name: f.dataType.simpleString() for f in reps.schema}
    coded = materialize(reps.mapInPandas(encode, f"label {types['label']}, dim int, cell int, rid long, n long, vec {types['vec']}, codes binary, error double, probes array<int>"))
    keys = ["label", "dim", "cell"]
    blocks = materialize(pack_blocks(coded.drop("probes"), keys, "rid", BLOCK_ROWS))
    # which lists meet, and then which blocks: narrow rows alone
    meets = coded.select(*keys, F.explode("probes").alias("probe")).distinct()
    names = blocks.select(*keys, "block")
    from_names = meets.join(names, keys).select("label", "dim", F.col("cell").alias("cell_a"), F.col("block").alias("block_a"), F.col("probe").alias("cell_b"))
    to_names = names.select("label", "dim", F.col("cell").alias("cell_b"), F.col("block").alias("block_b"))
    one, other = F.struct(F.col("cell_a").alias("cell"), F.col("block_a").alias("block")), F.struct(F.col("cell_b").alias("cell"), F.col("block_b").alias("block"))
    pairs = from_names.join(to_names, ["label", "dim", "cell_b"]).select("label", "dim", F.least(one, other).alias("a"), F.greatest(one, other).alias("b")).distinct()
    side = lambda s: blocks.select("label", "dim", F.struct("cell", "block").alias(s), F.col("payload").alias(f"payload_{s}"))
    met = pairs.join(side("a"), ["label", "dim", "a"]).join(side("b"), ["label", "dim", "b"])

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, a, b, same, pa, pb in zip(batch["dim"], batch["cell_a"], batch["cell_b"], batch["same"], unpack(batch["payload_a"]), unpack(batch["payload_b"])):
                yield pd.DataFrame(compare(pa, pb, same, quantisers.get(dim), b, chord, threshold), columns=["rid", "links", "root"], dtype="int64")

    flat = met.select("dim", F.col("a.cell").alias("cell_a"), F.col("b.cell").alias("cell_b"), (F.col("a") == F.col("b")).alias("same"), "payload_a", "payload_b")
    found = materialize(flat.mapInPandas(links, "rid long, links long, root long"))
    degree = found.groupBy("rid").agg(F.sum("links").alias("links"))
    classes = connected_components(found.where("rid <> root"), "rid", "root").select(F.col("node").alias("rid"), "component")
    known = reps.join(degree, "rid", "left").join(classes, "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    smallest = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(smallest, "component").select("label", "vec", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    return rows.join(known, ["label", "vec"], "left").select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
