"""What the two vector operators share: usable vectors, k-means, and packing rows into blocks."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: str) -> Column:
    """Whether a vector is not null, holds only finite numbers, and is not zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vec).isNotNull() & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def stack(rows) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=np.float64) for x in rows])


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1), 0)


def nearest_centres(x: np.ndarray, centres: np.ndarray, rows: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and its squared distance, a block of rows at a time."""
    near, far = np.empty(len(x), dtype=np.int64), np.empty(len(x))
    for a in range(0, len(x), rows):
        d = squared_distances(x[a : a + rows], centres)
        near[a : a + rows] = d.argmin(axis=1)
        far[a : a + rows] = d.min(axis=1)
    return near, far


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centres of a small sample; an empty centre moves to the point that is worst off."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near, least = nearest_centres(x, centres)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        full = count > 0
        centres[full] = total[full] / count[full, None]
        centres[~full] = x[np.argsort(-least)[: (~full).sum()]]
    return centres


def sample_vectors(rows: DataFrame, most: int) -> list:
    """Distinct vectors of ``rows`` (column vec), at most ``most``: those with the smallest hashes, so that a group of copies counts once."""
    hashes = rows.select(F.xxhash64("vec").alias("h")).distinct().orderBy("h").limit(most)
    last = hashes.agg(F.max("h")).first()[0]
    return [] if last is None else [v for (v,) in rows.where(F.xxhash64("vec") <= last).select("vec").dropDuplicates(["vec"]).orderBy(F.xxhash64("vec")).collect()]


def pack_blocks(rows: DataFrame, keys: list[str], row_id: str, size: int) -> DataFrame:
    """``keys``, ``block`` and ``payload`` (pickled columns): the rows of each key in blocks of about ``size``.

    The number of blocks follows the key's row count, so a hot key is cut into
    as many blocks as it needs and none grows with the data.
    """
    columns = [c for c in rows.columns if c not in keys]
    counts = rows.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias("_blocks"))
    placed = rows.join(counts, keys).withColumn("block", F.pmod(F.xxhash64(row_id), F.col("_blocks")).cast("int")).drop("_blocks")
    key_schema = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keys]

    def pack(batch: pd.DataFrame) -> pd.DataFrame:
        out = {k: [batch[k].iloc[0]] for k in [*keys, "block"]}
        out["payload"] = [pickle.dumps([list(batch[c]) if batch[c].dtype == object else batch[c].to_numpy() for c in columns])]
        return pd.DataFrame(out)

    return placed.select(*keys, "block", *columns).groupBy(*keys, "block").applyInPandas(pack, ", ".join([*key_schema, "block int", "payload binary"]))


def unpack(payloads: Iterator[bytes]) -> Iterator[list]:
    """Payloads of this very program, read from its own shared folder or shuffle."""
    return map(pickle.loads, payloads)
