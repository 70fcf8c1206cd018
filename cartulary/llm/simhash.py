"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Radius 3 is met as 1 + 2. Two fingerprints at distance 3 or less always share a
64-bit variant that lies within one flip of the one and within two flips of the
other. Conversely, members of a variant's group of which one is within one flip
are within 3 of it, so a group with such a member is joined by a star to it: the
collision is its own proof, no pair list is made, and a group of any size costs
one row a member.

Two facts keep the balls small without losing a link. Distance 3 means unequal
parity, so only fingerprints with an odd number of bits emit two-flip variants.
And of three flipped bits two lie in the same half of the word, so two-flip
variants stay inside a half.

Before that, fingerprints with no possible partner are put aside: at distance 3
or less one of the two 32-bit halves differs in one bit at most, so balls of
radius one over the halves (again emitted by odd halves only) leave just those
that meet another.

Defined cases: null and empty texts and texts of white space have fingerprint 0
and link with each other; a null id counts as larger than any; repeated rows
link with themselves; ties have no say, for every link of distance 3 or less
counts; texts of any length are read whole, their shingles hashed a block at a
time; an empty table gives an empty result; only the id and text columns are
read, so other columns and their names do not matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import connected_components, materialize, small_batches

SEED = 42
SHINGLE_WORDS = 3
NEAR_MASKS = [0, *(1 << i for i in range(64))]
FAR_MASKS = [(1 << i | 1 << j) << half for half in (0, 32) for i in range(32) for j in range(i)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def simhash64(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The unsigned fingerprint of one text: a bit is set if it is set in over half the shingle hashes."""
    tokens = text.encode("utf-8", "replace").lower().split() if text else []
    if not tokens:
        return 0
    joined = memoryview(b" ".join(tokens))
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(tokens) - words + 1
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for a in range(0, n, 1 << 15):
        b = min(n, a + (1 << 15))
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[a:b].tolist(), ends[a + words - 1 : b + words - 1].tolist())), dtype=np.uint64, count=b - a)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprint(text: Column | str) -> Column:
    """The fingerprint of each whole text, as a signed long."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([_signed(simhash64(t)) for t in texts], dtype="int64")

    return prints(text)


def fingerprint_hex(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def _masks(values: list[int]) -> Column:
    return F.array(*[F.lit(_signed(m)) for m in values])


def possible(fps: DataFrame) -> DataFrame:
    """Of distinct ``fp``, those of which another agrees in a half but for one bit at most."""
    halves = fps.select(
        "fp",
        F.explode(F.array(F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", 32) + F.lit(1 << 32))).alias("own"),
    )
    flips = F.array(*[F.lit(0)] + [F.lit(1 << i) for i in range(32)])
    odd = (F.bit_count(F.col("own").bitwiseAND(0xFFFFFFFF)) % 2) == 1
    entries = halves.select("fp", "own", F.explode(F.when(odd, flips).otherwise(F.array(F.lit(0)))).alias("flip")).select("fp", F.col("own").bitwiseXOR(F.col("flip")).alias("variant"), (F.col("flip") == 0).alias("exact"))
    group = Window.partitionBy("variant")
    met = entries.withColumn("n", F.count("*").over(group)).withColumn("home", F.max("exact").over(group))
    return met.where("n > 1 and home").select("fp").distinct()


def links(fps: DataFrame) -> DataFrame:
    """Edges ``(fp, root)`` whose components are those of all pairs of ``fps`` at distance 3 or less."""
    odd = (F.bit_count("fp") % 2) == 1
    balls = fps.select("fp", F.explode(F.when(odd, _masks(NEAR_MASKS + FAR_MASKS)).otherwise(_masks(NEAR_MASKS))).alias("mask"))
    variants = balls.select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), (F.bit_count("mask") <= 1).alias("near"))
    root = F.min(F.when(F.col("near"), F.col("fp"))).over(Window.partitionBy("variant"))
    return variants.withColumn("root", root).where("root is not null and root <> fp").select("fp", "root")


def with_components(prints: DataFrame) -> DataFrame:
    """``prints`` (``id``, ``fp``, and what else it has; a stored table) with the smallest id reachable
    (``component_id``) and the smallest fingerprint reachable (``class``)."""
    fps = prints.groupBy("fp").agg(F.min("id").alias("least"))
    active = materialize(possible(fps.select("fp")))
    classes = connected_components(links(active), "fp", "root").select(F.col("node").alias("fp"), F.col("component").alias("class"))
    labelled = fps.join(classes, "fp", "left").select("fp", "least", F.coalesce("class", "fp").alias("class"))
    smallest = labelled.groupBy("class").agg(F.min("least").alias("component_id"))
    by_fp = labelled.join(smallest, "class").select("fp", "component_id", "class")
    return prints.join(by_fp, "fp").select(*prints.columns, "component_id", "class")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp, component_id, class)``, a row for each row of ``docs``."""
    small_batches(docs.sparkSession)
    return with_components(materialize(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col)).alias("fp"))))
