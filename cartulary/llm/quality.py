"""Document quality by regularised quadratic discriminant analysis.

Statistics of the whole text, transformed to be roughly normal, are modelled by
one Gaussian a class. Each class covariance is shrunk towards the pooled one and
its diagonal, its Cholesky factor is kept, and a text's score is the logistic of
the difference of the two Mahalanobis log-densities plus the log prior odds.

Defined cases: null and empty texts have the statistics of an empty text and are
scored like any other; label rows whose label is neither 0 nor 1, or without a
document, are not learned from; repeated rows count as often as they occur; if a
class has no labelled document, every score is 0.5; a score equal to the
threshold keeps a document; very long texts are read whole; an empty table gives
an empty result; only id, text and label columns are read, and scores are a
column expression, so other columns and their names do not matter.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

#: Labelled rows that are learned from at most; beyond it, those with the smallest hash of the id.
MAX_FIT_ROWS = 100_000
#: Weight of the pooled covariance, and of its diagonal, in each class covariance.
POOL, DIAGONAL = 0.2, 0.05
#: Least score of a document that is kept.
THRESHOLD = 0.3

_LETTERS = [*range(65, 91), *range(97, 123)]
_CLASSES = {
    "upper": list(range(65, 91)),
    "digit": list(range(48, 58)),
    "mark": [ord(c) for c in "#$%&*@^~+=<>\\/_`"],
    "bar": [ord(c) for c in "|[]{}()"],
    "bang": [ord(c) for c in "!?"],
    "stop": [ord(c) for c in ".;:"],
    "comma": [44],
    "high": list(range(128, 256)),
}
FEATURES = ("chars", "words", "word_len", "word_spread", *(f"{k}_share" for k in _CLASSES), "distinct_words", "repeat_words", "top_word", "line_len", "repeat_lines", "entropy", "plain_words")


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text, in the order of FEATURES."""
    text = text if isinstance(text, str) else ""
    raw = text.encode("utf-8", "replace")
    hist = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    n = max(1, len(raw))
    words = text.split()
    k = len(words)
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=k)
    lines = [x for x in text.split("\n") if x.strip()]
    shares = hist[hist > 0] / n
    log_share = lambda part, whole: math.log((part + 0.5) / (whole + 1.0))
    return [
        math.log1p(len(text)),
        math.log1p(k),
        float(lengths.mean()) ** 0.5 if k else 0.0,
        float(lengths.std()) ** 0.5 if k else 0.0,
        *(math.log((int(hist[codes].sum()) + 0.5) / (n + 50.0)) for codes in _CLASSES.values()),
        log_share(len(counts), k) / math.log(k + 3.0),
        log_share(sum(a == b for a, b in pairwise(words)), k),
        log_share(max(counts.values(), default=0), k),
        math.log1p(len(text) / max(1, len(lines))),
        log_share(len(lines) - len(set(lines)), len(lines)),
        float(-(shares * np.log2(shares)).sum()) if len(raw) else 0.0,
        log_share(sum(map(str.isalpha, counts)), len(counts)),
    ]


def text_statistics(text: Column | str) -> Column:
    """The statistics of each whole text as ``array<double>``."""

    @F.pandas_udf("array<double>")
    def stats(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts], dtype=object)

    return stats(text)


@dataclass(frozen=True)
class Discriminant:
    """Class means, inverse Cholesky factors and constants; None for factors if a class was empty."""

    means: np.ndarray | None
    factors: np.ndarray | None
    constants: np.ndarray | None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.factors is None or not len(x):
            return np.full(len(x), 0.5)
        density = []
        for mean, inverse, constant in zip(self.means, self.factors, self.constants):
            z = (x - mean) @ inverse.T
            density.append(constant - 0.5 * np.einsum("ij,ij->i", z, z))
        return 1.0 / (1.0 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_FIT_ROWS) -> Discriminant:
    """Learn from the labelled documents outside the held-out fold.

    At most ``max_rows`` label rows are used, so they can be broadcast to the
    documents; class sums and products are added up by Spark, and only
    2 x (d + d x d) numbers come to the driver.
    """
    small_batches(docs.sparkSession)
    d = len(FEATURES)
    chosen = (
        labels.where(F.col(label).isin(0, 1) & ~held_out(id_col))
        .select(F.col(id_col).alias("_label_id"), F.col(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_label_id"), "_label_id", "_label")
        .limit(max_rows)
    )
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    stats = texts.join(F.broadcast(chosen), F.col("_id") == F.col("_label_id")).select("_label", text_statistics("_text").alias("x"))

    def moments(batches):
        sums = {c: np.zeros(1 + d + d * d) for c in (0, 1)}
        for batch in batches:
            for c, rows in batch.groupby("_label")["x"]:
                x = np.stack(rows.to_numpy())
                sums[c] += np.concatenate(([len(x)], x.sum(axis=0), (x.T @ x).ravel()))
        yield pd.DataFrame({"c": list(sums), "m": [v.tolist() for v in sums.values()]})

    total = {0: np.zeros(1 + d + d * d), 1: np.zeros(1 + d + d * d)}
    parts = stats.mapInPandas(moments, "c int, m array<double>").select("c", F.posexplode("m").alias("i", "v"))
    for c, i, v in parts.groupBy("c", "i").agg(F.sum("v")).collect():
        total[c][i] = v
    if min(total[0][0], total[1][0]) < 1:
        return Discriminant(None, None, None)
    count = np.array([total[c][0] for c in (0, 1)])
    means = np.array([total[c][1 : d + 1] / total[c][0] for c in (0, 1)])
    scatter = [total[c][d + 1 :].reshape(d, d) - total[c][0] * np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = sum(scatter) / max(1.0, count.sum() - 2)
    target = (1 - DIAGONAL) * pooled + DIAGONAL * np.diag(np.diag(pooled)) + 1e-4 * np.eye(d)
    factors, constants = [], []
    for c in (0, 1):
        weight = max(POOL, d / (d + count[c]))
        lower = np.linalg.cholesky((1 - weight) * scatter[c] / max(1.0, count[c] - 1) + weight * target)
        factors.append(np.linalg.inv(lower))
        constants.append(math.log(count[c] / count.sum()) - np.log(np.diag(lower)).sum())
    return Discriminant(means, np.array(factors), np.array(constants))


def held_out(id_col: str) -> Column:
    """Whether a row is in the held-out fold; a null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def quality_score(text: Column | str, model: Discriminant) -> Column:
    """The probability of label 1 for each whole text."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t) for t in texts]).reshape(len(texts), len(FEATURES))))

    return score(text)
