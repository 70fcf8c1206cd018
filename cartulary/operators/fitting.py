"""Softmax regression fitted in rounds: Spark sums gradients, the driver holds parameters alone.

In each round every task turns its vectors into one loss and one gradient, Spark
adds these up by position, and the driver moves the parameters. What travels is
classes x (dimensions + 1) numbers a task, whatever the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from .learning import MAX_CLASSES, doubles


@dataclass
class Model:
    """Weights by class: a bias, then one for each dimension; the loss before each round."""

    labels: list
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    losses: list[float] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Places of the most probable labels."""
        return np.argmax(scores(self.weights, (x - self.mean) / self.scale), axis=1)


def scores(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    return weights[:, 0] + x @ weights[:, 1:].T


def loss_and_gradient(weights: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed cross-entropy of the softmax and its gradient, for vectors ``x`` of classes ``y``."""
    z = scores(weights, x)
    z -= z.max(axis=1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(axis=1, keepdims=True)
    loss = float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum())
    p[np.arange(len(y)), y] -= 1
    return loss, np.concatenate([p.sum(axis=0)[:, None], p.T @ x], axis=1)


def cross_entropy(scores_: Column, label: Column) -> Column:
    """The cross-entropy of the softmax of an array of scores for the class at ``label`` (from 0)."""
    top = F.array_max(scores_)
    return F.log(F.aggregate(F.transform(scores_, lambda s: F.exp(s - top)), F.lit(0.0), lambda a, e: a + e)) + top - F.get(scores_, label)


def usable(rows: DataFrame, vec: str, dimensions: int) -> DataFrame:
    """Rows whose vector has so many components, all of them finite."""
    odd = F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.where((F.size(vec) == dimensions) & ~F.coalesce(odd, F.lit(True)))


def total_gradient(rows: DataFrame, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean loss and gradient over a stored table of (x: array<double>, y: int)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, n, gradient = 0.0, 0, np.zeros_like(weights)
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                more, step = loss_and_gradient(weights, x, batch.column(1).to_numpy(zero_copy_only=False))
                loss, n, gradient = loss + more, n + batch.num_rows, gradient + step
        values = np.concatenate([[loss, n], gradient.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], ["place", "value"])

    summed = rows.select("x", "y").mapInArrow(part, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).toPandas()
    values = summed.sort_values("place")["value"].to_numpy() if len(summed) else np.zeros(2 + weights.size)
    n = max(values[1], 1.0)
    return values[0] / n, values[2:].reshape(weights.shape) / n


def fit(rows: DataFrame, label: str, vec: str, rounds: int = 40, rate: float = 0.5, momentum: float = 0.9, ridge: float = 1e-3) -> Model:
    """A model of ``label`` by ``vec``, standardised; rows without a label, and vectors that are null, not finite or of another length than the first, take no part."""
    labels = [r[0] for r in rows.where(F.col(label).isNotNull()).select(label).distinct().orderBy(label).limit(MAX_CLASSES + 1).collect()]
    if len(labels) > MAX_CLASSES:
        raise ValueError("too many classes")
    first = rows.where(F.col(label).isNotNull() & (F.size(vec) > 0)).agg(F.min(F.size(vec))).first()[0]
    if not labels or not first:
        raise ValueError("nothing to fit")
    place = F.create_map(*[x for i, name in enumerate(labels) for x in (F.lit(name), F.lit(i))])
    known = materialize(usable(rows.where(F.col(label).isNotNull()), vec, first).select(doubles(vec).alias("x"), place[F.col(label)].alias("y")))
    moments = known.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("at").collect()
    mean, scale = np.array([r.m for r in moments]), np.array([r.s or 1.0 for r in moments])
    shift, by = (F.array(*map(F.lit, a.tolist())) for a in (mean, scale))
    ready = materialize(known.select(F.transform(F.arrays_zip(F.col("x").alias("x"), shift.alias("m"), by.alias("s")), lambda t: (t["x"] - t["m"]) / t["s"]).alias("x"), "y"))
    model = Model(labels, np.zeros((len(labels), first + 1)), mean, scale)
    pace = np.zeros_like(model.weights)
    for _ in range(rounds):
        ahead = model.weights + momentum * pace
        loss, gradient = total_gradient(ready, ahead)
        model.losses.append(loss)
        gradient[:, 1:] += ridge * ahead[:, 1:]
        pace = momentum * pace - rate * gradient
        model.weights = model.weights + pace
    return model


def predicted(model: Model, vec: Column) -> Column:
    """The label that the model gives a vector, as text; null for vectors of another length."""

    @F.pandas_udf("string")
    def label_of(vectors: pd.Series) -> pd.Series:
        known = [v is not None and len(v) == len(model.mean) for v in vectors]
        out = np.full(len(vectors), None, dtype=object)
        if any(known):
            x = np.stack([np.asarray(v, dtype=float) for v, k in zip(vectors, known) if k])
            out[np.flatnonzero(known)] = [str(model.labels[i]) for i in model.predict(x)]
        return pd.Series(out, dtype=object)

    return label_of(vec)
