"""Small models over vectors in array functions: standardise, prototypes, softmax, leave-one-out, attention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let, total

#: Classes that prototypes may have, at most: they travel with the plan.
MAX_CLASSES = 1000


def doubles(vec: str) -> Column:
    return F.transform(vec, lambda x: x.cast("double"))


def column_moments(df: DataFrame, vec: str) -> DataFrame:
    """``(pos, mean, std)``: population deviation, zero read as one."""
    parts = df.select(F.posexplode(doubles(vec)).alias("pos", "x"))
    m = parts.groupBy("pos").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    return m.withColumn("std", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")))


def standardized(df: DataFrame, vec: str) -> DataFrame:
    """``df`` with ``vec`` standardised; one row a dimension is collected for it."""
    rows = column_moments(df, vec).orderBy("pos").collect()
    mean, std = (F.array(*[F.lit(r[c]) for r in rows]) for c in ("mean", "std"))
    scaled = F.transform(F.arrays_zip(doubles(vec).alias("x"), mean.alias("m"), std.alias("s")), lambda t: (t["x"] - t["m"]) / t["s"])
    return df.withColumn(vec, scaled)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d))


def prototypes(df: DataFrame, label: str, vec: str) -> list[tuple]:
    """``(label, mean vector)`` of each class, collected if there are at most MAX_CLASSES."""
    parts = df.where(F.col(label).isNotNull()).select(label, F.posexplode(doubles(vec)).alias("pos", "x"))
    means = parts.groupBy(label, "pos").agg(F.avg("x").alias("m"))
    rows = means.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("v")).orderBy(label).limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError("too many classes for prototypes")
    return [(r[0], [x["m"] for x in r["v"]]) for r in rows]


def classify(df: DataFrame, protos: list[tuple], vec: str) -> DataFrame:
    """``df`` with ``predicted``, ``confidence`` (softmax of negative distances over all) and ``margin`` to the next."""
    x = doubles(vec)
    scored = F.array_sort(F.array(*[F.struct(distance(x, F.array(*map(F.lit, p))).alias("d"), F.lit(name).alias("label")) for name, p in protos]))
    best, weight = F.col("_s")[0], F.aggregate(F.col("_s"), F.lit(0.0), lambda s, e: s + F.exp(F.col("_s")[0]["d"] - e["d"]))
    out = df.withColumn("_s", scored)
    margin = F.col("_s")[1]["d"] - best["d"] if len(protos) > 1 else F.lit(None).cast("double")
    return out.select(*df.columns, best["label"].alias("predicted"), (1 / weight).alias("confidence"), margin.alias("margin"))


def softmax(v: Column) -> Column:
    exps = let(v, lambda x: let(F.array_max(x), lambda top: F.transform(x, lambda y: F.exp(y - top))))
    return let(exps, lambda e: let(total(e), lambda n: F.transform(e, lambda x: x / n)))


def variance(v: Column) -> Column:
    return let(v, lambda x: let(total(x) / F.size(x), lambda mean: total(F.transform(x, lambda y: (y - mean) * (y - mean))) / F.size(x)))


def layer_norm(v: Column, eps: float = 1e-5) -> Column:
    return let(v, lambda x: let(F.struct((total(x) / F.size(x)).alias("mean"), variance(x).alias("var")), lambda m: F.transform(x, lambda y: (y - m["mean"]) / F.sqrt(m["var"] + eps))))


def attention(rows: DataFrame, group: str, pos: str, vec: str, window: int) -> DataFrame:
    """Scaled dot-product self-attention of each row over the rows up to ``window`` before it in its group."""
    back = Window.partitionBy(group).orderBy(pos).rowsBetween(-window, 0)
    near = rows.withColumn("_near", F.collect_list(doubles(vec)).over(back)).withColumn("_q", doubles(vec))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, p: s + p)
    weights = softmax(F.transform("_near", lambda k: dot(F.col("_q"), k) / F.sqrt(F.size("_q").cast("double"))))
    near = near.withColumn("weights", weights)
    mixed = F.transform(F.sequence(F.lit(0), F.size("_q") - 1), lambda d: F.aggregate(F.zip_with("weights", "_near", lambda w, k: w * k[d]), F.lit(0.0), lambda s, p: s + p))
    return near.withColumn("mixed", mixed).drop("_near", "_q")


def leave_one_out(df: DataFrame, label: str, vec: str) -> DataFrame:
    """``(label, predicted)`` of each labelled row by class means that leave it out.

    Without a row, its class mean is n / (n - 1) times as far from it; a class of
    one row has no mean for that row.
    """
    labelled = df.where(F.col(label).isNotNull())
    protos = prototypes(labelled, label, vec)
    sizes = {r[0]: r[1] for r in labelled.groupBy(label).count().collect()}  # as many rows as prototypes()
    x = doubles(vec)

    def far(name, mean: list) -> Column:
        d = distance(x, F.array(*map(F.lit, mean)))
        own = d * sizes[name] / (sizes[name] - 1) if sizes[name] > 1 else F.lit(float("inf"))
        return F.struct(F.when(F.col(label) == name, own).otherwise(d).alias("d"), F.lit(name).alias("label"))

    return labelled.select(F.col(label).alias("label"), F.array_min(F.array(*[far(n, m) for n, m in protos]))["label"].alias("predicted"))


def noise(row_id: Column, pos: Column) -> Column:
    """A number of mean 0 and deviation 1 drawn from row and place alone: three uniform draws of a hash, summed and scaled."""
    digest = F.md5(F.concat(row_id.cast("string"), F.lit("-"), pos.cast("string")).cast("binary"))
    draw = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("double") / 4294967296.0
    return (draw(1) + draw(9) + draw(17) - 1.5) * 2


def robustness(df: DataFrame, row_id: str, label: str, vec: str, scale: float) -> DataFrame:
    """``(predicted, after)``: the nearest class mean of each row, and of the row with noise of deviation ``scale``."""
    protos = prototypes(df, label, vec)
    before = classify(df.select(row_id, vec), protos, vec).select(row_id, vec, "predicted")
    moved = before.withColumn(vec, F.transform(doubles(vec), lambda x, i: x + scale * noise(F.col(row_id), i)))
    return classify(moved.withColumnRenamed("predicted", "before"), protos, vec).select(F.col("before").alias("predicted"), F.col("predicted").alias("after"))


def sinusoidal(place: Column, dims: Column) -> Column:
    """The sinusoidal code of a place: sines at even and cosines at odd dimensions."""
    angle = lambda i: place / F.pow(F.lit(10000.0), (i - i % 2) / dims)
    return F.transform(F.sequence(F.lit(0), dims - 1), lambda i: F.when(i % 2 == 0, F.sin(angle(i))).otherwise(F.cos(angle(i))))
