"""Relational operators: distinct keep-first, diffs, tallies, modes, medians, gates, scorecards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first in ``order`` (a grouped minimum, combined map-side)."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.min(F.struct(*order, *rest)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*")


def tally(df: DataFrame, value: str) -> DataFrame:
    """Counts of each value."""
    return df.groupBy(value).agg(F.count("*").alias("n"))


def mode_per_group(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """The most frequent value of each group; ties to the smaller value."""
    counts = df.groupBy(*group, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*group).agg(F.min(F.struct((-F.col("n")).alias("k"), F.col(value))).alias("_m")).select(*group, F.col(f"_m.{value}").alias(value), (-F.col("_m.k")).alias("n"))


def upper_median_per_group(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """The value at position floor(n / 2) of each group, without gathering a group.

    Distinct values are counted first (combined map-side), and a running count
    over those finds the position; a group costs as many rows as it has values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*group)
    run = counts.withColumn("upto", F.sum("n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w))
    return run.where((F.col("upto") > F.floor(F.col("all") / 2)) & (F.col("upto") - F.col("n") <= F.floor(F.col("all") / 2))).select(*group, F.col(value).alias("median"), F.col("all").alias("n"))


def diff(before: DataFrame, after: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys added, removed or changed between two tables, with both values."""
    joined = before.select(*key, F.col(value).alias("before")).join(after.select(*key, F.col(value).alias("after")), key, "full_outer")
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    return joined.where(~F.col("before").eqNullSafe(F.col("after"))).withColumn("change", kind)


def scorecard(concerns: dict[str, tuple[DataFrame, Column] | None]) -> DataFrame:
    """A row for each concern: how many rows have it, of how many; a concern that did not run is absent, not zero."""
    spark = next(c[0].sparkSession for c in concerns.values() if c)
    rows = []
    for name, concern in concerns.items():
        if concern is None:
            rows.append(spark.range(1).select(F.lit(name).alias("concern"), F.lit(False).alias("present"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("of")))
        else:
            df, hit = concern
            rows.append(df.agg(F.coalesce(F.sum(hit.cast("long")), F.lit(0)).alias("n"), F.count("*").alias("of")).select(F.lit(name).alias("concern"), F.lit(True).alias("present"), "n", "of"))
    return reduce(DataFrame.unionByName, rows)


def gate(card: DataFrame, limit: int) -> DataFrame:
    """``card`` with its total, and an error in the plan if the total is over ``limit``."""
    total = card.agg(F.sum("n").alias("total"))
    return total.select(F.when(F.col("total") > limit, F.raise_error(F.concat(F.lit("ceiling passed: "), F.col("total").cast("string")))).otherwise(F.col("total")).alias("total"))
