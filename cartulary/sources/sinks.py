"""Sinks: findings tables, run history, stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_history(run: DataFrame, path: str) -> None:
    """Append a run's counters as JSON lines."""
    run.write.mode("append").json(path)


def write_findings(findings: DataFrame, path: str, by: str = "kind") -> None:
    """Findings as Parquet, a folder for each value of ``by``; rows are dealt out evenly, not by that value."""
    findings.write.mode("overwrite").partitionBy(by).parquet(path)


def upsert(store: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``store`` with ``changes`` in place of rows with the same key; new rows without one take the next ids."""
    kept = store.join(changes.where(F.col(key).isNotNull()).select(key), key, "left_anti")
    fresh = changes.where(F.col(key).isNull())
    top = store.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    numbered = fresh.crossJoin(F.broadcast(top)).withColumn(key, (F.col("_top") + 1 + F.monotonically_increasing_id()).cast(store.schema[key].dataType)).select(store.columns)
    return kept.unionByName(changes.where(F.col(key).isNotNull())).unionByName(numbered)
