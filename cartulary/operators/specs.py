"""Interface specifications as tables: operations, parameters with their references followed, and calls that lack one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from .graph import redirect_closure

METHODS = ("get", "put", "post", "delete", "patch", "head", "options")


def components(specs: DataFrame) -> DataFrame:
    """``(pointer, value)``: every named part of the specifications (column spec: a variant) by its local pointer."""
    spark = specs.sparkSession
    part = F.try_variant_get("spec", "$.components", "variant")
    kinds = specs.select(part.alias("part")).lateralJoin(spark.tvf.variant_explode(F.col("part").outer())).select(F.col("key").alias("kind"), F.col("value").alias("named"))
    return kinds.lateralJoin(spark.tvf.variant_explode(F.col("named").outer())).select(F.concat(F.lit("#/components/"), "kind", F.lit("/"), "key").alias("pointer"), "value")


def followed(parts: DataFrame) -> DataFrame:
    """``(pointer, value, cyclic)``: each part with the references that it is followed to their end, in a logarithm of
    the longest chain's rounds; a part in or behind a cycle, or whose reference leads nowhere, has no value."""
    hops = parts.select(F.col("pointer").alias("src"), F.try_variant_get("value", "$['$ref']", "string").alias("dst")).where("dst is not null")
    ends = redirect_closure(hops).select(F.col("src").alias("pointer"), F.col("dst").alias("_end"), "cyclic")
    values = parts.select(F.col("pointer").alias("_end"), F.col("value").alias("found"))
    led = parts.select("pointer", "value").join(ends, "pointer", "left").join(values, "_end", "left")
    value = F.when(F.col("_end").isNull(), F.col("value")).when(~F.col("cyclic"), F.col("found"))
    return led.select("pointer", value.alias("value"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


def parameters(specs: DataFrame) -> DataFrame:
    """``(method, path, name, place, required, ref, broken)``: parameters of every operation, those of its path with them."""
    spark = specs.sparkSession
    paths = specs.select(F.try_variant_get("spec", "$.paths", "variant").alias("v")).lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(F.col("key").alias("path"), F.col("value").alias("item"))
    each = paths.lateralJoin(spark.tvf.variant_explode(F.col("item").outer())).where(F.col("key").isin(*METHODS))
    listed = lambda v: F.coalesce(F.try_variant_get(v, "$.parameters", "array<variant>"), F.array().cast("array<variant>"))
    asked = each.select(F.upper("key").alias("method"), "path", F.explode(F.concat(listed(F.col("item")), listed(F.col("value")))).alias("p"))
    asked = asked.withColumn("ref", F.try_variant_get("p", "$['$ref']", "string"))
    parts = followed(materialize(components(specs))).select(F.col("pointer").alias("ref"), F.col("value").alias("led"))
    whole = asked.join(parts, "ref", "left").withColumn("p", F.when(F.col("ref").isNull(), F.col("p")).otherwise(F.col("led")))
    get = lambda field, kind: F.try_variant_get("p", f"$.{field}", kind)
    return whole.select("method", "path", get("name", "string").alias("name"), get("in", "string").alias("place"), F.coalesce(get("required", "boolean"), F.lit(False)).alias("required"), "ref", get("name", "string").isNull().alias("broken"))


def missing_parameters(calls: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(method, path, name, calls, missing)``: of the calls (method, path, query: array of names) to each operation, how many lack a required query parameter."""
    kinds = calls.groupBy("method", "path", F.array_sort(F.array_distinct(F.coalesce("query", F.array().cast("array<string>")))).alias("query")).agg(F.count("*").alias("n"))
    needed = wanted.where("required and place = 'query' and not broken").select("method", "path", "name").distinct()
    met = kinds.join(needed, ["method", "path"])
    lacks = F.sum(F.when(~F.array_contains("query", F.col("name")), F.col("n")).otherwise(0))
    return met.groupBy("method", "path", "name").agg(F.sum("n").alias("calls"), lacks.alias("missing"))
