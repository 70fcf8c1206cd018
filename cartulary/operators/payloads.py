"""What JSON payloads are made of: typed paths of any depth, merged into a lattice, and endpoints built from calls.

A payload is a variant. Its nodes are taken apart level by level: the children
of the containers of one level are counted by path and type, and those that are
containers themselves are the next level, written to the shared folder. So the
work is the number of nodes, a payload of any depth is read whole, and nothing
but counts is shuffled. Counts of two tables add up, so lattices can be merged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import drop_path, materialize, scratch_dir


def kind_of(value: Column) -> Column:
    """null, boolean, integer, number, string, object or array."""
    return kind_of_schema(F.schema_of_variant(value))


def kind_of_schema(raw: Column) -> Column:
    """The same by the schema of a variant."""
    return (
        F.when(raw == "VOID", "null")
        .when(raw == "BOOLEAN", "boolean")
        .when(raw.rlike(r"^(BIGINT|DECIMAL\([0-9]+,0\))$"), "integer")
        .when(raw.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number")
        .when(raw.startswith("OBJECT"), "object")
        .when(raw.startswith("ARRAY"), "array")
        .otherwise("string")
    )


def typed_paths(rows: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """``(keys, path, type, n)``: how often each path of the payloads has each type.

    The path of a payload itself is empty; ``.key`` is a field and ``[]`` any
    element; keys that are no plain words are quoted. Null payloads do not count,
    and one that is not JSON has type ``invalid``.
    """
    spark = rows.sparkSession
    value = F.try_parse_json(payload)
    own = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_none"))
    level = rows.where(F.col(payload).isNotNull()).select(own.alias("_keys"), F.lit("").alias("path"), value.alias("value"))
    counts, old = [], None
    while True:
        # the schema is a step of its own, so that it is made once for each value
        typed = level.withColumn("_schema", F.schema_of_variant("value"))
        level = typed.select("_keys", "path", F.when(F.col("value").isNull(), "invalid").otherwise(kind_of_schema(F.col("_schema"))).alias("type"), "value")
        counts.append(materialize(level.groupBy("_keys", "path", "type").agg(F.count("*").alias("n"))))
        if not counts[-1].where("type in ('object', 'array')").take(1):
            break
        path = scratch_dir(spark)
        level.where("type in ('object', 'array')").write.parquet(path)
        inner = spark.read.parquet(path)
        if old:
            drop_path(spark, old)
        old = path
        child = inner.withColumnsRenamed({"value": "_container", "type": "_kind", "path": "_path"}).lateralJoin(spark.tvf.variant_explode(F.col("_container").outer()))
        name = F.when(F.col("key").rlike("^[A-Za-z_][A-Za-z0-9_-]*$"), F.col("key")).otherwise(F.concat(F.lit('"'), F.replace("key", F.lit('"'), F.lit('\\"')), F.lit('"')))
        step = F.when(F.col("_kind") == "array", "[]").otherwise(F.concat(F.lit("."), name))
        level = child.select("_keys", F.concat("_path", step).alias("path"), "value")
    return combine(*counts, keys=["_keys"]).select(*[F.col("_keys")[k].alias(k) for k in keys], "path", "type", "n")


def combine(*counts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of several tables as one."""
    return reduce(DataFrame.unionByName, counts).groupBy(*keys, "path", "type").agg(F.sum("n").alias("n"))


def lattice(counts: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, path, type, nullable, optional, conflict, n)``: the least type that takes every value of a path.

    Integers and numbers are numbers; other kinds side by side are a union,
    joined by ``|``, and a conflict if one of them is an object or an array. A
    field is optional if fewer objects have it than there are at its parent.
    """
    known = F.array_sort(F.collect_set(F.when(F.col("type") != "null", F.col("type"))))  # seven kinds at most
    merged = counts.groupBy(*keys, "path").agg(known.alias("types"), F.bool_or(F.col("type") == "null").alias("nullable"), F.sum("n").alias("n"))
    types = F.when(F.array_contains("types", "number"), F.array_remove("types", "integer")).otherwise(F.col("types"))
    parent = F.regexp_replace("path", r'(\.[A-Za-z_][A-Za-z0-9_-]*|\.".*")$', "")
    field = F.col("path") != F.col("parent")
    above = counts.where("type = 'object'").select(*keys, F.col("path").alias("parent"), F.col("n").alias("objects"))
    joined = merged.withColumn("types", types).withColumn("parent", parent).join(above, [*keys, "parent"], "left")
    shape = F.when(F.size("types") > 0, F.array_join("types", "|")).otherwise("null")
    mixed = (F.size("types") > 1) & F.arrays_overlap("types", F.array(F.lit("object"), F.lit("array")))
    return joined.select(*keys, "path", shape.alias("type"), "nullable", (field & (F.col("n") < F.coalesce("objects", F.lit(0)))).alias("optional"), mixed.alias("conflict"), "n")


def body_shape(body: Column) -> Column:
    """The first level of a JSON object as ``key:type`` in order, values left out; ``not json`` for other texts."""
    variant = F.try_parse_json(body)
    keys = F.array_sort(F.json_object_keys(body))
    typed = F.transform(keys, lambda k: F.concat(k, F.lit(":"), kind_of(F.try_variant_get(variant, F.concat(F.lit('$["'), k, F.lit('"]')), "variant"))))
    return F.when(body.isNull(), F.lit(None)).when(variant.isNull() | keys.isNull(), F.lit("not json")).otherwise(F.array_join(typed, ","))


#: Examples of an endpoint's parameter: fixed value.
EXAMPLES = 3


def endpoints(calls: DataFrame) -> DataFrame:
    """Endpoints of ``calls`` (seq, method, path, query: array of names, status, body): paths that differ in a last
    segment that looks like an id are one, with ``:id``; each with the statuses and query names seen, the shape of
    its first body, and the first ids met."""
    leaf = F.try_element_at(F.filter(F.split("path", "/"), lambda s: s != ""), F.lit(-1))
    parts = calls.where(F.col("path").isNotNull()).withColumns({"leaf": F.coalesce(leaf, F.lit("")), "prefix": F.regexp_replace(F.regexp_replace("path", "/+", "/"), "/[^/]*/?$", "")})
    # one row for each distinct leaf, and the first bodies and sets, before anything is joined
    leaves = parts.groupBy("method", "prefix", "leaf").agg(F.min("seq").alias("seq"), F.count("*").alias("calls"), F.collect_set("status").alias("statuses"), F.array_distinct(F.flatten(F.collect_set("query"))).alias("query"), F.min(F.when(F.col("body").isNotNull(), F.struct("seq", "body"))).alias("body"))
    like_id = F.col("leaf").rlike("[0-9]") | (F.length("leaf") > 6)
    groups = leaves.groupBy("method", "prefix").agg(((F.count("*") > 1) & F.bool_and(like_id)).alias("varies"))
    named = leaves.join(groups, ["method", "prefix"]).withColumn("endpoint", F.concat("prefix", F.lit("/"), F.when(F.col("varies"), ":id").otherwise(F.col("leaf"))))
    key = ["method", "endpoint"]
    sets = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)  # noqa: E731  sets of sets of statuses and parameter names
    built = named.groupBy(key).agg(F.bool_or("varies").alias("varies"), F.sum("calls").alias("calls"), sets("statuses"), sets("query"), F.min("body")["body"].alias("body"))
    first = F.row_number().over(Window.partitionBy(*key).orderBy("seq", "leaf"))
    shown = named.where("varies").select(*key, "seq", "leaf").withColumn("n", first).where(F.col("n") <= EXAMPLES)
    examples = shown.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "leaf"))).alias("x")).select(*key, F.transform("x", lambda s: s["leaf"]).alias("examples"))
    none = F.array().cast("array<string>")
    return built.join(examples, key, "left").select(*key, F.when(F.col("varies"), F.array(F.lit("id"))).otherwise(none).alias("params"), "query", "statuses", body_shape(F.col("body")).alias("observed_body"), F.coalesce("examples", none).alias("examples"), "calls")
