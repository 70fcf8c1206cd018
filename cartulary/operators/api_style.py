"""The spelling habits of an interface, counted over its calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Query keys by the style of paging they belong to: fixed values.
PAGING = {
    "page": "page number", "per_page": "page number", "perPage": "page number", "size": "page number",
    "limit": "offset and limit", "offset": "offset and limit", "skip": "offset and limit", "top": "offset and limit",
    "cursor": "cursor", "after": "cursor", "next": "cursor", "pageToken": "cursor",
}
#: Words that tell what is done, when a segment begins with one.
ACTIONS = ("add", "apply", "cancel", "close", "copy", "create", "delete", "do", "edit", "fetch", "find", "get", "insert", "list", "load", "make", "move", "open", "put", "query", "read", "remove", "run", "save", "search", "send", "set", "start", "stop", "submit", "update")


def first_word(segment: Column) -> Column:
    """The first word of a name in any case style, in lower case."""
    return F.lower(F.regexp_extract(segment, "^([A-Z]+(?![a-z])|[A-Z]?[a-z]+)", 1))


def case_class(segment: Column) -> Column:
    return (
        F.when(segment.rlike("^[a-z0-9]+(-[a-z0-9]+)+$"), "kebab")
        .when(segment.rlike("^[a-z0-9]+(_[a-z0-9]+)+$"), "snake")
        .when(segment.rlike("^[a-z]+[A-Z][A-Za-z0-9]*$"), "camel")
        .when(segment.rlike("^[a-z][a-z0-9]*$"), "single word")
    )


def census(calls: DataFrame, path: str = "path") -> DataFrame:
    """``(aspect, value, n)``: case classes, versions, paging keys, plural nouns and verbs in paths."""
    bare, query = F.split_part(F.col(path), F.lit("?"), F.lit(1)), F.split_part(F.col(path), F.lit("?"), F.lit(2))
    segment = calls.select(F.explode(F.filter(F.split(bare, "/"), lambda s: (s != "") & ~s.rlike(r"[{$:]|^[0-9]+$"))).alias("s"))
    version = F.col("s").rlike("(?i)^v[0-9]+$")
    noun = F.when(~version & case_class(F.col("s")).isNotNull(), F.when(F.col("s").endswith("s"), "plural").otherwise("singular"))
    verb = F.when(first_word(F.col("s")).isin(*ACTIONS), F.col("s"))
    aspects = F.array(
        F.struct(F.lit("case").alias("aspect"), F.when(~version, case_class(F.col("s"))).alias("value")),
        F.struct(F.lit("version").alias("aspect"), F.when(version, F.lower("s")).alias("value")),
        F.struct(F.lit("noun").alias("aspect"), noun.alias("value")),
        F.struct(F.lit("verb").alias("aspect"), verb.alias("value")),
    )
    keys = calls.select(F.explode(F.split(query, "&")).alias("pair")).select(F.split_part("pair", F.lit("="), F.lit(1)).alias("key"))
    style = F.create_map(*[F.lit(x) for pair in PAGING.items() for x in pair])
    paging = keys.select(F.lit("paging").alias("aspect"), style[F.col("key")].alias("value"))
    found = segment.select(F.explode(aspects).alias("a")).select("a.*").unionByName(paging)
    return found.where("value is not null").groupBy("aspect", "value").agg(F.count("*").alias("n"))
