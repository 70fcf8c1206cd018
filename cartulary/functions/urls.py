"""URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(url: str) -> list[Column]:
    """Scheme, host, path, query and fragment; empty text where a part is missing."""
    return [
        F.regexp_extract(url, r"^([a-z]+)://", 1).alias("scheme"),
        F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1).alias("host"),
        F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"),
        F.regexp_extract(url, r"\?([^#]*)", 1).alias("query"),
        F.regexp_extract(url, r"#(.*)$", 1).alias("fragment"),
    ]


def normalized(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments; one that climbs above the root stays at the root."""
    step = lambda done, s: F.when(s == "..", F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)).when(s == ".", done).otherwise(F.concat(done, F.array(s)))
    closed = F.when(path.rlike(r"/\.\.?$"), F.concat(path, F.lit("/"))).otherwise(path)
    return F.array_join(F.aggregate(F.split(closed, "/"), F.array().cast("array<string>"), step), "/")


def resolve(base_path: Column, href: Column) -> Column:
    """The site path that a link reaches; null for links with a scheme or a host of their own."""
    bare = F.regexp_extract(href, r"^[^?#]*", 0)
    folder = F.when(base_path == "", F.lit("/")).otherwise(F.regexp_replace(base_path, r"[^/]*$", ""))
    full = F.when(href.startswith("/"), bare).when(bare == "", base_path).otherwise(F.concat(folder, bare))
    return F.when(href.rlike("^([A-Za-z][A-Za-z0-9+.-]*:|//)"), F.lit(None)).otherwise(normalized(full))


def shape(path: Column) -> Column:
    """A path with each parameter segment (``{id}``, ``:id``, ``${x}``, digits) as ``*``."""
    return F.regexp_replace(path, r"/(\{[^/}]*\}|:[^/]+|\$\{[^/}]*\}|[0-9]+)(?=/|$)", "/*")


def masked(path: Column) -> Column:
    """Segments that hold a digit as ``:id``; version segments stay."""
    segment = lambda s: F.when(s.rlike("^v[0-9]+$"), s).when(s.rlike("[0-9]"), ":id").otherwise(s)
    return F.array_join(F.transform(F.split(path, "/"), segment), "/")


def endpoint_name(method: Column, path: Column) -> Column:
    """A camel-case name from method and the path's plain segments."""
    plain = F.filter(F.split(path, "/"), lambda s: (s != "") & ~s.rlike("[0-9{}:]"))
    return F.concat(F.lower(method), F.array_join(F.transform(plain, lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.substr(s, F.lit(2)))), ""))


def fnv1a32(text: Column) -> Column:
    """FNV-1a of ASCII text, 32 bits, as lower-case hex."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    folded = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.lpad(F.lower(F.hex(folded)), 8, "0")
