"""Readers of recorded artifacts: files, request archives, logs, specifications, crawl rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Extensions that a corpus scan keeps.
KEPT = ("html", "htm", "js", "ts", "css", "json", "txt", "md", "xml")
_SECRET_HEADERS = ("cookie", "authorization", "set-cookie")
_ENTRY = "struct<request:struct<method:string,url:string,headers:array<struct<name:string,value:string>>,postData:struct<text:string>>,response:struct<status:int>>"


def corpus(spark: SparkSession, folder: str, kept: tuple[str, ...] = KEPT) -> DataFrame:
    """``(path, ext, bytes, text, skipped)`` of every file below ``folder``; text is null for skipped ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    known = ext.isin(*kept)
    return files.select("path", ext.alias("ext"), F.col("length").alias("bytes"), F.when(known, F.col("content").cast("string")).alias("text"), (~known).alias("skipped"))


def har_calls(spark: SparkSession, path: str) -> DataFrame:
    """``(method, path, headers, seq)``: distinct calls of request archives, credentials' header names left out."""
    har = spark.read.schema(f"log struct<entries:array<{_ENTRY}>>").option("multiLine", "true").json(path)
    e = har.select(F.posexplode("log.entries").alias("seq", "e"))
    names = F.array_sort(F.filter(F.transform("e.request.headers", lambda h: F.lower(h["name"])), lambda n: ~n.isin(*_SECRET_HEADERS)))
    calls = e.select("seq", F.col("e.request.method").alias("method"), F.regexp_extract("e.request.url", r"^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"), names.alias("headers"))
    return calls.groupBy("method", "path").agg(F.min(F.struct("seq", "headers")).alias("_f")).select("method", "path", "_f.headers", "_f.seq")


def ddl_tables(spark: SparkSession, path: str) -> DataFrame:
    """``(table)``: names in CREATE TABLE statements."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?i)create\s+table\s+(?:if\s+not\s+exists\s+)?[\"`\[]?([A-Za-z_][A-Za-z0-9_.]*)"))).alias("table")).distinct()


def csv_fields(spark: SparkSession, path: str) -> DataFrame:
    """``(file, fields)``: the first line's parts between commas, trimmed; quotes have no meaning."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", "\r?\n")[0].alias("line"))
    return lines.select("file", F.transform(F.split("line", ","), lambda f: F.trim(f)).alias("fields"))


def access_log(spark: SparkSession, path: str) -> DataFrame:
    """``(ip, ts, method, path, status, bytes)`` of common log lines; other lines are left out."""
    line = r'^(\S+) \S+ \S+ \[([^\]]*)\] "([A-Z]+) ([^ "]*)[^"]*" ([0-9]{3}) ([0-9-]+)'
    part = lambda i: F.regexp_extract("value", line, i)
    return spark.read.text(path).where(F.col("value").rlike(line)).select(
        part(1).alias("ip"), part(2).alias("ts"), part(3).alias("method"), part(4).alias("path"), part(5).cast("int").alias("status"), part(6).try_cast("long").alias("bytes")
    )


def missing_demand(log: DataFrame) -> DataFrame:
    """``(path, hits)``: paths without their query that were asked for and not found, most wanted first."""
    return log.where("status = 404").groupBy(F.regexp_extract("path", "^[^?]*", 0).alias("path")).agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "path")


def robots_rules(spark: SparkSession, path: str, agent: str = "*") -> DataFrame:
    """``(allow, pattern)`` that apply to ``agent``: a user-agent line replaces the one before it."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
    parts = lines.select("file", "pos", F.lower(F.trim(F.regexp_extract("line", "^([^:#]*):", 1))).alias("key"), F.trim(F.regexp_extract("line", "^[^:#]*:([^#]*)", 1)).alias("rule"))
    w = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    agents = parts.withColumn("agent", F.last(F.when(F.col("key") == "user-agent", F.lower("rule")), ignorenulls=True).over(w))
    return agents.where((F.col("agent") == agent) & F.col("key").isin("allow", "disallow") & (F.col("rule") != "")).select((F.col("key") == "allow").alias("allow"), F.col("rule").alias("pattern"))


def matches_rule(path: Column, pattern: Column) -> Column:
    """Whether a crawl rule takes a path: ``*`` is any run of characters, a last ``$`` the end of the path, all else the path's beginning.

    The parts between stars are looked for one after the other, each from where
    the one before ended, so time is linear in the path however many stars there are.
    """
    anchored = pattern.endswith("$")
    parts = F.split(F.when(anchored, F.regexp_replace(pattern, r"\$$", "")).otherwise(pattern), r"\*")
    last = F.element_at(parts, -1)
    inner = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - F.when(anchored, 2).otherwise(1), F.lit(0)))
    step = lambda at, part: F.when(at < 0, at).otherwise(F.when(part == "", at).otherwise(F.coalesce(F.nullif(F.position(part, path, at + 1), F.lit(0)) + F.length(part) - 1, F.lit(-1))))
    end = F.aggregate(inner, F.length(parts[0]), step)
    rest = F.when(F.size(parts) == 1, path == parts[0]).otherwise((end >= 0) & path.endswith(last) & (F.length(path) - F.length(last) >= end))
    return path.startswith(parts[0]) & F.when(anchored, rest).otherwise(end >= 0)


def robots_verdicts(paths: DataFrame, rules: DataFrame, path_col: str = "path", on: tuple[str, ...] = ()) -> DataFrame:
    """``paths`` with ``allowed``: the longest matching rule decides, allow wins ties; ``on``: columns that paths and rules share, such as the host.

    Rules are indexed by what they begin with, up to their first star; each path
    meets them by its own beginnings, no longer than the longest of the rules',
    and the pattern is verified on the candidates. A rule that begins with a
    star is a candidate for every path of its host. A null path is allowed.
    """
    literal = F.regexp_extract("pattern", r"^(.*?)(\*|\$$|$)", 1)
    known = rules.select(*on, "allow", "pattern", literal.alias("_begin"))
    longest = known.agg(F.max(F.length("_begin"))).first()[0] or 0
    length = F.least(F.length(path_col), F.lit(longest))
    begin = F.transform(F.sequence(F.lit(0), F.coalesce(length, F.lit(0))), lambda n: F.substring(F.col(path_col), F.lit(1), n))
    asked = paths.select(*on, path_col).distinct().where(F.col(path_col).isNotNull())
    hits = asked.select(*on, path_col, F.explode(begin).alias("_begin")).join(known, [*on, "_begin"]).where(matches_rule(F.col(path_col), F.col("pattern")))
    best = hits.groupBy(*on, path_col).agg(F.max(F.struct(F.length("pattern").alias("n"), "allow")).alias("_best"))
    return paths.join(best, [*on, path_col], "left").select(*paths.columns, F.coalesce("_best.allow", F.lit(True)).alias("allowed"))


def sitemap_urls(spark: SparkSession, path: str, origin: str) -> DataFrame:
    """``(url)``: locations of sitemaps that belong to ``origin``."""
    text = spark.read.text(path, wholetext=True)
    found = text.select(F.explode(F.regexp_extract_all("value", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"))).alias("url"))
    return found.where(F.col("url").startswith(origin)).distinct()


def deref(document: dict, schema: dict, depth: int = 6) -> dict:
    """A schema with its local references followed, at most ``depth`` deep."""
    if depth and "$ref" in schema and schema["$ref"].startswith("#/"):
        found = document
        for part in schema["$ref"][2:].split("/"):
            found = found[part]
        return deref(document, found, depth - 1)
    return schema


def openapi_operations(spark: SparkSession, path: str) -> DataFrame:
    """``(method, path, operation_id, deprecated)`` of specifications in JSON."""
    text = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    by_path = text.lateralJoin(spark.tvf.variant_explode(F.variant_get(F.col("v").outer(), "$.paths", "variant"))).select(F.col("key").alias("path"), F.col("value").alias("operations"))
    each = by_path.lateralJoin(spark.tvf.variant_explode(F.col("operations").outer())).where(F.col("key").isin("get", "put", "post", "delete", "patch", "head", "options"))
    get = lambda field, kind: F.try_variant_get("value", f"$.{field}", kind)
    return each.select(F.upper("key").alias("method"), "path", get("operationId", "string").alias("operation_id"), F.coalesce(get("deprecated", "boolean"), F.lit(False)).alias("deprecated"))
