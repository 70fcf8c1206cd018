"""What pages and manifests depend on: files they point at, and libraries by version and support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Extensions of files that are no code: fixed values.
ASSET = r"(?i)\.(png|jpe?g|gif|svg|webp|avif|ico|woff2?|ttf|otf|eot|mp[34]|webm|ogg|wav|pdf)$"

#: What projects have published about their own releases (name, major, status, since): fixed values.
SUPPORT = (
    ("angular", 1, "end of life", "2021-12-31"),
    ("jquery", 1, "unsupported", "2016-05-20"),
    ("jquery", 2, "unsupported", "2016-05-20"),
    ("bootstrap", 2, "end of life", "2013-08-19"),
    ("bootstrap", 3, "end of life", "2019-07-24"),
    ("bootstrap", 4, "end of life", "2023-01-01"),
    ("vue", 2, "end of life", "2023-12-31"),
    ("moment", 2, "maintenance mode", "2020-09-15"),
    ("prototype", 1, "dormant", "2015-09-22"),
    ("mootools", 1, "dormant", "2016-01-14"),
    ("@angular/core", 12, "end of life", "2022-11-12"),
    ("@angular/core", 13, "end of life", "2023-05-04"),
    ("@angular/core", 14, "end of life", "2023-11-18"),
    ("@angular/core", 15, "end of life", "2024-05-18"),
    ("@angular/core", 16, "end of life", "2024-11-08"),
    ("@angular/core", 17, "end of life", "2025-05-15"),
    ("@angular/core", 18, "end of life", "2025-11-19"),
    ("@angular/core", 19, "end of life", "2026-05-19"),
)


def references(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``(file, target, kind)``: files that markup and style sheets point at by a fixed, local address."""
    markup = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\b(?:src|href|poster)\s*=\s*[\"']([^\"']+)[\"']")), lambda t: F.struct(F.trim(t).alias("target"), F.lit("markup").alias("kind")))
    css = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)url\(\s*['\"]?([^'\")]+)['\"]?\s*\)")), lambda t: F.struct(F.trim(t).alias("target"), F.lit("css").alias("kind")))
    found = files.select(F.col(path).alias("file"), F.explode(F.concat(markup, css)).alias("r")).select("file", "r.*")
    local = ~F.col("target").rlike(r"(?i)^[a-z][\w+.-]*:|^//") & ~F.col("target").rlike(r"[{$<%]")
    return found.where(F.regexp_extract("target", "^[^?#]*", 0).rlike(ASSET) & local)


def _squeezed(path: Column) -> Column:
    return F.regexp_replace(path, "/+", "/")


def resolved(refs: DataFrame, held: DataFrame) -> DataFrame:
    """``refs`` with ``hit``: the held file (column path) that a reference means, or null.

    By preference the address itself, then below the file's own folder, then any
    file of that name, the least path first: three equi-joins on what each
    reference may mean; distinct references are looked up once.
    """
    paths = held.select(F.regexp_replace("path", r"^\./", "").alias("known")).distinct()
    by_name = paths.groupBy(F.regexp_extract("known", "[^/]*$", 0).alias("name")).agg(F.min("known").alias("by_name"))
    asked = refs.select("file", "target").distinct()
    clean = F.regexp_replace(F.regexp_replace(F.regexp_extract("target", "^[^?#]*", 0), r"^\./", ""), "^/", "")
    folder = F.regexp_extract("file", "^(.*)/[^/]*$", 1)
    asked = asked.withColumns({"_clean": clean, "_folder": folder}).withColumns({"_below": _squeezed(F.when(F.col("_folder") == "", F.col("_clean")).otherwise(F.concat("_folder", F.lit("/"), "_clean"))), "_name": F.regexp_extract("_clean", "[^/]*$", 0)})
    exact, below = paths.select(F.col("known").alias("_clean"), F.col("known").alias("exact")), paths.select(F.col("known").alias("_below"), F.col("known").alias("below"))
    met = asked.join(exact, "_clean", "left").join(below, "_below", "left").join(by_name.withColumnRenamed("name", "_name"), "_name", "left")
    hits = met.select("file", "target", F.coalesce("exact", "below", "by_name").alias("hit"))
    return refs.join(hits, ["file", "target"], "left")


def asset_report(refs: DataFrame, held: DataFrame) -> DataFrame:
    """``(path, state, n)``: files by how many references mean them (``referenced``, or ``unreferenced``), and addresses that no file has (``dead``)."""
    found = resolved(refs, held)
    counts = found.where("hit is not null").groupBy(F.col("hit").alias("path")).agg(F.count("*").alias("n"))
    files = held.select(F.regexp_replace("path", r"^\./", "").alias("path")).distinct().join(counts, "path", "left")
    own = files.select("path", F.when(F.col("n") > 0, "referenced").otherwise("unreferenced").alias("state"), F.coalesce("n", F.lit(0)).alias("n"))
    dead = found.where("hit is null").groupBy(F.col("target").alias("path")).agg(F.count("*").alias("n")).select("path", F.lit("dead").alias("state"), "n")
    return own.unionByName(dead)


def script_libraries(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """``(id, name, version)``: libraries whose address in a script element carries a version."""
    src = pages.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(html_col, F.lit(r"(?i)<script\b[^>]*\bsrc\s*=\s*[\"']([^\"']+)[\"']"))).alias("src"))
    path = F.regexp_extract("src", "^[^?#]*", 0)
    forms = [r"(?i)/ajax/libs/([a-z0-9_.-]+)/(\d+\.\d+(?:\.\d+)?)/", r"(?i)/(?:npm/)?((?:@[a-z0-9_-]+/)?[a-z0-9_.-]+)@(\d+\.\d+(?:\.\d+)?)(?:/|$)", r"(?i)(?:^|/)([a-z][a-z0-9_.-]*?)[-.@](\d+\.\d+(?:\.\d+)?)(?:[.-]min)?\.js$"]
    pick = lambda group: F.coalesce(*[F.nullif(F.regexp_extract(path, form, group), F.lit("")) for form in forms])
    return src.select("id", pick(1).alias("name"), pick(2).alias("version")).where("name is not null")


def manifest_libraries(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, name, version)``: what manifests in JSON declare; null where no version is pinned."""
    fields = ("dependencies", "devDependencies", "peerDependencies")
    pairs = [F.map_entries(F.from_json(F.get_json_object(text_col, f"$.{f}"), "map<string,string>")) for f in fields]
    none = F.array().cast("array<struct<key:string,value:string>>")
    each = files.select(F.col(id_col).alias("id"), F.explode(F.concat(*[F.coalesce(p, none) for p in pairs])).alias("d"))
    loose = F.trim(F.col("d.value")).rlike(r"(?i)^(latest|\*|x|>|git|http|file|link|workspace)")
    version = F.nullif(F.regexp_extract(F.col("d.value"), r"\d+(?:\.\d+)?(?:\.\d+)?", 0), F.lit(""))
    return each.select("id", F.col("d.key").alias("name"), F.when(~loose, version).alias("version"))


def support(libraries: DataFrame) -> DataFrame:
    """``libraries`` with ``status`` and ``since``: what the project published for the major version."""
    spark = libraries.sparkSession
    known = spark.createDataFrame([(n, m, s, d) for n, m, s, d in SUPPORT], "_name string, _major int, status string, since string")
    latest = known.groupBy("_name").agg(F.max("_major").alias("_latest"))
    major = F.regexp_extract("version", r"^\d+", 0).try_cast("int")
    asked = libraries.withColumns({"_name": F.lower("name"), "_major": major})
    met = asked.join(F.broadcast(known), ["_name", "_major"], "left").join(F.broadcast(latest), "_name", "left")  # as many rows as the table above
    status = F.when(F.col("_major").isNull(), "unpinned").when(F.col("status").isNotNull(), F.col("status")).when(F.col("_major") > F.col("_latest"), "later than the table").otherwise("not assessed")
    return met.select(*libraries.columns, status.alias("status"), "since")
