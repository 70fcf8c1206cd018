"""The given tables, and the typed tables that Spark derives from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log seen as requests: ``seq, ts, user_id, method, path, status, ms``."""
    e = table(spark, sf_dir, "events")
    method = F.when(F.col("event_type").isin("view", "click"), "GET").when(F.col("event_type") == "error", "DELETE").otherwise("POST")
    path = F.concat(F.lit("/api/v1/"), F.col("event_type"), F.lit("s/"), F.col("user_id").cast("string"))
    status = F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "purchase", 201).otherwise(200)
    return e.select(F.col("event_id").alias("seq"), "ts", "user_id", "event_type", method.alias("method"), path.alias("path"), status.alias("status"), F.col("value").alias("ms"), "props")


#: The same view for the SQL side.
CALLS_SQL = """calls AS (SELECT event_id AS seq, ts, user_id, event_type,
  CASE WHEN event_type IN ('view', 'click') THEN 'GET' WHEN event_type = 'error' THEN 'DELETE' ELSE 'POST' END AS method,
  '/api/v1/' || event_type || 's/' || user_id AS path,
  CASE event_type WHEN 'error' THEN 500 WHEN 'purchase' THEN 201 ELSE 200 END AS status, value AS ms, props FROM events)"""


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, url, scheme, host, path, query, fragment`` of every page."""
    return table(spark, sf_dir, "pages").select("page_id", "url", *urls.parts("url"))


PAGES_SQL = r"""u AS (SELECT page_id, url, html, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
  regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment FROM pages)"""


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, host, path, pos, href, target``: every link, resolved against its page's path."""
    p = table(spark, sf_dir, "pages").select("page_id", *urls.parts("url"), F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"')).alias("hrefs"))
    links = p.select("page_id", "host", "path", F.posexplode("hrefs").alias("pos", "href"))
    return links.withColumn("target", urls.resolve(F.col("path"), F.col("href")))


LINKS_SQL = (
    PAGES_SQL
    + r""", h AS (SELECT page_id, host, path, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS hrefs FROM u),
  l AS (SELECT page_id, host, path, unnest(range(len(hrefs)))::INT AS pos, unnest(hrefs) AS href FROM h),
  full_links AS (SELECT *, CASE WHEN regexp_matches(href, '^([A-Za-z][A-Za-z0-9+.-]*:|//)') THEN NULL WHEN starts_with(href, '/') THEN regexp_extract(href, '^[^?#]*')
    WHEN regexp_matches(href, '^($|[?#])') THEN path WHEN path = '' THEN '/' || regexp_extract(href, '^[^?#]*') ELSE regexp_replace(path, '[^/]*$', '') || regexp_extract(href, '^[^?#]*') END AS whole FROM l),
  links AS (SELECT page_id, host, path, pos, href, array_to_string(list_reduce(list_transform(string_split(CASE WHEN regexp_matches(whole, '/[.][.]?$') THEN whole || '/' ELSE whole END, '/'), lambda s: [s]),
    lambda done, s: CASE WHEN s[1] = '..' THEN CASE WHEN len(done) > 1 THEN done[:-2] ELSE done END WHEN s[1] = '.' THEN done ELSE list_concat(done, s) END), '/') AS target FROM full_links)"""
)
