"""Queries over ordered tables: crawls under budgets and answers to requests, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, ordered
from ..sources.tables import LINKS_SQL, page_links, page_urls, table
from .catalog import query
from .scratch import materialize

#: Budgets of the crawl: pages and bytes.
PAGES, BYTES = 150, 1_000_000

_OUTCOME = f"CASE WHEN n - page + {{0}} >= {PAGES} THEN 'over the page limit' WHEN total - size + {{1}} >= {BYTES} THEN 'over the byte limit' WHEN page = 0 THEN 'missing' ELSE 'page' END"
_RUN = "sum(page) OVER w AS n, sum(size) OVER w AS total, row_number() OVER w AS rank"


@query(f"""WITH {LINKS_SQL}, known AS (SELECT host || path AS node, min(page_id) AS place, max(octet_length(encode(html))) AS bytes FROM u GROUP BY 1),
  e AS (SELECT DISTINCT host || path AS src, pos, host || target AS dst FROM links WHERE target IS NOT NULL),
  m0 AS (SELECT node, 1 AS page, bytes AS size, {_RUN.replace("page)", "1)").replace("size)", "bytes)")} FROM known WHERE place IN (SELECT min(page_id) FROM u GROUP BY host) WINDOW w AS (ORDER BY place, node)),
  l0 AS (SELECT node, 0 AS depth, rank AS place, size, {_OUTCOME.format(0, 0)} AS outcome FROM m0),
  c1 AS (SELECT dst AS node, min(place * 1000000 + pos) AS met FROM l0 JOIN e ON src = l0.node WHERE outcome = 'page' AND dst NOT IN (SELECT node FROM l0) GROUP BY 1),
  m1 AS (SELECT c1.node, met, (bytes IS NOT NULL)::INT AS page, coalesce(bytes, 0) AS size, sum((bytes IS NOT NULL)::INT) OVER w AS n, sum(coalesce(bytes, 0)) OVER w AS total, row_number() OVER w AS rank FROM c1 LEFT JOIN known USING (node) WINDOW w AS (ORDER BY met, c1.node)),
  l1 AS (SELECT node, 1 AS depth, rank + (SELECT count(*) FROM l0) AS place, {_OUTCOME.format("(SELECT count(*) FROM l0 WHERE outcome = 'page')", "(SELECT coalesce(sum(size), 0) FROM l0 WHERE outcome = 'page')")} AS outcome FROM m1)
  SELECT node, depth::INT AS depth, place, outcome FROM l0 UNION ALL SELECT node, depth, place, outcome FROM l1""")
def r49_budgeted_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl from the first page of each host, one step deep, within a page and a byte budget."""
    pages = page_urls(spark, sf_dir).join(table(spark, sf_dir, "pages").select("page_id", F.octet_length("html").alias("bytes")), "page_id").select("host", F.concat("host", "path").alias("node"), "page_id", "bytes")
    links = materialize(page_links(spark, sf_dir).where("target is not null").select(F.concat("host", "path").alias("src"), "pos", F.concat("host", "target").alias("dst")))
    first = pages.groupBy("host").agg(F.min_by("node", "page_id").alias("node"), F.min("page_id").alias("place"))
    return graph.budgeted_crawl(first, links, pages, 1, PAGES, BYTES)


@query("""WITH RECURSIVE log AS (SELECT 'u' || user_id % 40 AS address, event_id AS seq, event_type IN ('view', 'click') AS asked FROM events WHERE event_type <> 'signup'),
  q AS (SELECT address, seq, asked, CASE WHEN asked THEN 1 ELSE -1 END AS s, row_number() OVER (PARTITION BY address ORDER BY seq) AS i FROM log),
  walk AS (SELECT address, i, seq, asked, greatest(0, s) AS open, CASE WHEN NOT asked THEN true ELSE false END AS lost FROM q WHERE i = 1
    UNION ALL SELECT q.address, q.i, q.seq, q.asked, greatest(0, walk.open + q.s), NOT q.asked AND walk.open = 0 FROM walk JOIN q ON q.address = walk.address AND q.i = walk.i + 1),
  r AS (SELECT address, seq, row_number() OVER (PARTITION BY address ORDER BY seq) AS k FROM walk WHERE asked), a AS (SELECT address, seq, row_number() OVER (PARTITION BY address ORDER BY seq) AS k FROM walk WHERE NOT asked AND NOT lost)
  SELECT r.address, r.seq AS request, a.seq AS response FROM r LEFT JOIN a ON a.address = r.address AND a.k = r.k""")
def request_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests and responses of an address: each response with the first open request."""
    kind = F.when(F.col("event_type").isin("view", "click"), "request").otherwise("response")
    log = table(spark, sf_dir, "events").where("event_type <> 'signup'").select(F.concat(F.lit("u"), F.col("user_id") % 40).alias("address"), F.col("event_id").alias("seq"), kind.alias("kind"))
    return ordered.first_answers(log)
