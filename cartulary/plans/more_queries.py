"""Further queries: routes, repeats, entities, stores, crawls, rasters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph, greedy
from ..sources.tables import CALLS_SQL, LINKS_SQL, PAGES_SQL, calls, page_links, page_urls, table
from .catalog import query


@query(f"""WITH {PAGES_SQL}, s AS (SELECT DISTINCT host, path FROM u) SELECT l.page_id, coalesce(a.path, b.path) AS screen, CASE WHEN a.path IS NOT NULL THEN 'exact' WHEN b.path IS NOT NULL THEN 'stripped' ELSE 'unrouted' END AS how
  FROM u l LEFT JOIN s a ON a.host = l.host AND a.path = l.path || '.html' LEFT JOIN s b ON b.host = l.host AND b.path = regexp_replace(l.path, '[.]html$', '')""")
def r13_route_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each path's page with suffix, else without."""
    u = page_urls(spark, sf_dir).select("page_id", "host", "path")
    s = u.select("host", "path").distinct()
    one, two = s.select("host", F.col("path").alias("_want"), F.col("path").alias("_a")), s.select("host", F.col("path").alias("_bare"), F.col("path").alias("_b"))
    j = u.withColumn("_want", F.concat("path", F.lit(".html"))).withColumn("_bare", F.regexp_replace("path", "[.]html$", "")).join(one, ["host", "_want"], "left").join(two, ["host", "_bare"], "left")
    how = F.when(F.col("_a").isNotNull(), "exact").when(F.col("_b").isNotNull(), "stripped").otherwise("unrouted")
    return j.select("page_id", F.coalesce("_a", "_b").alias("screen"), how.alias("how"))


@query("SELECT c_custkey, '/' || lower(r_name) || '/' || lower(n_name) || '/' || c_custkey AS full_path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def r14_nested_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full paths through parents, one join a level."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select("c_custkey", F.concat(F.lit("/"), F.lower("r_name"), F.lit("/"), F.lower("n_name"), F.lit("/"), F.col("c_custkey").cast("string")).alias("full_path"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), d AS (SELECT DISTINCT doc_id, md5(line) AS line FROM l WHERE length(line) >= 20) SELECT line, count(*) AS documents, min(doc_id) AS first FROM d GROUP BY 1 HAVING count(*) >= 2""")
def r19_repeated_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of twenty characters or more that two documents or more hold."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") >= 20)
    d = lines.select("doc_id", F.md5("line").alias("line")).distinct()
    return d.groupBy("line").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first")).where("documents >= 2")


@query(r"""WITH s AS (SELECT md5(regexp_replace(html, '>[^<]*<', '><', 'g')) AS skeleton, regexp_extract_all(html, '>([^<]+)<', 1) AS slots FROM pages), p AS (SELECT skeleton, unnest(range(len(slots)))::INT AS slot, unnest(slots) AS v FROM s)
  SELECT skeleton, slot, count(*) AS uses, count(DISTINCT v) AS seen FROM p GROUP BY 1, 2 HAVING count(DISTINCT v) > 1""")
def r20_varying_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text slots that vary among pages of the same skeleton."""
    s = table(spark, sf_dir, "pages").select(F.md5(F.regexp_replace("html", ">[^<]*<", "><")).alias("skeleton"), F.posexplode(F.regexp_extract_all("html", F.lit(">([^<]+)<"))).alias("slot", "v"))
    return s.groupBy("skeleton", "slot").agg(F.count("*").alias("uses"), F.count_distinct("v").alias("seen")).where("seen > 1")


@query()
def r28_greedy_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy clustering of the pages of a host by their tag sets, in page order."""
    tags = F.array_distinct(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)")))
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("host"), F.col("page_id").alias("id"), tags.alias("props"))
    return greedy.ordered_pass(p, "host", ["id"], greedy.entity_step(), "id long, entity long").withColumnRenamed("id", "page_id")


@query()
def r28_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of each host: a page's tags are the properties of its address, of type one or many."""
    tags = F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"))
    typed = F.transform(F.array_distinct("tags"), lambda t: F.concat(t, F.when(F.size(F.filter("tags", lambda x: x == t)) > 1, ":many").otherwise(":one")))
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("group"), F.col("page_id").alias("seq"), F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^#]*)", 1).alias("endpoint"), tags.alias("tags"))
    return greedy.entities(p.select("group", "seq", "endpoint", typed.alias("properties")))


_REFS = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels", "doc_id", "documents", "doc_id")]


@query(" UNION ALL ".join(f"SELECT '{a}.{x}' AS reference, '{b}' AS entity, count(*) AS rows, count(*) FILTER (NOT EXISTS (SELECT 1 FROM {b} t WHERE t.{y} = f.{x})) AS orphans FROM {a} f" for a, x, b, y in _REFS))
def r29_inferred_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that their names suggest, with the rows that point nowhere."""
    out = None
    for a, x, b, y in _REFS:
        known = table(spark, sf_dir, b).select(F.col(y).alias("_key")).distinct().withColumn("_hit", F.lit(1))
        counts = table(spark, sf_dir, a).groupBy(F.col(x).alias("_key")).agg(F.count("*").alias("n")).join(known, "_key", "left")
        row = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("_hit").isNull(), F.col("n"))), F.lit(0)).alias("orphans")).select(F.lit(f"{a}.{x}").alias("reference"), F.lit(b).alias("entity"), "rows", "orphans")
        out = row if out is None else out.union(row)
    return out


@query(f"""WITH RECURSIVE {LINKS_SQL}, e AS (SELECT DISTINCT host || path AS src, host || target AS dst FROM links WHERE target IS NOT NULL), w(node, depth) AS (SELECT DISTINCT host || path, 0 FROM u UNION SELECT dst, depth + 1 FROM w JOIN e ON src = node WHERE depth < 2) SELECT node, min(depth)::INT AS depth FROM w GROUP BY 1""")
def r49_bounded_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth-first from every page, two steps at most."""
    e = page_links(spark, sf_dir).where("target is not null").select(F.concat("host", "path").alias("src"), F.concat("host", "target").alias("dst")).distinct()
    roots = page_urls(spark, sf_dir).select(F.concat("host", "path").alias("node")).distinct()
    return graph.reachable(e, roots, 2)


@query("""WITH t AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) SELECT c_custkey, round(c_acctbal + coalesce(total, 0), 2) AS balance FROM customer LEFT JOIN t ON o_custkey = c_custkey
  UNION ALL SELECT max(c_custkey) + 1, 0.0 FROM customer""")
def r62_store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of updates to a store, and a new row under the next id."""
    c = table(spark, sf_dir, "customer")
    t = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    updated = c.join(t, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.round(F.col("c_acctbal") + F.coalesce("total", F.lit(0.0)), 2).alias("balance"))
    return updated.union(c.agg((F.max("c_custkey") + 1).alias("c_custkey")).withColumn("balance", F.lit(0.0)))


@query("""SELECT event_type, count(*) FILTER (json_valid(props)) AS ok, count(*) FILTER (NOT json_valid(props)) AS failed FROM events GROUP BY 1""")
def r64_error_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads parsed one by one; a failure is counted and stops nothing."""
    good = F.try_parse_json("props").isNotNull()
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(good).alias("ok"), F.count_if(~good).alias("failed"))


@query("""WITH RECURSIVE d AS (SELECT p_brand AS g, p_retailprice AS v, count(*) AS n FROM part GROUP BY 1, 2), f(g, first) AS (SELECT g, min(v) FROM d GROUP BY 1 UNION ALL SELECT f.g, (SELECT min(v) FROM d WHERE d.g = f.g AND v > first + 2) FROM f WHERE EXISTS (SELECT 1 FROM d WHERE d.g = f.g AND v > first + 2)),
  b AS (SELECT g, first, row_number() OVER (PARTITION BY g ORDER BY first) - 1 AS bucket FROM f), j AS (SELECT d.g, bucket, sum(n) AS n, sum(v * n) / sum(n) AS mean FROM d JOIN b ON d.g = b.g AND v BETWEEN first AND first + 2 GROUP BY 1, 2)
  SELECT g AS "group", bucket, n::BIGINT AS n, round(mean, 4) AS mean FROM j WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY g ORDER BY bucket) <= 7""")
def r66_tolerance_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of each brand in buckets within two of the first, with their means: the first seven buckets of two or more.

    The ordered pass sees each distinct price once, with its count.
    """
    p = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("group"), F.col("p_retailprice").alias("value")).agg(F.count("*").alias("k"))
    b = greedy.ordered_pass(p, "group", ["value"], greedy.tolerance_step(2.0), "group string, value double, bucket long").join(p, ["group", "value"])
    means = b.groupBy("group", "bucket").agg(F.sum("k").alias("n"), F.round(F.sum(F.col("value") * F.col("k")) / F.sum("k"), 4).alias("mean")).where("n >= 2")
    return means.withColumn("_at", F.row_number().over(Window.partitionBy("group").orderBy("bucket"))).where("_at <= 7").drop("_at")


@query(f"WITH {CALLS_SQL} SELECT regexp_extract(regexp_replace(path, '^/api/v1', ''), '^/([a-z]+)/', 1) AS route, count(*) AS n, count(DISTINCT user_id) AS users FROM calls GROUP BY 1")
def r70_stripped_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls matched to routes after the base path is taken off."""
    c = calls(spark, sf_dir).withColumn("bare", F.regexp_replace("path", "^/api/v1", ""))
    return c.groupBy(F.regexp_extract("bare", "^/([a-z]+)/", 1).alias("route")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query(f"""WITH {LINKS_SQL}, known AS (SELECT DISTINCT host, path FROM u) SELECT l.page_id, count(*) FILTER (k.path IS NOT NULL) AS hit, count(*) FILTER (k.path IS NULL AND target IS NOT NULL) AS miss, count(*) FILTER (target IS NULL) AS unknown FROM links l LEFT JOIN known k ON k.host = l.host AND k.path = l.target GROUP BY 1""")
def r71_three_valued_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that hit a page, miss, or cannot be judged."""
    known = page_urls(spark, sf_dir).select("host", F.col("path").alias("target")).distinct().withColumn("_hit", F.lit(True))
    j = page_links(spark, sf_dir).select("page_id", "host", "target").join(known, ["host", "target"], "left")
    return j.groupBy("page_id").agg(F.count("_hit").alias("hit"), F.count_if(F.col("_hit").isNull() & F.col("target").isNotNull()).alias("miss"), F.count_if(F.col("target").isNull()).alias("unknown"))


@query("""WITH p AS (SELECT embedding, unnest(range(len(embedding) // 3)) * 3 AS i FROM embeddings), x AS (SELECT floor((embedding[i + 1]::DOUBLE + 1) * 127.5)::INT AS r, floor((embedding[i + 2]::DOUBLE + 1) * 127.5)::INT AS g, floor((embedding[i + 3]::DOUBLE + 1) * 127.5)::INT AS b FROM p), c AS (SELECT r // 8 AS br, g // 8 AS bg, b // 8 AS bb, r, g, b, count(*) AS n FROM x GROUP BY ALL),
  k AS (SELECT br, bg, bb, sum(n)::BIGINT AS total, arg_min((r * 256 + g) * 256 + b, (-n, r, g, b)) AS colour FROM c GROUP BY 1, 2, 3) SELECT br, bg, bb, total, colour FROM k ORDER BY total DESC, br, bg, bb LIMIT 8""")
def r73_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors read as rows of pixels: the eight fullest five-bit bins, with each bin's most frequent exact value."""
    part = lambda i: F.floor((F.get("embedding", F.col("at") * 3 + i).cast("double") + 1) * 127.5).cast("int")
    pixels = table(spark, sf_dir, "embeddings").where(F.size("embedding") >= 3).select("embedding", F.explode(F.sequence(F.lit(0), F.floor(F.size("embedding") / 3).cast("int") - 1)).alias("at"))
    c = pixels.groupBy(part(0).alias("r"), part(1).alias("g"), part(2).alias("b")).agg(F.count("*").alias("n"))
    bins = [F.floor(F.col(x) / 8).cast("int").alias(f"b{x}") for x in "rgb"]
    k = c.groupBy(*bins).agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("k"), "r", "g", "b")).alias("m"))
    return k.select("br", "bg", "bb", "total", ((F.col("m.r") * 256 + F.col("m.g")) * 256 + F.col("m.b")).alias("colour")).orderBy(F.desc("total"), "br", "bg", "bb").limit(8)


@query()
def r74_raster_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as an image eight cells wide: regions above its mean."""

    @F.pandas_udf("int")
    def regions(images: pd.Series) -> pd.Series:
        return pd.Series([greedy.raster_components(list(x), 8) for x in images], dtype="int32")

    return table(spark, sf_dir, "embeddings").where("size(embedding) > 0").select("vec_id", regions("embedding").alias("regions"))


@query()
def r79_role_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names of a brand take roles in order, each role once."""
    hints = {"surface": "ring", "ink": "red", "accent": "blue", "muted": "small"}
    # only names with a hint can take a role, and of names with the same hints no more than there are roles
    held = F.filter(F.array(*map(F.lit, hints.values())), lambda h: F.contains("p_name", h))
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("group"), F.col("p_name").alias("name"), "p_partkey", held.alias("_held")).where("size(_held) > 0")
    first = p.withColumn("_at", F.row_number().over(Window.partitionBy("group", "_held").orderBy("p_partkey"))).where(F.col("_at") <= len(hints)).drop("_held", "_at")
    return greedy.ordered_pass(first, "group", ["p_partkey"], greedy.role_step(hints), "group string, name string, role string").where("role is not null")


@query(f"""WITH {LINKS_SQL}, f AS (SELECT host, path AS spot, 0 AS source FROM u UNION ALL SELECT host, target, 1 FROM links WHERE target IS NOT NULL) SELECT host, spot, min(source)::INT AS source, count(*) AS mentions FROM f GROUP BY 1, 2""")
def r81_url_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs from two sources, the listed ones before those found by crawling."""
    a = page_urls(spark, sf_dir).select("host", F.col("path").alias("spot"), F.lit(0).alias("source"))
    b = page_links(spark, sf_dir).where("target is not null").select("host", F.col("target").alias("spot"), F.lit(1).alias("source"))
    return a.union(b).groupBy("host", "spot").agg(F.min("source").alias("source"), F.count("*").alias("mentions"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, 'Apache License') THEN 'apache' WHEN regexp_matches(text, 'MIT License|Permission is hereby granted') THEN 'mit' WHEN regexp_matches(text, 'GNU (Lesser )?General Public') THEN 'gpl' WHEN regexp_matches(text, '(?i)creative commons|cc[- ]by') THEN 'cc' WHEN regexp_matches(text, '(?i)all rights reserved|copyright|license') THEN 'other' ELSE 'none' END AS family FROM documents""")
def r84_licence_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first licence family whose words a text holds."""
    t = F.col("text")
    family = F.when(t.rlike("Apache License"), "apache").when(t.rlike("MIT License|Permission is hereby granted"), "mit").when(t.rlike("GNU (Lesser )?General Public"), "gpl").when(t.rlike("(?i)creative commons|cc[- ]by"), "cc").when(t.rlike("(?i)all rights reserved|copyright|license"), "other").otherwise("none")
    return table(spark, sf_dir, "documents").select("doc_id", family.alias("family"))
