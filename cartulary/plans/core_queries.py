"""Relational, log and graph queries over the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import graph, relational
from ..sources.tables import CALLS_SQL, LINKS_SQL, PAGES_SQL, calls, page_links, page_urls, table
from .catalog import query


@query(f"WITH {CALLS_SQL} SELECT method, path, min(seq) AS seq, arg_min(status, seq) AS status FROM calls GROUP BY method, path")
def r07_distinct_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first call of each method and path."""
    c = calls(spark, sf_dir).select("seq", "method", "path", "status")
    return relational.keep_first(c, ["method", "path"], ["seq"]).select("method", "path", "seq", "status")


@query(f"""WITH {CALLS_SQL} SELECT DISTINCT method, path, lower(method) || list_aggregate(list_transform(list_filter(string_split(path, '/'), lambda s: s <> '' AND NOT regexp_matches(s, '[0-9{{}}:]')), lambda s: upper(s[1]) || s[2:]), 'string_agg', '') AS name FROM calls""")
def r08_endpoint_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name for each endpoint from its path's plain segments."""
    c = calls(spark, sf_dir).select("method", "path").distinct()
    return c.select("method", "path", urls.endpoint_name(F.col("method"), F.col("path")).alias("name"))


@query("""WITH nouns AS (SELECT DISTINCT lower(event_type) || 's' AS noun FROM events), parts AS (SELECT DISTINCT lower(regexp_extract(p_type, '[A-Z]+$')) AS kind FROM part),
  names AS (SELECT event_type AS name FROM (SELECT DISTINCT event_type FROM events) UNION SELECT kind FROM parts)
  SELECT noun, coalesce(a.name, b.name) AS entity, a.name IS NOT NULL AS exact FROM nouns LEFT JOIN names a ON a.name = noun LEFT JOIN names b ON b.name = regexp_replace(noun, 's$', '')""")
def r09_noun_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nouns of paths against entity names, the singular where the plural has none."""
    events = table(spark, sf_dir, "events").select("event_type").distinct()
    nouns = events.select(F.concat(F.lower("event_type"), F.lit("s")).alias("noun"))
    kinds = table(spark, sf_dir, "part").select(F.lower(F.regexp_extract("p_type", "[A-Z]+$", 0)).alias("name"))
    names = events.select(F.col("event_type").alias("name")).union(kinds).distinct()
    one, two = names.select(F.col("name").alias("plain")), names.select(F.col("name").alias("single"))
    joined = nouns.join(one, F.col("noun") == F.col("plain"), "left").join(two, F.regexp_replace("noun", "s$", "") == F.col("single"), "left")
    return joined.select("noun", F.coalesce("plain", "single").alias("entity"), F.col("plain").isNotNull().alias("exact"))


@query(f"WITH {PAGES_SQL} SELECT regexp_replace(regexp_replace(path, '/[0-9]+(/|$)', '/*\\1', 'g'), '/[0-9]+(/|$)', '/*\\1', 'g') AS shape, count(*) AS n FROM u GROUP BY 1")
def r10_path_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page paths with parameters as ``*``, counted."""
    return page_urls(spark, sf_dir).groupBy(urls.shape(F.col("path")).alias("shape")).agg(F.count("*").alias("n"))


_SPEC = """spec AS (SELECT DISTINCT 'GET' AS method, '/api/v1/' || event_type || 's/*' AS shape, event_type = 'click' AS deprecated FROM events
  UNION ALL SELECT DISTINCT 'PATCH', '/api/v1/' || lower(o_orderstatus) || '/*', false FROM orders)"""


@query(f"""WITH {CALLS_SQL}, {_SPEC}, used AS (SELECT DISTINCT method, regexp_replace(path, '/[0-9]+$', '/*') AS shape FROM calls)
  SELECT 'uncalled' AS finding, method, shape FROM spec s WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.method = s.method AND u.shape = s.shape)
  UNION ALL SELECT 'undocumented', method, shape FROM used u WHERE NOT EXISTS (SELECT 1 FROM spec s WHERE u.method = s.method AND u.shape = s.shape)
  UNION ALL SELECT 'deprecated', method, shape FROM spec s WHERE deprecated AND EXISTS (SELECT 1 FROM used u WHERE u.method = s.method AND u.shape = s.shape)""")
def r11_calls_against_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations never called, calls never documented, deprecated operations in use."""
    used = calls(spark, sf_dir).select("method", urls.shape(F.col("path")).alias("shape")).distinct()
    e = table(spark, sf_dir, "events").select("event_type").distinct()
    o = table(spark, sf_dir, "orders").select("o_orderstatus").distinct()
    spec = e.select(F.lit("GET").alias("method"), F.concat(F.lit("/api/v1/"), "event_type", F.lit("s/*")).alias("shape"), (F.col("event_type") == "click").alias("deprecated"))
    spec = spec.union(o.select(F.lit("PATCH"), F.concat(F.lit("/api/v1/"), F.lower("o_orderstatus"), F.lit("/*")), F.lit(False)))
    keys = ["method", "shape"]
    tag = lambda df, name: df.select(F.lit(name).alias("finding"), *keys)
    return tag(spec.join(used, keys, "left_anti"), "uncalled").union(tag(used.join(spec, keys, "left_anti"), "undocumented")).union(tag(spec.where("deprecated").join(used, keys, "left_semi"), "deprecated"))


@query("""WITH a AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1), b AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1)
  SELECT coalesce(a.k, b.k) AS o_custkey, a.v AS before, b.v AS after, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v""")
def r15_key_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose largest order differs between two periods."""
    o = table(spark, sf_dir, "orders")
    top = lambda cond: o.where(cond).groupBy("o_custkey").agg(F.max("o_totalprice").alias("v"))
    return relational.diff(top("o_orderdate < TIMESTAMP '1996-01-01'"), top("o_orderdate >= TIMESTAMP '1996-01-01'"), ["o_custkey"], "v")


_DAYS = "days AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1)"


@query(f"WITH {_DAYS} SELECT CAST(day AS VARCHAR) AS day, n, n - lag(n) OVER (ORDER BY day) AS delta, CASE WHEN n > lag(n) OVER (ORDER BY day) THEN 'up' WHEN n < lag(n) OVER (ORDER BY day) THEN 'down' WHEN n = lag(n) OVER (ORDER BY day) THEN 'same' ELSE 'first' END AS verdict FROM days")
def r16_r17_run_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events a day with the change since the day before and its verdict (one row a day after aggregation)."""
    days = table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    before = F.lag("n").over(Window.orderBy("day"))
    verdict = F.when(F.col("n") > before, "up").when(F.col("n") < before, "down").when(F.col("n") == before, "same").otherwise("first")
    return days.select(F.col("day").cast("string").alias("day"), "n", (F.col("n") - before).alias("delta"), verdict.alias("verdict"))


@query("SELECT l_suppkey, bool_or(l_returnflag = 'R') AS any_returned, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS statuses FROM lineitem GROUP BY l_suppkey")
def r18_group_or_and_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boolean-or and set union for each supplier."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_suppkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"), F.array_join(F.sort_array(F.collect_set("l_linestatus")), ",").alias("statuses"))


@query("SELECT l_shipdate::DATE::VARCHAR AS day, count(*) AS n FROM lineitem GROUP BY 1")
def r21_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items for each ship day."""
    return relational.tally(table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").cast("string").alias("day")), "day")


@query("""WITH c AS (SELECT l_suppkey, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, l_quantity, n FROM c QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_quantity) = 1""")
def r22_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent quantity of each supplier, ties to the smaller."""
    return relational.mode_per_group(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity")


@query("SELECT l_suppkey, list_sort(list(l_extendedprice))[(count(*) // 2) + 1] AS median, count(*) AS n FROM lineitem GROUP BY 1")
def r23_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper median price of each supplier."""
    return relational.upper_median_per_group(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice")


@query("SELECT p_brand, CASE WHEN p_size < 17 THEN 'compact' WHEN p_size < 36 THEN 'comfortable' ELSE 'roomy' END AS density, count(*) AS n FROM part GROUP BY 1, 2")
def r24_density_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes in three bands by brand."""
    band = F.when(F.col("p_size") < 17, "compact").when(F.col("p_size") < 36, "comfortable").otherwise("roomy")
    return table(spark, sf_dir, "part").groupBy("p_brand", band.alias("density")).agg(F.count("*").alias("n"))


@query("WITH f AS (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT label, count(*) AS n, round(sum(x), 6) AS total FROM f GROUP BY label")
def r25_nested_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All samples nested in vectors, flattened and summed by label."""
    samples = table(spark, sf_dir, "embeddings").select("label", F.explode("embedding").alias("x"))
    return samples.groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum(F.col("x").cast("double")), 6).alias("total"))


@query("""WITH c AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2), m AS (SELECT p_brand, arg_min(p_size, (-n, p_size)) AS body, sum(n) AS samples FROM c GROUP BY 1)
  SELECT c.p_brand, any_value(body) AS body, max(p_size) FILTER (p_size < body) AS smaller, min(p_size) FILTER (p_size > body) AS larger FROM c JOIN m ON c.p_brand = m.p_brand WHERE samples < 10 OR n > 1 GROUP BY 1""")
def r26_steps_around_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent size of each brand and the sizes next to it; of ten samples or more, single ones do not count."""
    c = relational.tally(table(spark, sf_dir, "part").select(F.struct("p_brand", "p_size").alias("k")), "k").select("k.*", "n")
    mode = c.groupBy("p_brand").agg(F.min(F.struct((-F.col("n")).alias("m"), "p_size")).alias("b"), F.sum("n").alias("samples")).select("p_brand", F.col("b.p_size").alias("body"), "samples")
    near = c.join(mode, "p_brand").where("samples < 10 or n > 1").groupBy("p_brand").agg(F.first("body").alias("body"), F.max(F.when(F.col("p_size") < F.col("body"), F.col("p_size"))).alias("smaller"), F.min(F.when(F.col("p_size") > F.col("body"), F.col("p_size"))).alias("larger"))
    return near


@query(f"""WITH {CALLS_SQL}, leaf AS (SELECT method, regexp_extract(path, '^(.*)/[^/]*$', 1) AS prefix, regexp_extract(path, '[^/]*$') AS leaf FROM calls),
  g AS (SELECT method, prefix, count(DISTINCT leaf) AS leaves, bool_and(regexp_matches(leaf, '[0-9]') OR length(leaf) > 6) AS ids, count(*) AS n FROM leaf GROUP BY 1, 2)
  SELECT method, prefix || '/:id' AS endpoint, n FROM g WHERE leaves > 1 AND ids
  UNION ALL SELECT l.method, l.prefix || '/' || leaf, count(*) FROM leaf l JOIN g ON l.method = g.method AND l.prefix = g.prefix WHERE NOT (leaves > 1 AND ids) GROUP BY 1, 2""")
def r30_endpoint_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that differ in an id only become one endpoint."""
    leaf = calls(spark, sf_dir).select("method", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("prefix"), F.regexp_extract("path", "[^/]*$", 0).alias("leaf"))
    counts = leaf.groupBy("method", "prefix", "leaf").agg(F.count("*").alias("n"))
    like_id = F.col("leaf").rlike("[0-9]") | (F.length("leaf") > 6)
    groups = counts.groupBy("method", "prefix").agg(((F.count("*") > 1) & F.bool_and(like_id)).alias("is_id"))
    named = counts.join(groups, ["method", "prefix"]).select("method", F.concat("prefix", F.lit("/"), F.when(F.col("is_id"), ":id").otherwise(F.col("leaf"))).alias("endpoint"), "n")
    return named.groupBy("method", "endpoint").agg(F.sum("n").alias("n"))


@query("""WITH k AS (SELECT event_type, unnest(json_keys(props)) AS key, props FROM events), t AS (SELECT event_type, key, CASE json_type(props, '$.' || key) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS type FROM k)
  SELECT event_type, key, type, count(*) AS n FROM t GROUP BY ALL""")
def r31_payload_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and value types of the JSON payloads, values left out."""
    e = table(spark, sf_dir, "events").select("event_type", "props", F.explode(F.json_object_keys("props")).alias("key"))
    raw = F.substring(F.schema_of_variant(F.variant_get(F.parse_json("props"), F.concat(F.lit("$."), "key"), "variant")), 1, 6)
    first = F.when(raw == "STRING", "string").when(raw == "BOOLEA", "boolean").when(raw == "VOID", "null").when(raw == "OBJECT", "object").when(raw == "ARRAY<", "array").otherwise("number")
    return e.groupBy("event_type", "key", first.alias("type")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type IN ('signup', 'purchase')) AS writes, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1)
  SELECT user_id, CASE WHEN writes * 2 > n THEN 'form' WHEN n > 10 THEN 'list' ELSE 'detail' END AS kind FROM s""")
def r32_screen_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form before list before detail, by what each user's log holds."""
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type").isin("signup", "purchase")).alias("writes"))
    return s.select("user_id", F.when(F.col("writes") * 2 > F.col("n"), "form").when(F.col("n") > 10, "list").otherwise("detail").alias("kind"))


@query("""WITH c AS (SELECT conv_id, bool_or(regexp_matches(text, '[?]')) AS asks, bool_or(length(text) = 0) AS empty, bool_or(regexp_matches(text, '(?i)error|sorry|failed')) AS failing FROM conversations GROUP BY 1)
  SELECT * FROM c""")
def r33_state_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States seen in any text of a conversation (flags are or-ed, texts are not gathered)."""
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.bool_or(F.col("text").rlike("[?]")).alias("asks"), F.bool_or(F.length("text") == 0).alias("empty"), F.bool_or(F.col("text").rlike("(?i)error|sorry|failed")).alias("failing"))


@query("""WITH s AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) SELECT a AS "from", b AS "to", count(*) AS n FROM s WHERE b IS NOT NULL GROUP BY 1, 2""")
def r34_event_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct transitions between successive events of a user, counted."""
    following = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    s = table(spark, sf_dir, "events").select(F.col("event_type").alias("from"), following.alias("to")).where("to is not null")
    return s.groupBy("from", "to").agg(F.count("*").alias("n"))


@query(f"""WITH {CALLS_SQL}, pat AS (SELECT DISTINCT '/api/v1/' || event_type || 's/{{id}}' AS pattern FROM events) SELECT pattern, count(*) AS n FROM calls JOIN pat ON regexp_replace(path, '/[0-9]+$', '/*') = regexp_replace(pattern, '/[{{][^/]*$', '/*') GROUP BY 1""")
def r35_pattern_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls against path patterns: an equi-join on the shape, not a theta join."""
    pat = table(spark, sf_dir, "events").select(F.concat(F.lit("/api/v1/"), "event_type", F.lit("s/{id}")).alias("pattern")).distinct()
    c = calls(spark, sf_dir).groupBy(urls.shape(F.col("path")).alias("shape")).agg(F.count("*").alias("n"))
    return pat.join(c, urls.shape(F.col("pattern")) == F.col("shape")).groupBy("pattern").agg(F.sum("n").alias("n"))


@query("SELECT regexp_replace(c_name, '[0-9]+', 'N', 'g') AS general, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT regexp_replace(s_name, '[0-9]+', 'N', 'g'), count(*) FROM supplier GROUP BY 1")
def r36_general_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with their numbers left out, counted."""
    general = lambda t, c: table(spark, sf_dir, t).groupBy(F.regexp_replace(c, "[0-9]+", "N").alias("general")).agg(F.count("*").alias("n"))
    return general("customer", "c_name").union(general("supplier", "s_name"))


_HOPS = "SELECT DISTINCT c_custkey AS src, c_nationkey::BIGINT AS dst FROM customer"


@query(f"""WITH RECURSIVE hops AS ({_HOPS}), walk(src, spot, seen) AS (SELECT src, dst, [src] FROM hops UNION ALL SELECT w.src, h.dst, list_append(seen, w.spot) FROM walk w JOIN hops h ON h.src = w.spot WHERE NOT list_contains(seen, w.spot)),
  ends AS (SELECT src, spot, row_number() OVER (PARTITION BY src ORDER BY len(seen) DESC) AS k, list_contains(seen, spot) AS cyclic FROM walk) SELECT src, CASE WHEN cyclic THEN NULL ELSE spot END AS dst, cyclic FROM ends WHERE k = 1""")
def r40_redirect_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a chain of hops from customer to nation number ends, cycles named."""
    hops = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src"), F.col("c_nationkey").cast("long").alias("dst"))
    return graph.redirect_closure(hops).select("src", F.when(~F.col("cyclic"), F.col("dst")).alias("dst"), "cyclic")


#: Components by the least node each round, in SQL: a node's row is replaced while a neighbour has a smaller one.
_COMPONENTS = """n AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
  cc(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM n UNION SELECT n.b, min(cc.component) FROM cc JOIN n ON n.a = cc.node JOIN recurring.cc AS r ON r.node = n.b WHERE cc.component < r.component GROUP BY n.b)
  SELECT node, component FROM cc"""


@query(f"""WITH RECURSIVE {LINKS_SQL}, e AS (SELECT DISTINCT page_id AS a, ('0x' || substr(md5(host || target), 1, 12))::BIGINT + 1000000000000 AS b FROM links WHERE target IS NOT NULL), {_COMPONENTS}""")
def r50_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components of pages and the addresses that they link to."""
    address = F.conv(F.substring(F.md5(F.concat("host", "target")), 1, 12), 16, 10).cast("long") + 1000000000000
    edges = page_links(spark, sf_dir).where("target is not null").select(F.col("page_id").alias("a"), address.alias("b"))
    return graph.connected_components(edges, "a", "b")


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, 1000000000 + l_suppkey AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey), {_COMPONENTS}""")
def r50_components_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components of customers and suppliers through all orders and their lines."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") + 1000000000).alias("b"))
    edges = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("a"), "b")
    return graph.connected_components(edges, "a", "b")


@query("""SELECT c.c_custkey, count(DISTINCT o_orderkey) AS orders, coalesce(count(l_linenumber), 0) AS lines, 10 * count(DISTINCT o_orderkey) + 3 * count(l_linenumber) + CASE WHEN any_value(c_acctbal) < 0 THEN 25 ELSE 0 END AS effort
  FROM customer c LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def r52_weighted_effort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weighted score from counts of related rows."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum(F.coalesce("n", F.lit(0))).alias("lines"))
    c = table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("lines", F.lit(0)).alias("lines"), "c_acctbal")
    return c.select("c_custkey", "orders", "lines", (10 * F.col("orders") + 3 * F.col("lines") + F.when(F.col("c_acctbal") < 0, 25).otherwise(0)).cast("long").alias("effort"))


def _scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return relational.scorecard({"returned": (li, F.col("l_returnflag") == "R"), "open": (o, F.col("o_orderstatus") == "O"), "not run": None})


_CARD = """card AS (SELECT 'returned' AS concern, true AS present, count(*) FILTER (l_returnflag = 'R') AS n, count(*) AS "of" FROM lineitem UNION ALL SELECT 'open', true, count(*) FILTER (o_orderstatus = 'O'), count(*) FROM orders UNION ALL SELECT 'not run', false, NULL, NULL)"""


@query(f"WITH {_CARD} SELECT * FROM card")
def r53_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concerns with counts; one that did not run is absent, not zero."""
    return _scorecard(spark, sf_dir)


@query(f"WITH {_CARD} SELECT sum(n)::BIGINT AS total FROM card")
def r54_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scorecard's total under a ceiling; the plan itself fails above it."""
    return relational.gate(_scorecard(spark, sf_dir), 1 << 60)


@query("SELECT CASE WHEN p_type LIKE '%BRASS' THEN 'brass' WHEN p_type LIKE '%STEEL' THEN 'steel' WHEN p_size > 40 THEN 'large' ELSE 'other' END AS kind, count(*) AS n FROM part GROUP BY 1")
def r55_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row in the first class that fits."""
    kind = F.when(F.col("p_type").like("%BRASS"), "brass").when(F.col("p_type").like("%STEEL"), "steel").when(F.col("p_size") > 40, "large").otherwise("other")
    return table(spark, sf_dir, "part").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment, floor(100.0 * count(DISTINCT o_custkey) / count(DISTINCT c_custkey) + 0.5)::BIGINT AS covered FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def r56_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a segment's customers with orders, in whole per cent."""
    buyers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("has", F.lit(1))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(buyers, "c_custkey", "left")
    return c.groupBy("c_mktsegment").agg(F.floor(100.0 * F.count("has") / F.count("*") + 0.5).cast("long").alias("covered"))


@query(f"""WITH {CALLS_SQL} SELECT regexp_extract(path, '^/api/v1/([a-z]+)', 1) AS resource, count(*) FILTER (method = 'GET') AS reads, count(*) FILTER (method = 'POST') AS creates, count(*) FILTER (method = 'DELETE') AS removes FROM calls GROUP BY 1""")
def r58_crud_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations of each resource."""
    c = calls(spark, sf_dir).groupBy(F.regexp_extract("path", "^/api/v1/([a-z]+)", 1).alias("resource"))
    return c.agg(*[F.count_if(F.col("method") == m).alias(n) for m, n in (("GET", "reads"), ("POST", "creates"), ("DELETE", "removes"))])


@query("""SELECT p_partkey, coalesce(o.v, p_retailprice, 0.0) AS price, CASE WHEN o.v IS NOT NULL THEN 'observed' WHEN p_retailprice IS NOT NULL THEN 'declared' ELSE 'stub' END AS source
  FROM part LEFT JOIN (SELECT l_partkey, max(l_extendedprice) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) o ON l_partkey = p_partkey""")
def r59_source_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed before declared before stub."""
    seen = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_partkey").agg(F.max("l_extendedprice").alias("v"))
    p = table(spark, sf_dir, "part").join(seen, F.col("p_partkey") == F.col("l_partkey"), "left")
    source = F.when(F.col("v").isNotNull(), "observed").when(F.col("p_retailprice").isNotNull(), "declared").otherwise("stub")
    return p.select("p_partkey", F.coalesce("v", "p_retailprice", F.lit(0.0)).alias("price"), source.alias("source"))


@query("SELECT o_orderpriority, CASE WHEN o_orderpriority LIKE '1%' THEN 0 WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END AS rank, count(*) AS n FROM orders GROUP BY 1, 2")
def r60_evidence_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by strength of evidence."""
    rank = F.when(F.col("o_orderpriority").like("1%"), 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority", rank.alias("rank")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'en') OR contains(lower(p_type), 'en') OR contains(lower(p_brand), 'en')")
def r61_filter_any_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in which any text column holds the words asked for, in either case."""
    p = table(spark, sf_dir, "part")
    return p.where(F.exists(F.array("p_name", "p_type", "p_brand"), lambda v: F.contains(F.lower(v), F.lit("en")))).select("p_partkey", "p_name")


@query("""WITH v AS (SELECT p_brand, unnest(range(p_size, p_size + 5)) AS year FROM part), c AS (SELECT p_brand, year, count(*) AS n FROM v GROUP BY 1, 2), t AS (SELECT * FROM c QUALIFY rank() OVER (PARTITION BY p_brand ORDER BY n DESC) = 1)
  SELECT p_brand, min(year)::BIGINT AS first, max(year)::BIGINT AS last, any_value(n) AS votes FROM t GROUP BY 1""")
def r63_interval_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row votes for an interval; first and last of the values with most votes."""
    v = table(spark, sf_dir, "part").select("p_brand", F.explode(F.sequence("p_size", F.col("p_size") + 4)).alias("year"))
    c = v.groupBy("p_brand", "year").agg(F.count("*").alias("n"))
    top = c.withColumn("k", F.rank().over(Window.partitionBy("p_brand").orderBy(F.desc("n")))).where("k = 1")
    return top.groupBy("p_brand").agg(F.min("year").cast("long").alias("first"), F.max("year").cast("long").alias("last"), F.first("n").alias("votes"))


@query("""WITH x AS (SELECT user_id, event_id, ts, value, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events)
  SELECT user_id, event_id, (epoch_us(after) - epoch_us(ts)) // 1000000 AS gap FROM x WHERE after > ts AND epoch_us(after) - epoch_us(ts) <= 3600000000""")
def r65_nearest_following(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event the user's next one, if it follows within an hour: whole seconds between."""
    after = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", after.alias("after"))
    gap = F.expr("timestampdiff(MICROSECOND, ts, after)")
    return e.where((F.col("after") > F.col("ts")) & (gap <= 3600000000)).select("user_id", "event_id", F.floor(gap / 1000000).cast("long").alias("gap"))


@query("""WITH m AS (SELECT l_linenumber AS step, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1) SELECT count(*) AS steps, round(CASE WHEN count(*) >= 3 THEN least(1.5, greatest(1.125, exp(regr_slope(ln(v), step)))) END, 6) AS ratio FROM m""")
def r67_log_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The growth ratio from step to step by a log-linear fit, within bounds."""
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("step")).agg(F.avg("l_extendedprice").alias("v"))
    slope = F.regr_slope(F.log("v"), F.col("step").cast("double"))
    return m.agg(F.count("*").alias("steps"), F.round(F.when(F.count("*") >= 3, F.least(F.lit(1.5), F.greatest(F.lit(1.125), F.exp(slope)))), 6).alias("ratio"))


@query("SELECT p_partkey, k AS step, round(p_size * pow(1.25, k), 4) AS size FROM part, (SELECT unnest(range(-2, 6))::INT AS k)")
def r68_geometric_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scale of eight steps from each base size."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(-2), F.lit(5))).alias("step"))
    return p.select("p_partkey", "step", F.round(F.col("p_size") * F.pow(F.lit(1.25), F.col("step")), 4).alias("size"))


@query("""WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part), q AS (SELECT DISTINCT event_type AS asked FROM events), d AS (SELECT asked, word, levenshtein(asked, word) AS d FROM q, w)
  SELECT asked, word, d, k FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY d, word) AS k FROM d WHERE d > 0 AND d <= greatest(3, length(asked) // 3)) WHERE k <= 3""")
def r69_nearest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event type the three nearest distinct words of part names by edit distance.

    The asked names are few (checked: at most 1000, else the plan fails) and are sent to the words.
    """
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    asked = table(spark, sf_dir, "events").select(F.col("event_type").alias("asked")).distinct()
    if asked.limit(1001).count() > 1000:
        raise ValueError("too many names are asked for at once")
    d = words.crossJoin(F.broadcast(asked)).withColumn("d", F.levenshtein("asked", "word")).where((F.col("d") > 0) & (F.col("d") <= F.greatest(F.lit(3), F.floor(F.length("asked") / 3))))
    return d.withColumn("k", F.row_number().over(Window.partitionBy("asked").orderBy("d", "word"))).where("k <= 3").select("asked", "word", "d", F.col("k").cast("long").alias("k"))


@query("""WITH s AS (SELECT p_brand, p_size, sum(length(p_name)) AS chars FROM part GROUP BY 1, 2), b AS (SELECT p_brand, arg_min(p_size, (-chars, p_size)) AS body FROM s GROUP BY 1)
  SELECT p_brand, p_size, least(3, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC)) AS level FROM s JOIN b USING (p_brand) WHERE p_size > 1.15 * body""")
def r72_heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mode as body size; larger sizes become levels, the third at most."""
    s = table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.sum(F.length("p_name")).alias("chars"))
    body = s.groupBy("p_brand").agg(F.min(F.struct((-F.col("chars")).alias("c"), "p_size")).alias("m")).select("p_brand", F.col("m.p_size").alias("body"))
    level = F.least(F.lit(3), F.dense_rank().over(Window.partitionBy("p_brand").orderBy(F.desc("p_size"))))
    return s.join(body, "p_brand").where("p_size > 1.15 * body").select("p_brand", "p_size", level.cast("long").alias("level"))


@query("""SELECT CASE WHEN l_shipdate < TIMESTAMP '1995-01-01' THEN 'old' ELSE 'new' END AS kind, count(*) AS n, sum(l_quantity)::BIGINT AS total FROM lineitem GROUP BY 1""")
def r75_size_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and totals by the first kind that fits."""
    kind = F.when(F.expr("l_shipdate < TIMESTAMP '1995-01-01'"), "old").otherwise("new")
    return table(spark, sf_dir, "lineitem").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("total"))


@query("SELECT event_type, round(sum(value), 4) AS ms, string_agg(DISTINCT CAST(user_id % 5 AS VARCHAR), ',' ORDER BY CAST(user_id % 5 AS VARCHAR)) AS stages FROM events GROUP BY 1")
def r76_run_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time and distinct stages of each kind of event."""
    stage = (F.col("user_id") % 5).cast("string")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("ms"), F.array_join(F.sort_array(F.collect_set(stage)), ",").alias("stages"))


@query(f"WITH {CALLS_SQL} SELECT seq, method || ' ' || regexp_replace(path, '/[^/]*[0-9][^/]*$', '/:id') AS step FROM calls")
def r77_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps with ids masked and version segments kept."""
    return calls(spark, sf_dir).select("seq", F.concat("method", F.lit(" "), urls.masked(F.col("path"))).alias("step"))


@query(f"""WITH {PAGES_SQL}, s AS (SELECT page_id, regexp_replace(path, '[0-9]+', 'N', 'g') AS signature FROM u) SELECT signature, min(page_id) AS page_id, count(*) AS n FROM s GROUP BY 1""")
def r78_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with equal paths but for numbers; the first keeps its id."""
    return page_urls(spark, sf_dir).groupBy(F.regexp_replace("path", "[0-9]+", "N").alias("signature")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


@query("""SELECT c_custkey AS id, 'shape' AS source FROM customer WHERE c_acctbal < 0 UNION ALL SELECT DISTINCT o_custkey, 'observation' FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)""")
def r80_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one source, and those of another whose id is not there yet."""
    one = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    two = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).distinct().join(one, "id", "left_anti")
    return one.withColumn("source", F.lit("shape")).unionByName(two.withColumn("source", F.lit("observation")))


@query("""WITH s AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY 1) SELECT count(*) AS total, count(*) FILTER (last <> 'error') AS passed, count(*) FILTER (last = 'error') AS failed FROM s""")
def r82_fold_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last result of each user wins; then totals."""
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    return s.agg(F.count("*").alias("total"), F.count_if(F.col("last") != "error").alias("passed"), F.count_if(F.col("last") == "error").alias("failed"))


@query(f"""WITH {CALLS_SQL}, c AS (SELECT method, regexp_replace(path, '/[0-9]+$', '/*') AS shape, min(seq) AS seq, arg_min(status, seq) FILTER (status BETWEEN 200 AND 299) AS ok FROM calls GROUP BY 1, 2) SELECT method, shape, coalesce(ok, 200) AS status FROM c""")
def r83_handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A handler for each call shape with a success status, 200 where none was seen."""
    c = calls(spark, sf_dir).groupBy("method", urls.shape(F.col("path")).alias("shape")).agg(F.min_by("status", F.when(F.col("status").between(200, 299), F.col("seq"))).alias("ok"))
    return c.select("method", "shape", F.coalesce("ok", F.lit(200)).alias("status"))


@query("""SELECT event_id, user_id, round(coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS started FROM events""")
def running_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of all earlier values of each user's events."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.round(F.coalesce(F.sum("value").over(w), F.lit(0.0)), 4).alias("started"))


@query("""SELECT 'never ordered' AS kind, c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'ordered and in debt', c_custkey FROM customer WHERE c_acctbal < 0 AND c_custkey IN (SELECT o_custkey FROM orders)
  UNION ALL SELECT 'part never sold', p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi and anti joins."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    p, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    tag = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), F.col(key).alias("key"))
    never = tag(c.join(o, "c_custkey", "left_anti"), "never ordered", "c_custkey")
    debt = tag(c.where("c_acctbal < 0").join(o, "c_custkey", "left_semi"), "ordered and in debt", "c_custkey")
    return never.union(debt).union(tag(p.join(li, "p_partkey", "left_anti"), "part never sold", "p_partkey"))


