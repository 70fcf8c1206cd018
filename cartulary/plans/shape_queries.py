"""Queries over routes, boxes, covers, runs, steps and names, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, maps, strings
from ..operators import shapes
from ..sources.tables import CALLS_SQL, LINKS_SQL, calls, page_links, page_urls, table
from .catalog import query

_ROUTES = """routes AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, lower(r_name) AS segment FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, lower(n_name) FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_custkey::VARCHAR FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, o_orderkey::VARCHAR FROM orders)"""


@query(f"""WITH RECURSIVE {_ROUTES}, w(id, full_path, level) AS (SELECT id, '/' || segment, 0 FROM routes WHERE parent IS NULL UNION ALL SELECT r.id, full_path || '/' || r.segment, level + 1 FROM w JOIN routes r ON r.parent = w.id) SELECT id, full_path, level FROM w""")
def r14_flattened_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full paths of nested routes of any depth: orders below customers below nations below regions."""
    part = lambda t, mark, key, parent, segment: table(spark, sf_dir, t).select(F.concat(F.lit(mark), key).alias("id"), parent.alias("parent"), segment.cast("string").alias("segment"))
    routes = part("region", "r", "r_regionkey", F.lit(None).cast("string"), F.lower("r_name"))
    routes = routes.unionByName(part("nation", "n", "n_nationkey", F.concat(F.lit("r"), "n_regionkey"), F.lower("n_name")))
    routes = routes.unionByName(part("customer", "c", "c_custkey", F.concat(F.lit("n"), "c_nationkey"), F.col("c_custkey")))
    return shapes.flatten_paths(routes.unionByName(part("orders", "o", "o_orderkey", F.concat(F.lit("c"), "o_custkey"), F.col("o_orderkey"))))


_BOXES = "boxes AS (SELECT l_orderkey AS screen, l_partkey * 10 + l_linenumber AS box, min(l_suppkey % 40 * 10)::DOUBLE AS x, min(l_partkey % 50 * 8)::DOUBLE AS y, min(l_quantity * 2) AS w, min(l_discount * 500) AS h FROM lineitem GROUP BY 1, 2)"


@query(f"""WITH {_BOXES}, p AS (SELECT a.screen, a.box, 'y' AS axis, b.y - (a.y + a.h) AS gap FROM boxes a JOIN boxes b ON a.screen = b.screen AND a.box <> b.box AND a.x < b.x + b.w AND b.x < a.x + a.w
  UNION ALL SELECT a.screen, a.box, 'x', b.x - (a.x + a.w) FROM boxes a JOIN boxes b ON a.screen = b.screen AND a.box <> b.box AND a.y < b.y + b.h AND b.y < a.y + a.h)
  SELECT screen, box, axis, floor(min(gap) + 0.5)::BIGINT AS gap FROM p WHERE gap > 0 AND gap <= 64 GROUP BY 1, 2, 3""")
def r65_box_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps from each line item, drawn as a box on its order's screen, to the next ones below and to the right."""
    li = table(spark, sf_dir, "lineitem")
    boxes = li.groupBy(F.col("l_orderkey").alias("screen"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("box")).agg(
        F.min(F.col("l_suppkey") % 40 * 10).cast("double").alias("x"), F.min(F.col("l_partkey") % 50 * 8).cast("double").alias("y"), F.min(F.col("l_quantity") * 2).alias("w"), F.min(F.col("l_discount") * 500).alias("h")
    )
    return shapes.nearest_gaps(boxes)


_HOPS = "hop AS (SELECT src, min(dst) AS dst FROM (SELECT c_custkey AS src, (c_custkey * 7 + c_nationkey) % 2000 + 40 AS dst FROM customer WHERE c_custkey % 3 <> 0) h GROUP BY 1)"


@query(f"""WITH RECURSIVE {_HOPS}, w(start, spot, n) AS (SELECT DISTINCT o_custkey, o_custkey, 0 FROM orders UNION ALL SELECT start, dst, n + 1 FROM w JOIN hop ON src = spot WHERE n < 10),
  e AS (SELECT start, arg_max(spot, n) AS spot, max(n) AS n FROM w GROUP BY 1) SELECT start, CASE WHEN src IS NULL THEN spot ELSE start END AS "end", CASE WHEN src IS NULL THEN n::INT END AS hops FROM e LEFT JOIN hop ON src = spot""")
def r70_resolved_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the customers of orders lead in ten hops at most, over a map of customers to customers."""
    c = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0")
    hops = c.select(F.col("c_custkey").alias("src"), ((F.col("c_custkey") * 7 + F.col("c_nationkey")) % 2000 + 40).alias("dst"))
    return shapes.resolve_hops(table(spark, sf_dir, "orders").select("o_custkey"), hops)


@query(f"""WITH {LINKS_SQL}, t AS (SELECT host, target, count(*) AS n FROM links WHERE target IS NOT NULL GROUP BY 1, 2), live AS (SELECT DISTINCT host, path FROM u), moved AS (SELECT DISTINCT host, regexp_replace(path, '[.]html$', '') AS path FROM u WHERE regexp_matches(path, '[.]html$'))
  SELECT t.host, target, n, CASE WHEN m.path IS NOT NULL THEN 'redirected' WHEN v.path IS NOT NULL THEN 'live' WHEN regexp_matches(target, '[.][A-Za-z0-9]{{1,5}}$') AND NOT regexp_matches(target, '[.]html?$') THEN 'asset' ELSE 'uncovered' END AS state
  FROM t LEFT JOIN moved m ON m.host = t.host AND m.path = target LEFT JOIN live v ON v.host = t.host AND v.path = target""")
def r06_cover_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each link target is covered: moved to its .html page, a page, a file, or nothing."""
    targets = page_links(spark, sf_dir).where("target is not null").groupBy("host", "target").agg(F.count("*").alias("n"))
    u = page_urls(spark, sf_dir)
    live = u.select("host", F.col("path").alias("target"))
    moved = live.where(F.col("target").rlike("[.]html$")).select("host", F.regexp_replace("target", "[.]html$", "").alias("target"))
    return shapes.cover_states(targets, live, moved, ["host", "target"], "target")


@query("""WITH n AS (SELECT DISTINCT CAST(ts AS DATE)::VARCHAR AS day, user_id FROM events), d AS (SELECT CAST(ts AS DATE)::VARCHAR AS day, count(*) AS metric FROM events GROUP BY 1), r AS (SELECT day, metric, lag(metric) OVER (ORDER BY day) AS before, lag(day) OVER (ORDER BY day) AS prior FROM d)
  SELECT day, metric, metric - before AS delta, CASE WHEN metric > before THEN 'up' WHEN metric < before THEN 'down' WHEN metric = before THEN 'same' ELSE 'first' END AS verdict,
  CASE WHEN prior IS NULL THEN 0 ELSE (SELECT count(*) FROM n a WHERE a.day = r.day AND NOT EXISTS (SELECT 1 FROM n b WHERE b.day = r.prior AND b.user_id = a.user_id)) END AS opened,
  CASE WHEN prior IS NULL THEN 0 ELSE (SELECT count(*) FROM n a WHERE a.day = r.prior AND NOT EXISTS (SELECT 1 FROM n b WHERE b.day = r.day AND b.user_id = a.user_id)) END AS closed FROM r""")
def r16_run_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days as runs: events against the day before, and the users that came and went."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("date").cast("string").alias("day"), "user_id")
    return shapes.run_deltas(e.groupBy("day").agg(F.count("*").alias("n")), "day", "n", e, "user_id")


#: Tables that references may point to, and the nouns that name them begin their names.
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")
_REFS = (("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("labels", "doc_id", "documents", "doc_id"))


@query(" UNION ALL ".join(f"SELECT '{a}.{x}' AS reference, '{b}.{y}' AS entity, count(*) AS rows, count(*) FILTER (NOT EXISTS (SELECT 1 FROM {b} t WHERE t.{y} = f.{x})) AS orphans FROM {a} f" for a, x, b, y in _REFS))
def r29_relations_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that column names suggest, found in the schemas of all tables, with the rows that point nowhere."""
    frames = {t: table(spark, sf_dir, t) for t in _TABLES}
    out = None
    for name, column, entity, key in shapes.name_references({t: f.columns for t, f in frames.items()}):
        known = frames[entity].select(F.col(key).alias("_key")).distinct().withColumn("_hit", F.lit(1))
        counts = frames[name].groupBy(F.col(column).alias("_key")).agg(F.count("*").alias("n")).join(known, "_key", "left")
        row = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("_hit").isNull(), F.col("n"))), F.lit(0)).alias("orphans"))
        row = row.select(F.lit(f"{name}.{column}").alias("reference"), F.lit(f"{entity}.{key}").alias("entity"), "rows", "orphans")
        out = row if out is None else out.union(row)
    return out


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_type), 'red') OR contains(lower(p_brand), 'red')")
def r61_filter_with_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in which any text column holds a word that occurs."""
    p = table(spark, sf_dir, "part")
    return p.where(F.exists(F.array("p_name", "p_type", "p_brand"), lambda v: F.contains(F.lower(v), F.lit("red")))).select("p_partkey", "p_name")


@query("WITH f AS (SELECT * FROM part WHERE contains(lower(p_name), 'red')) SELECT p_type AS facet, count(*) AS n, max(p_retailprice) AS dearest FROM f GROUP BY 1")
def r61_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types of the rows found, counted, with the largest cost of each."""
    return table(spark, sf_dir, "part").where(F.contains(F.lower("p_name"), F.lit("red"))).groupBy(F.col("p_type").alias("facet")).agg(F.count("*").alias("n"), F.max("p_retailprice").alias("dearest"))


@query(f"""WITH {CALLS_SQL}, c AS (SELECT regexp_extract(path, '^/api/v1/([a-z]+)/[0-9]+$', 1) AS resource, CASE WHEN method = 'GET' THEN 'read' WHEN method = 'DELETE' THEN 'remove' WHEN status = 201 THEN 'create' ELSE 'update' END AS op FROM calls WHERE user_id % 10 <> 0 UNION ALL SELECT '', 'skipped' FROM calls WHERE user_id % 10 = 0)
  SELECT resource, op, count(*) AS n FROM c GROUP BY 1, 2""")
def r58_resource_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Create, read, update and remove calls of each resource, and how many calls no resource takes (those to a bare collection)."""
    c = calls(spark, sf_dir).withColumn("path", F.when(F.col("user_id") % 10 == 0, F.regexp_replace("path", "/[0-9]+$", "")).otherwise(F.col("path")))
    resource = F.regexp_extract("path", "^/api/v1/([a-z]+)/[0-9]+$", 1)
    op = F.when(resource == "", "skipped").when(F.col("method") == "GET", "read").when(F.col("method") == "DELETE", "remove").when(F.col("status") == 201, "create").otherwise("update")
    return c.groupBy(resource.alias("resource"), op.alias("op")).agg(F.count("*").alias("n"))


@query(f"""WITH {CALLS_SQL}, logged AS (SELECT method, regexp_replace(path, '/[0-9]+$', '/*') AS shape, status, 0 AS source, seq FROM calls WHERE seq % 2 = 0), spec AS (SELECT method, regexp_replace(path, '/[0-9]+$', '/*') AS shape, 202 AS status, 1 AS source, seq FROM calls WHERE event_type <> 'click')
  SELECT method, shape, arg_min(source, (source, seq)) AS source, coalesce(arg_min(status, (source, seq)) FILTER (status BETWEEN 200 AND 299), 200) AS status FROM (SELECT * FROM logged UNION ALL SELECT * FROM spec) GROUP BY 1, 2""")
def r83_handlers_of_two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A handler for each call shape of two sources, the first source's before the second's, with the first success status, else 200."""
    from ..functions import urls

    c = calls(spark, sf_dir).select("method", urls.shape(F.col("path")).alias("shape"), "status", "seq", "event_type")
    both = c.where("seq % 2 = 0").select("method", "shape", "status", F.lit(0).alias("source"), "seq")
    both = both.union(c.where("event_type <> 'click'").select("method", "shape", F.lit(202), F.lit(1), "seq"))
    order = F.struct("source", "seq")
    return both.groupBy("method", "shape").agg(F.min("source").alias("source"), F.coalesce(F.min_by("status", F.when(F.col("status").between(200, 299), order)), F.lit(200)).alias("status"))


_USABLE = "event_type IN ('view', 'click', 'purchase') AND json_extract_string(props, '$.k')::INT % 4 <> 0"


@query(f"SELECT user_id, event_type, min(event_id) AS event_id, count(*) AS times FROM events WHERE {_USABLE} GROUP BY 1, 2")
def r85_recorded_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct cases of the usable steps of the log, by user and kind."""
    return _recorded(spark, sf_dir)[0]


@query(f"SELECT count(*) FILTER ({_USABLE}) AS used, count(*) FILTER (NOT coalesce({_USABLE}, false)) AS skipped FROM events")
def r85_recorded_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many steps of the log are used, and how many skipped."""
    return _recorded(spark, sf_dir)[1]


def _recorded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    usable = F.col("event_type").isin("view", "click", "purchase") & (F.get_json_object("props", "$.k").cast("int") % 4 != 0)
    return shapes.recorded_steps(table(spark, sf_dir, "events"), usable, ["user_id", "event_type"], "event_id")


_WORDS = r"list_filter(string_split(lower(regexp_replace(regexp_replace(s, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')"
_CAP = "lambda w: upper(w[1]) || substr(w, 2)"


@query(f"""WITH n AS (SELECT p_partkey, p_name || ' ' || p_brand || ' viewOf' || p_size AS s, p_name FROM part), w AS (SELECT p_partkey, p_name, {_WORDS} AS w FROM n)
  SELECT p_partkey, array_to_string(list_transform(w, {_CAP}), '') AS pascal, w[1] || array_to_string(list_transform(w[2:], {_CAP}), '') AS camel, array_to_string(w, '_') AS snake, array_to_string(w, '-') AS kebab, upper(array_to_string(w, '_')) AS constant,
  array_to_string(w[:3], '-') AS slug, p_name[:4] || repeat('*', greatest(0, length(p_name) - 4)) AS redacted, '[' || translate(p_name, 'aeiouAEIOU', 'áéíóúÁÉÍÓÚ') || ']' AS pseudo FROM w""")
def fn_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in five case styles, as slugs, redacted and pseudo-localised."""
    s = F.concat("p_name", F.lit(" "), "p_brand", F.lit(" viewOf"), "p_size")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", s.alias("s"))
    styles = [getattr(strings, f)(F.col("s")).alias(f) for f in ("pascal", "camel", "snake", "kebab", "constant")]
    return p.select("p_partkey", *styles, strings.slug(F.col("s"), 3).alias("slug"), strings.redacted(F.col("p_name")).alias("redacted"), strings.pseudo(F.col("p_name")).alias("pseudo"))


@query(r"""SELECT doc_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n\r\f\v]+', ' ', 'g')) AS plain,
  (length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3 AS matches, CASE WHEN strpos(lower(text), 'the') > 0 THEN strpos(lower(text), 'the') - 1 END AS first_match FROM documents""")
def fn_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with entities decoded and spaces squeezed, and where a word occurs."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", strings.match_ranges(F.col("text"), F.lit("the")).alias("r"))
    return d.select("doc_id", strings.squeezed(strings.decoded(F.col("text"))).alias("plain"), F.size("r").cast("long").alias("matches"), F.get("r", F.lit(0))["start"].alias("first_match"))


_UNIT = " ".join(f"WHEN abs(g) // {n} >= 1 THEN CASE WHEN g > 0 THEN (abs(g) // {n})::VARCHAR || ' {u}' || CASE WHEN abs(g) // {n} = 1 THEN '' ELSE 's' END || ' ago' ELSE 'in ' || (abs(g) // {n})::VARCHAR || ' {u}' || CASE WHEN abs(g) // {n} = 1 THEN '' ELSE 's' END END" for u, n in dates.UNITS)


@query(f"WITH g AS (SELECT o_orderkey, epoch(TIMESTAMP '1998-06-01') ::BIGINT - epoch(o_orderdate)::BIGINT AS g FROM orders) SELECT o_orderkey, CASE {_UNIT} ELSE 'just now' END AS told FROM g WHERE g IS NOT NULL")
def fn_relative_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates told from one day."""
    o = table(spark, sf_dir, "orders").where("o_orderdate is not null")
    return o.select("o_orderkey", dates.relative(F.col("o_orderdate").cast("timestamp"), F.expr("timestamp'1998-06-01 00:00:00'")).alias("told"))


@query("""SELECT p_partkey, 3 AS merged, 1 AS picked, 1 AS omitted, CASE WHEN p_type = p_name THEN 1 ELSE 2 END AS inverted, CASE WHEN p_type = 'ECONOMY' THEN 'colour,size' ELSE 'colour,size,type' END AS changed FROM part""")
def fn_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of each part merged, picked from, omitted from, inverted and compared."""
    one = F.create_map(F.lit("name"), "p_name", F.lit("type"), "p_type")
    two = F.create_map(F.lit("type"), F.lit("ECONOMY"), F.lit("size"), F.col("p_size").cast("string"), F.lit("colour"), F.lit("red"))
    base = F.create_map(F.lit("type"), F.col("p_type"))
    size = lambda m: F.size(m)
    return table(spark, sf_dir, "part").select(
        "p_partkey", (size(maps.merged(one, two)) - 1).alias("merged"), size(maps.picked(one, "name", "other")).alias("picked"), size(maps.omitted(one, "name")).alias("omitted"),
        size(maps.inverted(one)).alias("inverted"), F.array_join(maps.changed(base, two), ",").alias("changed"),
    )
