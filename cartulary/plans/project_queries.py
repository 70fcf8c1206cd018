"""Queries over dependencies, specifications, screens and archetypes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import archetypes, dependencies, screens, scripts, specs, styles
from ..sources.tables import CALLS_SQL, PAGES_SQL, calls, table
from .catalog import query
from .scratch import materialize
from .source_queries import _BARE, _SHEETS, _sheets

#: Files that customers' pages hold, and how orders point at them: by address, from below their folder, by name, by a binding, or at nothing.
_HELD = "'img/' || {0} || '/' || c_custkey || '.png'"
_TARGET = """CASE o_orderkey % 5 WHEN 0 THEN '/img/' || seg || '/' || o_custkey || '.png' WHEN 1 THEN './' || o_custkey || '.png?v=1' WHEN 2 THEN 'x/y/' || o_custkey || '.png' WHEN 3 THEN '{{file}}.png' ELSE 'https://cdn/' || o_custkey || '.png' END"""
_SEG = "lower(c_mktsegment)"


@query(f"""WITH held AS (SELECT {_HELD.format(_SEG)} AS path, c_custkey, {_SEG} AS seg FROM customer),
  o AS (SELECT o_orderkey, o_custkey, coalesce(seg, 'none') AS seg FROM orders LEFT JOIN held ON c_custkey = o_custkey),
  r AS (SELECT 'img/' || seg || '/p.html' AS file, {_TARGET} AS target FROM o), k AS (SELECT * FROM r WHERE NOT regexp_matches(target, '^https|[{{]')),
  h AS (SELECT target, coalesce((SELECT any_value(path) FROM held WHERE path = ltrim(target, '/')), 'img/' || split_part(file, '/', 2) || '/' || replace(replace(target, './', ''), '?v=1', '')) AS guess, regexp_extract(target, '([^/]*)[.]png', 1) AS key FROM k),
  m AS (SELECT h.target, held.path FROM h LEFT JOIN held ON held.c_custkey = h.key::BIGINT)
  SELECT held.path, CASE WHEN count(m.path) > 0 THEN 'referenced' ELSE 'unreferenced' END AS state, count(m.path) AS n FROM held LEFT JOIN m ON m.path = held.path GROUP BY 1
  UNION ALL SELECT target, 'dead', count(*) FROM m WHERE path IS NULL GROUP BY 1""")
def dsp_asset_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by how often they are pointed at, and addresses that no file has."""
    owner = table(spark, sf_dir, "customer").select("c_custkey", F.lower("c_mktsegment").alias("seg"))
    held = owner.select(F.expr(_HELD.format("seg")).alias("path"))
    o = table(spark, sf_dir, "orders").join(owner, F.col("o_custkey") == F.col("c_custkey"), "left").withColumn("seg", F.coalesce("seg", F.lit("none")))
    files = o.select(F.concat(F.lit("img/"), "seg", F.lit("/p.html")).alias("path"), F.concat(F.lit('<img src="'), F.expr(_TARGET), F.lit('">')).alias("text"))
    return dependencies.asset_report(materialize(dependencies.references(files)), held)


_NAMES = ("jquery", "vue", "bootstrap", "moment", "d3", "angular")
_LIBRARY = "CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES)) + " END"
_SRC = f"""CASE p_size % 3 WHEN 0 THEN '/ajax/libs/' || {_LIBRARY} || '/' || p_size % 6 || '.4.1/x.min.js' WHEN 1 THEN 'https://cdn/npm/' || {_LIBRARY} || '@' || p_size % 6 || '.2/y.js' ELSE '/js/' || {_LIBRARY} || '-' || p_size % 6 || '.0.9.min.js?z' END"""
_KNOWN = ", ".join(f"('{n}', {m}, '{s}', '{d}')" for n, m, s, d in dependencies.SUPPORT)


@query(f"""WITH k(name, major, status, since) AS (VALUES {_KNOWN}), l AS (SELECT {_LIBRARY} AS name, p_size % 6 AS major, CASE p_size % 3 WHEN 0 THEN '.4.1' WHEN 1 THEN '.2' ELSE '.0.9' END AS rest FROM part)
  SELECT l.name, l.major || rest AS version, coalesce(k.status, CASE WHEN l.major > (SELECT max(major) FROM k WHERE k.name = l.name) THEN 'later than the table' ELSE 'not assessed' END) AS status, k.since, count(*) AS n
  FROM l LEFT JOIN k ON k.name = l.name AND k.major = l.major GROUP BY ALL""")
def dsp_deps_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Libraries that pages load, by version, against what their projects say of its support."""
    pages = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("<script src='"), F.expr(_SRC), F.lit("'></script>")).alias("html"))
    counts = dependencies.script_libraries(pages, "p_partkey", "html").groupBy("name", "version").agg(F.count("*").alias("n"))
    return dependencies.support(counts)


@query(f"""WITH {CALLS_SQL}, c AS (SELECT method, event_type, CASE WHEN event_type = 'signup' THEN [] ELSE json_keys(props) END AS query FROM calls),
  w(name) AS (VALUES ('k'), ('trace')) SELECT method, '/api/v1/' || event_type || 's/{{id}}' AS path, name, count(*) AS calls, count(*) FILTER (NOT list_contains(query, name)) AS missing FROM c, w WHERE name = 'k' OR event_type = 'error' GROUP BY ALL""")
def r11_missing_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that lack a parameter which the specification requires, its references followed."""
    log = calls(spark, sf_dir)
    path = F.concat(F.lit("/api/v1/"), "event_type", F.lit("s/{id}"))
    kinds = log.select("event_type", F.lower("method").alias("m")).distinct()
    item = F.format_string('"/api/v1/%ss/{id}":{"parameters":[{"$ref":"#/components/parameters/%s"}],"%s":{"parameters":[{"name":"trace","in":"query","required":%s},{"$ref":"#/components/parameters/loop"}]}}', "event_type", "event_type", "m", F.when(F.col("event_type") == "error", "true").otherwise("false"))
    named = F.format_string('"%s":{"$ref":"#/components/parameters/key"}', "event_type")
    joined = lambda c: F.array_join(F.array_sort(F.collect_list(c)), ",")  # noqa: E731  five kinds
    text = kinds.agg(F.concat(F.lit('{"paths":{'), joined(item), F.lit('},"components":{"parameters":{'), joined(named), F.lit(',"key":{"name":"k","in":"query","required":true},"loop":{"$ref":"#/components/parameters/loop"}}}}')).alias("t"))
    wanted = specs.parameters(text.select(F.parse_json("t").alias("spec")))
    asked = log.select("method", path.alias("path"), F.when(F.col("event_type") == "signup", F.array().cast("array<string>")).otherwise(F.json_object_keys("props")).alias("query"))
    return specs.missing_parameters(asked, materialize(wanted))


#: Line items as elements of their order's screen.
_TAG = "CASE l_partkey % 5 WHEN 0 THEN 'button' WHEN 1 THEN 'a' WHEN 2 THEN 'input' WHEN 3 THEN 'select' ELSE 'p' END"


@query(rf"""WITH e AS (SELECT l_orderkey AS screen, l_linenumber AS place, '#' || l_linenumber AS selector, {_TAG} AS tag, CASE WHEN l_suppkey % 4 = 0 THEN '*' ELSE 'item ' || l_returnflag END AS name, l_suppkey % 3 = 0 AS labelled, l_discount < 0.02 AS disabled, CASE WHEN l_tax > 0.07 THEN l_linenumber END AS tabindex, (l_partkey % 50) * 8.0 AS x, l_suppkey % 40 * 10.0 AS y, l_quantity + 20.0 AS w, l_quantity + 10.0 AS h FROM lineitem),
  s AS (SELECT * FROM e WHERE tag <> 'p' OR tabindex IS NOT NULL), f AS (SELECT *, count(*) OVER (PARTITION BY screen) AS n FROM s WHERE NOT disabled), k AS (SELECT *, coalesce(tabindex, 0) > 0 AS by_hand FROM f WHERE n >= 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY screen ORDER BY CASE WHEN by_hand THEN tabindex ELSE 2147483647 END, place, y, x) AS tab, row_number() OVER (PARTITION BY screen ORDER BY floor(y / 16 + 0.5), x, place, y) AS read FROM k)
  SELECT screen::VARCHAR AS screen, selector AS element, 'accessible-name' AS kind, 'high' AS severity FROM e WHERE tag IN ('button', 'a') AND NOT regexp_matches(name, '[\p{{L}}\p{{N}}]{{2,}}')
  UNION ALL SELECT screen::VARCHAR, selector, 'unlabelled-field', 'high' FROM e WHERE tag IN ('input', 'select') AND NOT labelled
  UNION ALL SELECT screen::VARCHAR, selector, 'tap-target', 'medium' FROM e WHERE tag <> 'p' AND least(w, h) < 44
  UNION ALL SELECT screen::VARCHAR, string_agg(selector, ', ' ORDER BY place), 'focus-explicit', 'medium' FROM k WHERE by_hand GROUP BY screen
  UNION ALL SELECT screen::VARCHAR, arg_min(selector, tab), 'focus-order', 'medium' FROM r WHERE tab <> read GROUP BY screen""")
def dsp_improve_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, labels, sizes and focus of line items seen as the elements of their order's screen."""
    li = table(spark, sf_dir, "lineitem")
    e = li.select(
        F.col("l_orderkey").cast("string").alias("screen"), F.col("l_linenumber").cast("long").alias("place"), F.concat(F.lit("#"), "l_linenumber").alias("selector"), F.expr(_TAG).alias("tag"),
        F.when(F.col("l_suppkey") % 4 == 0, "*").otherwise(F.concat(F.lit("item "), "l_returnflag")).alias("name"), (F.col("l_suppkey") % 3 == 0).alias("labelled"), (F.col("l_discount") < 0.02).alias("disabled"),
        F.when(F.col("l_tax") > 0.07, F.col("l_linenumber")).cast("int").alias("tabindex"), (F.col("l_partkey") % 50 * 8.0).alias("x"), (F.col("l_suppkey") % 40 * 10.0).alias("y"), (F.col("l_quantity") + 20.0).alias("w"), (F.col("l_quantity") + 10.0).alias("h"),
    )
    return screens.element_findings(e).unionByName(screens.focus_findings(e))


_COUNT = "length(html) - length(replace(html, '{0}', ''))".format
#: Features of a page that both engines read alike: markup, its address, and words of its text.
_PAGE = {
    "loops": f"({_COUNT('<ul')}) / 3",
    "links": f"({_COUNT('<a ')}) / 3",
    "headings": f"({_COUNT('<h1')}) / 3",
    "inputs": f"({_COUNT('<input')}) / 6",
    "reads": "1",
    "by_id": "CASE WHEN regexp_like(path, '/[0-9]+(/|$)') THEN 1 ELSE 0 END",
    "collections": "CASE WHEN regexp_like(path, '/[0-9]+(/|$)') THEN 0 ELSE 1 END",
    "queries": "CASE WHEN query <> '' THEN 1 ELSE 0 END",
    "search_fields": "CASE WHEN query LIKE '%ref=%' THEN 1 ELSE 0 END",
    "widgets": f"({_COUNT('track(')}) / 6",
}
_DUCK = {k: v.replace("regexp_like(", "regexp_matches(").replace(") / ", ") // ") for k, v in _PAGE.items()}
_SIGNALS = " UNION ALL ".join(f"SELECT page_id, '{a}' AS archetype, {' + '.join(f'({s})::INT' for s in signals)} AS matched FROM f" for a, signals in archetypes.ARCHETYPES.items())


@query(f"""WITH {PAGES_SQL}, f AS (SELECT page_id, {", ".join(f"({_DUCK[k]})::BIGINT AS {k}" if k in _DUCK else f"0 AS {k}" for k in archetypes.FEATURES)} FROM u), s AS ({_SIGNALS})
  SELECT page_id, archetype, matched / 4 AS confidence, matched FROM s WHERE matched >= 2""")
def dsp_archetypes_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every archetype of which a page shows two signals or more."""
    p = table(spark, sf_dir, "pages").select("page_id", "html", *urls.parts("url"))
    features = p.select("page_id", *[F.floor(F.expr(v)).alias(k) for k, v in _PAGE.items()])
    return archetypes.classify(features, ["page_id"])


@query(rf"""WITH {_SHEETS}, {_BARE}, d AS (SELECT sheet, unnest(regexp_extract_all(selector, '\.([A-Za-z_][\w-]*)', 1)) AS name FROM sel),
  used AS (SELECT DISTINCT unnest(flatten(list_transform(regexp_extract_all(html, '\sclass="([^"]*)"', 1), lambda c: string_split_regex(c, '\s+')))) AS name FROM pages)
  SELECT name, count(DISTINCT sheet) AS sheets FROM d WHERE name NOT IN (SELECT name FROM used) AND NOT EXISTS (SELECT 1 FROM pages WHERE regexp_matches(regexp_extract(html, '<script>(.*?)</script>', 1), '(^|["''`\s.])' || d.name || '(["''`\s.]|$)')) GROUP BY 1""")
def dsp_dead_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes that sheets declare and nothing on any page or in any script has."""
    pages = table(spark, sf_dir, "pages")
    return styles.dead_classes(styles.selectors(_sheets(spark, sf_dir)), materialize(styles.used_tokens(pages)), scripts.inline_scripts(pages))
