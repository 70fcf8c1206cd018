"""Queries over findings, audits and interface style, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analyzers, api_style, audits, findings, learning, markup, scorecards, scripts, source_code
from ..sources.tables import CALLS_SQL, calls, table
from .catalog import query
from .corpus_queries import _PROTO
from .scratch import materialize

_QUOTE = lambda s: "'" + s.replace("'", "''") + "'"
_RULES = [(a, k, findings.severity(a, k), p) for a, kinds in analyzers.ANALYZERS.items() for k, p in kinds]
_HITS = " UNION ALL ".join(f"SELECT page_id, {_QUOTE(a)} AS analyzer, {_QUOTE(k)} AS kind, {_QUOTE(s)} AS severity, len(regexp_extract_all(html, {_QUOTE(p)})) AS n FROM pages" for a, k, s, p in _RULES)


def page_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.findings(table(spark, sf_dir, "pages"))


@query()
def findings_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding of every analyzer, in one pass over the pages."""
    return page_findings(spark, sf_dir)


@query(f"WITH h AS ({_HITS}) SELECT analyzer, kind, severity, coalesce(sum(n), 0)::BIGINT AS hits, count(*) FILTER (n > 0) AS pages FROM h GROUP BY 1, 2, 3")
def findings_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and pages of every rule of every analyzer, from one pass."""
    return findings.report(page_findings(spark, sf_dir))


@query(f"""WITH h AS ({_HITS}), p AS (SELECT analyzer, page_id, sum(n) AS n, max(CASE WHEN n = 0 THEN NULL WHEN severity = 'high' THEN 2 WHEN severity = 'medium' THEN 1 ELSE 0 END) AS worst FROM h GROUP BY 1, 2),
  c AS (SELECT analyzer, sum(n)::BIGINT AS findings, max(worst) AS w, count(*) FILTER (worst > 0) AS pages FROM p GROUP BY 1)
  SELECT analyzer, findings, CASE w WHEN 2 THEN 'high' WHEN 1 THEN 'medium' WHEN 0 THEN 'note' ELSE 'none' END AS worst, pages, round(pages::DOUBLE / (SELECT count(DISTINCT page_id) FROM pages), 4) AS share, round(pages::DOUBLE / (SELECT count(DISTINCT page_id) FROM pages), 4) <= 0.25 AS passes FROM c""")
def findings_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scorecards over the findings, with a ceiling on the share of pages."""
    return findings.scorecard(page_findings(spark, sf_dir), table(spark, sf_dir, "pages"))


def page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.nodes(table(spark, sf_dir, "pages"))


@query()
def audit_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every audit of the node table, which is parsed and written once."""
    return audits.all_audits(materialize(page_nodes(spark, sf_dir)))


@query("""WITH c AS (SELECT page_id, len(regexp_extract_all(html, '<main[ >]')) AS mains, len(regexp_extract_all(html, '<nav[ >]')) AS navs FROM pages WHERE html <> '')
  SELECT page_id, unnest(list_filter([CASE WHEN mains = 0 THEN 'no-main' END, CASE WHEN mains > 1 THEN 'several-mains' END, CASE WHEN navs = 0 THEN 'no-nav' END], lambda k: k IS NOT NULL)) AS kind FROM c""")
def audit_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that lack landmarks."""
    return audits.landmarks(page_nodes(spark, sf_dir)).select("page_id", "kind")


@query("""SELECT page_id, len(regexp_extract_all(html, ' style="'))::BIGINT AS style_attributes, len(regexp_extract_all(html, '<style[ >]'))::BIGINT AS style_blocks, len(regexp_extract_all(html, '<script>'))::BIGINT AS inline_scripts, len(regexp_extract_all(html, ' on[a-z]+="'))::BIGINT AS handlers FROM pages WHERE html <> ''""")
def audit_inline_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline styles, scripts and handlers of each page."""
    return audits.inline_code(page_nodes(spark, sf_dir))


@query(r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<(?:script|link)( [^<>]*)>', 1)) AS a FROM pages), u AS (SELECT page_id, a, regexp_extract(a, '(?:src|href)="((?:https?:)?//[^"]*)"', 1) AS url FROM t)
  SELECT url, regexp_extract(url, '//([^/?#]*)', 1) AS host, count(DISTINCT page_id) AS pages, bool_or(a LIKE '% integrity%') AS integrity, bool_or(a LIKE '% crossorigin%') AS crossorigin FROM u WHERE url <> '' GROUP BY 1, 2""")
def audit_supply_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign scripts and style sheets by address."""
    return audits.supply_chain(page_nodes(spark, sf_dir))


def _side(i: int) -> str:
    """Matches of one side of the pairs over whole texts, with the line each begins on."""
    one = "SELECT page_id, '{kind}' AS kind, name, (1 + sum(length(before) - length(replace(before, chr(10), '')) + lag_lines) OVER (PARTITION BY page_id ORDER BY i))::INT AS line FROM (SELECT page_id, i, before, {name} AS name, coalesce(lag(length(hit) - length(replace(hit, chr(10), ''))) OVER (PARTITION BY page_id ORDER BY i), 0) AS lag_lines FROM (SELECT page_id, unnest(range(len(hits))) AS i, unnest(hits) AS hit, unnest(pieces[1:len(hits)]) AS before, unnest(names) AS group1 FROM (SELECT page_id, regexp_extract_all(html, {p}) AS hits, string_split_regex(html, {p}) AS pieces, regexp_extract_all(html, {p}, {g}) AS names FROM pages)))"
    return " UNION ALL ".join(one.format(kind=side[-1], name="group1" if "[^" in side[i] else "''", p=_QUOTE(side[i]), g=1 if "[^" in side[i] else 0) for side in scripts.PAIRED)


@query(f"""WITH o AS ({_side(0)}), c AS ({_side(1)}) SELECT page_id, line, kind, name AS detail FROM o WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.page_id = o.page_id AND c.kind = o.kind AND c.name = o.name)""")
def audit_unpaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listeners, timers, observers and stored keys without their counterpart in the page."""
    return scripts.unpaired(table(spark, sf_dir, "pages"))


def _count(pattern: str) -> str:
    return f"(SELECT coalesce(sum(len(regexp_extract_all(html, {_QUOTE(pattern)}))), 0) FROM pages)"


def _of(*patterns: str) -> str:
    return " + ".join(map(_count, patterns))


_CARD_SQL = {
    "landmarks": ("(SELECT count(*) FILTER (len(regexp_extract_all(html, '<main[ >]')) <> 1 OR NOT regexp_matches(html, '<nav[ >]')) FROM pages)", "(SELECT count(*) FROM pages WHERE html <> '')"),
    "control names": (_of("<(?:input|select|textarea)[ >]"), "NULL"),
    "focus": (_of("tabindex=\"[1-9]", " autofocus", " accesskey=", scorecards._FOCUS_CALL), "NULL"),
    "media captions": (_of("<video[ >]"), _of("<video[ >]")),
    "tables": (_of("<table[ >]"), _of("<table[ >]")),
    "keyboard": (_of("<(?:div|span|li|td|p|img)[^>]* onclick="), "NULL"),
    "iframes": (_of("<iframe[ >]"), _of("<iframe[ >]")),
    "markup and script": (_of(" on[a-z]+=\"", *scorecards.SHARP.values(), "target=\"_blank\""), "NULL"),
    "supply chain": ("(SELECT count(DISTINCT u) FROM (SELECT unnest(regexp_extract_all(html, '<(?:script|link)[^>]+(?:src|href)=\"((?:https?:)?//[^\"]*)\"', 1)) AS u FROM pages))",) * 2,
    "iframe sandbox": (_of("<iframe[^>]+src=\"(?:https?:)?//"),) * 2,
    "cookies and consent": (f"CASE WHEN {_count(scorecards.CONSENT)} > 0 THEN 0 ELSE {_count(scorecards.COOKIE_WRITE)} END", "NULL"),
    "trackers": (" + ".join(f"({_count(p)} > 0)::INT" for p in scorecards.TRACKERS.values()), "NULL"),
    "script habits": (_of(*scorecards.HABITS.values()), "NULL"),
    "first paint": (_of("<script[^>]+src=", "<link[^>]+rel=\"stylesheet\""), "NULL"),
    "inline style and script": (_of(" style=\"", "<style[ >]", "<script>"), "NULL"),
    "images": (_of("<img[ >]"), _of("<img[ >]")),
    "dom size": ("(SELECT count(*) FILTER (len(regexp_extract_all(regexp_replace(html, '<(script|style)>.*?</(script|style)>', '<$1>', 'gs'), '<[a-z]')) > 1500) FROM pages)", "(SELECT count(*) FROM pages WHERE html <> '')"),
    "fonts": (_of("@font-face"), _of("@font-face")),
    "timers": (_of("setInterval\\(", "setTimeout\\(", "requestAnimationFrame\\("),) * 2,
    "listeners": (_of("addEventListener\\("),) * 2,
    "observers": (_of("new (?:Intersection|Mutation|Resize|Performance)Observer\\("),) * 2,
}


@query(" UNION ALL ".join(f"SELECT '{card}' AS card, '{c}' AS concern, true AS present, ({_CARD_SQL[c][0]})::BIGINT AS n, ({_CARD_SQL[c][1]})::BIGINT AS of" for card, cs in scorecards.CARDS.items() for c in cs))
def scorecards_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four scorecards of all pages (which have no controls with labels, captions or clean-up, so that the SQL counts openings)."""
    return scorecards.scorecards(table(spark, sf_dir, "pages"), materialize(page_nodes(spark, sf_dir)))


#: Each user's events as one function: every kind of event is a statement of its own shape.
_STATEMENT = "CASE event_type WHEN 'click' THEN 'if (k) { b(\"}\"); }\n' WHEN 'error' THEN 'while (k) { if (j) { c(); } }\n' WHEN 'purchase' THEN 'x = (a) => { if (a && b) { while (c) { d(); } } };\n' ELSE 'y();\n' END"


@query("""WITH u AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'error') AS e, count(*) FILTER (event_type = 'purchase') AS p FROM events GROUP BY 1)
  SELECT user_id, 1 + p AS functions, (n + 2 > 40 OR CASE WHEN p > 0 THEN 4 WHEN e > 0 THEN 3 WHEN c > 0 THEN 2 ELSE 1 END >= 4 OR c + 2 * e + 3 * p >= 10)::BIGINT AS complex, n + 2 AS lines, CASE WHEN p > 0 THEN 4 WHEN e > 0 THEN 3 WHEN c > 0 THEN 2 ELSE 1 END AS depth, c + 2 * e + 3 * p AS branches FROM u""")
def dsp_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of each user's events written as source, and those that are long, deep or branched, with the outer one's measures."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.expr(_STATEMENT).alias("line"))
    body = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "line"))).alias("l"))
    source = body.select("user_id", F.concat(F.lit("function u"), "user_id", F.lit("() {\n"), F.array_join(F.transform("l", lambda x: x["line"]), ""), F.lit("}\n")).alias("source"))
    found = source_code.complexity(source, "user_id", "source").withColumnRenamed("page_id", "user_id")
    outer = F.col("name") != "x"
    return found.groupBy("user_id").agg(F.count("*").alias("functions"), F.count_if(source_code.over_bounds()).alias("complex"), *[F.max(F.when(outer, F.col(c))).cast("long").alias(c) for c in ("lines", "depth", "branches")])


_PAGING = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in api_style.PAGING.items())


@query(f"""WITH {CALLS_SQL}, p AS (SELECT path || '?' || regexp_replace(props, '[^a-z0-9]+', '', 'g') || '=1&page=' || user_id AS path FROM calls),
  s AS (SELECT unnest(list_filter(string_split(split_part(path, '?', 1), '/'), lambda s: s <> '' AND NOT regexp_matches(s, '[{{$:]|^[0-9]+$'))) AS s FROM p),
  c AS (SELECT s, regexp_matches(s, '(?i)^v[0-9]+$') AS v, CASE WHEN regexp_matches(s, '^[a-z0-9]+(-[a-z0-9]+)+$') THEN 'kebab' WHEN regexp_matches(s, '^[a-z0-9]+(_[a-z0-9]+)+$') THEN 'snake' WHEN regexp_matches(s, '^[a-z]+[A-Z][A-Za-z0-9]*$') THEN 'camel' WHEN regexp_matches(s, '^[a-z][a-z0-9]*$') THEN 'single word' END AS k FROM s),
  a AS (SELECT 'case' AS aspect, k AS value FROM c WHERE NOT v UNION ALL SELECT 'version', lower(s) FROM c WHERE v UNION ALL SELECT 'noun', CASE WHEN ends_with(s, 's') THEN 'plural' ELSE 'singular' END FROM c WHERE NOT v AND k IS NOT NULL
  UNION ALL SELECT 'verb', s FROM c WHERE lower(regexp_extract(s, '^([A-Z]?[a-z]+)', 1)) IN {api_style.ACTIONS}
  UNION ALL SELECT 'paging', CASE split_part(x, '=', 1) {_PAGING} END FROM (SELECT unnest(string_split(split_part(path, '?', 2), '&')) AS x FROM p))
  SELECT aspect, value, count(*) AS n FROM a WHERE value IS NOT NULL GROUP BY 1, 2""")
def dsp_apistyle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case, versions, plurals, verbs and paging of the call log's paths."""
    asked = F.concat("path", F.lit("?"), F.regexp_replace("props", "[^a-z0-9]+", ""), F.lit("=1&page="), "user_id")
    return api_style.census(calls(spark, sf_dir).select(asked.alias("path")))


@query(f"""WITH {_PROTO}, n AS (SELECT label, count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY 1), l AS (SELECT vec_id, d.label, proto, CASE WHEN d.label = proto THEN CASE WHEN n = 1 THEN 'inf'::DOUBLE ELSE d * n / (n - 1) END ELSE d END AS d FROM d LEFT JOIN n ON d.label = n.label WHERE d.label IS NOT NULL),
  b AS (SELECT vec_id, any_value(label) AS label, arg_min(proto, d) AS predicted FROM l GROUP BY vec_id) SELECT label, count(*) AS n, count(*) FILTER (label = predicted) AS correct FROM b GROUP BY 1""")
def ml_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the nearest class mean is a vector's own when the vector is left out of it."""
    held = learning.leave_one_out(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return held.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("predicted")).alias("correct"))


@query(f"""WITH {_PROTO.replace("unnest(embedding)::DOUBLE AS x FROM embeddings)", "unnest(embedding)::DOUBLE AS x FROM embeddings), q AS (SELECT vec_id, label, pos, x + 0.05 * (('0x' || substr(md5(vec_id || '-' || pos), 1, 8))::BIGINT / 4294967296.0::DOUBLE + ('0x' || substr(md5(vec_id || '-' || pos), 9, 8))::BIGINT / 4294967296.0::DOUBLE + ('0x' || substr(md5(vec_id || '-' || pos), 17, 8))::BIGINT / 4294967296.0::DOUBLE - 1.5) * 2 AS x FROM p)")},
  e AS (SELECT vec_id, proto, sqrt(sum((x - c) * (x - c))) AS d FROM q JOIN m USING (pos) GROUP BY vec_id, proto), a AS (SELECT vec_id, arg_min(proto, d) AS before FROM d GROUP BY 1), b AS (SELECT vec_id, arg_min(proto, d) AS after FROM e GROUP BY 1)
  SELECT before AS predicted, count(*) AS n, count(*) FILTER (before = after) AS stayed FROM a JOIN b USING (vec_id) GROUP BY 1""")
def ml_noise_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many vectors keep their predicted class under seeded noise."""
    return learning.robustness(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding", 0.05).groupBy("predicted").agg(F.count("*").alias("n"), F.count_if(F.col("predicted") == F.col("after")).alias("stayed"))


@query("""WITH p AS (SELECT vec_id, unnest(range(len(embedding)))::INT AS i, unnest(embedding)::DOUBLE AS x, len(embedding) AS d FROM embeddings), s AS (SELECT vec_id, x, i, vec_id / pow(10000, (i - i % 2)::DOUBLE / d) AS angle FROM p) SELECT vec_id, round(sum(x * CASE WHEN i % 2 = 0 THEN sin(angle) ELSE cos(angle) END), 6) AS placed FROM s GROUP BY 1""")
def ml_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's product with the sinusoidal code of its place."""
    code = learning.sinusoidal(F.col("vec_id"), F.size("embedding"))
    product = F.zip_with(learning.doubles("embedding"), code, lambda a, b: a * b)
    return table(spark, sf_dir, "embeddings").where(F.size("embedding") > 0).select("vec_id", F.round(F.aggregate(product, F.lit(0.0), lambda s, x: s + x), 6).alias("placed"))
