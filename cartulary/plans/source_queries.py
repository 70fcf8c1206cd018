"""Queries over crawl rules, style sheets, scripts and credentials, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import credentials, scripts, styles, text
from ..sources import artifacts
from ..sources.tables import PAGES_SQL, table
from .catalog import query
from .scratch import materialize

_QUOTE = lambda s: "'" + s.replace("'", "''") + "'"

# crawl rules: what a host's own pages look like, as rules of four kinds
_KINDS = ("'/' || seg", "'/' || seg || '/*' || tail || '$'", "'/*' || tail || '$'", "'/' || seg || '/'")
_RULE_OF = "CASE page_id % 4 " + " ".join(f"WHEN {i} THEN {k}" for i, k in enumerate(_KINDS)) + " END"


@query(rf"""WITH {PAGES_SQL}, p AS (SELECT page_id, host, path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS path, regexp_extract(path, '^/([^/]*)', 1) AS seg, right(path || CASE WHEN query <> '' THEN '?' || query ELSE '' END, 1) AS tail FROM u),
  r AS (SELECT DISTINCT host, page_id % 4 >= 2 AS allow, {_RULE_OF} AS pattern FROM p),
  x AS (SELECT *, '^' || array_to_string(list_transform(string_split(rtrim(pattern, '$'), '*'), lambda s: regexp_escape(s)), '.*') || CASE WHEN ends_with(pattern, '$') THEN '$' ELSE '' END AS re FROM r),
  h AS (SELECT p.page_id, allow, length(pattern) AS n FROM p JOIN x ON x.host = p.host AND regexp_matches(p.path, x.re)),
  b AS (SELECT page_id, arg_max(allow, n * 2 + allow::INT) AS allowed FROM h GROUP BY 1)
  SELECT p.page_id, p.path, coalesce(allowed, true) AS allowed FROM p LEFT JOIN b USING (page_id)""")
def r48_crawl_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the rules of its host, with stars and ends, allow each page."""
    whole = F.concat("path", F.when(F.col("query") != "", F.concat(F.lit("?"), "query")).otherwise(""))
    p = table(spark, sf_dir, "pages").select("page_id", *urls.parts("url")).select("page_id", "host", F.regexp_extract("path", "^/([^/]*)", 1).alias("seg"), whole.alias("path"))
    p = p.withColumn("tail", F.right("path", F.lit(1)))
    rules = materialize(p.select("host", (F.col("page_id") % 4 >= 2).alias("allow"), F.expr(_RULE_OF).alias("pattern")).distinct())
    return artifacts.robots_verdicts(p, rules, on=("host",)).select("page_id", "path", "allowed")


#: The style blocks of each page, and rules for what its address says: its first segment as a class, its fragment as an id.
_SHEET = r"""concat(style, '\n.ad .', seg, '{float:left;width:9px;color:red!important}\n/* .gone{} */ .', seg, ', #', frag, ' > p b i a{color:red;}\na{color:red;}b{color:red;}i{color:red;}')"""
_SHEETS = rf"""{PAGES_SQL}, v AS (SELECT page_id, array_to_string(regexp_extract_all(html, '(?is)<style[^>]*>(.*?)</style>', 1), chr(10)) AS style, coalesce(nullif(regexp_extract(path, '^/([A-Za-z]+)', 1), ''), 'none') AS seg, coalesce(nullif(fragment, ''), 'main') AS frag FROM u),
  sheets AS (SELECT page_id AS sheet, seg, frag, style, {_SHEET.replace(chr(92) + "n", "' || chr(10) || '").replace("concat(style, '' ||", "concat(style,")} AS css FROM v)"""


def _sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    own = styles.sheets(pages).withColumnsRenamed({"sheet": "page_id", "css": "style"})
    named = pages.select("page_id", *urls.parts("url")).join(own, "page_id", "left")
    word = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    parts = named.select("page_id", F.coalesce("style", F.lit("")).alias("style"), word(F.regexp_extract("path", "^/([A-Za-z]+)", 1), "none").alias("seg"), word(F.col("fragment"), "main").alias("frag"))
    return parts.select(F.col("page_id").alias("sheet"), F.expr(_SHEET).alias("css"))


_BARE = r"""bare AS (SELECT sheet, regexp_replace(css, '/\*.*?\*/', '', 'gs') AS css FROM sheets), heads AS (SELECT sheet, unnest(regexp_extract_all(css, '(?:^|\})\s*([^{}@]+)\{', 1)) AS head FROM bare),
  sel AS (SELECT sheet, trim(regexp_replace(unnest(string_split(head, ',')), '\s+', ' ', 'g')) AS selector FROM heads)"""


@query(rf"""WITH {_SHEETS}, {_BARE}, c AS (SELECT sheet, count(*) AS selectors, count(*) FILTER (regexp_matches(selector, '#[\w-]')) AS ids, count(*) FILTER (len(list_filter(string_split_regex(selector, '\s+|>'), lambda s: s <> '')) >= 4) AS deep FROM sel WHERE selector <> '' GROUP BY 1)
  SELECT sheet, selectors, len(regexp_extract_all(css, '!\s*important')) AS important, ids, deep, len(regexp_extract_all(css, 'float:left;width:')) AS floats FROM bare JOIN c USING (sheet)""")
def css_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selectors, important marks, ids, deep chains and float scaffolding of each sheet."""
    return styles.audit(_sheets(spark, sf_dir))


@query(rf"""WITH {_SHEETS}, d AS (SELECT sheet, unnest(regexp_extract_all(css, '[\w-]+\s*:\s*[^;{{}}]+;')) AS d FROM sheets) SELECT sheet, replace(rtrim(d, ';'), ':', ': ') AS declaration, count(*) AS n FROM d GROUP BY 1, 2 HAVING count(*) >= {styles.REPEATED}""")
def css_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations that a sheet repeats."""
    return styles.repeated_declarations(_sheets(spark, sf_dir))


@query(rf"""WITH {_SHEETS}, {_BARE}, used AS (SELECT DISTINCT '.' || unnest(flatten(list_transform(regexp_extract_all(html, '\sclass="([^"]*)"', 1), lambda c: string_split_regex(c, '\s+')))) AS token FROM pages UNION SELECT DISTINCT '#' || unnest(regexp_extract_all(html, '\sid="([^"]*)"', 1)) FROM pages),
  t AS (SELECT sheet, selector, regexp_extract_all(selector, '[.#][A-Za-z_][\w-]*') AS tokens FROM sel)
  SELECT sheet, selector, 3 + (SELECT any_value(length(style) - length(replace(style, chr(10), ''))) FROM sheets s WHERE s.sheet = t.sheet) AS line FROM t WHERE len(tokens) > 0 AND NOT EXISTS (SELECT 1 FROM used WHERE list_contains(t.tokens, used.token))""")
def css_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selectors of which no class and no id is on any page."""
    pages = table(spark, sf_dir, "pages")
    return styles.unmatched(styles.selectors(_sheets(spark, sf_dir)), materialize(styles.used_tokens(pages))).select("sheet", "selector", "line")


#: A user's events as a script: promise links with as many blanks between them as minutes passed.
_CALL = "CASE event_type WHEN 'click' THEN '.then(' WHEN 'error' THEN '.catch(' WHEN 'view' THEN '.finally(' ELSE '\n.map(' END"


@query(rf"""WITH g AS (SELECT user_id, event_id, event_type, repeat(' ', least(900, coalesce(epoch(ts)::BIGINT // 60 - epoch(lag(ts) OVER w)::BIGINT // 60, 0))::INT) || {_CALL.replace(chr(10), "' || chr(10) || '")} || props || ')' AS piece FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  p AS (SELECT e.user_id, e.event_id, event_type, piece, sum(length(piece)) OVER w - length(piece) + length(piece) - length(ltrim(piece, ' ')) AS place, sum((event_type NOT IN ('click', 'error', 'view'))::INT) OVER w AS breaks FROM g e JOIN (SELECT event_id, ts FROM events) t USING (event_id) WINDOW w AS (PARTITION BY e.user_id ORDER BY t.ts, e.event_id)),
  k AS (SELECT *, coalesce(place - lag(place) OVER (PARTITION BY user_id ORDER BY place) > {scripts.CHAIN_GAP}, true) AS new FROM p WHERE event_type IN ('click', 'error', 'view')),
  i AS (SELECT *, count(*) FILTER (new) OVER (PARTITION BY user_id ORDER BY place) AS island FROM k)
  SELECT user_id AS id, 'promise-chain' AS kind, (1 + min(breaks))::INT AS line, count(*)::INT AS depth FROM i GROUP BY user_id, island HAVING count(*) >= {scripts.LONG}""")
def async_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long promise chains in the events of each user, written as a script."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    minute = F.expr("cast(rint(unix_micros(cast(ts AS timestamp)) / 1e6D) AS bigint) div 60")  # of the nearest second, as in the SQL
    gap = F.least(F.lit(900), F.coalesce(F.col("minute") - F.lag("minute").over(w), F.lit(0))).cast("int")
    pieces = table(spark, sf_dir, "events").withColumn("minute", minute).select("user_id", "ts", "event_id", F.concat(F.repeat(F.lit(" "), gap), F.expr(_CALL), "props", F.lit(")")).alias("piece"))
    written = pieces.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "piece"))).alias("p")).select("user_id", F.array_join(F.transform("p", lambda p: p["piece"]), "").alias("text"))
    return scripts.async_findings(written, "user_id", "text")


_CREDENTIAL = " ".join(f"WHEN regexp_matches(t, {_QUOTE(rule)}) THEN {_QUOTE(kind)}" for kind, rule in credentials.CREDENTIALS)


#: Documents as source files: what they assign to a token is a credential of some kind.
_SECRET = """replace(text, 'token = "', CASE doc_id % 7 WHEN 0 THEN 'api_key: "' WHEN 1 THEN 'password = "' WHEN 2 THEN 'client_secret="' WHEN 3 THEN 'Bearer ' WHEN 4 THEN 'ghp_' WHEN 5 THEN 'redis://u:' ELSE 'npm_' END)"""


@query(f"""WITH l AS (SELECT doc_id AS id, unnest(string_split({_SECRET}, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents), k AS (SELECT id, line, CASE {_CREDENTIAL} END AS kind FROM l) SELECT id, line, kind FROM k WHERE kind IS NOT NULL""")
def policy_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credentials in documents: one finding a line, of the first rule that matches; no values."""
    files = table(spark, sf_dir, "documents").select("doc_id", F.expr(_SECRET).alias("text"))
    return text.policy_findings(files, "doc_id", "text", credentials.CREDENTIALS, credentials.HINT)
