"""Queries over pages, documents, conversations and vectors, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers, urls
from ..functions.arrays import let
from ..operators import analyzers, learning, markup, text
from ..sources.tables import LINKS_SQL, PAGES_SQL, page_links, page_urls, table
from .catalog import query

for _name, _patterns in analyzers.ANALYZERS.items():
    query(analyzers.report_sql(_patterns), name=f"dsp_{_name}")(lambda spark, sf_dir, p=_patterns: analyzers.report(table(spark, sf_dir, "pages"), "html", p))

# retrieval and text

_ASKED = "the reading of order"
_CHUNKS = r"""c AS (SELECT doc_id AS id, unnest(range(len(string_split_regex(text, '\n[ \t]*\n'))))::INT AS pos, unnest(string_split_regex(text, '\n[ \t]*\n')) AS raw FROM documents),
  chunks AS (SELECT id, pos, regexp_replace(raw, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS chunk FROM c WHERE length(regexp_replace(raw, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')) >= 20)"""


@query(f"""WITH {_CHUNKS}, t AS (SELECT id, pos, unnest(string_split_regex(lower(chunk), '[^a-z0-9]+')) AS term FROM chunks), tf AS (SELECT id, pos, term, count(*) AS tf FROM t WHERE term IN ('the', 'reading', 'order') GROUP BY ALL),
  idf AS (SELECT term, ln(1 + (SELECT count(*) FROM chunks) / (1 + count(*))) AS idf FROM tf GROUP BY 1)
  SELECT id, pos, round(sum(idf * (1 + ln(tf))), 6) AS score FROM tf JOIN idf USING (term) GROUP BY 1, 2 HAVING round(sum(idf * (1 + ln(tf))), 6) > 0 ORDER BY score DESC, id, pos LIMIT 6""")
def r37_retrieve_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six paragraphs that answer a query best."""
    return text.retrieve(text.paragraphs(table(spark, sf_dir, "documents"), "doc_id", "text"), _ASKED)


@query("""WITH h AS (SELECT doc_id AS id, lower(text) AS low FROM documents), s AS (SELECT id, CAST(round((length(low) - length(replace(low, 'the', ''))) / 3.0 + (length(low) - length(replace(low, 'ing', ''))) / 3.0, 0) AS BIGINT) AS score FROM h) SELECT * FROM s WHERE score > 0""")
def r38_substring_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of two terms as substrings in each document."""
    return text.substring_rank(table(spark, sf_dir, "documents"), "doc_id", "text", ["the", "ing"])


@query(r"SELECT doc_id, greatest(1, floor(len(list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda w: w <> '')) / 200.0 + 0.5))::BIGINT AS minutes FROM documents")
def r39_reading_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes to read each document."""
    words = F.size(F.filter(F.split("text", "[ \t\n\r]+"), lambda w: w != ""))
    return table(spark, sf_dir, "documents").select("doc_id", F.greatest(F.lit(1), F.floor(words / 200.0 + 0.5)).cast("long").alias("minutes"))


@query("""WITH t AS (SELECT doc_id AS id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9+/=_-]{24,}'))) AS token FROM documents), c AS (SELECT id, token, unnest(string_split(token, '')) AS ch FROM t), n AS (SELECT id, token, ch, count(*) AS k FROM c GROUP BY ALL),
  e AS (SELECT id, token, floor(sum(-(k / length(token)) * log2(k / length(token))) * 100 + 0.5) / 100 AS bits FROM n GROUP BY 1, 2) SELECT * FROM e WHERE bits >= 4.2""")
def dsp_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long tokens of high entropy."""
    return text.high_entropy_tokens(table(spark, sf_dir, "documents"), "doc_id", "text")


_POLICY = " ".join(f"WHEN regexp_matches(t, '{rule.replace(chr(39), chr(39) * 2)}') THEN '{kind}'" for kind, rule in text.POLICY_RULES)


@query(rf"""WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents), k AS (SELECT id, line, CASE {_POLICY} END AS kind FROM l) SELECT id, line, kind FROM k WHERE kind IS NOT NULL""")
def policy_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding a line, of the first rule that matches; no values."""
    return text.policy_findings(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(r"""WITH w AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: w <> '') AS words, greatest(1, len(list_filter(string_split_regex(text, '[.!?]+'), lambda s: regexp_matches(s, '[A-Za-z]')))) AS sentences FROM documents),
  s AS (SELECT id, len(words) AS words, sentences, list_sum(list_transform(words, lambda w: greatest(1, len(regexp_extract_all(regexp_replace(w, 'e$', ''), '[aeiouy]+')))))::BIGINT AS syllables FROM w WHERE len(words) > 0)
  SELECT *, floor((0.39 * words::DOUBLE / sentences + 11.8 * syllables::DOUBLE / words - 15.59) * 10 + 0.5) / 10 AS grade FROM s""")
def dsp_cognitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readability grade of each document."""
    return text.readability(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""WITH s AS (SELECT role, length(text) AS n FROM conversations) SELECT role, count(*) AS texts, list_sort(list(n))[(count(*) // 2) + 1]::BIGINT AS median_chars FROM s GROUP BY 1""")
def copy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and upper median length by role, through counts of lengths."""
    from ..operators.relational import upper_median_per_group

    c = table(spark, sf_dir, "conversations").select("role", F.length("text").alias("chars"))
    return upper_median_per_group(c, ["role"], "chars").select("role", F.col("n").alias("texts"), F.col("median").cast("long").alias("median_chars"))


@query(r"""SELECT doc_id, len(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._+-]+@[A-Za-z0-9-]+[.][A-Za-z]+')))::INT AS emails, len(regexp_extract_all(text, '[$€£] ?[0-9]+([.,][0-9]+)?'))::INT AS prices FROM documents""")
def scrape_emails_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct e-mail addresses and prices in each document, counted."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9._+-]+@[A-Za-z0-9-]+[.][A-Za-z]+"), F.lit(0)))).alias("emails"), F.regexp_count("text", F.lit("[$€£] ?[0-9]+([.,][0-9]+)?")).alias("prices"))


@query(r"""WITH t AS (SELECT page_id, list_transform(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1), lambda x: x) AS tags FROM pages), g AS (SELECT page_id, list_distinct(list_transform(range(1, len(tags)), lambda i: tags[i] || ' ' || tags[i + 1])) AS grams FROM t),
  r AS (SELECT list_sort(grams) AS grams, any_value(grams) AS first, min(page_id) AS id FROM g GROUP BY list_sort(grams)), p AS (SELECT x.id AS a, y.id AS b, len(list_intersect(x.grams, y.grams)) AS c, len(x.grams) AS n, len(y.grams) AS m FROM r x JOIN r y ON x.id < y.id)
  SELECT a, b, floor(c::DOUBLE / (n + m - c) * 100 + 0.5) / 100 AS similarity FROM p WHERE floor(c::DOUBLE / (n + m - c) * 100 + 0.5) / 100 >= 0.6""")
def r27_tag_bigram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of page skeletons with alike tag bigrams; pages with the same set are one skeleton."""
    tags = F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"))
    pairs = let(tags, lambda t: F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t) - 1), lambda x, y: F.concat(x, F.lit(" "), y)))
    pages = table(spark, sf_dir, "pages").where(F.regexp_count("html", F.lit("<[a-z]")) > 1)
    reps = pages.groupBy(F.array_sort(F.array_distinct(pairs)).alias("grams")).agg(F.min("page_id").alias("id"))
    return text.set_similarity(reps, "id", "grams")


# pages

@query(r"""SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '') AS lang, nullif(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '') AS h1 FROM pages""")
def page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, language and first heading."""
    get = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", get("<title>([^<]*)</title>").alias("title"), get('<html lang="([^"]*)"').alias("lang"), get("<h1>([^<]*)</h1>").alias("h1"))


@query(f"WITH {PAGES_SQL} SELECT page_id, scheme, host, path, query, fragment FROM u")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each page's URL."""
    return page_urls(spark, sf_dir).drop("url")


@query(f"WITH {LINKS_SQL} SELECT host, target, count(*) AS n FROM links WHERE target IS NOT NULL GROUP BY 1, 2")
def r42_link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved link targets of each host."""
    return page_links(spark, sf_dir).where("target is not null").groupBy("host", "target").agg(F.count("*").alias("n"))


@query(f"WITH {LINKS_SQL}, known AS (SELECT DISTINCT host, path FROM u) SELECT DISTINCT host, target FROM links l WHERE target IS NOT NULL AND NOT EXISTS (SELECT 1 FROM known k WHERE k.host = l.host AND k.path = l.target)")
def r42_dead_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that are no known page of their host."""
    known = page_urls(spark, sf_dir).select("host", F.col("path").alias("target")).distinct()
    return page_links(spark, sf_dir).where("target is not null").select("host", "target").distinct().join(known, ["host", "target"], "left_anti")


@query(f"WITH {LINKS_SQL} SELECT page_id FROM u WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.host = u.host AND l.target = u.path)")
def r41_orphan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that no link of their host reaches."""
    into = page_links(spark, sf_dir).where("target is not null").select("host", F.col("target").alias("path")).distinct()
    return page_urls(spark, sf_dir).join(into, ["host", "path"], "left_anti").select("page_id")


@query(r"""WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<(?:nav|header|footer)[^>]*>.*?</(?:nav|header|footer)>')) AS block FROM pages), n AS (SELECT page_id, md5(regexp_replace(block, '[ \t\n\r]+', ' ', 'g')) AS block FROM b) SELECT block, count(*) AS uses, min(page_id) AS first_page FROM n GROUP BY 1 HAVING count(*) >= 2""")
def r43_shared_chrome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Navigation, header and footer blocks used twice or more."""
    b = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("(?s)<(?:nav|header|footer)[^>]*>.*?</(?:nav|header|footer)>"), F.lit(0))).alias("raw"))
    n = b.select("page_id", F.md5(F.regexp_replace("raw", "[ \t\n\r]+", " ")).alias("block"))
    return n.groupBy("block").agg(F.count("*").alias("uses"), F.min("page_id").alias("first_page")).where("uses >= 2")


@query(f"WITH {PAGES_SQL}, s AS (SELECT host, regexp_replace(path, '[0-9]+', '#', 'g') AS stem FROM u WHERE regexp_matches(path, '[0-9]')) SELECT host, stem, count(*) AS pages FROM s GROUP BY 1, 2 HAVING count(*) >= 2")
def r44_pagination_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of a host that differ in numbers only."""
    s = page_urls(spark, sf_dir).where(F.col("path").rlike("[0-9]"))
    return s.groupBy("host", F.regexp_replace("path", "[0-9]+", "#").alias("stem")).agg(F.count("*").alias("pages")).where("pages >= 2")


@query(f"WITH {PAGES_SQL}, q AS (SELECT host, unnest(string_split(query, '&')) AS pair FROM u WHERE query <> ''), p AS (SELECT host, regexp_extract(pair, '^[^=]*') AS param, regexp_extract(pair, '=(.*)$', 1) AS v FROM q) SELECT host, param, string_agg(DISTINCT v, ',' ORDER BY v) AS seen FROM p GROUP BY 1, 2 HAVING count(DISTINCT v) >= 2")
def r45_query_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query parameters of a host with two values or more."""
    q = page_urls(spark, sf_dir).where("query <> ''").select("host", F.explode(F.split("query", "&")).alias("pair"))
    p = q.select("host", F.regexp_extract("pair", "^[^=]*", 0).alias("param"), F.regexp_extract("pair", "=(.*)$", 1).alias("v")).distinct()
    return p.groupBy("host", "param").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("v")), ",").alias("seen")).where("n >= 2").drop("n")


@query(f"WITH {PAGES_SQL}, t AS (SELECT DISTINCT regexp_extract(path, '^/([a-z][a-z])/', 1) AS locale, regexp_extract(path, '^/[a-z][a-z]/(.*)$', 1) AS tail FROM u WHERE regexp_matches(path, '^/[a-z][a-z]/')) SELECT tail, string_agg(locale, ',' ORDER BY locale) AS locales, count(*) = (SELECT count(DISTINCT locale) FROM t) AS everywhere FROM t GROUP BY 1 HAVING count(*) >= 2")
def r46_locale_alternates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths present under two locale folders or more, and whether under all."""
    t = page_urls(spark, sf_dir).where(F.col("path").rlike("^/[a-z][a-z]/")).select(F.regexp_extract("path", "^/([a-z][a-z])/", 1).alias("locale"), F.regexp_extract("path", "^/[a-z][a-z]/(.*)$", 1).alias("tail")).distinct()
    total = t.agg(F.count_distinct("locale").alias("total"))
    g = t.groupBy("tail").agg(F.array_join(F.sort_array(F.collect_list("locale")), ",").alias("locales"), F.count("*").alias("n")).where("n >= 2")
    return g.crossJoin(F.broadcast(total)).select("tail", "locales", (F.col("n") == F.col("total")).alias("everywhere"))  # total is one row


@query(rf"""WITH {PAGES_SQL}, b AS (SELECT page_id, query, host || CASE WHEN path LIKE '%/' THEN path || 'index.html' WHEN regexp_matches(path, '[.][a-z]+$') THEN path ELSE path || '.html' END AS base FROM u)
  SELECT page_id, CASE WHEN query = '' THEN base ELSE base || '@' || printf('%08x', list_reduce(list_transform(string_split(query, ''), lambda c: ascii(c)::BIGINT), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::BIGINT)) END AS local_path FROM b""")
def r47_local_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A local file path for each URL; a query becomes its FNV-1a hash."""
    u = page_urls(spark, sf_dir)
    base = F.concat(F.col("host"), F.when(F.col("path").endswith("/"), F.concat("path", F.lit("index.html"))).when(F.col("path").rlike(r"\.[a-z]+$"), F.col("path")).otherwise(F.concat("path", F.lit(".html"))))
    return u.select("page_id", F.when(F.col("query") == "", base).otherwise(F.concat(base, F.lit("@"), urls.fnv1a32(F.col("query")))).alias("local_path"))


@query(r"""WITH t AS (SELECT page_id % 2 = 0 AS even, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages), a AS (SELECT tag, count(*) AS n FROM t WHERE even GROUP BY 1), b AS (SELECT tag, count(*) AS n FROM t WHERE NOT even GROUP BY 1)
  SELECT coalesce(a.tag, b.tag) AS tag, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, coalesce(b.n, 0) - coalesce(a.n, 0) AS drift FROM a FULL JOIN b ON a.tag = b.tag""")
def r57_tag_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag histograms of two halves of the pages, compared."""
    t = table(spark, sf_dir, "pages").select((F.col("page_id") % 2 == 0).alias("even"), F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"))).alias("tag"))
    c = t.groupBy("tag").agg(F.count_if("even").alias("before"), F.count_if(~F.col("even")).alias("after"))
    return c.withColumn("drift", F.col("after") - F.col("before"))


@query(f"WITH {LINKS_SQL} SELECT page_id, count(DISTINCT target) AS out_degree FROM links WHERE target IS NOT NULL GROUP BY 1")
def r51_composition_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct targets of each page."""
    return page_links(spark, sf_dir).where("target is not null").groupBy("page_id").agg(F.count_distinct("target").alias("out_degree"))


@query(f"""WITH {PAGES_SQL}, m AS (SELECT host, count(*) AS pages, count(*) FILTER (query <> '') AS asked FROM u GROUP BY 1), d AS (SELECT DISTINCT regexp_replace(host, '^(m|blog|www)[.]', '') AS bare FROM u WHERE regexp_matches(host, '^(m|blog|www)[.]')) SELECT host, pages, asked, bare IS NOT NULL AS has_alias FROM m LEFT JOIN d ON bare = host""")
def r06_cover_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts with the pages that cover them and whether an alias host exists."""
    u = page_urls(spark, sf_dir)
    m = u.groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("query") != "").alias("asked"))
    d = u.where(F.col("host").rlike("^(m|blog|www)[.]")).select(F.regexp_replace("host", "^(m|blog|www)[.]", "").alias("bare")).distinct()
    return m.join(d, F.col("host") == F.col("bare"), "left").select("host", "pages", "asked", F.col("bare").isNotNull().alias("has_alias"))


_SIGNS = " UNION ALL ".join(f"SELECT page_id, '{a}' AS archetype, '{s}' AS sign FROM pages WHERE {c}" for a, s, c in analyzers.ARCHETYPES)


@query(f"""WITH s AS ({_SIGNS}), c AS (SELECT page_id, archetype, count(*) AS matched FROM s GROUP BY 1, 2 HAVING count(*) >= 2) SELECT page_id, archetype, matched FROM c QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY matched DESC, archetype) = 1""")
def dsp_archetype(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archetype with most signs, two at least."""
    hits = F.array(*[F.when(F.expr(c), F.lit(a)) for a, _, c in analyzers.ARCHETYPES])
    s = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array_compact(hits)).alias("archetype"))
    c = s.groupBy("page_id", "archetype").agg(F.count("*").alias("matched")).where("matched >= 2")
    best = c.groupBy("page_id").agg(F.min(F.struct((-F.col("matched")).alias("m"), "archetype")).alias("b"))
    return best.select("page_id", "b.archetype", (-F.col("b.m")).alias("matched"))


@query()
def page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as node tables (attributes as JSON text)."""
    return markup.nodes(table(spark, sf_dir, "pages")).withColumn("attrs", F.to_json("attrs"))


@query()
def dsp_dom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, depth and widest element of each page."""
    return markup.dom_summary(markup.nodes(table(spark, sf_dir, "pages")))


@query()
def scrape_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as Markdown."""
    return table(spark, sf_dir, "pages").select("page_id", markup.markdown("html").alias("markdown"))


@query(r"""WITH h AS (SELECT page_id, unnest(range(len(regexp_extract_all(html, '<h([1-6])[ >]', 1)))) AS pos, unnest(regexp_extract_all(html, '<h([1-6])[ >]', 1))::INT AS level FROM pages WHERE regexp_matches(html, '<h[1-6][ >]')), l AS (SELECT page_id, level, lag(level) OVER (PARTITION BY page_id ORDER BY pos) AS before FROM h)
  SELECT page_id, count(*) AS headings, count(*) FILTER (level > coalesce(before, 0) + 1) AS skips FROM l GROUP BY 1""")
def heading_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings that leave out a level."""
    h = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<h([1-6])[ >]"))).alias("pos", "level")).withColumn("level", F.col("level").cast("int"))
    before = F.lag("level").over(Window.partitionBy("page_id").orderBy("pos"))
    return h.withColumn("before", before).groupBy("page_id").agg(F.count("*").alias("headings"), F.count_if(F.col("level") > F.coalesce("before", F.lit(0)) + 1).alias("skips"))


# learning

@query("""WITH p AS (SELECT vec_id, unnest(range(len(embedding)))::INT AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT pos, round(avg(x), 6) AS mean, round(CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END, 6) AS std FROM p GROUP BY 1""")
def ml_column_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and population deviation of each dimension."""
    return learning.column_moments(table(spark, sf_dir, "embeddings"), "embedding").select("pos", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("""WITH p AS (SELECT vec_id, unnest(range(len(embedding)))::INT AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT pos, avg(x) AS mean, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS std FROM p GROUP BY 1)
  SELECT vec_id, round(sum(((x - mean) / std) * ((x - mean) / std)), 5) AS squared FROM p JOIN m USING (pos) GROUP BY 1""")
def ml_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardised vectors, by their squared length."""
    s = learning.standardized(table(spark, sf_dir, "embeddings"), "embedding")
    return s.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x * x), 5).alias("squared"))


_PROTO = """p AS (SELECT vec_id, label, unnest(range(len(embedding)))::INT AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label AS proto, pos, avg(x) AS c FROM p WHERE label IS NOT NULL GROUP BY 1, 2),
  d AS (SELECT vec_id, any_value(label) AS label, proto, sqrt(sum((x - c) * (x - c))) AS d FROM p JOIN m USING (pos) GROUP BY vec_id, proto)"""


@query(f"WITH {_PROTO} SELECT vec_id, arg_min(proto, d) AS predicted, round(exp(-min(d)) / sum(exp(-d)), 6) AS confidence FROM d GROUP BY vec_id")
def ml_nearest_prototype(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest class mean and its softmax confidence."""
    e = table(spark, sf_dir, "embeddings")
    return learning.classify(e, learning.prototypes(e, "label", "embedding"), "embedding").select("vec_id", "predicted", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {_PROTO}, b AS (SELECT vec_id, any_value(label) AS label, arg_min(proto, d) AS predicted FROM d GROUP BY vec_id) SELECT label, count(*) AS n, count(*) FILTER (label = predicted) AS correct FROM b GROUP BY 1")
def ml_prototype_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the nearest class mean is a vector's own."""
    e = table(spark, sf_dir, "embeddings")
    c = learning.classify(e, learning.prototypes(e, "label", "embedding"), "embedding")
    return c.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("predicted")).alias("correct"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), e AS (SELECT vec_id, v, list_transform(v, lambda x: exp(x - list_max(v))) AS e FROM v) SELECT vec_id, round(list_max(e) / list_sum(e), 6) AS top, round(sqrt(list_sum(list_transform(v, lambda x: (x - list_avg(v)) * (x - list_avg(v)))) / len(v)), 6) AS spread FROM e""")
def ml_softmax_layernorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest softmax weight of each vector, and its deviation."""
    v = learning.doubles("embedding")
    spread = F.sqrt(learning.variance(v))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.array_max(learning.softmax(v)), 6).alias("top"), F.round(spread, 6).alias("spread"))


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings), p AS (SELECT q.vec_id, k.v, list_dot_product(q.v, k.v) / sqrt(len(q.v)) AS s FROM e q JOIN e k ON q.label IS NOT DISTINCT FROM k.label AND k.rn BETWEEN q.rn - 8 AND q.rn),
  m AS (SELECT vec_id, max(s) AS most FROM p GROUP BY 1), w AS (SELECT vec_id, v, exp(s - most) AS e FROM p JOIN m USING (vec_id)) SELECT vec_id, count(*)::INT AS n, round(max(e) / sum(e), 6) AS top, round(sum(e * list_sum(v)) / sum(e), 6) AS total FROM w GROUP BY 1""")
def ml_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Self-attention of each vector over up to eight before it of its label."""
    out = learning.attention(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 8)
    return out.select("vec_id", F.size("weights").alias("n"), F.round(F.array_max("weights"), 6).alias("top"), F.round(F.aggregate("mixed", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("""WITH c AS (SELECT vec_id, lpad(printf('%x', 65536 * ((vec_id * 37) % 256) + 256 * ((vec_id * 91) % 256) + (vec_id * 53) % 256), 6, '0') AS colour FROM embeddings), l AS (SELECT vec_id, colour, list_transform([1, 3, 5], lambda i: ('0x' || substr(colour, i, 2))::INT / 255.0::DOUBLE) AS ch FROM c),
  m AS (SELECT vec_id, colour, list_transform(ch, lambda x: CASE WHEN x <= 0.04045 THEN x / 12.92 ELSE pow((x + 0.055) / 1.055, 2.4) END) AS ch FROM l), y AS (SELECT vec_id, colour, 0.2126 * ch[1] + 0.7152 * ch[2] + 0.0722 * ch[3] AS y FROM m) SELECT vec_id, colour, round(1.05 / (y + 0.05), 4) AS on_white, round((y + 0.05) / 0.05, 4) AS on_black FROM y""")
def colour_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contrast of a colour made from each row's id on white and on black."""
    number = (65536 * ((F.col("vec_id") * 37) % 256) + 256 * ((F.col("vec_id") * 91) % 256) + (F.col("vec_id") * 53) % 256).cast("long")
    c = table(spark, sf_dir, "embeddings").select("vec_id", F.lpad(F.lower(F.hex(number)), 6, "0").alias("colour"))
    on = lambda back: F.round(numbers.contrast(F.col("colour"), F.lit(back)), 4)
    return c.select("vec_id", "colour", on("ffffff").alias("on_white"), on("000000").alias("on_black"))
