"""Queries over shared blocks of markup, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from ..operators import blocks, markup
from ..sources.tables import table
from .catalog import query
from .scratch import materialize

_TAGS = "|".join(sorted(blocks.BLOCK_TAGS))
#: Blocks by counting the opening and closing tags of each name; a level's open tag and the next tag of that level belong together.
_BLOCKS = rf"""src AS (SELECT page_id, regexp_replace(html, '<(script|style)>.*?</(script|style)>', '', 'gs') AS h FROM pages),
  cut AS (SELECT page_id, h, regexp_extract_all(h, '<[^<>]*>') AS toks, string_split_regex(h, '<[^<>]*>') AS texts FROM src),
  tok AS (SELECT page_id, h, unnest(range(len(toks))) AS i, unnest(toks) AS t, unnest(texts[1:len(toks)]) AS before FROM cut),
  placed AS (SELECT *, sum(length(before) + length(t)) OVER (PARTITION BY page_id ORDER BY i) AS stop FROM tok),
  named AS (SELECT *, regexp_extract(t, '^</?([a-z0-9]+)', 1) AS tag, CASE WHEN starts_with(t, '</') THEN -1 ELSE 1 END AS s FROM placed WHERE regexp_matches(t, '^</?({_TAGS})[ >]')),
  levels AS (SELECT *, sum(s) OVER (PARTITION BY page_id, tag ORDER BY i) + CASE WHEN s < 0 THEN 1 ELSE 0 END AS level FROM named),
  paired AS (SELECT *, lead(stop) OVER w AS fin, lead(s) OVER w AS next FROM levels WINDOW w AS (PARTITION BY page_id, tag, level ORDER BY i)),
  blocks AS (SELECT page_id, tag, stop - length(t) AS first, fin AS last, regexp_replace(substr(h, (stop - length(t) + 1)::BIGINT, (fin - stop + length(t))::BIGINT), '\s+', ' ', 'g') AS frag, (fin - stop + length(t))::INT AS chars FROM paired WHERE s = 1 AND next = -1 AND fin - stop + length(t) >= {blocks.LEAST_CHARS}),
  shaped AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(frag, '="[^"]*"', '=@', 'g'), '>[^<>]*[^<> ][^<>]*<', '>@<', 'g'), '> <', '><', 'g') AS skeleton FROM blocks)"""
_ENTITIES = {"&quot;": '"', "&#x27;": "''", "&lt;": "<", "&gt;": ">", "&copy;": "©", "&middot;": "·", "&amp;": "&"}
_DECODE = reduce(lambda sql, e: f"replace({sql}, '{e[0]}', '{e[1]}')", _ENTITIES.items(), "{0}").format


@query(rf"""WITH {_BLOCKS}, shared AS (SELECT frag, count(DISTINCT page_id) AS pages, count(*) AS uses FROM shaped GROUP BY 1 HAVING count(DISTINCT page_id) >= 2),
  found AS (SELECT s.*, pages, uses FROM shaped s JOIN shared USING (frag)),
  marked AS (SELECT *, EXISTS (SELECT 1 FROM found o WHERE o.page_id = f.page_id AND o.first < f.first AND o.last >= f.last) AS inner_ FROM found f)
  SELECT any_value(tag) AS tag, coalesce(nullif({_DECODE("trim(regexp_extract(frag, '<h[1-6][^>]*>([^<]{2,40})</h[1-6]>', 1))")}, ''), nullif(regexp_extract(frag, ' class="([^" ]+)', 1), '')) AS label, any_value(pages) AS pages, any_value(uses)::BIGINT AS uses, min(chars) AS chars, contains(frag, '{{{{') OR contains(frag, '}}}}') AS dynamic, min(page_id) AS page_id
  FROM marked GROUP BY frag HAVING NOT bool_and(inner_)""")
def r19_shared_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that are the same in two pages or more, the largest of those that lie in each other."""
    found = blocks.repeated_blocks(materialize(blocks.block_table(table(spark, sf_dir, "pages"))))
    return found.select("tag", "label", "pages", "uses", "chars", "dynamic", "page_id")


@query(rf"""WITH {_BLOCKS}, shared AS (SELECT skeleton, count(DISTINCT page_id) AS pages, count(*) AS uses FROM shaped WHERE contains(skeleton, '@') GROUP BY 1 HAVING count(DISTINCT page_id) >= 2 AND count(DISTINCT frag) > 1),
  found AS (SELECT s.*, pages, uses FROM shaped s JOIN shared USING (skeleton)),
  marked AS (SELECT *, EXISTS (SELECT 1 FROM found o WHERE o.page_id = f.page_id AND o.first < f.first AND o.last >= f.last) AS inner_ FROM found f),
  kept AS (SELECT *, regexp_extract_all(frag, '="[^"]*"|>[^<>]*[^<> ][^<>]*<') AS hits, regexp_extract_all(frag, '([a-z-]+)="|>[^<>]*[^<> ][^<>]*<', 1) AS names FROM marked WHERE skeleton IN (SELECT skeleton FROM marked GROUP BY 1 HAVING NOT bool_and(inner_))),
  slots AS (SELECT skeleton, tag, pages, uses, len(hits) AS width, unnest(range(len(hits)))::INT AS slot, unnest(hits) AS hit, unnest(names) AS name FROM kept),
  vals AS (SELECT *, CASE WHEN starts_with(hit, '=') THEN 'attr' ELSE 'text' END AS kind, CASE WHEN starts_with(hit, '=') THEN {_DECODE("hit[3:-2]")} ELSE trim({_DECODE("hit[2:-2]")}) END AS value FROM slots)
  SELECT any_value(tag) AS tag, any_value(pages) AS pages, any_value(uses)::BIGINT AS uses, any_value(width)::INT AS width, slot, any_value(kind) AS kind, nullif(any_value(name), '') AS name, count(DISTINCT value) AS seen, min(value) AS low, max(value) AS high FROM vals GROUP BY skeleton, slot HAVING count(DISTINCT value) > 1""")
def r20_block_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What varies in blocks of one shape: slots whose values differ among pages."""
    pages = table(spark, sf_dir, "pages")
    kept = materialize(blocks.varying_blocks(materialize(blocks.block_table(pages))))
    held = pages.join(kept.select("page_id").distinct(), "page_id", "left_semi")
    return blocks.varying_slots(kept, blocks.slot_table(held)).drop("skeleton")


_QUIET = "regexp_replace(html, '<(script|style)>.*?</(script|style)>', '', 'gs')"


@query(rf"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(h, '<(title|h1|p|div[^>]*|footer|b|a [^>]*)>([^<]+)', 1)) AS tag, trim(regexp_replace({_DECODE("unnest(regexp_extract_all(h, '<(title|h1|p|div[^>]*|footer|b|a [^>]*)>([^<]+)', 2))")}, '\s+', ' ', 'g')) AS value FROM (SELECT page_id, {_QUIET} AS h FROM pages)),
  w AS (SELECT page_id, CASE WHEN tag = 'b' THEN 'p' WHEN tag LIKE 'a %' THEN 'li' ELSE regexp_extract(tag, '^[a-z0-9]+') END AS "where", value, CASE WHEN tag = 'b' THEN '<0>' || value || '<1/></0>' WHEN tag LIKE 'a %' THEN '<0>' || value || '</0>' ELSE value END AS pattern FROM t)
  SELECT page_id, "where", value, pattern, coalesce(nullif(array_to_string(list_filter(string_split_regex(lower(value), '[^a-z0-9]+'), lambda x: x <> '')[:6], '_'), ''), 'text') AS key FROM w WHERE length(value) >= 2 AND regexp_matches(value, '[A-Za-z][A-Za-z]')""")
def dsp_i18n_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running texts of each page's blocks, with places for inline elements, keyed by their first words."""
    return blocks.sentences(table(spark, sf_dir, "pages")).select("page_id", "where", "value", "pattern", "key")


@query(rf"""SELECT page_id, len(regexp_extract_all({_QUIET}, '<[a-z]')) + 2 AS elements, true AS held, '' AS drift FROM pages WHERE html <> ''""")
def page_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written back from its nodes, parsed again and compared."""
    return markup.round_trip(materialize(markup.nodes(table(spark, sf_dir, "pages")))).select("page_id", "elements", "held", "drift")
