"""Queries over payloads and endpoints, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import payloads
from ..sources.tables import CALLS_SQL, calls, table
from .catalog import query

#: Events as nested payloads: the stored properties beside values of mixed kinds, lists and inner objects.
_PAYLOAD = """CASE WHEN value > 30 THEN '{"props":' || props || ',"price":' || value || ',"tags":["' || event_type || '",' || user_id || ']}'
  WHEN user_id % 7 = 0 THEN '{"props":' || props || ',"price":null,"user":{"id":' || user_id || ',"seen":[{"at":1},{"at":"x"},[]]}}'
  WHEN user_id % 11 = 0 THEN '{"props":"' || event_type || '","price":' || user_id || '}' ELSE '{"props":' || props || '}' END"""

_KIND = "CASE {0} WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'DOUBLE' THEN 'number' ELSE 'integer' END"


@query(rf"""WITH p AS (SELECT event_type, {_PAYLOAD} AS body FROM events),
  t AS (SELECT event_type, regexp_replace(substr(fullkey, 2), '\[[0-9]+\]', '[]', 'g') AS path, {_KIND.format("j.type")} AS type FROM p, json_tree(p.body::JSON) j),
  c AS (SELECT event_type, path, type, count(*) AS n FROM t GROUP BY 1, 2, 3),
  m AS (SELECT event_type, path, list_sort(list(DISTINCT type) FILTER (type <> 'null')) AS all_types, bool_or(type = 'null') AS nullable, sum(n)::BIGINT AS n FROM c GROUP BY 1, 2),
  k AS (SELECT *, CASE WHEN list_contains(all_types, 'number') THEN list_filter(all_types, lambda x: x <> 'integer') ELSE all_types END AS types, regexp_replace(path, '[.][A-Za-z_][A-Za-z0-9_-]*$', '') AS parent FROM m)
  SELECT k.event_type, k.path, coalesce(array_to_string(types, '|'), 'null') AS type, nullable, k.path <> parent AND k.n < coalesce(o.n, 0) AS optional, coalesce(len(types) > 1 AND (list_contains(types, 'object') OR list_contains(types, 'array')), false) AS conflict, k.n
  FROM k LEFT JOIN c o ON o.event_type = k.event_type AND o.path = parent AND o.type = 'object'""")
def r31_payload_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types of all paths of nested payloads, with what is nullable, optional or in conflict."""
    body = table(spark, sf_dir, "events").select("event_type", F.expr(_PAYLOAD).alias("body"))
    return payloads.lattice(payloads.typed_paths(body, ["event_type"], "body"), ["event_type"])


@query(rf"""WITH {CALLS_SQL}, c AS (SELECT seq, method, path, status, CASE WHEN method = 'GET' THEN json_keys(props) ELSE [] END AS query, CASE WHEN method <> 'GET' THEN props END AS body, regexp_extract(path, '^(.*)/[^/]*$', 1) AS prefix, regexp_extract(path, '[^/]*$') AS leaf FROM calls),
  g AS (SELECT method, prefix, count(DISTINCT leaf) > 1 AND bool_and(regexp_matches(leaf, '[0-9]') OR length(leaf) > 6) AS varies FROM c GROUP BY 1, 2),
  n AS (SELECT c.*, varies, c.prefix || '/' || CASE WHEN varies THEN ':id' ELSE leaf END AS endpoint FROM c JOIN g ON g.method = c.method AND g.prefix = c.prefix),
  l AS (SELECT method, endpoint, leaf, min(seq) AS first, row_number() OVER (PARTITION BY method, endpoint ORDER BY min(seq), leaf) AS k FROM n WHERE varies GROUP BY 1, 2, 3),
  x AS (SELECT method, endpoint, list(leaf ORDER BY k) AS examples FROM l WHERE k <= 3 GROUP BY 1, 2)
  SELECT n.method, n.endpoint, CASE WHEN bool_or(varies) THEN ['id'] ELSE [] END AS params, list_sort(list_distinct(flatten(list(query)))) AS query, list_sort(list(DISTINCT status::VARCHAR)) AS statuses,
    list_aggregate(list_transform(json_keys(arg_min(body, seq) FILTER (body IS NOT NULL)), lambda k: k || ':integer'), 'string_agg', ',') AS observed_body, coalesce(any_value(examples), []) AS examples, count(*) AS calls
  FROM n LEFT JOIN x ON x.method = n.method AND x.endpoint = n.endpoint GROUP BY 1, 2""")
def r31_endpoint_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints with parameters, query names, statuses, the shape of the first body and three examples."""
    read = F.col("method") == "GET"
    seen = calls(spark, sf_dir).select("seq", "method", "path", "status", F.when(read, F.json_object_keys("props")).otherwise(F.array().cast("array<string>")).alias("query"), F.when(~read, F.col("props")).alias("body"))
    return payloads.endpoints(seen).withColumn("statuses", F.transform("statuses", lambda s: s.cast("string")))
