"""DuckDB SQL for those training-data queries that SQL can express."""

from __future__ import annotations

from . import chat, merkle, pii, secrets, sharding

SQL: dict[str, str] = {}


def _spans_of(rule: secrets.Rule, order: int) -> str:
    """All spans of one rule: pieces between the matches tell where each match starts."""
    regex = rule.regex.replace("(?i:(password|passwd|secret|token|api_?key))", "((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))")
    quoted = "'" + regex.replace("'", "''") + "'"
    return f"""SELECT doc_id, '{rule.kind}' AS kind, {order} AS ord, i, part, hit, len FROM (
      SELECT doc_id, string_split_regex(text, {quoted}) AS parts, regexp_extract_all(text, {quoted}, 0) AS hits,
             list_transform(regexp_extract_all(text, {quoted}, {rule.group}), lambda g: length(g)) AS lens FROM docs),
      LATERAL (SELECT unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS hit, unnest(parts[1:len(hits)]) AS part, unnest(lens) AS len)"""


def _secret_sql() -> str:
    least = " ".join(f"WHEN '{r.kind}' THEN {r.least}" for r in secrets.RULES)
    parts = "\n    UNION ALL ".join(_spans_of(r, i) for i, r in enumerate(secrets.RULES))
    base = ", ".join(f"'{k}'" for k in secrets.BASE_KINDS)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secrets.BASE_KINDS)
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    raw AS ({parts}),
    placed AS (SELECT *, sum(length(part) + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM raw),
    spans AS (SELECT doc_id, kind, ord, stop - length(hit) AS start, stop FROM placed WHERE len >= CASE kind {least} END),
    joined AS (SELECT doc_id, {counts}, string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, ord) FILTER (kind IN ({base})) AS base,
      string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, ord) AS spans FROM spans GROUP BY doc_id)
    SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secrets.BASE_KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM docs d LEFT JOIN joined USING (doc_id)"""


SQL["op1_secret_scan"] = _secret_sql()

SQL["op2_chat_format"] = rf"""WITH rows AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      sum({len(chat.BEGIN)} + length(url_encode(role)) + 1 + {len(chat.END)} + length(regexp_replace(text, '([<\[])(\\*)({chat.CONTROL})', '\1\\\2\3', 'g')))::BIGINT AS formatted_chars
    FROM rows GROUP BY conv_id"""


def _tree_sql() -> str:
    tree = sharding.hash_tree()

    def level(nodes):
        return ", ".join(f"('{n.name}', {n.weight}, '{parent}', {-1 if n.shard is None else n.shard})" for parent, n in nodes)

    regions = [("root", r) for r in tree.children]
    racks = [(r.name, k) for r in tree.children for k in r.children]
    shards = [(k.name, s) for _, k in racks for s in k.children]
    new = tree.grown().children[-1]
    draw = "-ln((('0x' || substr(md5(key || '|' || name), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / weight"
    return f"""WITH RECURSIVE crc(n, k, c) AS (SELECT n, 0, n FROM range(256) t(n) UNION ALL
      SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 8),
    tbl AS (SELECT list(c ORDER BY n) AS t FROM crc WHERE k = 8),
    docs AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS key, encode(coalesce(text, '')) AS raw FROM documents),
    bytes AS (SELECT doc_id, key, octet_length(raw) AS n, list_transform(regexp_extract_all(hex(raw), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM docs),
    sums AS (SELECT doc_id, key, n + {sharding.ROW_BYTES} AS size,
      xor(list_reduce(b, lambda acc, x: xor(acc >> 8, t[(xor(acc, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32 FROM bytes, tbl),
    regions(name, weight, parent, shard) AS (VALUES {level(regions)}), racks(name, weight, parent, shard) AS (VALUES {level(racks)}),
    shards(name, weight, parent, shard) AS (VALUES {level(shards)}),
    r AS (SELECT doc_id, key, arg_min(name, {draw}) AS region, min({draw}) AS best FROM sums, regions GROUP BY doc_id, key),
    k AS (SELECT doc_id, key, best, arg_min(name, {draw}) AS rack FROM r JOIN racks ON parent = region GROUP BY doc_id, key, best),
    s AS (SELECT doc_id, key, best, arg_min(shard, {draw}) AS shard FROM k JOIN shards ON parent = rack GROUP BY doc_id, key, best)
    SELECT doc_id, size, text_crc32, 'key' AS law, shard,
      row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(key || '|' || text_crc32), 1, 4))::BIGINT % {sharding.SLOT_BUCKETS}, doc_id) - 1 AS slot,
      CASE WHEN {draw.replace("name", f"'{new.name}'").replace("weight", str(new.weight))} < best THEN {tree.shards} ELSE shard END AS grown_shard
    FROM s JOIN sums USING (doc_id, key)"""


SQL["op3_hash_tree_sharding"] = _tree_sql()

SQL["op4_warc_round_trip"] = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS raw FROM pages),
    f AS (SELECT page_id, raw, sha256(raw) AS digest, min(page_id) OVER (PARTITION BY raw) AS first FROM p),
    g AS (SELECT *, octet_length(raw) >= 100 AND first <> page_id AS again FROM f)
    SELECT page_id, octet_length(raw)::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN again THEN first END AS refers_to, CASE WHEN again THEN NULL ELSE true END AS verified FROM g"""

SQL["op11_fill_in_middle"] = """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
    t AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS toks, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
      ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
    c AS (SELECT *, len(toks)::BIGINT AS n, least(h1 % (len(toks) + 1), h2 % (len(toks) + 1)) AS a, greatest(h1 % (len(toks) + 1), h2 % (len(toks) + 1)) AS b FROM t),
    p AS (SELECT *, array_to_string(toks[1:a], '') AS pre, array_to_string(toks[a + 1:b], '') AS mid, array_to_string(toks[b + 1:], '') AS suf,
      CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
      sha256(text) AS restored_sha256 FROM p"""


def _levels(first: str, keys: str, name: str, count: int) -> str:
    """Tables ``name0`` to ``name{count}``: nodes (keys, place, n, digest), each level of runs of the one before."""
    out = [f"{name}0 AS ({first})"]
    for k in range(count):
        up = f"SELECT {keys} place // {merkle.ARITY} AS place, min(n) AS n, CASE WHEN min(n) > 1 THEN sha256(string_agg(digest, '' ORDER BY place)) ELSE min(digest) END AS digest FROM {name}{k} GROUP BY {keys} place // {merkle.ARITY}"
        out.append(f"{name}{k + 1} AS (SELECT {keys} place, ceil(n / {merkle.ARITY}::DOUBLE)::BIGINT AS n, digest FROM ({up}))")
    return ", ".join(out)


def _folds(start: str, group: str, name: str, count: int) -> str:
    """Tables ``f{name}0`` to ``f{name}{count}``: claims folded with the nodes of each level, siblings gathered."""
    out = [f"f{name}0 AS ({start})"]
    for k in range(count):
        run = "x.place // 16 = f.place // 16" + (f" AND x.{group} = f.{group}" if group else "")
        own = "x.place = f.place"
        out.append(
            f"""f{name}{k + 1} AS (SELECT f.u, any_value(f.g) AS g, any_value(f.place) // 16 AS place, CASE WHEN any_value(x.n) > 1 THEN sha256(string_agg(CASE WHEN {own} THEN f.folded ELSE x.digest END, '' ORDER BY x.place)) ELSE any_value(f.folded) END AS folded,
            any_value(f.proof) || coalesce(string_agg(x.digest, '' ORDER BY x.place) FILTER (NOT ({own})), '') AS proof FROM f{name}{k} f JOIN {name}{k} x ON {run} GROUP BY f.u)"""
        )
    return ", ".join(out)


def _merkle_sql(levels: int = 6) -> str:
    """The tree by levels; ``levels`` runs of 16 are enough for 16 million rows of a source."""
    coded = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join(coded(text if c == "text" else c) for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = "list_reduce(list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT), lambda acc, x: xor(acc >> 8, t[(xor(acc, x) & 255) + 1]), 4294967295::BIGINT)"
    return f"""WITH RECURSIVE crc(n, k, c) AS (SELECT n, 0, n FROM range(256) t(n) UNION ALL
      SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 8),
    tbl AS (SELECT list(c ORDER BY n) AS t FROM crc WHERE k = 8),
    rows AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '>' || source END AS g, {leaf("text")} AS leaf, CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN {leaf(lower)} END AS claim FROM documents, tbl),
    placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, claim NULLS FIRST) - 1 AS place, count(*) OVER (PARTITION BY g) AS n, row_number() OVER () AS u FROM rows),
    {_levels("SELECT g, place, n, leaf AS digest FROM placed", "g,", "s", levels)},
    {_levels(f"SELECT g, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS n, digest FROM s{levels}", "", "t", levels)},
    {_folds("SELECT u, g, place, coalesce(claim, leaf) AS folded, '' AS proof FROM placed", "g", "s", levels)},
    {_folds(f"SELECT f.u, f.g, t0.place, f.folded, f.proof FROM fs{levels} f JOIN t0 ON t0.g = f.g", "", "t", levels)}
    SELECT doc_id, leaf, s.digest AS subroot, r.digest AS root, sha256(f.proof) AS proof_sha256, f.folded AS folded_root, f.folded = r.digest AS verified
    FROM placed JOIN ft{levels} f USING (u) JOIN s{levels} s ON s.g = placed.g, t{levels} r"""


SQL["op12_merkle_manifest"] = _merkle_sql()


def _personal_sql() -> str:
    """Pieces between the matches of a kind tell where each match starts; context comes from the ends of the pieces."""
    digits = "regexp_replace(hit, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 0 THEN CASE WHEN substr(reverse({digits}), i, 1)::INT > 4 THEN 2 * substr(reverse({digits}), i, 1)::INT - 9 ELSE 2 * substr(reverse({digits}), i, 1)::INT END ELSE substr(reverse({digits}), i, 1)::INT END)) % 10 = 0"
    code = "replace(hit, ' ', '')"
    turned = f"(substr({code}, 5) || substr({code}, 1, 4))"
    value = f"strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr({turned}, i, 1)) - 1"
    mod97 = f"list_reduce(list_transform(range(1, length({turned}) + 1), lambda i: ({value})::BIGINT), lambda acc, v: (acc * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97, 0::BIGINT)"
    checks = {
        "email": "true",
        "ip": "list_max(list_transform(string_split(hit, '.'), lambda p: CASE WHEN length(ltrim(p, '0')) > 3 THEN 256 ELSE coalesce(try_cast(ltrim(p, '0') AS INT), 0) END)) <= 255",
        "card": f"length({digits}) BETWEEN 14 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 10 AND 15",
        "iban": f"length({code}) BETWEEN 15 AND 34 AND {mod97} = 1",
        "social": "NOT regexp_matches(hit, '^(000|666|9)|-00-|-0000$')",
    }
    parts = []
    for order, kind in enumerate(pii.KINDS):
        quoted = "'" + kind.plain.replace("'", "''") + "'"
        hint = lambda words: f"CASE WHEN regexp_matches(context, '(?i){'|'.join(words)}') THEN {pii.HINT} ELSE 0 END" if words else "0"
        parts.append(f"""SELECT doc_id, u, '{kind.name}' AS kind, {order} AS ord, stop - length(hit) AS start, stop, greatest(0, least(100, {kind.score} + {hint(kind.hints)} - {hint(kind.doubts)})) AS score FROM (
          SELECT doc_id, u, hit, right(part, {pii.WINDOW}) || ' ' || left(next, {pii.WINDOW}) AS context, sum(length(part) + length(hit)) OVER (PARTITION BY u ORDER BY i) AS stop FROM (
            SELECT doc_id, u, string_split_regex(text, {quoted}) AS pieces, regexp_extract_all(text, {quoted}) AS hits FROM docs),
            LATERAL (SELECT unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS hit, unnest(pieces[1:len(hits)]) AS part, unnest(pieces[2:len(hits) + 1]) AS next))
          WHERE {checks[kind.name]}""" + ("" if kind.base else f" AND greatest(0, least(100, {kind.score} + {hint(kind.hints)} - {hint(kind.doubts)})) >= {pii.LEAST_SCORE}"))
    union = "\n    UNION ALL ".join(parts)
    base = ", ".join(f"'{k}'" for k in pii.BASE_KINDS)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.BASE_KINDS)
    text = "kind || ':' || start::BIGINT || ':' || stop::BIGINT"
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS u FROM documents),
    spans AS ({union}),
    joined AS (SELECT u, {counts}, string_agg({text}, ',' ORDER BY start, ord) FILTER (kind IN ({base})) AS base, string_agg({text}, ',' ORDER BY start, ord) AS spans, string_agg(score::VARCHAR, ',' ORDER BY start, ord) AS scores FROM spans GROUP BY u)
    SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.BASE_KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
    FROM docs d LEFT JOIN joined USING (u)"""


SQL["op13_personal_data"] = _personal_sql()
