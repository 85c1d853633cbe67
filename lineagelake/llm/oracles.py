"""DuckDB SQL that gives the same rows as those of the queries that SQL can express."""

from __future__ import annotations

from .secret_scan import BASE, KINDS, MAX_OWNERS, MAX_REPOS, SHAPES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"'[^\x20\x09-\x0D]+'"


def secrets() -> str:
    parts = []
    for kind in KINDS:
        pattern, group, least = (BASE | SHAPES)[kind]
        p = "'" + pattern.replace("}+", "}").replace("'", "''") + "'"
        parts.append(
            f"""SELECT doc_id, owner, {KINDS.index(kind)} AS rank, '{kind}' AS kind, {str(kind in BASE).lower()} AS base, v[i] AS value,
              list_sum(list_transform(g[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[:i - 1], lambda x: length(x))), 0) AS s, length(w[i]) AS n
            FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, source AS owner, regexp_extract_all(t, {p}, 0) AS w, regexp_extract_all(t, {p}, {group}) AS v, string_split_regex(t, {p}) AS g FROM d) a) b
            WHERE length(v[i]) >= {least}"""
        )
    listed = "string_agg({0}concat(kind, ':', s::bigint, ':', (s + n)::bigint), ',' ORDER BY s, rank) FILTER ({1})"
    return f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents), found AS ({' UNION ALL '.join(parts)}),
      own AS (SELECT value, owners, repos, owners <= {MAX_OWNERS} AND repos <= {MAX_REPOS} * greatest(owners, 1) AS owned FROM (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT doc_id) AS repos FROM found GROUP BY value) o),
      j AS (SELECT * FROM found JOIN own USING (value)),
      per AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        {listed.format('', 'base')} AS b, {listed.format('', 'base OR owned')} AS spans, count(*) FILTER (NOT owned) AS n_copied, count(*) FILTER (owned) AS n_owned, max(owners) AS most_owners, max(repos) AS most_repos FROM j GROUP BY doc_id)
      SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans,
        coalesce(n_copied, 0) AS n_copied, coalesce(n_owned, 0) AS n_owned, coalesce(most_owners, 0) AS most_owners, coalesce(most_repos, 0) AS most_repos FROM documents LEFT JOIN per USING (doc_id)"""


def warc() -> str:
    letters = ", ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, {5 * k + 1}, 5))::int >> {shift}) & 31) + 1, 1)" for k in range(8) for shift in (15, 10, 5, 0))
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages), m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p)
      SELECT page_id, payload_bytes::bigint AS payload_bytes, concat({letters}) AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM m"""


QUALITY = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORD}) AS ws FROM documents),
  win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) > 8) a),
  again AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
  rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM again) b GROUP BY doc_id),
  m AS (SELECT d.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::bigint AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
      list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls, coalesce(rep.n, 0) AS n_repeat_words,
      length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS upper,
      len(list_distinct(ws)) AS n_distinct, len(list_filter(ws, lambda w: regexp_matches(w, '\p{{L}}'))) AS n_letter_words, coalesce(list_max(map_values(list_aggregate(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]), 'histogram'))), 0) AS n_top_pair FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id),
  f AS (SELECT *, len(ls) - len(list_distinct(ls)) AS n_dup_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines::bigint AS n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND word_chars BETWEEN 2 * n_words AND 20 * n_words AND n_symbols <= 0.5 * n_words AND n_dup_lines <= 0.5 * len(ls) AND letters >= 0.5 * word_chars AND upper <= 0.7 * letters
      AND n_distinct >= 0.02 * n_words AND n_letter_words >= 0.5 * n_words AND n_top_pair <= 0.2 * n_words
      AND len(list_filter(ls, lambda l: regexp_matches(l, '^[\x20\t]*[-*•]'))) <= 0.9 * len(ls) AND len(list_filter(ls, lambda l: regexp_matches(l, '(\.\.\.|…)[\x20\t\r]*$'))) <= 0.5 * len(ls) AS kept FROM f"""

CHAT = r"""WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
  t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c)
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, sha256(text))) AS turns_sha256,
    sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::bigint AS loss_chars, sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, sha256(text))) AS loss_sha256,
    sum(length(regexp_replace(role, '([\\\[\]<])', '\1\\', 'g')) + length(regexp_replace(text, '([\\\[\]<])', '\1\\', 'g')) + 11)::bigint AS formatted_chars FROM t GROUP BY conv_id"""

_SHINGLES = f"list_distinct(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' ')))"
DECONTAMINATION = f"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORD}) AS ws FROM documents),
  i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORD}) AS ws FROM benchmark),
  ds AS (SELECT doc_id, unnest({_SHINGLES}) AS s FROM d WHERE len(ws) > 0), q AS (SELECT item_id, {_SHINGLES} AS ss FROM i WHERE len(ws) > 0), qs AS (SELECT item_id, len(ss) AS n_item, unnest(ss) AS s FROM q)
  SELECT doc_id, item_id, count(*) AS n_shared, n_item, count(*) / n_item::double AS containment FROM ds JOIN qs USING (s) GROUP BY doc_id, item_id, n_item HAVING count(*) >= ceil(0.8 * n_item - 1e-9)"""

_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
LEXICAL = f"""WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents), c AS (SELECT sum(len(ts))::bigint AS l, count(*) AS n FROM d WHERE len(ts) > 0),
  tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d) t GROUP BY ALL),
  w AS (SELECT term, floor(1000 * ln((2 * c.n + 2)::double / (2 * df + 1)))::bigint AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term) f, c),
  i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
  s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * tf.n * c.n) // c.l))))::bigint AS score FROM i JOIN tf USING (term) JOIN w USING (term), c GROUP BY ALL)
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::int AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50"""

_FOURS = _SHINGLES.replace("- 4,", "- 3,").replace("i + 4]", "i + 3]")
NEAR_COPIES = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORD}) AS ws FROM documents),
  sets AS (SELECT doc_id, CASE WHEN len(ws) > 0 THEN list_sort({_FOURS}) ELSE [] END AS ss FROM d), c AS (SELECT min(doc_id) AS cls, ss FROM sets WHERE len(ss) > 0 GROUP BY ss),
  s AS (SELECT cls, len(ss) AS n, unnest(ss) AS s FROM c),
  l AS (SELECT a.cls AS a, b.cls AS b FROM s a JOIN s b ON a.s = b.s AND a.cls < b.cls AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.cls, b.cls, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
  e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r(a, b) AS (SELECT cls, cls FROM c UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), low AS (SELECT a AS cls, min(b) AS component_id FROM r GROUP BY a)
  SELECT doc_id, len(sets.ss)::bigint AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept FROM sets LEFT JOIN c ON sets.ss = c.ss LEFT JOIN low USING (cls)"""
