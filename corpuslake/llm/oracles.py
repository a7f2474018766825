"""DuckDB SQL for the queries that SQL can say, by plain means."""

OP2 = r"""
WITH iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + 12) AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM iw WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
sizes AS (SELECT DISTINCT len(g) AS n FROM win),
pos AS (
  SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, n, i, item_id FROM pos JOIN win USING (g)),
hit AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id),
ph AS (SELECT g, row_number() OVER () AS id FROM (SELECT DISTINCT g FROM win)),
terms AS (SELECT id, len(g) AS size, unnest(g) AS t, unnest(range(len(g))) AS o FROM ph),
tok AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS p FROM dw),
freq AS (SELECT t, count(*) AS n FROM tok SEMI JOIN terms USING (t) GROUP BY t),
ranked AS (
  SELECT id, t, o, least(size, 3) AS k, row_number() OVER (PARTITION BY id ORDER BY n, t, o) AS r, count(*) OVER (PARTITION BY id) AS known
  FROM terms JOIN freq USING (t)),
shifted AS (SELECT doc_id, id, r, k, p - o AS s FROM tok JOIN (SELECT * FROM ranked WHERE known >= k AND r <= k) USING (t)),
near AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_near FROM (
    SELECT a.doc_id, a.id FROM shifted AS a JOIN shifted AS b ON a.doc_id = b.doc_id AND a.id = b.id AND b.s BETWEEN a.s AND a.s + 3
    GROUP BY a.doc_id, a.id, a.s, a.k HAVING count(DISTINCT b.r) = a.k)
  JOIN ph USING (id) JOIN win USING (g) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near_items
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)
"""

OP3 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (
  SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
r AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 5)) AS k FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1)
  GROUP BY doc_id),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(list_aggregate(list_concat([''], w), 'string_agg', '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals
  FROM d LEFT JOIN r USING (doc_id)),
b AS (
  SELECT *, CAST(
    CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 4 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words) THEN 16 ELSE 0 END
    + CASE WHEN 3 * n_capitals > word_chars THEN 32 ELSE 0 END AS BIGINT) AS failed_rules
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_rules & 3) <> 0 AS base_failed, failed_rules = 0 AS kept, failed_rules,
  CASE failed_rules WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_words' WHEN 4 THEN 'symbols' WHEN 8 THEN 'duplicate_lines'
    WHEN 16 THEN 'short_or_long_words' WHEN 32 THEN 'shouting' END AS only_rule
FROM b
"""

OP9 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (
  SELECT doc_id, i, list_aggregate(list_slice(w, i, i + 19), 'string_agg', ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM again),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM d),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY k) AS t FROM word ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _matches(kind: str, rank: int, pattern: str) -> str:
    return f"SELECT doc_id, source, '{kind}' AS kind, {rank} AS rank, regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS g FROM d"


OP10 = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
m AS (
  {_matches("assign", 0, _ASSIGN)} UNION ALL {_matches("access", 1, "AKIA[A-Z0-9]+")}
  UNION ALL {_matches("hex", 2, "[0-9a-f]{16,}")} UNION ALL {_matches("token", 3, "[A-Za-z0-9+/_-]{20,}")}),
e AS (SELECT doc_id, source, kind, rank, i, m[i] AS m, length(g[i]) AS gap, length(m[i]) AS n FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m)),
s AS (SELECT *, CAST(sum(gap + n) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS e, CASE kind WHEN 'assign' THEN regexp_extract(m, '{_ASSIGN}', 2) ELSE m END AS v FROM e),
f AS (
  SELECT doc_id, source, kind, rank, e - n AS b, e, v FROM s
  WHERE CASE kind WHEN 'assign' THEN length(v) >= 12 WHEN 'access' THEN n >= 18 WHEN 'hex' THEN n >= 16
    ELSE regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') END),
c AS (
  SELECT * FROM f WHERE kind <> 'token' OR NOT EXISTS (SELECT 1 FROM f AS o WHERE o.doc_id = f.doc_id AND o.kind <> 'token' AND o.b < f.e AND f.b < o.e)),
o AS (SELECT v, count(DISTINCT source) <= 2 AS live FROM c GROUP BY v),
j AS (SELECT c.*, live, concat(kind, ':', b, ':', e) AS x FROM c JOIN o USING (v)),
a AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    coalesce(string_agg(x, ',' ORDER BY b, rank) FILTER (kind <> 'token'), '') AS base, coalesce(string_agg(x, ',' ORDER BY b, rank) FILTER (kind <> 'token' OR live), '') AS spans,
    count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied
  FROM j GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN a USING (doc_id)
"""

#: FP-growth by brute force: every combination of a labelled page's tokens is counted.
OP5 = r"""
WITH u AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(coalesce(url, ''), '\?([^#]*)', 1) AS q FROM pages),
t AS (
  SELECT *, list_distinct(list_concat(
    list_transform(list_reverse(string_split(host, '.')), lambda x, i: concat('h', i - 1, '=', x)),
    list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x, i: concat('p', i - 1, '=', x)),
    list_transform(list_filter(list_transform(regexp_split_to_array(q, '[&;]'), lambda x: regexp_extract(x, '^([^=]*)', 1)), lambda x: x <> ''), lambda x: concat('q=', x)))) AS tokens
  FROM u),
l AS (SELECT doc_id, bool_or(coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0) AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
s AS (SELECT tokens, bad FROM t JOIN l ON TRY_CAST(nullif(regexp_extract(path, '([0-9]+)(?:\.[A-Za-z0-9]+)?/?$', 1), '') AS BIGINT) = doc_id),
n AS (SELECT count(*) AS n, count(*) FILTER (bad) AS b FROM s),
m AS (SELECT tokens, bad, unnest(range(1, CAST(power(2, len(tokens)) AS BIGINT))) AS m FROM s),
c AS (SELECT list_sort(list_filter(tokens, lambda x, i: (m >> (i - 1)) % 2 = 1)) AS a, bad FROM m),
r AS (SELECT a FROM c GROUP BY a HAVING count(*) FILTER (bad) >= (SELECT ceil(greatest(20, 1e-4 * n)) FROM n) AND count(*) FILTER (bad) >= 0.75 * count(*) AND (SELECT b FROM n) >= 20),
g AS (
  SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM t)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN EXISTS (SELECT 1 FROM r WHERE list_has_all(g.tokens, r.a)) THEN 'block' ELSE 'allow' END AS verdict
FROM g
"""

SQL = {"op2_contamination": OP2, "op3_quality": OP3, "op5_url_rules": OP5, "op9_substrings": OP9, "op10_secrets": OP10}
