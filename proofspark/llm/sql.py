"""DuckDB SQL of the operators that SQL can express."""

#: Words, as ``[^\x20\x09-\x0D]+``.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

QUALITY = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS words, row_number() OVER () AS k FROM documents
), w AS (
  SELECT k, unnest(words) AS word, unnest(range(len(words))) AS pos FROM d
), five AS (
  SELECT k, pos,
    word || ' ' || lead(word, 1) OVER p || ' ' || lead(word, 2) OVER p || ' ' || lead(word, 3) OVER p
      || ' ' || lead(word, 4) OVER p AS run
  FROM w WINDOW p AS (PARTITION BY k ORDER BY pos)
), twice AS (
  SELECT k, pos FROM (SELECT k, pos, count(*) OVER (PARTITION BY k, run) AS n FROM five WHERE run IS NOT NULL)
  WHERE n > 1
), covered AS (
  SELECT k, count(DISTINCT pos) AS n FROM (SELECT k, pos + unnest([0, 1, 2, 3, 4]) AS pos FROM twice) GROUP BY k
), l AS (
  SELECT k, unnest(string_split(text, chr(10))) AS line FROM d
), lines AS (
  SELECT k, count(*) AS n, count(*) - count(DISTINCT line) AS dup
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k
), m AS (
  SELECT d.doc_id, len(words) AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(lines.dup, 0) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words,
    coalesce(lines.n, 0) AS n_lines,
    length(text) - length(replace(text, '!', '')) AS bangs,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals,
    length(regexp_replace(text, '[^a-z]', '', 'g')) AS smalls
  FROM d LEFT JOIN covered USING (k) LEFT JOIN lines USING (k)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * n_symbols > n_words
    OR 10 * n_dup_lines > 3 * n_lines OR 10 * bangs > 3 * n_words OR capitals > smalls) AS kept
FROM b
"""

FILL_IN_MIDDLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents
), k AS (
  SELECT doc_id, text, units, len(units) AS n,
    ('0x' || substr(h, 1, 8))::BIGINT % (len(units) + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (len(units) + 1) AS c2,
    ('0x' || substr(h, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS h4
  FROM d
), f AS (
  SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 50 THEN 'plain'
      WHEN h4 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM k
), p AS (
  SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS prefix,
    array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix
  FROM f
)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""

PREFIX_TRIE = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS code, turn
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, code, strlen(text) AS bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, code) AS p FROM t
), c AS (
  SELECT conv_id AS c, conv_id - conv_id % 5 AS lender, count(*) AS n,
    xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
      lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) % 9 AS h
  FROM t GROUP BY conv_id
), turns AS (
  SELECT c.c, own.p AS d, code, bytes FROM c JOIN own ON own.conv_id = c.lender AND own.p <= c.h
  UNION ALL
  SELECT c.c, own.p - c.h + least(c.h, coalesce(l.n, 0)), code, bytes
  FROM c JOIN own ON own.conv_id = c.c AND own.p > c.h LEFT JOIN c l ON l.c = c.lender
), coded AS (
  SELECT c, d, bytes, string_agg(code, '') OVER (PARTITION BY c ORDER BY d) AS code,
    d = max(d) OVER (PARTITION BY c) AS last
  FROM turns
), paths AS (
  SELECT c, d, bytes, code, last, coalesce(lag(code) OVER (PARTITION BY c ORDER BY d), '') AS parent FROM coded
  UNION ALL
  SELECT c, 0, 0, '', NOT EXISTS (SELECT 1 FROM turns WHERE turns.c = c.c), NULL FROM c
), nodes AS (
  SELECT d, code, any_value(parent) AS parent, min(c) AS owner, count(*) AS n, any_value(bytes) AS bytes,
    coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '') AS ends
  FROM paths GROUP BY d, code
), children AS (
  SELECT d - 1 AS d, parent AS code, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL
), whole AS (
  SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children USING (d, code)
), sums AS (
  SELECT p.d, p.code, sum((u.n_children = 0)::BIGINT) AS n_leaves, sum((u.n - 1) * u.bytes) AS saved_tokens
  FROM whole u JOIN paths p ON p.c = u.owner AND p.d <= u.d GROUP BY p.d, p.code
)
SELECT w.owner AS conv_id, w.d AS depth, up.owner AS parent_conv_id, w.n AS n_convs, w.n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(w.ends) AS ends_sha256
FROM whole w JOIN sums s USING (d, code) LEFT JOIN nodes up ON up.d = w.d - 1 AND up.code = w.parent
"""

#: Redirects and canonical links are read where they give a whole address or one from the site's root.
URL_FILTERS = r"""
WITH RECURSIVE rules AS (
  SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
    ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) AS t(kind, rule_host, rule_path)
), tags AS (
  SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM pages
  WHERE contains(url, '://') AND regexp_matches(html, '(?i)canonical|refresh')
), links AS (
  SELECT url, trim(replace(target, '&amp;', '&')) AS target FROM (
    SELECT url, regexp_extract(tag, '(?is)href\s*=\s*["'']?([^"''>]*)', 1) AS target FROM tags
    WHERE regexp_matches(tag, '(?is)^<link.*rel\s*=\s*["'']?canonical')
    UNION ALL
    SELECT url, regexp_extract(tag, '(?is)content\s*=\s*["'']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*([^"''>]*)', 1) FROM tags
    WHERE regexp_matches(tag, '(?is)^<meta.*http-equiv\s*=\s*["'']?refresh'))
), linked AS (
  SELECT url AS a, CASE WHEN starts_with(target, '/') THEN regexp_extract(url, '^[^/]*//[^/?#]*') || target ELSE target END AS b
  FROM links WHERE target <> ''
), addresses AS (
  SELECT url FROM pages WHERE contains(url, '://') UNION SELECT b FROM linked
), parts AS (
  SELECT url, substr(url, position('://' IN url) + 3) AS rest,
    translate(regexp_extract(substr(url, position('://' IN url) + 3), '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
  FROM addresses
), plain AS (
  SELECT url, 'https://'
    || regexp_replace(regexp_replace(regexp_replace(host, ':(80|443)$', ''), '[.]$', ''), '^(?:www|m)[.]([^.]+[.])', '\1')
    || regexp_replace(regexp_replace(regexp_replace(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1),
      '/index[.](?:html?|php)$', '/'), '[.]html?$', ''), '/+$', '')
    || coalesce('?' || nullif(array_to_string(list_filter(string_split(regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(?:utm_[a-z]+|ref|fbclid|gclid)(?:=|$)')), '&'), ''), '') AS address
  FROM parts WHERE host <> ''
), nodes AS (
  SELECT url FROM addresses UNION SELECT address FROM plain
), split AS (
  SELECT url, translate(regexp_extract(substr(url, position('://' IN url) + 3), '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(url, position('://' IN url) + 3), '^[^/?#]*([^?#]*)', 1) AS path
  FROM nodes
), judged AS (
  SELECT url, host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    arg_max(kind, length(rule_host || rule_path)) AS kind
  FROM split LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY url, host, path
), edges AS (
  SELECT e.a, e.b FROM (SELECT a, b FROM linked UNION SELECT url, address FROM plain) e
  JOIN judged ja ON ja.url = e.a JOIN judged jb ON jb.url = e.b
  WHERE e.a <> e.b AND ja.kind IS DISTINCT FROM 'allow' AND jb.kind IS DISTINCT FROM 'allow'
), both_ways AS (
  SELECT a, b FROM edges UNION SELECT b, a FROM edges
), reached AS (
  SELECT url FROM judged WHERE kind = 'block'
  UNION
  SELECT b FROM reached JOIN both_ways ON a = url
)
SELECT page_id, coalesce(j.host, '') AS host, coalesce(j.path, '') AS path, j.rule,
  CASE WHEN j.kind IS NOT NULL THEN j.kind WHEN r.url IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN j.kind IS NOT NULL THEN 'rule' WHEN r.url IS NOT NULL THEN 'alias' ELSE 'default' END AS by
FROM pages p LEFT JOIN judged j ON j.url = p.url LEFT JOIN reached r ON r.url = p.url
"""
