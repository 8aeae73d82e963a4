"""DuckDB SQL for the queries of this subpackage that SQL can express."""

OP8 = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, coalesce(html, '') AS html,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
         lower(regexp_extract(split_part(coalesce(url, ''), '#', 1), '(?s)^(.*?://[^/?#]*)', 1)) ||
           substr(split_part(coalesce(url, ''), '#', 1), length(regexp_extract(split_part(coalesce(url, ''), '#', 1), '(?s)^(.*?://[^/?#]*)', 1)) + 1) AS key
  FROM pages),
links AS (
  SELECT key AS a, replace(unnest([regexp_extract(regexp_extract(html, '(?is)(<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>)', 1), '(?is)\bhref\s*=\s*["'']?([^\s"''>]+)', 1),
         regexp_extract(regexp_extract(html, '(?is)(<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>)', 1), '(?is)\burl\s*=\s*["'']?([^\s"''>]+)', 1)]), '&amp;', '&') AS b
  FROM p WHERE url LIKE '%://%'),
full_ AS (SELECT a, CASE WHEN b LIKE '%://%' THEN b WHEN b LIKE '//%' THEN split_part(a, '://', 1) || ':' || b
         WHEN b LIKE '/%' THEN regexp_extract(a, '(?s)^(.*?://[^/?#]*)', 1) || b
         ELSE coalesce(nullif(regexp_extract(a, '(?s)^(.*?://[^/?#]*/(?:[^?#]*/)?)', 1), ''), regexp_extract(a, '(?s)^(.*?://[^/?#]*)', 1) || '/') || b END AS b FROM links WHERE b <> ''),
e AS (SELECT a, lower(regexp_extract(split_part(b, '#', 1), '(?s)^(.*?://[^/?#]*)', 1)) || substr(split_part(b, '#', 1), length(regexp_extract(split_part(b, '#', 1), '(?s)^(.*?://[^/?#]*)', 1)) + 1) AS b FROM full_),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, x.b FROM reach r JOIN both_ways x ON r.b = x.a),
named AS (SELECT DISTINCT b, translate(regexp_extract(b, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(b, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM reach),
rules(action, rule, rhost, rpath) AS (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
         ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
hits AS (SELECT h.host, h.path, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.action, length(r.rule)) AS action
  FROM (SELECT host, path FROM p UNION SELECT host, path FROM named) h
  JOIN rules r ON (h.host = r.rhost OR ends_with(h.host, '.' || r.rhost)) AND starts_with(h.path, r.rpath) GROUP BY h.host, h.path),
alias AS (SELECT r.a, bool_or(h.action = 'allow') AS allowed, bool_or(h.action = 'block') AS blocked
  FROM reach r JOIN named n ON n.b = r.b JOIN hits h ON h.host = n.host AND h.path = n.path GROUP BY r.a)
SELECT p.page_id, p.host, p.path, h.rule,
       coalesce(h.action, CASE WHEN s.blocked AND NOT s.allowed THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN hits h ON h.host = p.host AND h.path = p.path LEFT JOIN alias s ON s.a = p.key
"""

OP7 = r'''
WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, stratum, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, sum(n) AS n FROM (SELECT doc_id, least(8, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), 8)) AS n FROM dup) GROUP BY doc_id),
f AS (SELECT w.doc_id, stratum, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
             length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS upper_n, length(regexp_replace(text, '[^!]', '', 'g')) AS bang_n, md5(text) AS copy
      FROM w LEFT JOIN cov USING (doc_id)),
p AS (SELECT *, least(100 * n_symbols // greatest(word_chars, 1), 100) AS symbol_pct, least(100 * n_dup_lines // greatest(n_lines, 1), 100) AS dup_line_pct,
             least(100 * n_repeat_words // greatest(n_words, 1), 100) AS repeat_pct, least(100 * upper_n // greatest(word_chars, 1), 100) AS upper_pct,
             least(100 * bang_n // greatest(n_words, 1), 100) AS bang_pct FROM f),
lab AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
s AS (SELECT stratum, copy, max(quality) = 1 AS good, substr(copy, 1, 1) < '8' AS chooses, any_value(symbol_pct) AS symbol_pct, any_value(dup_line_pct) AS dup_line_pct,
             any_value(repeat_pct) AS repeat_pct, any_value(upper_pct) AS upper_pct, any_value(bang_pct) AS bang_pct FROM p JOIN lab USING (doc_id) GROUP BY stratum, copy),
u AS (UNPIVOT s ON symbol_pct, dup_line_pct, repeat_pct, upper_pct, bang_pct INTO NAME rule VALUE m),
v AS (SELECT stratum, rule, m, count(*) FILTER (good) AS good, count(*) FILTER (NOT good) AS bad FROM u WHERE chooses GROUP BY stratum, rule, m),
t AS (SELECT stratum, rule, m, sum(good) OVER (PARTITION BY stratum, rule) AS n, sum(good) OVER (PARTITION BY stratum, rule ORDER BY m DESC) AS k,
             sum(bad) OVER (PARTITION BY stratum, rule ORDER BY m DESC) AS g FROM v),
best AS (SELECT stratum, rule, m, g - k AS gain FROM t WHERE g > k AND k <= n * 0.01 QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY g - k DESC, m DESC) = 1),
chosen AS (SELECT stratum, rule, m, row_number() OVER (PARTITION BY stratum ORDER BY gain DESC, rule) AS place FROM best),
first_ AS (SELECT u.stratum, u.copy, min(CASE WHEN u.m >= c.m THEN c.place END) AS place FROM u JOIN chosen c USING (stratum, rule) WHERE good AND NOT chooses GROUP BY u.stratum, u.copy),
lost AS (SELECT c.stratum, c.rule, c.m, count(*) AS n, count(*) FILTER (f.place <= c.place) AS k FROM chosen c JOIN first_ f USING (stratum) GROUP BY c.stratum, c.rule, c.m),
cut AS (SELECT stratum, rule, m FROM lost WHERE k <= n * 0.01
      AND list_sum(list_transform(range(0, CAST(k AS BIGINT) + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.01) + (n - i) * ln(0.99))))
          <= 0.05 / (SELECT count(DISTINCT stratum) FROM s)),
hit AS (SELECT DISTINCT doc_id FROM (UNPIVOT (SELECT doc_id, stratum, symbol_pct, dup_line_pct, repeat_pct, upper_pct, bang_pct FROM p) ON symbol_pct, dup_line_pct, repeat_pct, upper_pct, bang_pct INTO NAME rule VALUE m) x
        JOIN cut ON cut.stratum = x.stratum AND cut.rule = x.rule AND x.m >= cut.m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       (NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND hit.doc_id IS NULL) AS kept
FROM p LEFT JOIN hit USING (doc_id)
'''

OP5 = '''
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
blk AS (SELECT doc_id, b, substr(h, 2 * b + 1, 1122) AS t FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49, 512)) AS b FROM d)),
w AS (SELECT doc_id, b + j AS i, substr(t, 2 * j + 1, 100) AS s FROM (SELECT doc_id, b, t, unnest(range(0, len(t) // 2 - 49)) AS j FROM blk)),
f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT w.doc_id, w.i FROM w JOIN f ON f.s = w.s AND f.m < w.doc_id),
g AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM hit),
r AS (SELECT doc_id, i, p, sum(CASE WHEN p IS NULL OR i - p > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM r GROUP BY doc_id, run),
cut AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
kept AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS tail, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS k FROM cut JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(k, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
'''

#: The given pages have one plain article each, of headings, paragraphs, line breaks and bold text, cut short at most.
OP3 = r"""
WITH b AS (
  SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1), '</?(?:p|h1|br)>') AS parts FROM pages),
t AS (
  SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(replace(
    regexp_replace(x, '</?b>', '', 'g'), '&quot;', '"'), '&#39;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&amp', '&'), '[ \t\n\x0b\f\r]+', ' ', 'g'))) AS said FROM b)
SELECT page_id, url, array_to_string(list_filter(said, lambda x: x <> ''), ' ') AS text, CAST(length(array_to_string(list_filter(said, lambda x: x <> ''), ' ')) AS BIGINT) AS n_chars FROM t
"""

#: CRC-32 of the decimal conv_id, bit by bit.
OP12 = '''
WITH t AS (
  SELECT conv_id, hex(encode(coalesce(role, ''))) || ':' || coalesce(text, '') AS said, length(coalesce(text, '')) AS n,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(hex(encode(coalesce(role, ''))) || ':' || coalesce(text, ''))) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
         lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, 0 AS own, t.k, t.said, t.n FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.k <= c.h
  UNION ALL SELECT c.conv_id, 1, t.k, t.said, t.n FROM c JOIN t ON t.conv_id = c.conv_id AND t.k > c.h),
p AS (
  SELECT conv_id, row_number() OVER w AS depth, n, string_agg(sha256(said), '') OVER w AS node FROM r
  WINDOW w AS (PARTITION BY conv_id ORDER BY own, k ROWS UNBOUNDED PRECEDING)),
m AS (SELECT conv_id, 0 AS depth, 0 AS n, '' AS node FROM c UNION ALL SELECT conv_id, depth, n, node FROM p),
g AS (SELECT node, any_value(depth) AS depth, any_value(n) AS n, min(conv_id) AS conv_id, count(*) AS n_convs FROM m GROUP BY node),
kids AS (SELECT left(node, len(node) - 64) AS node, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY ALL),
f AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN kids USING (node)),
under AS (
  SELECT a.node, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.n) AS saved_tokens
  FROM f a JOIN f b ON starts_with(b.node, a.node) GROUP BY a.node),
ends AS (SELECT node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(node, depth) AS node FROM m GROUP BY conv_id) GROUP BY node)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM f LEFT JOIN f up ON f.depth > 0 AND up.node = left(f.node, len(f.node) - 64) JOIN under ON under.node = f.node LEFT JOIN ends ON ends.node = f.node
'''

OP11 = r'''
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
total AS (SELECT lang, CAST(sum(len(ws)) AS HUGEINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 6) AS r(k) WHERE len(ws) >= k),
f AS (SELECT lang, array_to_string(ws[i:i + k - 1], ' ') AS phrase, any_value(k) AS k, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2),
cut AS (SELECT c.*, unnest(range(1, k)) AS first FROM c),
s AS (SELECT cut.lang, cut.phrase, a, l.f AS l, r.f AS r, n, 1000 * a * n // (l.f * r.f) AS score, first
  FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = array_to_string(ws[:first], ' ') JOIN f r ON r.lang = cut.lang AND r.phrase = array_to_string(ws[first + 1:], ' ') JOIN total ON total.lang = cut.lang
  QUALIFY row_number() OVER (PARTITION BY cut.lang, cut.phrase ORDER BY score, first) = 1),
inner_ AS (SELECT lang, a, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, a, ws, m, unnest(range(1, k - m + 2)) AS i FROM c, range(2, 5) AS r(m) WHERE m < k)),
most AS (SELECT lang, phrase, max(a) AS most FROM inner_ GROUP BY lang, phrase)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank, s.phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM s LEFT JOIN most ON most.lang = s.lang AND most.phrase = s.phrase WHERE most IS NULL OR 100 * most < 100 * a QUALIFY rank <= 2000
'''

SQL = {
    "op3_html": OP3,
    "op5_suffix_dedup": OP5,
    "op7_rules": OP7,
    "op8_url_filter": OP8,
    "op11_collocations": OP11,
    "op12_prefix_trie": OP12,
}
