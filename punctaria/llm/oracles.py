"""SQL for the rows of those operators' queries that SQL can express."""

from __future__ import annotations

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = f"list_filter(string_split_regex({_LOW}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
_WORDS = f"list_filter(string_split_regex({_LOW}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

_HOST = r"translate(regexp_extract(coalesce({0}, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract(coalesce({0}, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2)"
_QUERY = r"regexp_extract({0}, '(?s)^[^?#]*\?([^#]*)', 1)"
_RULE_OF = """r AS (SELECT * FROM (VALUES ('block', 'net/'), ('allow', 'example.net/en/'), ('block', 'example.com/de/'), ('allow', 'org/fr/')) v(action, rule))"""
_FITS = "(host = split_part(rule, '/', 1) OR suffix(host, '.' || split_part(rule, '/', 1))) AND prefix(path, substr(rule, strpos(rule, '/')))"


def _key(url: str) -> str:
    host, path, query = _HOST.format(url), _PATH.format(url), _QUERY.format(url)
    return f"CASE WHEN {host} <> '' THEN {host} || CASE WHEN {path} = '' THEN '/' ELSE {path} END || CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END END"


OP5 = rf"""
WITH RECURSIVE u AS (SELECT page_id, url, {_HOST.format("url")} AS host, {_PATH.format("url")} AS path, {_key("url")} AS key FROM pages),
{_RULE_OF},
t AS (
  SELECT url, regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS link FROM pages, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*>', 0)) x(tag) WHERE regexp_matches(tag, '(?is)\brel\s*=\s*["'']?\s*canonical')
  UNION ALL
  SELECT url, regexp_extract(tag, '(?is)\bcontent\s*=\s*["''][^"''>]*?url\s*=\s*([^"''\s>]+)', 1) FROM pages, unnest(regexp_extract_all(html, '(?is)<meta\b[^>]*>', 0)) x(tag) WHERE regexp_matches(tag, '(?is)\bhttp-equiv\s*=\s*["'']?\s*refresh')
),
l AS (SELECT {_key("url")} AS src, CASE WHEN regexp_matches(link, '(?i)^[a-z][a-z0-9+.-]*://') THEN link WHEN prefix(link, '//') THEN 'http:' || link WHEN prefix(link, '/') THEN 'http://' || {_HOST.format("url")} || link ELSE 'http://' || {_HOST.format("url")} || regexp_replace({_PATH.format("url")}, '[^/]*$', '') || CASE WHEN {_PATH.format("url")} = '' THEN '/' ELSE '' END || link END AS target FROM t WHERE link <> ''),
e AS (SELECT DISTINCT src, {_key("target")} AS dst, {_HOST.format("target")} AS host, {_PATH.format("target")} AS path FROM l WHERE src IS NOT NULL AND {_key("target")} IS NOT NULL),
both_ways AS (SELECT src AS p, dst AS q FROM e UNION SELECT dst, src FROM e),
reach(key, seen) AS (SELECT p, p FROM both_ways UNION SELECT b.q, r.seen FROM reach r JOIN both_ways b ON b.p = r.key AND r.seen < b.q),
member AS (SELECT key, min(seen) AS component FROM reach GROUP BY key),
own AS (SELECT page_id, rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS k FROM u JOIN r ON {_FITS}),
outer_rule AS (SELECT dst, action, row_number() OVER (PARTITION BY dst, host, path ORDER BY length(rule) DESC) AS k FROM e JOIN r ON {_FITS}),
decided AS (SELECT key, action FROM u JOIN own USING (page_id) WHERE k = 1 AND key IS NOT NULL UNION ALL SELECT dst, action FROM outer_rule WHERE k = 1),
named AS (SELECT coalesce(component, key) AS component, action FROM decided LEFT JOIN member USING (key)),
blocked AS (SELECT component FROM named GROUP BY component HAVING bool_or(action = 'block') AND NOT bool_or(action = 'allow'))
SELECT u.page_id, u.host, u.path, rule, coalesce(action, CASE WHEN coalesce(component, key) IN (SELECT component FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict FROM u LEFT JOIN (SELECT * FROM own WHERE k = 1) b USING (page_id) LEFT JOIN member USING (key)
"""

OP8 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, k, k + 4), ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) t(k) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS p, b.doc_id AS q, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p, q FROM c JOIN n x ON x.doc_id = p JOIN n y ON y.doc_id = q WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.q, r.seen FROM reach r JOIN e ON e.p = r.doc_id AND r.seen < e.q),
m AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""

OP10 = f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_ITEM_WORDS} AS ws FROM benchmark),
v AS (SELECT DISTINCT item_id, list_slice(ws, k, k + 9) AS w FROM b, unnest(range(1, greatest(len(ws) - 8, 2))) t(k) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT len(w) AS n FROM v),
x AS (SELECT doc_id, k, n, list_slice(ws, k, k + n - 1) AS w FROM d, sizes, unnest(range(1, len(ws) - n + 2)) t(k)),
h AS (SELECT doc_id, k, n, item_id FROM x JOIN v USING (w)),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM h, unnest(range(k, k + n)) t(pos) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN p USING (doc_id) LEFT JOIN i USING (doc_id)
"""

_MINUS = "substr(word, 1, i - 1) || substr(word, i + 1)"

# The table of the checksum follows from its polynomial, 0xEDB88320.
OP12 = rf"""
WITH RECURSIVE t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c FROM t WHERE length(run) >= 6 GROUP BY 1, 2),
steps AS (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) x(i)),
sums AS (SELECT list(c ORDER BY i) AS c FROM steps),
b AS (SELECT run, r.c, lower(hex(encode(id || run))) AS x, sums.c AS sums FROM r, sums),
l AS (SELECT run, c, sums, list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: (strpos('0123456789abcdef', substr(x, i, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(x, i + 1, 1)) - 1)) AS bytes FROM b),
h AS (SELECT run, c, xor(list_reduce(bytes, lambda s, y: xor(sums[xor(s % 256, y) + 1], s // 256)), 4294967295) AS h FROM l),
s AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h),
w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM s WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
d AS (SELECT word, n, i, {_MINUS} AS part FROM w, unnest(range(1, length(word) + 1)) x(i)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM d a JOIN d b ON a.part = b.part AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.part = w.word
  UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.part = w.word
),
best AS (SELECT word, other, m, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS k FROM near),
f AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN other END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n FROM w LEFT JOIN best ON best.word = w.word AND k = 1),
chain(word, last, k) AS (SELECT word, word, 0 FROM f UNION ALL SELECT c.word, f.form, c.k + 1 FROM chain c JOIN f ON f.word = c.last WHERE f.form IS NOT NULL)
SELECT word, form, (SELECT arg_max(c.last, c.k) FROM chain c WHERE c.word = f.word) AS root, n, n_near, form_n FROM f
"""
