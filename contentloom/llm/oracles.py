"""SQL twins, for DuckDB, of the queries that SQL can express."""

FOLD = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
PLAIN = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP5 = f"""
WITH d AS (SELECT doc_id, {FOLD} AS w FROM documents),
b AS (SELECT item_id, {FOLD} AS w FROM benchmark),
spans AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM b WHERE len(w) > 0),
windows AS (SELECT item_id, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS k FROM spans),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
tens AS (SELECT doc_id, p, 10 AS n, string_agg(x, ' ') OVER o AS k, count(*) OVER o AS c FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
few AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d CROSS JOIN (SELECT DISTINCT n FROM windows WHERE n < 10) WHERE len(w) >= n),
runs AS (SELECT doc_id, p, n, k FROM tens WHERE c = 10 UNION ALL SELECT doc_id, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') FROM few),
hits AS (SELECT r.doc_id, r.p, r.n, i.item_id FROM runs r JOIN windows i ON i.n = r.n AND i.k = r.k),
places AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)"""

OP9 = f"""
WITH d AS (SELECT doc_id, {PLAIN} AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
runs AS (SELECT doc_id, p, string_agg(x, ' ') OVER o AS k, count(*) OVER o AS c FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
windows AS (SELECT doc_id, p, md5(k) AS k FROM runs WHERE c = 13),
earliest AS (SELECT k, min(doc_id) AS least FROM windows GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM windows JOIN earliest USING (k) WHERE least < doc_id),
kept AS (SELECT w.doc_id, count(g.p) AS n_removed, string_agg(w.x, ' ' ORDER BY w.p) FILTER (g.p IS NULL) AS t FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.p = w.p GROUP BY w.doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""


OP11 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT page_id, html, CASE WHEN strlen(html) >= 100 THEN min(page_id) OVER (PARTITION BY html) END AS first FROM p)
SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest, CASE WHEN coalesce(page_id > first, first IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN coalesce(page_id > first, first IS NOT NULL) THEN first END AS refers_to FROM f"""


OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT id, lang, source, unnest(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS l FROM words GROUP BY ALL HAVING count(DISTINCT id) >= 3),
counted AS (SELECT w.lang, w.source, w.term, count(*) AS g FROM words w JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, sum(l) AS nl, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT g.lang, g.source, coalesce(c.n, 0) AS n, coalesce(s.nl, 0) AS nl, coalesce(s.v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN (SELECT lang, source, sum(g) AS n FROM counted GROUP BY ALL) c USING (lang, source) LEFT JOIN sizes s USING (lang)),
grid AS (SELECT r.lang, r.source, k.term, coalesce(c.g, 0) AS g, 1 + (1000000000::HUGEINT * (coalesce(c.g, 0) + 1)) // (r.n + r.v) AS p, 1 + (1000000000::HUGEINT * (k.l + 1)) // (r.nl + r.v) AS q
  FROM groups r JOIN kept k USING (lang) LEFT JOIN counted c ON c.lang = r.lang AND c.source = r.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(p.value, 0) AS BIGINT) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
top AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM grid WHERE g > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM every UNION ALL SELECT * FROM top)) WHERE part = 'pair' OR rank <= 200"""


OP13 = r"""
WITH bits AS (SELECT i, list_reduce(list_concat([i], range(8)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS v FROM range(256) r(i)),
tab AS (SELECT list(v ORDER BY i) AS tab FROM bits),
own AS (SELECT conv_id, list({'role': coalesce(role, ''), 'said': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS l FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (SELECT conv_id, l, conv_id - conv_id % 5 AS base,
  xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 9 AS h FROM own, tab),
rebuilt AS (SELECT c.conv_id, list_concat(coalesce(list_slice(b.l, 1, c.h), []), list_slice(c.l, c.h + 1, len(c.l))) AS s FROM heads c LEFT JOIN own b ON b.conv_id = c.base),
steps AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS depth FROM rebuilt),
paths AS (SELECT conv_id, depth, len(s) AS whole, to_json(list_slice(s, 1, depth)) AS k, to_json(list_slice(s, 1, depth - 1)) AS up, CASE WHEN depth > 0 THEN strlen(s[depth].said) ELSE 0 END AS bytes FROM steps),
nodes AS (SELECT depth, k, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (whole = depth), '') AS ends FROM paths GROUP BY depth, k),
kids AS (SELECT depth - 1 AS depth, up AS k, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
below AS (SELECT DISTINCT a.depth, a.k, b.depth AS d, b.k AS kk FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
sums AS (SELECT b.depth, b.k, count(*) FILTER (c.n_children IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved FROM below b JOIN nodes n ON n.depth = b.d AND n.k = b.kk LEFT JOIN kids c ON c.depth = b.d AND c.k = b.kk GROUP BY b.depth, b.k)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN sums s ON s.depth = n.depth AND s.k = n.k LEFT JOIN kids c ON c.depth = n.depth AND c.k = n.k LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.k = n.up"""
