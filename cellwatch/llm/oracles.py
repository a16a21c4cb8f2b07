"""SQL for the operators that it can express; it works by plain joins and is meant for small tables."""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Bits of a SHA-1, five at a time, in the base32 alphabet.
_BASE32 = (
    "array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(substr(b, i * 5 + 1, 1) AS INTEGER) * 16 + CAST(substr(b, i * 5 + 2, 1) AS INTEGER) * 8 + CAST(substr(b, i * 5 + 3, 1) AS INTEGER) * 4"
    " + CAST(substr(b, i * 5 + 4, 1) AS INTEGER) * 2 + CAST(substr(b, i * 5 + 5, 1) AS INTEGER), 1) FOR i IN range(0, 32)], '')"
)
WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, CAST(CAST(unhex(sha1(html)) AS BIT) AS VARCHAR) AS b FROM p),
m AS (SELECT b, max(page_id) AS latest FROM h GROUP BY b)
SELECT page_id, payload_bytes, {_BASE32.replace("substr(b,", "substr(h.b,")} AS payload_digest, CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> latest THEN latest END AS refers_to
FROM h JOIN m ON h.b = m.b
"""

_REACH = """
e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT DISTINCT a AS node, a AS top FROM e UNION SELECT e.b, r.top FROM reach r JOIN e ON e.a = r.node),
comp AS (SELECT node, min(top) AS component FROM reach GROUP BY node)
"""
NEAR_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 85 * (na.n + nb.n - shared)),
{_REACH}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp ON comp.node = d.doc_id
"""

_WORDS = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws"
WINDOWS_SQL = f"""
WITH iw AS (SELECT item_id, {_WORDS} FROM benchmark),
ip AS (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM iw WHERE len(ws) > 0),
wi AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM ip),
l AS (SELECT DISTINCT n FROM wi),
dw AS (SELECT doc_id, {_WORDS} FROM documents),
dp AS (SELECT doc_id, ws, l.n, unnest(range(1, len(ws) - l.n + 2)) AS i FROM dw JOIN l ON len(ws) >= l.n),
hit AS (SELECT doc_id, i, dp.n, item_id FROM dp JOIN wi ON wi.n = dp.n AND wi.win = array_to_string(ws[i:i + dp.n - 1], ' ')),
cov AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov ON cov.doc_id = dw.doc_id LEFT JOIN its ON its.doc_id = dw.doc_id
"""

COSINE_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0 AND len([c FOR c IN embedding IF c <> 0]) > 0),
n AS (SELECT *, sqrt(list_dot_product(x, x)) AS size FROM v),
link AS (SELECT p.vec_id AS a, q.vec_id AS b FROM n p JOIN n q ON p.label = q.label AND len(p.x) = len(q.x) AND p.vec_id < q.vec_id WHERE list_dot_product(p.x, q.x) / (p.size * q.size) >= 0.98),
{_REACH},
k AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a)
SELECT m.vec_id, coalesce(k.n, 0) AS n_links, coalesce(component, m.vec_id) AS component_id, coalesce(component, m.vec_id) = m.vec_id AS kept
FROM embeddings m LEFT JOIN k ON k.vec_id = m.vec_id LEFT JOIN comp ON comp.node = m.vec_id
"""
