"""The same results in DuckDB SQL, for the operators that SQL can express."""

from __future__ import annotations

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = r"[^\x20\x09-\x0D]+"


def _components(nodes: str, links: str) -> str:
    """CTEs ``reach`` and ``comp``: the smallest id that each node of ``nodes`` (id) reaches over ``links`` (a, b), both ways."""
    return f"""both_ways AS (SELECT a, b FROM {links} UNION SELECT b, a FROM {links}),
reach(id, other) AS (SELECT id, id FROM {nodes} UNION SELECT r.id, l.b FROM reach r JOIN both_ways l ON r.other = l.a),
comp AS (SELECT id, min(other) AS component_id FROM reach GROUP BY 1)"""


OP1 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(range(0, len(h) // 2)) AS i FROM d),
s AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS b, CASE WHEN 2 * i + 200 <= len(h) THEN md5_number(substr(h, 2 * i + 1, 200)) END AS k FROM p),
f AS (SELECT k, min((doc_id, i)) AS first FROM s WHERE k IS NOT NULL GROUP BY k),
r AS (SELECT s.doc_id, s.i, s.b, coalesce((s.doc_id, s.i) <> f.first, false) AS again FROM s LEFT JOIN f ON s.k = f.k),
c AS (SELECT *, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM r),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM c),
g AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans,
  coalesce(string_agg(b, '' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM e GROUP BY 1)
SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)"""

OP5 = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
s AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 49 <= len(w) THEN md5_number(array_to_string(w[i:i + 49], ' ')) END AS k FROM p),
f AS (SELECT k, min(doc_id) AS first FROM s WHERE k IS NOT NULL GROUP BY k),
r AS (SELECT s.doc_id, s.i, s.word, coalesce(s.doc_id > f.first, false) AS again FROM s LEFT JOIN f ON s.k = f.k),
c AS (SELECT *, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM r),
g AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)"""

_QUAD = " || ".join(f"substr('{_LETTERS}234567', ((CAST('0x' || substr(h, g * 5 + 1, 5) AS BIGINT) >> {s}) & 31) + 1, 1)" for s in (15, 10, 5, 0))
OP6 = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY 1)
SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 8), lambda g: {_QUAD}), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f ON p.html = f.html"""

OP7 = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND list_dot_product(e, e) > 0),
links AS (SELECT a.id AS a, b.id AS b FROM ok a JOIN ok b ON a.id < b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
{_components('v', 'links')},
n AS (SELECT a AS id, count(*) AS n_links FROM both_ways GROUP BY 1)
SELECT comp.id AS vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, comp.id = component_id AS kept FROM comp LEFT JOIN n USING (id)"""

OP9 = f"""WITH RECURSIVE d AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '{_WORDS}') AS w FROM documents),
q AS (SELECT id, w, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [1] ELSE range(1, len(w) - 2) END) AS i FROM d),
sh AS (SELECT DISTINCT id, md5_number(array_to_string(w[i:i + 3], ' ')) AS s FROM q),
n AS (SELECT id, count(*) AS n FROM sh GROUP BY 1),
links AS (SELECT x.id AS a, y.id AS b FROM sh x JOIN sh y ON x.s = y.s AND x.id < y.id JOIN n nx ON nx.id = x.id JOIN n ny ON ny.id = y.id
  GROUP BY x.id, y.id, nx.n, ny.n HAVING 100 * count(*) >= 80 * (nx.n + ny.n - count(*))),
{_components('d', 'links')}
SELECT comp.id AS doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, comp.id = component_id AS kept FROM comp LEFT JOIN n USING (id)"""

_LOWER = f"translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}')"
OP11 = f"""WITH RECURSIVE table_of AS (SELECT list_transform(range(0, 256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
r AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-z\u00C0-\u00FF]+')) AS run FROM documents)
  WHERE doc_id IS NOT NULL AND length(run) >= 5 GROUP BY ALL),
x AS (SELECT *, hex(encode(doc_id || ':' || run)) AS b FROM r),
h AS (SELECT run, k, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, len(b) // 2), lambda i: CAST('0x' || substr(b, 2 * i + 1, 2) AS BIGINT))),
  lambda c, y: xor(t[(xor(c, y) & 255) + 1], c >> 8)), 4294967295) AS h FROM x, table_of),
v AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM h),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM v WHERE length(word) >= 5 GROUP BY 1 HAVING sum(k) >= 3),
less AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS short FROM (SELECT word, unnest(range(0, length(word))) AS i FROM words)),
near AS (SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.i = b.i AND a.short = b.short AND a.word <> b.word
  UNION SELECT word, short FROM less WHERE short IN (SELECT word FROM words) UNION SELECT short, word FROM less WHERE short IN (SELECT word FROM words)),
best AS (SELECT a, count(*) AS n_near, max(w.n) AS top, arg_min(b, (-w.n, b)) AS b FROM near JOIN words w ON w.word = near.b GROUP BY 1),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * n THEN b END AS form, CASE WHEN top >= 2 * n THEN top END AS form_n FROM words LEFT JOIN best ON a = word),
chain AS (SELECT word, word AS root FROM forms WHERE form IS NULL UNION ALL SELECT f.word, c.root FROM forms f JOIN chain c ON f.form = c.word)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM forms JOIN chain USING (word)"""
