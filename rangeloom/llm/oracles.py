"""DuckDB SQL for the text queries that SQL can express."""

from __future__ import annotations

_SPACE = r"[\x20\x09-\x0D]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{_SPACE}'), lambda x: x <> '')"


QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {_words("text")} AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT rid, unnest(ws) AS a, unnest(range(len(ws))) AS i FROM w),
t AS (SELECT rid, i, a, lead(a) OVER x AS b, lead(a, 2) OVER x AS c FROM p WINDOW x AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM t WHERE c IS NOT NULL),
k AS (SELECT rid, count(DISTINCT i + o) AS n FROM r, (SELECT unnest([0, 1, 2]) AS o) WHERE n > 1 GROUP BY rid),
m AS (SELECT w.rid, doc_id, text, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '{_SPACE}', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines, coalesce(k.n, 0)::BIGINT AS n_repeat_words,
             len(regexp_extract_all(text, '\p{{L}}[^\x20\x09-\x0D]*')) AS lettered
      FROM w LEFT JOIN k ON w.rid = k.rid),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 10 > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR n_dup_lines * 100 > 50 * n_lines
            OR length(regexp_replace(text, '[^A-Z]', '', 'g')) * 100 > length(text) * 30
            OR length(regexp_replace(text, '[^0-9]', '', 'g')) * 100 > length(text) * 30
            OR lettered * 2 < n_words) AS kept
FROM b
"""

WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes >= 1000) ELSE page_id END AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < last THEN last END AS refers_to
FROM m
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_words(_LOWER)} AS ws FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, (len(ws) - 3)::BIGINT), lambda i: array_to_string(ws[i:i+4], ' ')) END)) AS h FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
g AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, g.component_id, d.doc_id = g.component_id AS kept
FROM documents d JOIN g ON g.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

#: Items have five words or more in these tables.
DECONTAMINATION = rf"""
WITH dw AS (SELECT doc_id, {_words(_LOWER)} AS ws FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, {_words(_LOWER)} AS ws FROM benchmark WHERE text IS NOT NULL),
d AS (SELECT doc_id, len(ws) - 4 AS n_doc, unnest(list_transform(range(1, (len(ws) - 3)::BIGINT), lambda i: array_to_string(ws[i:i+4], ' '))) AS h,
             unnest(range(0, (len(ws) - 4)::BIGINT)) AS pos FROM dw WHERE len(ws) >= 5),
i AS (SELECT item_id, len(ws) - 4 AS n, unnest(list_transform(range(1, (len(ws) - 3)::BIGINT), lambda i: array_to_string(ws[i:i+4], ' '))) AS h FROM iw WHERE len(ws) >= 5),
ic AS (SELECT item_id, n, h, count(*) AS k FROM i GROUP BY ALL),
hit AS (SELECT doc_id, n_doc, item_id, n, h, k, pos FROM d JOIN ic USING (h)),
start AS (SELECT DISTINCT doc_id, item_id, s FROM (SELECT doc_id, item_id, n, n_doc, unnest(range(greatest(pos - n + 1, 0)::BIGINT, (pos + 1)::BIGINT)) AS s FROM hit)
          WHERE s <= greatest(n_doc - n, 0)),
c AS (SELECT doc_id, item_id, s, n, n_doc, h, least(count(*), k) AS k FROM start JOIN hit USING (doc_id, item_id) WHERE pos BETWEEN s AND s + n - 1 GROUP BY doc_id, item_id, s, n, n_doc, h, hit.k),
t AS (SELECT doc_id, item_id, s, n + least(n, n_doc) AS total, sum(k) AS shared FROM c GROUP BY ALL),
j AS (SELECT *, shared / (total - shared) AS j FROM t WHERE shared * 175 >= total * 75)
SELECT doc_id, item_id, round(max(j), 6) AS similarity, arg_max(s, struct_pack(j := j, b := -s))::BIGINT AS start_word FROM j GROUP BY doc_id, item_id
"""


def _assigned(name: str, codebook: str) -> str:
    """Each part's nearest entry, ties to the lower index."""
    return f"""
{name} AS (SELECT r, p, min(struct_pack(d := d, e := e)) AS best FROM (
    SELECT x.r, x.p, c.e, sum((x.v - c.v) * (x.v - c.v)) AS d FROM x JOIN {codebook} c ON x.p = c.p AND x.i = c.i GROUP BY x.r, x.p, c.e) GROUP BY r, p)"""


def _moved(name: str, given: str, codebook: str) -> str:
    """Means of the parts given to each entry, rounded down; others stay."""
    return f"""
{name}_m AS (SELECT x.p, a.best.e AS e, x.i, sum(x.v) AS s, count(*) AS n FROM x JOIN {given} a ON x.r = a.r AND x.p = a.p GROUP BY ALL),
{name} AS (SELECT c.p, c.e, c.i, CASE WHEN m.n IS NULL THEN c.v ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS v
    FROM {codebook} c LEFT JOIN {name}_m m ON m.p = c.p AND m.e = c.e AND m.i = c.i)"""


VECTOR_CODES = f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, embedding, len(embedding) // 16 AS w FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x0 AS (SELECT r, w, unnest(range(16 * w)) AS j, unnest(embedding) AS v FROM k),
x AS (SELECT r, j // w AS p, j % w AS i, floor(256 * v)::BIGINT AS v FROM x0),
c0 AS (SELECT p, r AS e, i, v FROM x WHERE r < 64),{_assigned("a0", "c0")},{_moved("c1", "a0", "c0")},{_assigned("a1", "c1")},{_moved("c2", "a1", "c1")},{_assigned("a2", "c2")},
f AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a2 GROUP BY r),
h AS (SELECT sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS s FROM c2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h.s AS codebooks_sha256 FROM f JOIN k USING (r), h
"""

FILTER_AUDIT = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part, {_words("coalesce(text, '')")} AS ws FROM documents),
m AS (SELECT min(doc_id) AS least, text FROM d GROUP BY text),
f AS (SELECT d.doc_id, part, len(ws) < 100 AS a, 100 * len(list_distinct(ws)) < 80 * len(ws) AS b,
             100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 10 * length(d.text) AS c, regexp_matches(d.text, '[#$%&*|]') AS s, coalesce(doc_id > least, false) AS e
      FROM d JOIN m ON m.text = d.text),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
q AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN s THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails
      FROM f LEFT JOIN l ON l.doc_id = f.doc_id),
n AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM q GROUP BY part, fails),
t AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT concat(v.x, w.x, y.x, z.x, u.x) AS filter_order FROM t v, t w, t y, t z, t u
      WHERE w.x <> v.x AND y.x NOT IN (v.x, w.x) AND z.x NOT IN (v.x, w.x, y.x) AND u.x NOT IN (v.x, w.x, y.x, z.x)),
s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o),
r AS (SELECT part, filter_order, step, filter_order[step] AS own, n, good, toxic, fails,
             contains(fails, filter_order[step]) AS hit, step > 1 AND regexp_matches(fails, '[' || filter_order[1:step - 1] || '_]') AS gone FROM n, s),
g AS (SELECT part, filter_order, step, own,
             coalesce(sum(n) FILTER (WHERE NOT hit AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE hit AND NOT gone), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER (WHERE hit AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE fails = own), 0)::BIGINT AS unique_fails,
             coalesce(sum(good) FILTER (WHERE hit AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE hit AND NOT gone), 0)::BIGINT AS toxic_lost
      FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM g
"""
