"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

OP2 = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
e AS (SELECT r, unnest(g) AS x FROM s),
o AS (SELECT a.r AS ra, b.r AS rb, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.r < b.r GROUP BY ALL),
l AS (SELECT ra, rb FROM o JOIN s a ON a.r = ra JOIN s b ON b.r = rb WHERE 100 * n >= 75 * (len(a.g) + len(b.g) - n)),
pair AS (SELECT ra, rb FROM l UNION ALL SELECT rb, ra FROM l),
reach AS (SELECT r AS a, r AS b FROM s UNION SELECT reach.a, pair.rb FROM reach JOIN pair ON reach.b = pair.ra),
c AS (SELECT a AS r, min(s.doc_id) AS component_id FROM reach JOIN s ON s.r = reach.b GROUP BY a)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (r)
"""

OP7 = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS g
        FROM d, unnest(range(1, len(w) - 11)) AS t(i) WHERE len(w) >= 13),
hit AS (SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY g) AS least FROM win) WHERE least < doc_id),
gone AS (SELECT DISTINCT r, i + o AS p FROM hit, unnest(range(0, 13)) AS t(o)),
g AS (SELECT r, list(p) AS ps FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN ps IS NULL THEN array_to_string(w, ' ') ELSE coalesce((SELECT string_agg(w[p], ' ' ORDER BY p)
              FROM unnest(range(1, len(w) + 1)) AS t(p) WHERE NOT list_contains(ps, p)), '') END) AS kept_sha256
FROM d LEFT JOIN g USING (r)
"""

OP8 = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT r, doc_id, i, hash(substr(h, 2 * i + 1, 100)) AS g
        FROM d, unnest(range(0, length(h) // 2 - 49)) AS t(i) WHERE length(h) >= 100),
hit AS (SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY g) AS least FROM win) WHERE least < doc_id),
isl AS (SELECT r, i, CASE WHEN i - 50 > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -1000) THEN 1 ELSE 0 END AS new FROM hit),
run AS (SELECT r, sum(new) OVER (PARTITION BY r ORDER BY i) AS k, i FROM isl),
span AS (SELECT r, k, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY r, k),
part AS (SELECT r, k, b AS a, lead(a) OVER (PARTITION BY r ORDER BY a) AS e FROM span
         UNION ALL SELECT r, -1, 0, min(a) FROM span GROUP BY r),
kept AS (SELECT r, string_agg(substr(h, 2 * p.a + 1, 2 * (coalesce(p.e, length(h) // 2) - p.a)), '' ORDER BY p.a) AS hk
         FROM part p JOIN d USING (r) GROUP BY r),
sums AS (SELECT r, sum(b - a) AS n, count(*) AS c FROM span GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(c, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(hk, h))) AS kept_sha256
FROM d LEFT JOIN sums USING (r) LEFT JOIN kept USING (r)
"""

VALID = """embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""

OP1 = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS w
           FROM embeddings WHERE {VALID}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.w) = len(c.w) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 10
"""

OP3 = f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS w FROM embeddings
           WHERE {VALID} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.w) + 1),
             lambda i: (q.w[i] - c.w[i]) * (q.w[i] - c.w[i])), lambda a, b: a + b)) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.w) = len(c.w) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 10
"""

# crc32 of a string's bytes, by the table of the reflected polynomial 0xEDB88320
CRC = r"""
crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i)))"""


def _crc(text: str) -> str:
    return f"""xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(0, octet_length(encode({text}))),
        lambda b: CAST(('0x' || substr(hex(encode({text})), 2 * b + 1, 2)) AS BIGINT))),
        lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])))"""


OP11 = rf"""
WITH {CRC},
raw AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (SELECT r, doc_id, w, len(w) AS n, {_crc("CAST(doc_id AS VARCHAR)")} AS h FROM raw, crc_table),
p AS (SELECT *, (h // 10) % greatest(n, 1) AS a FROM h),
d AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n),
        lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END]) ELSE w END AS w FROM p),
u AS (SELECT r, i, w[i] AS x FROM d, unnest(range(1, n + 1)) AS t(i)),
m AS (SELECT a.r, b.i - a.i AS q, a.i, a.i - row_number() OVER (PARTITION BY a.r, b.i - a.i ORDER BY a.i) AS k
      FROM u a JOIN u b ON a.r = b.r AND a.x = b.x AND a.i < b.i),
v AS (SELECT r, q, min(i) - 1 AS s, count(*) + q AS l FROM m GROUP BY r, q, k HAVING count(*) + q >= greatest(12, 2 * q)),
runs AS (SELECT * FROM v WHERE NOT EXISTS (SELECT 1 FROM v z WHERE z.r = v.r AND z.q < v.q AND v.q % z.q = 0 AND z.s <= v.s AND z.s + z.l >= v.s + v.l)),
gone AS (SELECT DISTINCT r, p FROM runs, unnest(range(s + q, s + l)) AS t(p)),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS c FROM u ANTI JOIN gone ON u.r = gone.r AND u.i - 1 = gone.p GROUP BY r),
g AS (SELECT r, count(*) AS c, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS x, max_by(struct_pack(s := s, l := l, q := q), [l, -s, -q]) AS b
      FROM runs GROUP BY r)
SELECT doc_id, CAST(coalesce(g.c, 0) AS BIGINT) AS n_runs, CAST(b.s AS BIGINT) AS start, CAST(b.l AS BIGINT) AS length, CAST(b.q AS BIGINT) AS period,
       CAST(1000 * b.l // b.q AS BIGINT) AS exponent_milli, sha256(coalesce(x, '')) AS runs_sha256, sha256(coalesce(kept.c, '')) AS collapsed_sha256
FROM d LEFT JOIN g USING (r) LEFT JOIN kept USING (r)
"""

OP12 = rf"""
WITH RECURSIVE {CRC},
run AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents) GROUP BY ALL),
h AS (SELECT w, n, {_crc("(CAST(doc_id AS VARCHAR) || ':' || w)")} AS h FROM run, crc_table),
read AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM read WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
hole AS (SELECT word, i, left(word, i) || chr(0) || substr(word, i + 2) AS masked, left(word, i) || substr(word, i + 2) AS cut FROM v, unnest(range(0, length(word))) AS t(i)),
pair AS (SELECT a.word, b.word AS other FROM hole a JOIN hole b ON a.masked = b.masked AND a.word <> b.word
         UNION SELECT a.word, a.cut FROM hole a JOIN v b ON a.cut = b.word
         UNION SELECT a.cut, a.word FROM hole a JOIN v b ON a.cut = b.word),
best AS (SELECT pair.word, count(*) AS k, max(v.n) AS m, min_by(other, struct_pack(a := -v.n, b := other)) AS other FROM pair JOIN v ON v.word = other GROUP BY pair.word),
f AS (SELECT v.word, v.n, coalesce(k, 0) AS n_near, CASE WHEN m >= 2 * v.n THEN other END AS form, CASE WHEN m >= 2 * v.n THEN m END AS form_n FROM v LEFT JOIN best USING (word)),
reach AS (SELECT word, form AS top FROM f WHERE form IS NOT NULL UNION ALL SELECT reach.word, f.form FROM reach JOIN f ON f.word = reach.top WHERE f.form IS NOT NULL),
ended AS (SELECT reach.word, top FROM reach JOIN f ON f.word = top WHERE f.form IS NULL)
SELECT f.word, form, coalesce(top, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN ended USING (word)
"""

OP13 = f"""
WITH RECURSIVE v AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, CASE WHEN {VALID} AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        THEN CAST(embedding AS DOUBLE[]) END AS w FROM embeddings),
pair AS (SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.r <> b.r AND len(a.w) = len(b.w) WHERE list_cosine_similarity(a.w, b.w) >= 0.95),
reach AS (SELECT r AS a, r AS b FROM v UNION SELECT reach.a, pair.b FROM reach JOIN pair ON reach.b = pair.a),
c AS (SELECT a AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY a),
l AS (SELECT a AS r, count(*) AS n FROM pair GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c USING (r) LEFT JOIN l USING (r)
"""

ORACLE: dict[str, str] = {
    "op1_exact_topk": OP1,
    "op2_minhash_dedup": OP2,
    "op3_nearest": OP3,
    "op7_substring_dedup": OP7,
    "op8_suffix_dedup": OP8,
    "op11_periodic_runs": OP11,
    "op12_spelling_variants": OP12,
    "op13_embedding_dedup": OP13,
}
