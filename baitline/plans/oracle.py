"""DuckDB SQL oracle for the registered queries.

Written independently of the Spark code, from the operator definitions: the
derived inputs (articles, truth, prepared set, ...) are inlined as CTEs over
the raw driver views, token lists use list lambdas, counts use UNNEST +
GROUP BY. Floats are rounded to 6 places (5 for float32 vectors).
"""

from __future__ import annotations

import itertools

_n = itertools.count()


def _v(prefix: str = "v") -> str:
    return f"{prefix}{next(_n)}"


WS = r"'[ \t\n\r\f]+'"


def W(x: str) -> str:
    """Whitespace tokens, empty ones dropped."""
    t = _v("t")
    return f"list_filter(regexp_split_to_array({x}, {WS}), lambda {t}: {t} <> '')"


def PIECES(x: str) -> str:
    s = _v("s")
    return f"list_filter(string_split({x}, '.'), lambda {s}: length({s}) > 0)"


def RWORDS(x: str) -> str:
    s = _v("p")
    return (f"flatten(list_transform({PIECES(x)}, lambda {s}: "
            f"CASE WHEN len({W(s)}) = 0 THEN [''] ELSE {W(s)} END))")


def BIGRAMS(w: str) -> str:
    i = _v("i")
    return f"list_transform(range(1, len({w})), lambda {i}: {w}[{i}] || ' ' || {w}[{i} + 1])"


def HID(t: str, buckets: int = 32768, offset: int = 4) -> str:
    return f"(((('0x' || substr(md5({t}), 1, 8))::BIGINT % {buckets}) + {offset})::INTEGER)"


def IDS(x: str) -> str:
    t = _v("h")
    return f"list_transform({W(x)}, lambda {t}: {HID(t)})"


def DIGEST(lst: str) -> str:
    return f"md5(array_to_string({lst}, ','))"


def F1(o: str, ne: str, nr: str) -> str:
    p = f"(CASE WHEN {ne} > 0 THEN {o}::DOUBLE / {ne} ELSE 0.0::DOUBLE END)"
    r = f"(CASE WHEN {nr} > 0 THEN {o}::DOUBLE / {nr} ELSE 0.0::DOUBLE END)"
    return f"(2.0::DOUBLE * (({p} * {r}) / ({p} + {r} + 1e-8::DOUBLE)))"


def COUNT_IN(lst: str, t: str) -> str:
    x = _v("c")
    return f"len(list_filter({lst}, lambda {x}: {x} = {t}))"


# ------------------------------------------------------------- inputs ----

ARTICLES = """
art_lines AS (SELECT doc_id AS id, string_split(text, chr(10)) AS lines FROM documents),
articles AS (SELECT id, lines[1] AS targetTitle, lines[2:] AS targetParagraphs FROM art_lines),
truth AS (SELECT doc_id AS id, ((1 - quality) * 2 + toxic)::DOUBLE / 3.0::DOUBLE AS truthMode FROM labels)"""

_LEAD = f"coalesce(array_to_string({W('substring(Body, 1, 500)')}[1:20], ' '), '')"

PREPARED = ARTICLES + f""",
joined AS (
  SELECT a.id AS row_id, a.targetTitle AS Title, array_to_string(a.targetParagraphs, ' ') AS Body,
         t.truthMode AS Score
  FROM articles a JOIN truth t ON a.id = t.id),
with_summary AS (SELECT row_id, Title, Body, {_LEAD} AS Summary, Score FROM joined),
prepared AS (
  SELECT * FROM with_summary
  WHERE row_id IS NOT NULL AND Title IS NOT NULL AND Body IS NOT NULL AND Summary IS NOT NULL
    AND Score IS NOT NULL AND NOT isnan(Score))"""

PREPARED_POS = """
art_lines AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, string_split(text, chr(10)) AS lines
              FROM documents),
articles AS (SELECT pos, lines[1] AS targetTitle, lines[2:] AS targetParagraphs FROM art_lines),
truth AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos,
                 ((1 - quality) * 2 + toxic)::DOUBLE / 3.0::DOUBLE AS truthMode FROM labels)""" + f""",
joined AS (
  SELECT a.pos AS row_id, a.targetTitle AS Title, array_to_string(a.targetParagraphs, ' ') AS Body,
         t.truthMode AS Score
  FROM articles a JOIN truth t ON a.pos = t.pos),
with_summary AS (SELECT row_id, Title, Body, {_LEAD} AS Summary, Score FROM joined),
prepared AS (
  SELECT * FROM with_summary
  WHERE Title IS NOT NULL AND Body IS NOT NULL AND Summary IS NOT NULL
    AND Score IS NOT NULL AND NOT isnan(Score))"""

HEADLINE = PREPARED + f""",
sent AS (
  SELECT row_id, unnest(range(0, len(string_split(Body, '.')))) AS sidx,
         unnest(string_split(Body, '.')) AS s FROM prepared),
sent_w AS (SELECT row_id, sidx, {W('s')} AS w FROM sent),
sent_n AS (SELECT row_id, sidx, w, len(w) AS k, sum(len(w)) OVER (PARTITION BY row_id) AS n_doc FROM sent_w),
tok AS (SELECT row_id, sidx, k, n_doc, unnest(w) AS tk FROM sent_n),
tok_c AS (SELECT row_id, sidx, k, n_doc, count(*) OVER (PARTITION BY row_id, tk) AS c FROM tok),
sscore AS (SELECT row_id, sidx, round(sum(c)::DOUBLE / (k * n_doc)::DOUBLE, 6) AS score FROM tok_c
           WHERE k BETWEEN 5 AND 50 GROUP BY row_id, sidx, k, n_doc),
best AS (SELECT row_id, sidx FROM (
           SELECT row_id, sidx, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, sidx ASC) AS rn
           FROM sscore) WHERE rn = 1),
pairs AS (
  SELECT p.row_id, p.Title, p.Body, p.Summary, p.Score,
         CASE WHEN b.sidx IS NOT NULL
              THEN array_to_string({W("string_split(p.Body, '.')[b.sidx + 1]")}, ' ')
              ELSE array_to_string({W('p.Body')}[1:10], ' ') END AS gen_title
  FROM prepared p LEFT JOIN best b ON p.row_id = b.row_id)"""


def _bleu(r: str, g: str) -> str:
    t = _v("u")
    m = f"coalesce(list_sum(list_transform(list_distinct({g}), lambda {t}: least({COUNT_IN(g, t)}, {COUNT_IN(r, t)}))), 0)"
    return (f"(CASE WHEN {m} = 0 THEN 0.0::DOUBLE ELSE {m}::DOUBLE / len({g}) * "
            f"(CASE WHEN len({g}) > len({r}) THEN 1.0::DOUBLE ELSE exp(1.0::DOUBLE - len({r})::DOUBLE / len({g})) END) END)")


def _bow(a: str, b: str) -> str:
    t1, t2, t3 = _v("u"), _v("u"), _v("u")
    dot = f"coalesce(list_sum(list_transform(list_distinct({b}), lambda {t1}: {COUNT_IN(b, t1)} * {COUNT_IN(a, t1)})), 0)"
    na = f"coalesce(list_sum(list_transform(list_distinct({a}), lambda {t2}: {COUNT_IN(a, t2)} * {COUNT_IN(a, t2)})), 0)"
    nb = f"coalesce(list_sum(list_transform(list_distinct({b}), lambda {t3}: {COUNT_IN(b, t3)} * {COUNT_IN(b, t3)})), 0)"
    den = f"sqrt({na}::DOUBLE * {nb}::DOUBLE)"
    return f"(CASE WHEN {den} > 0 THEN {dot}::DOUBLE / {den} ELSE 0.0::DOUBLE END)"


def _emb(w: str) -> str:
    j, x, y = _v("j"), _v("x"), _v("y")
    buckets = f"list_transform({w}, lambda {x}: (('0x' || substr(md5({x}), 1, 8))::BIGINT % 64)::INTEGER)"
    return f"list_transform(range(0, 64), lambda {j}: len(list_filter({buckets}, lambda {y}: {y} = {j}))::DOUBLE)"


def _cos(a: str, b: str) -> str:
    i, k, m = _v("i"), _v("i"), _v("i")
    dot = f"list_sum(list_transform(range(1, len({a}) + 1), lambda {i}: {a}[{i}]::DOUBLE * {b}[{i}]::DOUBLE))"
    na = f"list_sum(list_transform({a}, lambda {k}: {k}::DOUBLE * {k}::DOUBLE))"
    nb = f"list_sum(list_transform({b}, lambda {m}: {m}::DOUBLE * {m}::DOUBLE))"
    den = f"(sqrt({na}) * sqrt({nb}))"
    return f"(CASE WHEN {den} > 0 THEN {dot} / {den} END)"


EVAL = HEADLINE + f""",
ev0 AS (
  SELECT row_id, Score AS score, Title AS real_title, gen_title, Body AS body_text FROM pairs
  WHERE Body <> '' AND gen_title <> '' AND Title <> ''
    AND len({PIECES('Body')}) > 0 AND len({PIECES('gen_title')}) > 0 AND len({PIECES('Title')}) > 0),
ev1 AS (
  SELECT *, {W('real_title')} AS rw, {W('gen_title')} AS gw,
         {RWORDS('body_text')} AS bw, {RWORDS('gen_title')} AS gr, {RWORDS('real_title')} AS rr FROM ev0),
ev2 AS (
  SELECT *, list_distinct(bw) AS b1, list_distinct(gr) AS g1, list_distinct(rr) AS r1,
         list_distinct({BIGRAMS('bw')}) AS b2, list_distinct({BIGRAMS('gr')}) AS g2,
         list_distinct({BIGRAMS('rr')}) AS r2, {_emb('rw')} AS re, {_emb('gw')} AS ge FROM ev1),
eval_rows AS (
  SELECT row_id, score, real_title, gen_title, body_text,
         {_bleu('rw', 'gw')} AS bleu_score,
         {_bow('rw', 'gw')} AS cosine_similarity_spacey,
         coalesce({_cos('re', 'ge')}, 0.0::DOUBLE) AS cosine_similarity_bert_embed,
         {F1('len(list_intersect(b1, g1))', 'len(b1)', 'len(g1)')} AS rouge1_f1_score_gen_title,
         {F1('len(list_intersect(b2, g2))', 'len(b2)', 'len(g2)')} AS rouge2_f1_score_gen_title,
         {F1('len(list_intersect(b1, r1))', 'len(b1)', 'len(r1)')} AS rouge1_f1_score_real_title,
         {F1('len(list_intersect(b2, r2))', 'len(b2)', 'len(r2)')} AS rouge2_f1_score_real_title
  FROM ev2)"""

METRICS = ["bleu_score", "cosine_similarity_spacey", "cosine_similarity_bert_embed",
           "rouge1_f1_score_gen_title", "rouge2_f1_score_gen_title",
           "rouge1_f1_score_real_title", "rouge2_f1_score_real_title"]


def _report(by: str | None) -> str:
    keys = f"{by}, " if by else ""
    src = ("(SELECT e.*, d.lang FROM eval_rows e JOIN documents d ON e.row_id = d.doc_id)" if by
           else "eval_rows")
    unions = " UNION ALL ".join(
        f"SELECT {keys}'{c}_metrics' AS metric, {c}::DOUBLE AS value FROM {src}" for c in ["score"] + METRICS)
    return (f"WITH {EVAL}, lng AS ({unions}) "
            f"SELECT {keys}metric, round(min(value), 6) AS min, round(max(value), 6) AS max, "
            f"round(median(value), 6) AS median, round(avg(value), 6) AS mean, "
            f"round(stddev_pop(value), 6) AS std FROM lng WHERE value IS NOT NULL AND NOT isnan(value) "
            f"GROUP BY {keys}metric")


def _r(x: str, n: int = 6) -> str:
    return f"round({x}, {n})"


def _hash_split(key: str) -> str:
    h = f"(('0x' || substr(md5({key}::VARCHAR), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE)"
    return f"CASE WHEN {h} < 0.1 THEN 'test' WHEN {h} < 0.2 THEN 'dev' ELSE 'train' END"


IDS_CTE = PREPARED + f""",
ids AS (SELECT row_id, Title, Body, Summary, Score, {IDS('Body')} AS body_ids, {IDS('Title')} AS title_ids
        FROM prepared),
packed AS (SELECT row_id, title_ids[1:64] AS t, body_ids[1:(512 - len(title_ids[1:64]) - 1)] AS b FROM ids),
packed2 AS (SELECT row_id, b, t, list_resize(list_concat(b, [1], t), 512, 0) AS seq FROM packed)"""

_CUE_N = f"len({W('Title')})"
_CUE = (f"(-0.5::DOUBLE + 1.4::DOUBLE * (CASE WHEN contains(Title, '?') THEN 1 ELSE 0 END)"
        f" + 0.9::DOUBLE * (CASE WHEN contains(Title, '!') THEN 1 ELSE 0 END)"
        f" + 0.8::DOUBLE * (CASE WHEN regexp_matches(Title, '^[0-9]') THEN 1 ELSE 0 END)"
        f" + 0.7::DOUBLE * (CASE WHEN regexp_matches(lower(Title), '(^|[^a-z])(you|your)([^a-z]|$)') THEN 1 ELSE 0 END)"
        f" + 0.6::DOUBLE * (CASE WHEN {_CUE_N} <= 6 THEN 1 ELSE 0 END)"
        f" + (-0.02)::DOUBLE * least({_CUE_N}, 50)::DOUBLE)")

PRED = PREPARED + f""",
pred0 AS (SELECT row_id, Score, {_CUE} AS logit FROM prepared),
pred AS (SELECT row_id, Score, logit, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-logit)), 6) AS prob,
                (CASE WHEN Score > 0.5 THEN 1 ELSE 0 END) AS label,
                (CASE WHEN round(1.0::DOUBLE / (1.0::DOUBLE + exp(-logit)), 6) >= 0.5 THEN 1 ELSE 0 END) AS pred
         FROM pred0),
conf AS (SELECT sum(CASE WHEN label = 1 AND pred = 1 THEN 1 ELSE 0 END)::BIGINT AS pp,
                sum(CASE WHEN label = 1 AND pred = 0 THEN 1 ELSE 0 END)::BIGINT AS fn,
                sum(CASE WHEN label = 0 AND pred = 1 THEN 1 ELSE 0 END)::BIGINT AS fp,
                sum(CASE WHEN label = 0 AND pred = 0 THEN 1 ELSE 0 END)::BIGINT AS nn FROM pred)"""

RUNLOG = """
runlog AS (
  SELECT event_type AS run, user_id % 4 AS epoch, event_id AS step, value AS loss,
         CASE WHEN user_id % 7 = 0 THEN event_type || '-' || (user_id % 4)::VARCHAR || '.part'
              ELSE event_type || '-' || (user_id % 4)::VARCHAR END AS artifact
  FROM events)"""

VOCAB = PREPARED + f""",
toks AS (SELECT unnest({W('Title')}) AS token FROM prepared
         UNION ALL SELECT unnest({W('Body')}) AS token FROM prepared),
cnt AS (SELECT token, count(*) AS count FROM toks GROUP BY token),
top AS (SELECT token, (row_number() OVER (ORDER BY count DESC, token ASC) - 1 + 4)::BIGINT AS id, count
        FROM cnt QUALIFY row_number() OVER (ORDER BY count DESC, token ASC) <= 500)"""

_S2S_BODY = f"list_concat(({IDS(chr(39) + 'summarize: ' + chr(39) + ' || Body')})[1:511], [2])"
_S2S_T = f"list_concat(({IDS('Title')})[1:49], [2])"
_S2S_S = f"list_concat(({IDS('Summary')})[1:49], [2])"
_x = _v("x")

ORACLE: dict[str, str] = {
    "prepare_by_key": f"WITH {PREPARED} SELECT row_id, Title, Body, Summary, round(Score, 6) AS Score FROM prepared",
    "prepare_by_position": f"WITH {PREPARED_POS} SELECT row_id, Title, Body, Summary, round(Score, 6) AS Score FROM prepared",
    "union_sources": ("SELECT doc_id, lang, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE source END AS source, "
                      "n_chars, (doc_id % 3)::INTEGER AS part FROM documents"),
    "web_articles": (r"SELECT page_id, title, len(ps)::BIGINT AS n_paragraphs, array_to_string(ps, ' ') AS body FROM ("
                     r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, "
                     r"list_transform(regexp_split_to_array(html, '<p(?:\s[^>]*)?>')[2:], lambda x: "
                     r"regexp_replace(regexp_replace(x, '(?s)</(?:p|article|body)\s*>.*$', ''), '<[^>]*>', '', 'g')) AS ps FROM pages)"),
    "lead_summary": (f"WITH {ARTICLES}, b AS (SELECT id, array_to_string(targetParagraphs, ' ') AS Body FROM articles) "
                     f"SELECT id AS row_id, {_LEAD} AS Summary, length(substring(Body, 1, 500))::BIGINT AS prefix_chars "
                     f"FROM b"),
    "record_lookup": """WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n_rows, doc_id, text FROM documents)
        SELECT pos, n_rows, doc_id, md5(text) AS text_md5 FROM d WHERE pos IN (0, n_rows // 2, n_rows - 1)""",
    "first_record": "SELECT doc_id, n_chars, lang FROM documents ORDER BY n_chars DESC, doc_id LIMIT 1",
    "mini_prepared": (f"WITH {PREPARED}, first AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS p FROM documents) "
                      f"WHERE p <= 100) SELECT row_id, Title, md5(Body) AS body_md5, round(Score, 6) AS Score FROM prepared "
                      f"WHERE row_id IN (SELECT doc_id FROM first)"),
    "job_runs": (f"WITH {PRED}, s AS (SELECT {_hash_split('row_id')} AS split, (CASE WHEN pred = label THEN 1 ELSE 0 END) AS ok FROM pred) "
                 f"SELECT split, count(*) AS \"rows\", round((count(*) - sum(ok))::DOUBLE / count(*), 6) AS loss, "
                 f"round(sum(ok)::DOUBLE / count(*), 6) AS accuracy FROM s GROUP BY split"),
    "split_hash": f"SELECT doc_id AS row_id, {_hash_split('doc_id')} AS split FROM documents",
    "split_exact": """WITH h AS (SELECT doc_id AS row_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT AS hk
                                 FROM documents),
        sz AS (SELECT ceil(0.1::DOUBLE * count(*))::BIGINT AS n_test, count(*) AS n FROM h),
        sz2 AS (SELECT n_test, ceil((0.1::DOUBLE / (1 - 0.1::DOUBLE)) * (n - n_test))::BIGINT AS n_dev FROM sz),
        r AS (SELECT row_id, row_number() OVER (ORDER BY hk, row_id) - 1 AS rk FROM h)
        SELECT row_id, CASE WHEN rk < n_test THEN 'test' WHEN rk < n_test + n_dev THEN 'dev' ELSE 'train' END AS split
        FROM r, sz2""",
    "wanted_scores": (f"WITH {PREPARED} SELECT row_id, round(Score, 6) AS Score FROM prepared "
                      f"WHERE abs(0 - Score) < 0.1 OR abs(1 - Score) < 0.1"),
    "resolve_split_rows": (f"WITH {PREPARED}, s AS (SELECT row_id, {_hash_split('row_id')} AS split, Score FROM prepared) "
                           f"SELECT row_id, split, round(Score, 6) AS Score FROM s WHERE split = 'test'"),
    "pack_sequences": (f"WITH {IDS_CTE} SELECT row_id, {DIGEST('seq')} AS seq_md5, len(seq)::BIGINT AS seq_len, "
                       f"(512 - len(b))::BIGINT AS mask_sum, len(b)::BIGINT AS body_len FROM packed2"),
    "pack_right": (f"WITH {IDS_CTE}, pr0 AS (SELECT ids.row_id, ids.title_ids[1:64] AS t, ids.body_ids FROM ids), "
                   f"pr1 AS (SELECT row_id, t, body_ids[1:(511 - len(t))] AS b, 511 - len(t) AS zone FROM pr0), "
                   f"pr2 AS (SELECT row_id, list_concat(list_resize(b, zone, 0), [1], t) AS seq FROM pr1) "
                   f"SELECT row_id, {DIGEST('seq')} AS seq_md5, "
                   f"len(list_filter(seq, lambda {_x}: {_x} <> 0))::BIGINT AS attn_sum FROM pr2"),
    "seq2seq_encode": (f"WITH {PREPARED}, e AS (SELECT row_id, {_S2S_BODY} AS sc, {_S2S_T} AS tc, {_S2S_S} AS uc "
                       f"FROM prepared), "
                       f"e2 AS (SELECT row_id, sc, tc, uc, list_resize(sc, 512, 0) AS s, list_resize(tc, 50, 0) AS t, "
                       f"list_resize(uc, 50, 0) AS u FROM e) "
                       f"SELECT row_id, {DIGEST('s')} AS sequences_md5, {DIGEST('t')} AS titles_md5, "
                       f"{DIGEST('u')} AS summaries_md5, "
                       f"{DIGEST('list_transform(u, lambda q: CASE WHEN q = 0 THEN -100 ELSE q END)')} AS labels_md5, "
                       f"len(sc)::BIGINT AS seq_mask_sum, len(tc)::BIGINT AS title_mask_sum, "
                       f"len(uc)::BIGINT AS summary_mask_sum FROM e2"),
    "mask_shift": (f"WITH {IDS_CTE}, m AS (SELECT row_id, seq, "
                   f"list_transform(range(0, 512), lambda i: CASE WHEN i >= len(b) THEN 1 ELSE 0 END) AS mask "
                   f"FROM packed2), "
                   f"m2 AS (SELECT row_id, seq, list_concat([0], mask[1:511]) AS sh FROM m) "
                   f"SELECT row_id, {DIGEST('sh')} AS shifted_md5, "
                   f"{DIGEST('list_transform(range(1, 513), lambda i: CASE WHEN sh[i] = 0 THEN 0 ELSE seq[i] END)')} "
                   f"AS labels_md5, "
                   f"{DIGEST('list_transform(seq, lambda q: CASE WHEN q <> 1 THEN 1 ELSE 0 END)')} AS attn_md5 FROM m2"),
    "first_zero": f"WITH {IDS_CTE} SELECT row_id, len(title_ids[1:64])::BIGINT AS title_len FROM ids",
    "vocab": f"WITH {VOCAB} SELECT token, id, count FROM top",
    "roundtrip_decode": (f"WITH {VOCAB}, tt AS (SELECT row_id, t.pos, ({W('Title')})[t.pos] AS token FROM prepared "
                         f"LEFT JOIN LATERAL (SELECT unnest(range(1, len({W('Title')}) + 1)) AS pos) t ON true), "
                         f"j AS (SELECT tt.row_id, tt.pos, tt.token, v.id FROM tt LEFT JOIN top v ON tt.token = v.token) "
                         f"SELECT row_id, md5(coalesce(string_agg(CASE WHEN id IS NOT NULL THEN token END, ' ' "
                         f"ORDER BY pos), '')) AS decoded_md5, "
                         f"sum(CASE WHEN id IS NULL AND token IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS n_unk, count(token)::BIGINT AS n_tokens "
                         f"FROM j GROUP BY row_id"),
    "reencode_pack_right": (
        f"WITH {VOCAB}, tt AS (SELECT row_id, t.pos, ({W('Title')})[t.pos] AS token FROM prepared "
        f"LEFT JOIN LATERAL (SELECT unnest(range(1, len({W('Title')}) + 1)) AS pos) t ON true), "
        f"j AS (SELECT tt.row_id, tt.pos, tt.token, v.id FROM tt LEFT JOIN top v ON tt.token = v.token), "
        f"dec AS (SELECT row_id, coalesce(string_agg(CASE WHEN id IS NOT NULL THEN token END, ' ' ORDER BY pos), '') "
        f"AS decoded FROM j GROUP BY row_id), "
        f"x AS (SELECT d.row_id, d.decoded, ({IDS('d.decoded')})[1:64] AS t, {IDS('p.Body')} AS body_ids "
        f"FROM dec d JOIN prepared p ON d.row_id = p.row_id), "
        f"y AS (SELECT row_id, decoded, t, body_ids[1:(511 - len(t))] AS b, 511 - len(t) AS zone FROM x) "
        f"SELECT row_id, md5(decoded) AS decoded_md5, {DIGEST('list_concat(list_resize(b, zone, 0), [1], t)')} "
        f"AS seq_md5, (len(b) + 1 + len(t))::BIGINT AS attn_sum FROM y"),
    "batches": (f"WITH {PREPARED}, p AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS pos FROM prepared) "
                f"SELECT (pos // 4)::BIGINT AS batch_id, count(*)::BIGINT AS n_rows, "
                f"arg_min(row_id, pos) AS first_row_id, "
                f"md5(string_agg(row_id::VARCHAR, ',' ORDER BY pos)) AS rows_md5 FROM p GROUP BY pos // 4"),
    "extractive_headline": f"WITH {HEADLINE} SELECT row_id, gen_title FROM pairs",
    "bleu1": (f"WITH {HEADLINE}, w AS (SELECT row_id, {W('Title')} AS r, {W('gen_title')} AS g FROM pairs) "
              f"SELECT row_id, round({_bleu('r', 'g')}, 6) AS bleu_score FROM w"),
    "rouge12": (f"WITH {EVAL} SELECT row_id, "
                + ", ".join(f"round({c}, 6) AS {c}" for c in METRICS if c.startswith("rouge"))
                + " FROM eval_rows"),
    "bow_cosine": (f"WITH {HEADLINE}, w AS (SELECT row_id, {W('Title')} AS r, {W('gen_title')} AS g FROM pairs) "
                   f"SELECT row_id, round({_bow('r', 'g')}, 6) AS cosine FROM w"),
    "embedding_cosine": (f"SELECT a.vec_id AS id_a, b.vec_id AS id_b, "
                         f"round({_cos('a.embedding', 'b.embedding')}, 5) AS cosine "
                         f"FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"),
    "pair_eval": (f"WITH {EVAL} SELECT row_id, round(score, 6) AS score, real_title, gen_title, body_text, "
                  + ", ".join(f"round({c}, 6) AS {c}" for c in METRICS) + " FROM eval_rows"),
    "rejected_pairs": (f"WITH {HEADLINE} SELECT sum(CASE WHEN Body <> '' AND gen_title <> '' AND Title <> '' "
                       f"AND len({PIECES('Body')}) > 0 AND len({PIECES('gen_title')}) > 0 "
                       f"AND len({PIECES('Title')}) > 0 THEN 0 ELSE 1 END)::BIGINT AS rejected, "
                       f"count(*)::BIGINT AS total FROM pairs"),
    "metric_report": _report(None),
    "metric_report_by_lang": _report("lang"),
    "eval_cap": (f"WITH {EVAL.replace('SELECT row_id, Score AS score', 'SELECT pos AS row_id, Score AS score').replace('FROM pairs', 'FROM (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS pos FROM pairs)', 1)} "
                 f", capped AS (SELECT row_id AS pos, bleu_score FROM eval_rows WHERE row_id <= 200 "
                 f"UNION ALL SELECT row_id AS pos, bleu_score FROM eval_rows "
                 f"WHERE row_id = (SELECT min(row_id) FROM eval_rows WHERE row_id > 200)) "
                 f"SELECT pos, round(bleu_score, 6) AS bleu_score FROM capped"),
    "confusion": f"WITH {PRED} SELECT pp, fn, fp, nn FROM conf",
    "rates": (f"WITH {PRED} SELECT "
              f"round(CASE WHEN pp + fn > 0 THEN pp::DOUBLE / (pp + fn) END, 6) AS \"True Postive\", "
              f"round(CASE WHEN nn + fp > 0 THEN nn::DOUBLE / (nn + fp) END, 6) AS \"True Negative\", "
              f"round(CASE WHEN fn + pp > 0 THEN fn::DOUBLE / (fn + pp) END, 6) AS \"False Negative\", "
              f"round(CASE WHEN fp + nn > 0 THEN fp::DOUBLE / (fp + nn) END, 6) AS \"False Positive\", "
              f"round(CASE WHEN fp + fn + nn + pp > 0 THEN (nn + pp)::DOUBLE / (fp + fn + nn + pp) END, 6) "
              f"AS \"Overall Accuracy\" FROM conf"),
    "softmax_label": (f"WITH {PRED} SELECT row_id, (1 - label)::INTEGER AS onehot0, label::INTEGER AS onehot1, "
                      f"round(1.0::DOUBLE / (1.0::DOUBLE + exp(0.0::DOUBLE - logit)), 6) AS p1, "
                      f"round(prob, 6) AS prob FROM pred"),
    "running_accuracy": (f"WITH {PRED}, p AS (SELECT row_number() OVER (ORDER BY row_id) - 1 AS pos, "
                         f"(CASE WHEN pred = label THEN 1 ELSE 0 END) AS ok FROM pred), "
                         f"c AS (SELECT pos, sum(ok) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) "
                         f"AS acc FROM p) "
                         f"SELECT pos, acc::BIGINT AS acc, round(acc / (pos + 1), 6) AS accuracy FROM c "
                         f"WHERE pos % 100 = 1"),
    "epoch_loss": (f"WITH {RUNLOG} SELECT run, epoch::BIGINT AS epoch, round(avg(loss), 6) AS mean_loss, "
                   f"count(*)::BIGINT AS steps FROM runlog GROUP BY run, epoch"),
    "top_k_runs": (f"WITH {RUNLOG}, per AS (SELECT artifact AS name, avg(loss) AS train_loss FROM runlog GROUP BY artifact) "
                   f"SELECT name, round(train_loss, 6) AS train_loss FROM per ORDER BY train_loss, name LIMIT 3"),
    "latest_artifact": (f"WITH {RUNLOG} SELECT run, max(artifact) AS latest FROM runlog "
                        f"WHERE starts_with(artifact, run || '-') AND NOT suffix(artifact, '.part') GROUP BY run"),
}

# vectors and models
WORD_VECTORS = f"""
wv AS (SELECT token, vector FROM (SELECT DISTINCT unnest({W('text')}) AS token FROM documents) t
       JOIN (SELECT vec_id % 64 AS bucket, arg_min(embedding, vec_id) AS vector FROM embeddings GROUP BY 1) e
         ON {HID('token', 64, 0)} = bucket)"""


def _word_cosine(pairs: str, real: str, gen: str) -> str:
    return f"""
side AS (SELECT row_id, 0 AS s, unnest({W(real)}) AS token FROM {pairs} UNION ALL SELECT row_id, 1 AS s, unnest({W(gen)}) AS token FROM {pairs}),
mean AS (SELECT row_id, i, coalesce(sum(vector[i]::DOUBLE) FILTER (s = 0), 0) AS a, coalesce(sum(vector[i]::DOUBLE) FILTER (s = 1), 0) AS b
         FROM side JOIN wv USING (token), unnest(range(1, 65)) AS t(i) GROUP BY row_id, i),
wc AS (SELECT row_id, sum(a * b) / nullif(sqrt(sum(a * a)) * sqrt(sum(b * b)), 0) AS c FROM mean GROUP BY row_id)"""


_SENTENCE_COS = f"(SELECT a.vec_id AS row_id, {_cos('a.embedding', 'b.embedding')} AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"
_ROUGE = ", ".join(f"round({c}, 6) AS {c}" for c in METRICS if not c.startswith("cosine"))
ORACLE["word_vector_similarity"] = (f"WITH {HEADLINE}, {WORD_VECTORS}, {_word_cosine('pairs', 'Title', 'gen_title')} "
                                    f"SELECT row_id, round(coalesce(c, 0.0), 5) AS cosine FROM pairs LEFT JOIN wc USING (row_id)")
ORACLE["pair_eval_vectors"] = (f"WITH {EVAL}, {WORD_VECTORS}, {_word_cosine('eval_rows', 'real_title', 'gen_title')} "
                               f"SELECT row_id, round(score, 6) AS score, gen_title, {_ROUGE}, round(coalesce(wc.c, 0.0), 5) AS cosine_similarity_spacey, "
                               f"round(s.c, 5) AS cosine_similarity_bert_embed FROM eval_rows LEFT JOIN wc USING (row_id) LEFT JOIN {_SENTENCE_COS} s USING (row_id)")
_FIRST_500 = W("substring(Body, 1, 500)")
ORACLE["model_summary"] = f"WITH {PREPARED} SELECT row_id, Title, Body, Summary, round(Score, 6) AS Score FROM prepared WHERE len({_FIRST_500}) >= 5"
ORACLE["model_failures"] = (f"WITH {PREPARED} SELECT count(*)::BIGINT AS rows, count(CASE WHEN len({_FIRST_500}) < 5 THEN 1 END)::BIGINT AS failed FROM prepared")
# the model's headline: the body's first tokens
_LEAD_EVAL = EVAL.replace("FROM pairs", f"FROM (SELECT * EXCLUDE (gen_title), array_to_string({W('Body')}[1:10], ' ') AS gen_title FROM pairs)", 1)
ORACLE["model_pair_eval"] = (f"WITH {_LEAD_EVAL} SELECT row_id, round(score, 6) AS score, gen_title, {_ROUGE}, "
                             f"round(cosine_similarity_spacey, 5) AS cosine_similarity_spacey, round(s.c, 5) AS cosine_similarity_bert_embed "
                             f"FROM eval_rows LEFT JOIN {_SENTENCE_COS} s USING (row_id)")
ORACLE["model_embedding"] = (f"WITH {ARTICLES} SELECT id AS row_id, md5(array_to_string(list_transform({_emb(W('targetTitle'))}, lambda q0: q0::INTEGER), ',')) AS embedding_md5 "
                             f"FROM articles")

# what the writers wrote and the readers read back
ORACLE["prepared_roundtrip"] = (f"WITH {PREPARED} SELECT row_id, Title, round(Score, 6) AS Score FROM prepared "
                                f"WHERE {_hash_split('row_id')} = 'dev'")
ORACLE["jsonl_prepared"] = (f"WITH {PREPARED} SELECT row_id::VARCHAR AS row_id, Title, md5(Body) AS body_md5, Summary, round(Score, 6) AS Score "
                           f"FROM prepared WHERE row_id % 50 <> 0")
ORACLE["jsonl_rejects"] = ("SELECT doc_id % 3 AS file_ordinal, count(CASE WHEN doc_id % 7 <> 0 THEN 1 END)::BIGINT AS records, "
                           "count(CASE WHEN doc_id % 7 = 0 THEN 1 END)::BIGINT AS rejected FROM documents GROUP BY 1")
ORACLE["encoded_roundtrip"] = (f"WITH {IDS_CTE}, p2 AS (SELECT row_id, {DIGEST('seq')} AS seq_md5 FROM packed2) "
                               f"SELECT p2.row_id, seq_md5, round(Score, 6) AS scores FROM p2 JOIN prepared USING (row_id) "
                               f"WHERE {_hash_split('row_id')} = 'test' AND abs(Score) < 0.1")
ORACLE["report_roundtrip"] = f"SELECT 'extractive' AS model_type, metric, mean FROM ({ORACLE['metric_report']}) r"
