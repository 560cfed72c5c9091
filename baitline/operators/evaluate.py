"""Headline evaluation (I2 built-in generator, M1-M6, P7, P8).

``extractive_headline`` is a SumBasic-style sentence pick computed inside each
document row (sorted token occurrences -> run-length counts -> one scalar
pass), so the corpus is never shuffled for it.

``evaluate_pairs`` is one projection over (body, real, generated) rows: all
metrics are Catalyst higher-order functions on token arrays computed once per
row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import (_bleu_from, bigrams, count_stats, f1_from_counts, let, rouge_valid,
                                    rouge_words)
from ..functions.text import SENTENCE_SEP, words
from .filters import non_empty_text
from .vectors import supplied_cosine, word_vector_cosine

# Fixed values of the built-in headline generator.
HEADLINE_MIN_TOKENS = 5
HEADLINE_MAX_TOKENS = 50
HEADLINE_FALLBACK_TOKENS = 10

# Output columns of an evaluation row.
EVAL_COLUMNS = ["score", "real_title", "gen_title", "body_text", "bleu_score",
                "cosine_similarity_spacey", "cosine_similarity_bert_embed",
                "rouge1_f1_score_gen_title", "rouge2_f1_score_gen_title",
                "rouge1_f1_score_real_title", "rouge2_f1_score_real_title"]
METRIC_COLUMNS = EVAL_COLUMNS[4:]


def headline_expr(body, min_tokens: int = HEADLINE_MIN_TOKENS, max_tokens: int = HEADLINE_MAX_TOKENS,
                  fallback_tokens: int = HEADLINE_FALLBACK_TOKENS) -> Column:
    """The built-in headline of one document as a single expression,
    O(n log n) in the document and free of per-token searches:

    1. token occurrences (token, sentence), sorted, so each token's copies
       form one run;
    2. run lengths expanded back to one count per occurrence
       (``array_repeat`` per run);
    3. candidate occurrences re-sorted by sentence and walked once with
       scalar accumulators, keeping the best mean of count / n (ties: the
       earlier sentence).

    Intermediates are bound once with ``let``, so the expression stays cheap
    wherever the optimizer substitutes it (a pushed-down filter, a collapsed
    projection)."""
    b = F.col(body) if isinstance(body, str) else body

    def with_sentences(sw):
        sizes = F.transform(sw, lambda w: F.size(w))
        occ = F.flatten(F.transform(sw, lambda w, j: F.transform(
            w, lambda t: F.struct(t.alias("t"), j.alias("j")))))

        def with_sorted(so, ks):
            n = F.size(so)
            starts = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                              lambda i: (i == 1) | (F.try_element_at(so, i)["t"] != F.try_element_at(so, i - 1)["t"]))

            def with_starts(rs):
                ends = F.concat(F.slice(rs, 2, F.greatest(F.size(rs) - 1, F.lit(0))), F.array(n + 1))
                counts = F.flatten(F.zip_with(rs, ends, lambda a, c: F.array_repeat(c - a, c - a)))
                per_occ = F.zip_with(so, counts, lambda o, c: F.struct(o["j"].alias("j"), c.alias("c")))
                cand = F.array_sort(F.filter(
                    per_occ, lambda x: F.element_at(ks, x["j"] + 1).between(min_tokens, max_tokens)))
                # mean of count / n over the sentence = sum(count) / (k n): an
                # integer sum and one division, so the score (and its ties)
                # does not depend on a floating-point summation order
                z = F.struct(F.lit(-1).alias("cj"), F.lit(0).cast("long").alias("s"),
                             F.lit(None).cast("double").alias("bs"), F.lit(None).cast("int").alias("bj"))

                def flush(a):
                    kn = F.try_element_at(ks, a["cj"] + 1).cast("long") * n.cast("long")
                    sc = F.round(a["s"].cast("double") / kn.cast("double"), 6)
                    better = (a["cj"] >= 0) & (a["bs"].isNull() | (sc > a["bs"]))
                    return (F.when(better, sc).otherwise(a["bs"]), F.when(better, a["cj"]).otherwise(a["bj"]))

                def step(a, x):
                    new = x["j"] != a["cj"]
                    bs, bj = flush(a)
                    return F.when(new, F.struct(x["j"].alias("cj"), x["c"].cast("long").alias("s"),
                                                bs.alias("bs"), bj.alias("bj"))).otherwise(
                        F.struct(a["cj"].alias("cj"), (a["s"] + x["c"]).alias("s"),
                                 a["bs"].alias("bs"), a["bj"].alias("bj")))
                best = F.aggregate(cand, z, step, lambda a: flush(a)[1])
                return let(best, lambda bj: F.when(
                    bj.isNotNull(), F.array_join(F.element_at(sw, bj + 1), " ")).otherwise(
                    F.array_join(F.slice(words(b), 1, fallback_tokens), " ")))
            return let(F.when(n > 0, starts).otherwise(F.array().cast("array<int>")), with_starts)
        return let(F.array_sort(occ), lambda so: let(sizes, lambda ks: with_sorted(so, ks)))
    return let(F.transform(F.split(b, SENTENCE_SEP), lambda x: words(x)), with_sentences)


def extractive_headline(df: DataFrame, key: str = "row_id", body: str = "Body",
                        out: str = "gen_title", min_tokens: int = HEADLINE_MIN_TOKENS,
                        max_tokens: int = HEADLINE_MAX_TOKENS,
                        fallback_tokens: int = HEADLINE_FALLBACK_TOKENS) -> DataFrame:
    """I2 built-in, SumBasic-style: add ``out`` = the '.'-sentence of
    ``min..max`` tokens with the highest mean in-document token frequency
    (sum of counts / (sentence tokens x document tokens), rounded to 6; ties
    go to the earliest), its
    tokens joined by one blank; documents without a candidate get their first
    ``fallback_tokens`` tokens.

    Per document, in one projection and no shuffle: the document's tokens
    are sorted once, run lengths give a token -> count map, and each sentence
    is scored by map lookups. Work is O(n log n) in the document, and a
    document never leaves its partition."""
    return df.withColumn(out, headline_expr(body, min_tokens, max_tokens, fallback_tokens))


def pair_token_metrics(df: DataFrame, key: str, ref: str, hyp: str) -> DataFrame:
    """(key, bleu_score, cosine_similarity_spacey, cosine_similarity_bert_embed)
    for two text columns; one projection. Rows whose texts have no token on
    either side get 0."""
    d = df.select(key, words(ref).alias("_rw"), words(hyp).alias("_gw"))
    d = d.select("*", count_stats("_rw", "_gw").alias("_cs"))
    return d.select(key, *_count_metrics())


def _count_metrics():
    cs = F.col("_cs")
    bleu = _bleu_from(cs["m"], F.size("_gw"), F.size("_rw"))
    den = F.sqrt(cs["nr"].cast("double") * cs["ng"].cast("double"))
    bow = F.when(den > 0, cs["dot"].cast("double") / den).otherwise(F.lit(0.0))
    eden = F.sqrt(cs["enr"].cast("double")) * F.sqrt(cs["eng"].cast("double"))
    emb = F.coalesce(F.when(eden > 0, cs["edot"].cast("double") / eden), F.lit(0.0))
    return [bleu.alias("bleu_score"), bow.alias("cosine_similarity_spacey"),
            emb.alias("cosine_similarity_bert_embed")]


def with_text_metrics(df: DataFrame, key: str = "row_id", real: str = "real_title",
                      gen: str = "gen_title", body: str = "body_text") -> DataFrame:
    """Add the seven metric columns. Token arrays are projected once as
    columns; ROUGE sets are hash-based array functions (linear per row);
    token counts for BLEU-1, the count cosine and the hashed-embedding cosine
    come from one sorted pass (:func:`count_stats`). No shuffle, no join."""
    d = df.select("*",
                  words(real).alias("_rw"), words(gen).alias("_gw"),
                  rouge_words(body).alias("_bw"), rouge_words(gen).alias("_gr"),
                  rouge_words(real).alias("_rr"))
    d = d.select("*",
                 F.array_distinct("_bw").alias("_b1"), F.array_distinct("_gr").alias("_g1"),
                 F.array_distinct("_rr").alias("_r1"),
                 F.array_distinct(bigrams("_bw")).alias("_b2"),
                 F.array_distinct(bigrams("_gr")).alias("_g2"),
                 F.array_distinct(bigrams("_rr")).alias("_r2"))

    def ov(a, b):
        return F.size(F.array_intersect(a, b))
    # integer counts once per row; the final projection is plain arithmetic
    d = d.select(*df.columns, "_rw", "_gw", count_stats("_rw", "_gw").alias("_cs"),
                 ov("_b1", "_g1").alias("_o1g"), ov("_b2", "_g2").alias("_o2g"),
                 ov("_b1", "_r1").alias("_o1r"), ov("_b2", "_r2").alias("_o2r"),
                 F.size("_b1").alias("_nb1"), F.size("_b2").alias("_nb2"),
                 F.size("_g1").alias("_ng1"), F.size("_g2").alias("_ng2"),
                 F.size("_r1").alias("_nr1"), F.size("_r2").alias("_nr2"))
    return d.select(
        *[c for c in df.columns],
        *_count_metrics(),
        f1_from_counts("_o1g", "_nb1", "_ng1").alias("rouge1_f1_score_gen_title"),
        f1_from_counts("_o2g", "_nb2", "_ng2").alias("rouge2_f1_score_gen_title"),
        f1_from_counts("_o1r", "_nb1", "_nr1").alias("rouge1_f1_score_real_title"),
        f1_from_counts("_o2r", "_nb2", "_nr2").alias("rouge2_f1_score_real_title"))


def pair_validity(body: str = "body_text", real: str = "real_title", gen: str = "gen_title"):
    """P7 + P8 as one predicate: no empty text, and ROUGE accepts every text."""
    return non_empty_text(body, gen, real) & rouge_valid(body) & rouge_valid(gen) & rouge_valid(real)


def valid_pairs(df: DataFrame, key: str = "row_id", score: str = "Score", real: str = "Title",
                gen: str = "gen_title", body: str = "Body") -> DataFrame:
    """P7 + P8: (key, score, real_title, gen_title, body_text) rows that the
    metrics accept."""
    d = df.select(F.col(key), F.col(score).alias("score"), F.col(real).alias("real_title"),
                  F.col(gen).alias("gen_title"), F.col(body).alias("body_text"))
    # keep valid rows through a 0/1-element explode instead of a Filter: a
    # Filter would be pushed below the projection that makes ``gen`` and
    # evaluate the headline twice; the Generate keeps it computed once
    keep = F.when(pair_validity(), F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>"))
    return d.select("*", F.explode(keep).alias("_keep")).drop("_keep")


def evaluate_pairs(df: DataFrame, key: str = "row_id", score: str = "Score", real: str = "Title",
                   gen: str = "gen_title", body: str = "Body", word_vectors: DataFrame | None = None,
                   dim: int | None = None, embeddings: DataFrame | None = None) -> DataFrame:
    """M6: evaluation rows (reference column names) for valid pairs.

    ``word_vectors`` (token, vector of ``dim``) gives the word-vector similarity
    in place of the token-count one, and ``embeddings`` (key, real_vector,
    gen_vector) the sentence similarity in place of the hashed one; rows without
    vectors get 0 and NULL. Both are joined by key to the valid rows."""
    return with_vectors(with_text_metrics(valid_pairs(df, key, score, real, gen, body), key), key, word_vectors, dim, embeddings)


def with_vectors(ev: DataFrame, key: str, word_vectors: DataFrame | None = None, dim: int | None = None,
                 embeddings: DataFrame | None = None) -> DataFrame:
    """Evaluation rows with the similarities that supplied vectors give."""
    columns = ev.columns
    if word_vectors is not None:
        if not dim:
            raise ValueError("word_vectors need their dimension")
        ev = ev.drop("cosine_similarity_spacey").join(word_vector_cosine(ev, key, "real_title", "gen_title", word_vectors, dim), key)
    if embeddings is not None:
        ev = ev.drop("cosine_similarity_bert_embed").join(supplied_cosine(ev, key, embeddings), key)
    return ev.select(*columns)


def rejected_pairs(df: DataFrame, real: str = "Title", gen: str = "gen_title", body: str = "Body") -> DataFrame:
    """Count of rows P7/P8 reject (the reference printed them instead)."""
    ok = pair_validity(body, real, gen)
    return df.agg(F.sum(F.when(ok, 0).otherwise(1)).cast("bigint").alias("rejected"),
                  F.count(F.lit(1)).alias("total"))
