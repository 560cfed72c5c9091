"""Text-similarity column functions (M1-M5).

Definitions (ours, fixed so Spark and the SQL oracle agree):

* BLEU-1: clipped unigram matches ``m`` over hypothesis length, times the
  brevity penalty ``exp(1 - |ref| / |hyp|)`` when ``|hyp| <= |ref|``; 0 when
  ``m`` is 0.
* ROUGE-N F1: text cut at '.', empty pieces dropped, each piece's blanks
  normalised; words are the pieces split on ' ' (a blank-only piece yields one
  '' word). N-grams are sets; F = 2pr / (p + r + 1e-8).
* Cosine: dot / (|a| |b|), 0 for a zero vector.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SENTENCE_SEP, words
from .tokens import token_hash

# Fixed values.
ROUGE_EPS = 1e-8
EMBED_DIM = 64


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable
    (a one-element ``transform``); keeps an expensive array from being
    recomputed when ``body`` refers to it inside another lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


# ---------------------------------------------------------------- ROUGE ----

def rouge_pieces(text) -> Column:
    """Non-empty '.'-separated pieces of ``text``."""
    return F.filter(F.split(_c(text), SENTENCE_SEP), lambda s: F.length(s) > 0)


def rouge_valid(text) -> Column:
    """ROUGE accepts the text: at least one non-empty piece."""
    return F.size(rouge_pieces(text)) > 0


def rouge_words(text) -> Column:
    """ROUGE word list of ``text``."""
    return F.flatten(F.transform(
        rouge_pieces(text),
        lambda s: F.when(F.size(words(s)) == 0, F.array(F.lit(""))).otherwise(words(s))))


def bigrams(ws) -> Column:
    """Adjacent word pairs as strings (words never hold a blank)."""
    w = _c(ws)
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))


def set_f1(eval_items, ref_items) -> Column:
    """F1 of two item sets, as ROUGE reports it."""
    e = F.array_distinct(_c(eval_items))
    r = F.array_distinct(_c(ref_items))
    o = F.size(F.array_intersect(e, r)).cast("double")
    p = F.when(F.size(e) > 0, o / F.size(e)).otherwise(F.lit(0.0))
    rc = F.when(F.size(r) > 0, o / F.size(r)).otherwise(F.lit(0.0))
    return F.lit(2.0) * ((p * rc) / (p + rc + F.lit(ROUGE_EPS)))


def f1_from_counts(overlap, n_eval, n_ref) -> Column:
    """ROUGE F1 from set sizes (columns of ints)."""
    o = F.col(overlap).cast("double") if isinstance(overlap, str) else overlap.cast("double")
    ne = F.col(n_eval) if isinstance(n_eval, str) else n_eval
    nr = F.col(n_ref) if isinstance(n_ref, str) else n_ref
    p = F.when(ne > 0, o / ne).otherwise(F.lit(0.0))
    r = F.when(nr > 0, o / nr).otherwise(F.lit(0.0))
    return F.lit(2.0) * ((p * r) / (p + r + F.lit(ROUGE_EPS)))


def rouge_n_f1(eval_words, ref_words, n: int) -> Column:
    """ROUGE-1 or ROUGE-2 F1 over two ROUGE word lists (M2, M3)."""
    if n == 1:
        return set_f1(eval_words, ref_words)
    if n == 2:
        return set_f1(bigrams(eval_words), bigrams(ref_words))
    raise ValueError("n must be 1 or 2")


# ------------------------------------------------------- BLEU, cosine ----

def bleu1(ref_tokens, hyp_tokens) -> Column:
    """M1 on two whitespace token arrays, from :func:`count_stats`."""
    return let(count_stats(ref_tokens, hyp_tokens), lambda cs: _bleu_from(
        cs["m"], F.size(_c(hyp_tokens)), F.size(_c(ref_tokens))))


def _bleu_from(m, lh, lr) -> Column:
    m, lh, lr = m.cast("double"), lh.cast("double"), lr.cast("double")
    bp = F.when(lh > lr, F.lit(1.0)).otherwise(F.exp(F.lit(1.0) - lr / lh))
    return F.when(m == 0, F.lit(0.0)).otherwise(m / lh * bp)


def bow_cosine(a_tokens, b_tokens) -> Column:
    """M4 stand-in: cosine of the two token-count vectors, from
    :func:`count_stats`; 0 for an empty side."""
    def cos(cs):
        den = F.sqrt(cs["nr"].cast("double") * cs["ng"].cast("double"))
        return F.when(den > 0, cs["dot"].cast("double") / den).otherwise(F.lit(0.0))
    return let(count_stats(a_tokens, b_tokens), cos)


def count_stats(ref_tokens, hyp_tokens, dim: int = EMBED_DIM) -> Column:
    """Token-count statistics of two token arrays in O(n log n), one pass:

    struct(m, dot, nr, ng, edot, enr, eng) with ``m`` = clipped matches
    ``sum_t min(c_ref, c_hyp)`` (BLEU-1), ``dot``/``nr``/``ng`` = dot product
    and squared norms of the token-count vectors, and ``edot``/``enr``/``eng``
    the same for the ``dim``-bucket hashed embedding.

    Both arrays are tagged (bucket, token, side) and sorted together, so equal
    tokens (and equal buckets) are adjacent; one ``aggregate`` walks the runs
    with scalar accumulators only (no per-element search, no array growth)."""
    def tag(arr, side):
        return F.transform(_c(arr), lambda t: F.struct(token_hash(t, dim).alias("b"), t.alias("t"),
                                                       F.lit(side).alias("s")))
    merged = F.array_sort(F.concat(tag(ref_tokens, 0), tag(hyp_tokens, 1)))
    z = F.lit(0).cast("long")
    init = F.struct(F.lit(-1).cast("long").alias("pb"), F.lit(None).cast("string").alias("pt"),
                    z.alias("cr"), z.alias("cg"), z.alias("er"), z.alias("eg"),
                    z.alias("m"), z.alias("dot"), z.alias("nr"), z.alias("ng"),
                    z.alias("edot"), z.alias("enr"), z.alias("eng"))

    def flush_tok(a, c):
        return F.when(c, F.struct(
            (a["m"] + F.least(a["cr"], a["cg"])).alias("m"), (a["dot"] + a["cr"] * a["cg"]).alias("dot"),
            (a["nr"] + a["cr"] * a["cr"]).alias("nr"), (a["ng"] + a["cg"] * a["cg"]).alias("ng"))
        ).otherwise(F.struct(a["m"].alias("m"), a["dot"].alias("dot"), a["nr"].alias("nr"), a["ng"].alias("ng")))

    def flush_bkt(a, c):
        return F.when(c, F.struct(
            (a["edot"] + a["er"] * a["eg"]).alias("edot"), (a["enr"] + a["er"] * a["er"]).alias("enr"),
            (a["eng"] + a["eg"] * a["eg"]).alias("eng"))
        ).otherwise(F.struct(a["edot"].alias("edot"), a["enr"].alias("enr"), a["eng"].alias("eng")))

    def step(a, x):
        new_b = x["b"] != a["pb"]
        new_t = new_b | a["pt"].isNull() | (x["t"] != a["pt"])
        ft, fb = flush_tok(a, new_t), flush_bkt(a, new_b)
        is_r = (x["s"] == 0).cast("long")
        is_g = (x["s"] == 1).cast("long")
        keep_t = F.when(new_t, z).otherwise(F.lit(1).cast("long"))
        keep_b = F.when(new_b, z).otherwise(F.lit(1).cast("long"))
        return F.struct(x["b"].alias("pb"), x["t"].alias("pt"),
                        (a["cr"] * keep_t + is_r).alias("cr"), (a["cg"] * keep_t + is_g).alias("cg"),
                        (a["er"] * keep_b + is_r).alias("er"), (a["eg"] * keep_b + is_g).alias("eg"),
                        ft["m"].alias("m"), ft["dot"].alias("dot"), ft["nr"].alias("nr"), ft["ng"].alias("ng"),
                        fb["edot"].alias("edot"), fb["enr"].alias("enr"), fb["eng"].alias("eng"))

    def finish(a):
        ft, fb = flush_tok(a, F.lit(True)), flush_bkt(a, F.lit(True))
        return F.struct(ft["m"].alias("m"), ft["dot"].alias("dot"), ft["nr"].alias("nr"), ft["ng"].alias("ng"),
                        fb["edot"].alias("edot"), fb["enr"].alias("enr"), fb["eng"].alias("eng"))

    return F.aggregate(merged, init, step, finish)


def hashed_embedding(tokens, dim: int = EMBED_DIM) -> Column:
    """I4 stand-in sentence embedding: counts of token hash buckets."""
    bucket = F.transform(_c(tokens), lambda t: token_hash(t, dim).cast("int"))
    # bind the bucket ids once (a one-element transform acts as a let), so the
    # hashes are not recomputed for each of the ``dim`` components
    return F.element_at(F.transform(F.array(bucket), lambda b: F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda j: F.size(F.filter(b, lambda x: x == j)).cast("double"))), 1)


def array_cosine(a, b) -> Column:
    """M5: cosine of two numeric arrays (float32 widened to double first);
    NULL when either vector is zero."""
    x = F.transform(_c(a), lambda v: v.cast("double"))
    y = F.transform(_c(b), lambda v: v.cast("double"))
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    nx = F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)
    ny = F.aggregate(y, F.lit(0.0), lambda s, v: s + v * v)
    den = F.sqrt(nx) * F.sqrt(ny)
    return F.when(den > 0, dot / den)
