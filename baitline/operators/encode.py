"""Corpus vocabulary, vocabulary encoding and decoding.

The vocabulary is a top-k of token counts: explode -> partial count per
partition -> shuffle of (token, partial count) -> top-k merge. Heavy tokens
are combined map-side, so skew in token frequency does not reach the shuffle.
Its size is the ``size`` parameter, which is what makes broadcasting it safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..functions.tokens import N_RESERVED, RESERVED_TOKENS, UNK_ID, encode_text

# Largest vocabulary we broadcast; beyond it the joins shuffle on the token.
BROADCAST_VOCAB_MAX = 2_000_000


def _bcast(vocab: DataFrame, size: int) -> DataFrame:
    return F.broadcast(vocab) if size <= BROADCAST_VOCAB_MAX else vocab


def build_vocab(df: DataFrame, cols: list[str], size: int = 30_000) -> DataFrame:
    """(token, id, count): the ``size`` most frequent whitespace tokens of the
    text columns (ties by token), ids after the reserved ones."""
    # one explode over all text columns: the input is scanned once (a union
    # of one explode per column would compute ``df`` once per column)
    toks = df.select(F.explode(F.concat(*[words(c) for c in cols])).alias("token"))
    top = (toks.groupBy("token").agg(F.count(F.lit(1)).alias("count"))
           .orderBy(F.col("count").desc(), F.col("token").asc()).limit(size))
    # a window over at most ``size`` rows
    w = Window.orderBy(F.col("count").desc(), F.col("token").asc())
    return top.select("token", (F.row_number().over(w) - 1 + N_RESERVED).cast("int").alias("id"), "count")


def encode_with_vocab(df: DataFrame, key: str, col: str, vocab: DataFrame, size: int = 30_000,
                      with_names: bool = False) -> DataFrame:
    """(key, pos, token, id): tokens of ``col`` mapped through the vocabulary,
    UNK when absent. One row per token, and one of NULLs for a text without any; the vocabulary is broadcast.
    ``with_names`` also keeps ``dtoken``, the vocabulary's name of the id
    (NULL for UNK), so a decode needs no second lookup of the same table."""
    t = df.select(key, F.posexplode_outer(words(col)).alias("pos", "token"))
    cols = ["token", "id"] + ([F.col("token").alias("dtoken")] if with_names else [])
    v = _bcast(vocab.select(*cols), size)
    return t.join(v, "token", "left").withColumn("id", F.when(F.col("token").isNotNull(), F.coalesce("id", F.lit(UNK_ID))))


def ids_array(encoded: DataFrame, key: str) -> DataFrame:
    """(key, ids): encoded rows gathered back in token order. Each group is one
    text, so its size is bounded by the text."""
    return encoded.groupBy(key).agg(
        F.transform(F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "id")))), lambda s: s["id"]).alias("ids"))


def decode_ids(encoded: DataFrame, key: str, vocab: DataFrame, size: int = 30_000,
               skip_special: bool = True) -> DataFrame:
    """(key, decoded): ids back to text, reserved ids skipped (or shown
    by their names with ``skip_special=False``)."""
    names = vocab.sparkSession.createDataFrame(
        [(t, i) for i, t in enumerate(RESERVED_TOKENS)], "dtoken string, id int")
    v = vocab.select(F.col("token").alias("dtoken"), "id")
    v = v if skip_special else v.unionByName(names)
    shown = (F.col("id") >= N_RESERVED) if skip_special else F.col("id").isNotNull()
    j = encoded.select(key, "pos", "id").join(_bcast(v, size), "id", "left")
    # a text whose ids are all skipped stays, as ''
    return j.groupBy(key).agg(F.array_join(
        F.transform(F.sort_array(F.collect_list(F.when(shown, F.struct("pos", "dtoken")))), lambda s: s["dtoken"]),
        " ").alias("decoded"))


def roundtrip(df: DataFrame, key: str, col: str, vocab: DataFrame, size: int = 30_000) -> DataFrame:
    """T15 after T1b: encode with the vocabulary, decode the ids back (reserved
    ids skipped), and count unknown tokens, in one aggregation per text.
    decode(encode(x)) == x for in-vocabulary text."""
    # the id -> name lookup rides on the token -> id join (one vocabulary
    # table, one broadcast); reserved ids have no name and are skipped
    j = encode_with_vocab(df, key, col, vocab, size, with_names=True)
    return j.groupBy(key).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "dtoken"))),
                                 lambda s: s["dtoken"]), " ").alias("decoded"),
        F.coalesce(F.sum((F.col("id") == UNK_ID).cast("int")), F.lit(0)).alias("n_unk"),
        F.count("token").alias("n_tokens"))


def reencode(df: DataFrame, key: str, col: str, vocab: DataFrame, size: int = 30_000,
             out: str = "reencoded") -> DataFrame:
    """Text encoded with vocabulary A (``vocab``), decoded, and encoded
    again with the hashed vocabulary B; returns (key, decoded, ``out``)."""
    rt = roundtrip(df, key, col, vocab, size)
    return rt.select(key, "decoded", encode_text(F.col("decoded")).alias(out))
