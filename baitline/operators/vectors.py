"""Similarities from vector tables (M4, M5).

``word_vector_cosine`` is the similarity of two texts by the means of their word
vectors: tokens are counted for each row, counted tokens meet the (token,
vector) table by an equi-join, and the two means are sums of one partial
aggregate. ``supplied_cosine`` takes ready embeddings by key. Neither table is
forced into a broadcast; a token that a third of the rows hold is one row a text
and is split by AQE's skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import array_cosine
from ..functions.text import words


def _cosine_of_sums(dim: int) -> Column:
    """Cosine of sums a0.. and b0..; 0 where a side has no known word."""
    a, b = ([F.col(f"{s}{i}") for i in range(dim)] for s in "ab")

    def dot(x, y):
        return sum((p * q for p, q in zip(x, y)), F.lit(0.0))

    den = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(den > 0, dot(a, b) / den).otherwise(F.lit(0.0))


def word_vector_cosine(df: DataFrame, key: str, real: str, gen: str, vectors: DataFrame, dim: int,
                       out: str = "cosine_similarity_spacey") -> DataFrame:
    """(key, out) for each row: ``vectors`` is (token, vector array of ``dim``),
    a token once. Words without a vector count as zero vectors, so a text of
    none gives 0. ``key`` is unique."""
    def of(text, side):
        return F.transform(words(text), lambda t: F.struct(t.alias("token"), F.lit(side).alias("side")))

    tokens = df.select(F.col(key).alias("_key"), F.explode(F.concat(of(real, 0), of(gen, 1))).alias("t")).groupBy("_key", "t.token").agg(
        F.count(F.when(F.col("t.side") == 0, 1)).alias("nr"), F.count(F.when(F.col("t.side") == 1, 1)).alias("ng"))
    known = tokens.join(vectors.select("token", F.col("vector").cast("array<double>").alias("v")), "token")
    sums = known.groupBy("_key").agg(*[F.sum(F.col(n) * F.get("v", F.lit(i))).alias(f"{s}{i}") for s, n in (("a", "nr"), ("b", "ng")) for i in range(dim)])
    got = sums.select("_key", _cosine_of_sums(dim).alias(out))
    return df.select(F.col(key)).join(got, F.col(key) == F.col("_key"), "left").select(key, F.coalesce(out, F.lit(0.0)).alias(out))


def supplied_cosine(df: DataFrame, key: str, embeddings: DataFrame, real: str = "real_vector", gen: str = "gen_vector",
                    out: str = "cosine_similarity_bert_embed") -> DataFrame:
    """(key, out) for each row: the cosine of the two vectors that
    ``embeddings`` (key, real, gen) holds for it; NULL for a row without, or
    with a zero vector."""
    got = embeddings.select(F.col(key).alias("_key"), array_cosine(real, gen).alias(out))
    return df.select(F.col(key)).join(got, F.col(key) == F.col("_key"), "left").select(key, out)
