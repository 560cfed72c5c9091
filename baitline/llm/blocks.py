"""Documents in hash blocks, and questions of blocks answered by key buckets.

A block is a hash share of the documents (about ``block_bytes`` of text), so a
hot source or a group of copies spreads over all blocks. A block asks key
buckets about what its documents hold: it sends one packed row for each bucket,
with every key at most once, however many of its documents share the key. The
buckets answer with packed rows, and a cogroup brings the answers back to the
block. So a key that a third of all documents hold costs one entry per block.

Both sides are a pure function of the block's rows, taken in a fixed order, so
a task that runs again after a lost executor makes the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 8 << 20
LEAST_BLOCKS = 32


def blocked(docs: DataFrame, carry: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """(block, doc_id, text, *carry) and the number of blocks. The number
    comes from the bytes of all texts, one aggregate row."""
    total = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    n = max(LEAST_BLOCKS, math.ceil(total / block_bytes))
    out = docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("block"),
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        *carry)
    return out, n


def in_order(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows of a block by doc_id, then text: the order does not depend on how
    the shuffle delivered them (rows equal in both are interchangeable)."""
    return pdf.sort_values(["doc_id", "text"], na_position="last", kind="stable", ignore_index=True)


def asked(blocks: DataFrame, ask: Callable, answers: DataFrame | None = None) -> DataFrame:
    """(bucket, block, payload): what each block asks. ``ask(pdf[, answered])``
    yields (bucket, payload bytes); ``answered`` is {bucket: payload} of an
    earlier round, if one is given."""
    schema = "bucket int, block int, payload binary"

    def rows(block, found):
        found = list(found)
        return pd.DataFrame({"bucket": pd.Series([b for b, _ in found], dtype="int32"),
                             "block": pd.Series([block] * len(found), dtype="int32"),
                             "payload": pd.Series([p for _, p in found], dtype="object")})

    if answers is None:
        return blocks.groupBy("block").applyInPandas(
            lambda key, pdf: rows(key[0], ask(in_order(pdf))), schema)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        lambda key, pdf, a: rows(key[0], ask(in_order(pdf), dict(zip(a.bucket, a.payload)))), schema)


def answered(questions: DataFrame, answer: Callable) -> DataFrame:
    """(block, bucket, payload): ``answer(payloads in block order)`` gives one
    answer for each payload."""

    def one(key, pdf):
        pdf = pdf.sort_values("block", ignore_index=True)
        return pd.DataFrame({"block": pdf.block, "bucket": pdf.bucket, "payload": answer(list(pdf.payload))})

    return questions.groupBy("bucket").applyInPandas(one, "block int, bucket int, payload binary")


def finished(blocks: DataFrame, answers: list[DataFrame], finish: Callable, schema: str) -> DataFrame:
    """``finish(pdf, {bucket: payload}, ...)`` gives the block's result; one
    dict for each round of answers."""
    tagged, turns = None, len(answers)
    for i, a in enumerate(answers):
        a = a.withColumn("turn", F.lit(i))
        tagged = a if tagged is None else tagged.unionByName(a)

    def one(key, pdf, a):
        if not len(pdf):
            return finish(pdf, *({} for _ in range(turns)))
        return finish(in_order(pdf), *(dict(zip(a.bucket[a.turn == i], a.payload[a.turn == i]))
                                       for i in range(turns)))

    return blocks.groupBy("block").cogroup(tagged.groupBy("block")).applyInPandas(one, schema)
