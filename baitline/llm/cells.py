"""A stated query set against all rows, in blocks.

Candidates fall into ``n_c`` hash blocks, queries into ``n_q``. A cell is one
block of each: candidates are sent once for each query block, queries once for
each candidate block, and the two meet in a cogroup on the cell. So a task holds
at most one block of each, whatever the totals, and no key is hot: blocks are by
hash of the row. Each cell returns at most k rows a query; the rank over cells
is a window whose partial limit runs before its shuffle.

Rows: id null, vector null, empty, or with a null or non-finite component take
no part. Vectors of different lengths are not compared. Rows with the query's id
are its own. Repeated rows are candidates each; equal query rows are one query.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES = 16384      # a block's rows, about
QUERIES = 2048
LEAST_BLOCKS = 16


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array<double>, d) of the rows that take part."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
            .where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
            .where(F.coalesce(fine, F.lit(False))).withColumn("d", F.size("v")))


def matrix(col) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in col])


def top_in_cells(rows: DataFrame, k: int, every: int, cell: Callable, ascending: bool, score: str) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each row whose
    id is divisible by ``every``. ``cell(query ids, queries, candidate ids,
    candidates, d)`` yields arrays (query index, candidate index, score) that
    hold each query's k best of the cell at least, ties to smaller ids."""
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("id") % every == 0, 1)).alias("q")).first()
    n_c = max(LEAST_BLOCKS, math.ceil(n["n"] / CANDIDATES))
    n_q = max(1, math.ceil(n["q"] / QUERIES))
    # equal queries are one; of one id, different vectors are numbered by their hash
    queries = rows.where(F.col("id") % every == 0).withColumn("key", F.xxhash64("v")).dropDuplicates(["id", "key", "v"])
    q = queries.select("id", "v", "d", "key", F.pmod(F.xxhash64("id", "v"), F.lit(n_q)).alias("qb"),
                       F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_c - 1).cast("long"))).alias("cb"))
    c = rows.select("id", "v", "d", F.pmod(F.xxhash64("id", "v"), F.lit(n_c)).alias("cb"),
                    F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_q - 1).cast("long"))).alias("qb"))

    def one(key, qs, cs):
        out = []
        for d, own in qs.groupby("d"):
            there = cs[cs.d == d]
            if not len(there):
                continue
            own, there = own.sort_values(["id", "key"]), there.sort_values("id", kind="stable")
            i, j, s = cell(own.id.to_numpy(), matrix(own.v), there.id.to_numpy(), matrix(there.v), int(d))
            out.append(pd.DataFrame({"query_id": own.id.to_numpy()[i], "key": own.key.to_numpy()[i],
                                     "vec_id": there.id.to_numpy()[j], "score": s}))
        if out:
            return pd.concat(out)
        return pd.DataFrame({"query_id": np.empty(0, np.int64), "key": np.empty(0, np.int64),
                             "vec_id": np.empty(0, np.int64), "score": np.empty(0, "float64" if score == "double" else "int64")})

    found = q.groupBy("cb", "qb").cogroup(c.groupBy("cb", "qb")).applyInPandas(
        one, f"query_id long, key long, vec_id long, score {score}")
    order = [F.col("score").asc() if ascending else F.col("score").desc(), F.col("vec_id").asc()]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "key").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def k_best(i: np.ndarray, j: np.ndarray, s: np.ndarray, ids: np.ndarray, k: int, ascending: bool):
    """The k best of each query of the pairs, ties to smaller ids."""
    order = np.lexsort((ids[j], s if ascending else -s, i))
    i, j, s = i[order], j[order], s[order]
    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.empty(0, np.int64)
    place = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
    return i[place < k], j[place < k], s[place < k]
