"""Exact top-k search (op1): norm-sorted inner products with SVD partial sums.

Vectors are scaled to whole numbers, floor(1024 x). The right singular vectors
of all vectors (from the d x d matrix of their products, summed in Spark) rotate
queries and candidates, so that the first few coordinates hold most of a
product. Within a cell (see ``cells``) candidates come by descending length, in
chunks. A query whose length times the chunk's longest is below its k-th best
score is done; else the partial sum over the first coordinates plus the product
of the residual lengths (Cauchy-Schwarz) bounds each score, and only pairs whose
bound reaches the k-th best are multiplied in full, on the whole numbers.

Edge cases: see ``cells``; a component whose scaled value overflows a double
counts as non-finite. Scores beyond a long are cut to its range. An empty table
or no query gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baitline.llm import cells

SCALE = 1024.0
TOP = 10
CHUNK = 1024
LONG = 2 ** 63 - 1


def rotations(rows: DataFrame) -> dict[int, np.ndarray]:
    """{d: d x d rotation, strongest direction first}. Tasks send one d x d
    matrix for each length; its size does not grow with the rows."""

    def gram(frames):
        sums: dict[int, np.ndarray] = {}
        for pdf in frames:
            for d, own in pdf.groupby("d"):
                m = cells.matrix(own.v)
                m /= max(np.abs(m).max(), 1e-300)      # only directions matter
                sums[int(d)] = sums.get(int(d), 0) + m.T @ m
        yield pd.DataFrame([{"d": d, "i": i, "row": r.tolist()} for d, s in sums.items() for i, r in enumerate(s)],
                           columns=["d", "i", "row"])

    parts = rows.select("v", "d").mapInPandas(gram, "d int, i int, row array<double>")
    sums = (parts.select("d", "i", F.posexplode("row").alias("j", "x")).groupBy("d", "i", "j").agg(F.sum("x").alias("x"))
            .orderBy("d", "i", "j").collect())
    out: dict[int, np.ndarray] = {}
    for r in sums:
        out.setdefault(r["d"], np.zeros((r["d"], r["d"])))[r["i"], r["j"]] = r["x"]
    return {d: np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy() for d, m in out.items()}


def search_cell(q_ids, q, c_ids, c, rotation, k):
    """Each query's k best of the cell: (query index, candidate index, score)."""
    q, c = np.floor(SCALE * q), np.floor(SCALE * c)
    if max(np.abs(q).max(), 1) * max(np.abs(c).max(), 1) * q.shape[1] >= 2.0 ** 53:
        return whole_cell(q_ids, q, c_ids, c, k)
    c_len, q_len = np.linalg.norm(c, axis=1), np.linalg.norm(q, axis=1)
    by = np.argsort(-c_len, kind="stable")
    h = max(1, q.shape[1] // 4)
    qr, cr = q @ rotation, c[by] @ rotation
    q_rest, c_rest = np.linalg.norm(qr[:, h:], axis=1), np.linalg.norm(cr[:, h:], axis=1)
    kth = np.full(len(q), -np.inf)
    best = np.full((len(q), k), -np.inf)
    out = []
    for at in range(0, len(by), CHUNK):
        own = by[at:at + CHUNK]
        # bounds are doubles: leave room for their rounding
        live = np.flatnonzero(q_len * c_len[own[0]] * (1 + 1e-9) + 1 >= kth)
        if not len(live):
            break
        bound = qr[live, :h] @ cr[at:at + CHUNK, :h].T + q_rest[live, None] * c_rest[None, at:at + CHUNK]
        room = 1e-9 * q_len[live] * c_len[own[0]] + 1
        take = (bound + room[:, None] >= kth[live, None]) & (q_ids[live, None] != c_ids[None, own])
        if take.mean() > 0.2:
            score = np.where(take, q[live] @ c[own].T, -np.inf)
        else:
            score = np.full(take.shape, -np.inf)
            a, b = np.nonzero(take)
            score[a, b] = np.einsum("ij,ij->i", q[live[a]], c[own[b]])
        best[live] = -np.partition(-np.concatenate([best[live], score], axis=1), k - 1, axis=1)[:, :k]
        kth[live] = best[live].min(axis=1)
        a, b = np.nonzero(take & (score >= kth[live, None]))
        out.append((live[a], own[b], score[a, b]))
    i, j, s = (np.concatenate(x) for x in zip(*out))
    keep = s >= kth[i]
    i, j, s = cells.k_best(i[keep], j[keep], s[keep], c_ids, k, False)
    return i, j, s.astype(np.int64)


def whole_cell(q_ids, q, c_ids, c, k):
    """Products too large for doubles: whole numbers of any size."""
    ci = [[int(x) for x in r] for r in c]
    i, j, s = [], [], []
    for a, r in enumerate(q):
        r = [int(x) for x in r]
        scores = sorted((-max(-LONG - 1, min(LONG, sum(x * y for x, y in zip(r, t)))), int(c_ids[b]), b)
                        for b, t in enumerate(ci) if c_ids[b] != q_ids[a])[:k]
        for x, _, b in scores:
            i.append(a), j.append(b), s.append(-x)
    return np.array(i, np.int64), np.array(j, np.int64), np.array(s, np.int64)


def exact_topk(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = TOP, every: int = 100) -> DataFrame:
    rows = cells.valid_vectors(df, id_col, vec_col)
    rows = rows.where(F.forall("v", lambda x: F.abs(x * SCALE) < F.lit(float("inf"))))
    turn = rotations(rows)
    return cells.top_in_cells(rows, k, every, lambda qi, q, ci, c, d: search_cell(qi, q, ci, c, turn[d], k), False, "long")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
