"""Approximate nearest neighbours (op3): int8 product tiles, then floats.

Within a cell (see ``cells``) every vector is written as scale * int8 vector.
Tiles of int8 products give the distance of the quantised vectors; the length of
what quantising left out of each of the two bounds how far the true distance is
from it. A pair whose least possible distance is above the k-th smallest
greatest possible one cannot be among the k nearest; the others are computed
anew on the original doubles, and a heap keeps each query's k nearest. The
bounds are proven, so the result is exact (recall 1).

Edge cases: see ``cells``; zero vectors take no part. Distances add squares in
component order; one that overflows a double is infinite and sorts last.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baitline.llm import cells

TOP = 10
TILE = 2048


def quantise(m: np.ndarray):
    """int8 values (as floats: products of int8 are exact in them), their
    scale, the length of the quantised vector and of what it leaves out."""
    scale = np.abs(m).max(axis=1) / 127
    small = np.rint(m / np.maximum(scale, 1e-300)[:, None])
    back = small * scale[:, None]
    kind = np.float32 if m.shape[1] <= 1000 else np.float64
    return small.astype(np.int8).astype(kind), scale, np.sqrt((back * back).sum(axis=1)), np.sqrt(((m - back) ** 2).sum(axis=1))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, squares added in component order."""
    total = np.zeros(len(a))
    for x in range(a.shape[1]):
        total += (a[:, x] - b[:, x]) ** 2
    return np.sqrt(total)


def search_cell(q_ids, q, c_ids, c, k):
    qs, q_scale, q_len, q_err = quantise(q)
    cs, c_scale, c_len, c_err = quantise(c)
    kth = np.full((len(q), k), np.inf)
    heaps: list[list] = [[] for _ in q]
    near = []
    with np.errstate(all="ignore"):
        for at in range(0, len(c), TILE):
            t = slice(at, at + TILE)
            dot = (qs @ cs[t].T).astype(np.float64) * q_scale[:, None] * c_scale[None, t]
            mid = np.sqrt(np.maximum(q_len[:, None] ** 2 + c_len[None, t] ** 2 - 2 * dot, 0))
            # rounding of the sum of squares, as a distance
            room = 1e-7 * (q_len[:, None] + c_len[None, t]) + q_err[:, None] + c_err[None, t]
            other = q_ids[:, None] != c_ids[None, t]
            most = np.where(other & ~np.isnan(mid), mid + room, np.inf)
            kth = np.partition(np.concatenate([kth, most], axis=1), k - 1, axis=1)[:, :k]
            limit = kth.max(axis=1)
            a, b = np.nonzero(other & ~((mid - room) > limit[:, None]))
            near.append((a, b + at, (mid - room)[a, b]))
        limit = kth.max(axis=1)
        for a, b, least in near:
            keep = ~(least > limit[a])
            a, b = a[keep], b[keep]
            for i, j, s in zip(a.tolist(), b.tolist(), distances(q[a], c[b]).tolist()):
                item = (-s, -int(c_ids[j]), j)
                if len(heaps[i]) < k:
                    heapq.heappush(heaps[i], item)
                elif item > heaps[i][0]:
                    heapq.heapreplace(heaps[i], item)
    flat = [(i, j, -s) for i, h in enumerate(heaps) for s, _, j in h]
    i, j, s = zip(*flat) if flat else ((), (), ())
    return np.array(i, np.int64), np.array(j, np.int64), np.array(s, np.float64)


def nearest(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = TOP, every: int = 100) -> DataFrame:
    rows = cells.valid_vectors(df, id_col, vec_col).where(F.exists("v", lambda x: x != 0))
    return cells.top_in_cells(rows, k, every, lambda qi, q, ci, c, d: search_cell(qi, q, ci, c, k), True, "double")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
