"""Embedding near-dedup (op13): a forest of random-projection trees.

Equal vectors are one class. Each of TREES trees splits the classes again and
again by random directions: what lies on a side of the threshold goes there, and
what lies within the spill of it goes to both sides, so that a near pair seldom
parts. All pairs within a leaf are verified by cosine in double precision, and
the links found in all trees unite to components.

A tree grows in rounds. A round takes a sample of about SAMPLE classes of each
open node, fits splits on it down to cells that hold LEAF classes or less, or too
few sampled ones, and sends every class down the splits; only the cells with too
few sampled classes are open in the next round, so rounds grow with the log of
the rows. Directions come from a seed and need not be sent. If no direction
parts a cell without spilling half of it (a group of near copies), the cell is a
leaf of any size. Leaves are cut into blocks, and pairs of blocks go to separate
tasks, so no task holds more than two blocks.

No pair leaves its task: a row carries the names of all its leaves, and a pair
counts in the first leaf that it shares. Tasks send the number of links of each
class, and the least class of its component within the task.

Rows whose vector is null, empty, zero or holds a null or non-finite component
link with nothing. Vectors of different lengths are not compared. A row without
a vec_id can link others; it is kept if nothing with a vec_id is reachable.
Repeated rows give a row each and link with each other. Other columns are not
read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baitline.llm.components import components
from baitline.session import materialize

COSINE = 0.95
TREES = 8
LEAF = 512              # classes of a leaf, about; a group of near copies may be larger
BLOCK = 1024            # classes of a block of a leaf
SAMPLE = 32768          # classes from which a node's splits are fitted, about
FEWEST = 32             # sampled classes of a cell that is split
SPREAD = 16384          # classes of a task that sends them down
TRIES = 8               # directions tried for a split
MOST_SPILL = 0.5
SPLIT = np.dtype("i8,f8,i4,i4")


def _matrix(col) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in col])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)        # no overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _direction(seed: int, d: int) -> np.ndarray:
    u = np.random.Generator(np.random.PCG64(seed)).standard_normal(d)
    return u / np.sqrt((u * u).sum())


def spill(d: int) -> float:
    """A quarter of the deviation, along a random direction, of the difference
    of two unit vectors at the threshold."""
    return 0.25 * math.sqrt((2 - 2 * COSINE) / d)


def fit(x: np.ndarray, count: int, seed: int) -> list[tuple[int, float, int, int]]:
    """Splits (seed, threshold, left, right) of a tree over ``count`` rows of
    which x is a sample. A child >= 0 is a split's number, -1 a leaf, -2 a cell
    that stays open."""
    rng = np.random.Generator(np.random.PCG64(seed))
    d, share, margin = x.shape[1], count / len(x), spill(x.shape[1])
    out: list[tuple[int, float, int, int]] = []

    def cell(own: np.ndarray) -> int:
        """The number of the cell's split, or its kind."""
        if len(own) * share <= LEAF:
            return -1
        if len(own) < FEWEST:
            return -2
        best = (MOST_SPILL, 0, 0.0, None)
        for _ in range(TRIES):
            s = int(rng.integers(1 << 62))
            p = x[own] @ _direction(s, d)
            t = float(np.quantile(p, rng.uniform(0.35, 0.65)))
            # what goes to both sides, and a side that gets all is no split
            both = float((np.abs(p - t) <= margin).mean())
            if both < best[0] and (p > t + margin).any() and (p < t - margin).any():
                best = (both, s, t, p)
        if best[3] is None:
            return -1
        out.append((best[1], best[2], -1, -1))
        todo.append((len(out) - 1, own[best[3] <= best[2] + margin], own[best[3] >= best[2] - margin]))
        return len(out) - 1

    todo: list = []
    top = cell(np.arange(len(x)))
    if top < 0:
        return [(0, 0.0, top, top)]
    while todo:
        at, left, right = todo.pop()
        out[at] = (*out[at][:2], cell(left), cell(right))
    return out


def send(x: np.ndarray, splits: list) -> list[tuple[int, bool, np.ndarray]]:
    """(cell, open, rows): where the rows end."""
    margin = spill(x.shape[1])
    if splits[0][2] < 0 and splits[0][2] == splits[0][3] and splits[0][0] == 0:
        return [(0, splits[0][2] == -2, np.arange(len(x)))]
    todo, out = [(0, np.arange(len(x)))], []
    while todo:
        at, own = todo.pop()
        seed, t, *children = splits[at]
        p = x[own] @ _direction(seed, x.shape[1])
        for side, (child, there) in enumerate(zip(children, (own[p <= t + margin], own[p >= t - margin]))):
            if not len(there):
                continue
            if child >= 0:
                todo.append((child, there))
            else:
                out.append((2 * at + side + 1, child == -2, there))
    return out


def _fitter(trees: int):
    def fitted(key, pdf):
        pdf = pdf.sort_values("cid")
        x, count = _unit(_matrix(pdf.v)), int(pdf["count"].iloc[0])
        made = [fit(x, max(count, len(x)), (int(key[0]) * 131 + t) & ((1 << 63) - 1)) for t in range(trees)]
        return pd.DataFrame({"node": key[0], "tree": range(trees), "splits": [np.array(m, SPLIT).tobytes() for m in made]})

    return fitted


def _down(key, rows, own):
    """Where the rows of a share of a node end in each of its trees."""
    parts = []
    if len(rows):
        x = _unit(_matrix(rows.v))
        for tree, raw in sorted(zip(own.tree, own.splits)):
            for cell, more, there in send(x, np.frombuffer(raw, SPLIT).tolist()):
                got = rows.iloc[there]
                parts.append(pd.DataFrame({"tree": tree, "cell": cell, "cid": got.cid, "v": got.v if more else None, "more": more}))
    out = pd.concat(parts) if parts else pd.DataFrame({"tree": [], "cell": [], "cid": [], "v": [], "more": []})
    return out.assign(parent=key[0])[["parent", "tree", "cell", "cid", "v", "more"]]


def _grow(classes: DataFrame) -> DataFrame:
    """(leaf, cid) of all trees."""
    nodes = classes.select(F.col("d").cast("long").alias("node"), "cid", "v")
    leaves, turn = None, 0
    while True:
        sizes = materialize(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("count")), "nodes")
        known = nodes.join(sizes, "node")
        drawn = known.where(F.pmod(F.xxhash64("cid", F.lit(turn)), F.lit(1 << 20)) * F.col("count") < F.lit((1 << 20) * SAMPLE))

        fits = materialize(drawn.groupBy("node").applyInPandas(_fitter(TREES if turn == 0 else 1), "node long, tree int, splits binary"), "splits")
        shares = F.ceil(F.col("count") / SPREAD).cast("int")
        dealt = known.withColumn("share", F.pmod(F.xxhash64("cid"), shares).cast("int")).select("node", "share", "cid", "v")
        told = fits.join(sizes, "node").select("node", "tree", "splits", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"))

        gone = dealt.groupBy("node", "share").cogroup(told.groupBy("node", "share")).applyInPandas(
            _down, "parent long, tree int, cell int, cid long, v array<double>, more boolean")
        gone = materialize(gone.withColumn("node", F.xxhash64("parent", "tree", "cell", F.lit(turn))), "cells")
        ended = gone.where("not more").select(F.col("node").alias("leaf"), "cid")
        leaves = ended if leaves is None else leaves.union(ended)
        nodes, turn = gone.where("more").select("node", "cid", "v"), turn + 1
        if nodes.isEmpty():
            return leaves


def _verified(key, pdf):
    """(cid, links, near) of the classes of a tile that have links: links that
    count here, in rows, and the least class of the component."""
    pdf = pdf.sort_values("cid", ignore_index=True)
    leaf, i, j = key
    x, cid, copies, n = _unit(_matrix(pdf.v)), pdf.cid.to_numpy(), pdf.copies.to_numpy(), len(pdf)
    linked = x @ x.T >= COSINE
    np.fill_diagonal(linked, False)
    if i != j:
        b = pdf.b.to_numpy()
        linked &= b[:, None] != b[None, :]
    some = np.flatnonzero(linked.any(axis=1))
    linked = linked[np.ix_(some, some)]
    counted = linked.copy()
    shared: dict[int, list[int]] = {}
    for at, r in enumerate(some):
        for other in pdf.leaves.iloc[r]:
            if other < leaf:
                shared.setdefault(other, []).append(at)
    for rows in shared.values():
        if len(rows) > 1:
            counted[np.ix_(rows, rows)] = False
    root = np.full(len(some), -1)
    for at in range(len(some)):
        if root[at] < 0:
            todo, root[at] = [at], at
            while todo:
                new = np.flatnonzero(linked[todo].any(axis=0) & (root < 0))
                root[new] = at
                todo = new.tolist()
    return pd.DataFrame({"cid": cid[some], "links": (counted @ copies[some]).astype(np.int64), "near": cid[some][root]})


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row."""
    x = F.col("v")
    fine = x.isNotNull() & (F.size("v") > 0) & F.forall("v", lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < F.lit(float("inf")))) & F.exists("v", lambda a: a != 0)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vec_col).cast("array<double>"), lambda a: a + F.lit(0.0)).alias("v"))
    named = rows.withColumn("v", F.when(F.coalesce(fine, F.lit(False)), x)).select(
        "id", "v", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("k1"), F.when(F.col("v").isNotNull(), F.xxhash64(F.size("v"), F.reverse("v"))).alias("k2"))
    classes = (named.where("v is not null").groupBy("k1", "k2")
               .agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("least")))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("d", F.size("v")), "classes")
    leaves = _grow(classes)
    held = leaves.groupBy("cid").agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))     # a few for each tree
    sizes = materialize(leaves.groupBy("leaf").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "leaves")
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    tiles = (classes.join(held, "cid").select("cid", "v", "copies", "leaves", F.explode("leaves").alias("leaf")).join(sizes, "leaf")
             .withColumn("b", F.pmod(F.xxhash64("cid"), blocks).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
             .select("leaf", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "cid", "v", "copies", "leaves"))
    found = materialize(tiles.groupBy("leaf", "i", "j").applyInPandas(_verified, "cid long, links long, near long"), "links")
    label = components(found.select(F.col("cid").alias("u"), F.col("near").alias("v")).where("u <> v"))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    root = F.coalesce("root", "cid")
    known = classes.select("cid", "k1", "k2", "copies", "least").join(label.withColumnRenamed("id", "cid"), "cid", "left").withColumn("root", root)
    small = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(small, "root").join(links, "cid", "left").select(
        "k1", "k2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = named.join(known, ["k1", "k2"], "left")
    component = F.when(F.col("v").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
