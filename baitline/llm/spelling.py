"""Spelling variant grouping (op12): dense prefix-suffix tiles.

Two words are near if one inserted, deleted or replaced code point tells them
apart. Let m be the length of the shorter one, cut into four pieces: the edit
lies in one piece, so the words share all before it and all after it. A tile
holds the words of length m and m + 1 with the same prefix and suffix around the
same piece; a word is in at most eight. In a tile, padded code-point matrices,
one from the front and one from the back, compare the words of two blocks: they
are near if common prefix plus common suffix reach the longer length minus one.
A pair that shares several tiles counts in the first.

A tile of many words is cut into blocks, and its block pairs go to separate
tasks, so no task holds more than two blocks whatever the tile. Tasks send for
each word the number of near words and the best of them, never the pairs.

Nulls: a null word takes no part; rows of one word are added up. A null text has
no words; a row without a doc_id has all its words as they stand. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from baitline.session import materialize

PIECES = 4
BLOCK = 512             # words of a block
CELLS = 1 << 22         # code points of a block's matrix, and of a step of comparisons
LETTERS = "([A-Za-zÀ-ÿ]+)"


def _posts(words: DataFrame) -> DataFrame:
    """(word, n, m, piece, key): a word under each prefix and suffix."""
    roles = F.array(*[F.struct((F.length("word") - r).alias("m"), F.lit(k).alias("piece")) for r in (0, 1) for k in range(PIECES)])
    m, k = F.col("at.m"), F.col("at.piece")
    front, back = F.floor(m * k / PIECES).cast("int"), (m - F.floor(m * (k + 1) / PIECES)).cast("int")
    key = F.xxhash64(m, k, F.substr("word", F.lit(1), front), F.right("word", back))
    return (words.select("word", "n", F.explode(roles).alias("at")).where(m > 0)
            .select("word", "n", m.alias("m"), k.alias("piece"), key.alias("key")))


def _tiles(posts: DataFrame) -> DataFrame:
    """The posts in tiles (key, i, j) of two blocks, or of one (i = j)."""
    block = F.greatest(F.lit(2), F.least(F.lit(BLOCK), F.floor(F.lit(CELLS) / (F.col("m") + 1))))
    large = (posts.groupBy("key", "m").agg(F.count(F.lit(1)).alias("c")).withColumn("blocks", F.ceil(F.col("c") / block))
             .where("blocks > 1").select("key", F.col("blocks").cast("int")))
    own = posts.join(materialize(large, "tiles").groupBy("key").agg(F.max("blocks").alias("blocks")), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = own.withColumn("b", F.pmod(F.xxhash64("word"), "blocks").cast("int"))
    own = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return own.select("word", "n", "m", "piece", "key", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))


def _whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of whole tiles of one m, from rows in the order (m, key, piece, i, j);
    a run holds about CELLS code points, or one tile."""
    held: list[pd.DataFrame] = []
    tile = ["m", "key", "piece", "i", "j"]

    def cut(pdf, last):
        v = pdf[tile].to_numpy()
        new = np.r_[True, (v[1:] != v[:-1]).any(axis=1)]
        starts = np.flatnonzero(new)
        end = len(pdf) if last else starts[-1]
        at = 0
        while at < end:
            m = v[at, 0]
            stop = min(end, int(np.searchsorted(v[:, 0], m, "right")), at + max(1, CELLS // (4 * (int(m) + 1))))
            if stop < end and not new[stop]:        # to the end of the tile
                stop = int(starts[np.searchsorted(starts, stop)]) if stop < starts[-1] else end
            yield pdf.iloc[at:min(stop, end)]
            at = min(stop, end)
        held[:] = [pdf.iloc[end:]] if end < len(pdf) else []

    for pdf in frames:
        if len(pdf):
            held.append(pdf)
        if sum(map(len, held)) >= 1 << 16:
            yield from cut(pd.concat(held, ignore_index=True), False)
    if held:
        yield from cut(pd.concat(held, ignore_index=True), True)


def _matrix(words: list[str], width: int) -> np.ndarray:
    return np.array(words, f"<U{width}").view(np.uint32).reshape(len(words), width)


def _common(a: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Columns on which rows i and j agree before they first differ."""
    differ = a[i] != a[j]
    first = differ.argmax(axis=1)
    return np.where(differ[np.arange(len(i)), first], first, a.shape[1])


def _near_pairs(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs (row, row) of whole tiles of one m."""
    m = int(pdf.m.iloc[0])
    words = pdf.word.tolist()
    size = np.fromiter(map(len, words), np.int64, len(words))
    front, back = _matrix(words, m + 1), _matrix([w[::-1] for w in words], m + 1)
    v = pdf[["key", "piece", "i", "j"]].to_numpy()
    starts = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]).any(axis=1)])
    ends = np.repeat(np.r_[starts[1:], len(v)], np.diff(np.r_[starts, len(v)]))
    own, block, piece = size == m, pdf.b.to_numpy(), v[:, 1]
    crossed = v[:, 2] != v[:, 3]
    others = ends - np.arange(len(v)) - 1
    edges = np.array([m * k // PIECES for k in range(PIECES + 1)])
    done, total = 0, np.cumsum(others)
    while done < len(v):
        stop = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + max(1, CELLS // (m + 1)), "right")))
        count = others[done:stop]
        i = np.repeat(np.arange(done, stop), count)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        done = stop
        use = (own[i] | own[j]) & (~crossed[i] | (block[i] != block[j]))
        i, j = i[use], j[use]
        if not len(i):
            continue
        least, most = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        p, s = np.minimum(_common(front, i, j), least), np.minimum(_common(back, i, j), least)
        near = p + s >= most - 1
        i, j, p, s = i[near], j[near], p[near], s[near]
        first = ((p[:, None] >= edges[:-1]) & (s[:, None] >= m - edges[1:])).argmax(axis=1)
        once = first == piece[i]
        yield i[once], j[once]


def _links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, near, best): of the tiles here, for each word how many near words
    it has and (-n, word) of the most frequent."""
    for pdf in _whole(frames):
        n, words = pdf.n.to_numpy(), pdf.word.to_numpy()
        pairs = list(_near_pairs(pdf))
        a = np.concatenate([np.r_[i, j] for i, j in pairs] or [np.empty(0, np.int64)])
        if not len(a):
            continue
        b = np.concatenate([np.r_[j, i] for i, j in pairs])
        out = pd.DataFrame({"word": words[a], "least": -n[b], "other": words[b]}).sort_values(["word", "least", "other"], kind="stable")
        got = out.groupby("word", sort=False).agg(near=("other", "size"), least=("least", "first"), other=("other", "first")).reset_index()
        yield got[["word", "near", "least", "other"]]


def variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of (word, n): form is the near word
    of largest n (ties: the smallest) if that is twice the word's at least; root
    is the last form reached."""
    words = materialize(words.where("word is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n")), "words")
    tiles = _tiles(_posts(words)).repartition("m", "key", "piece", "i", "j").sortWithinPartitions("m", "key", "piece", "i", "j")
    found = (tiles.mapInPandas(_links, "word string, near long, least long, other string").groupBy("word")
             .agg(F.sum("near").alias("n_near"), F.min(F.struct("least", "other")).alias("best")))
    formed = words.join(found, "word", "left")
    strong = -F.col("best.least") >= 2 * F.col("n")
    out = materialize(formed.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.other")).alias("form"),
                                    F.when(strong, -F.col("best.least")).alias("form_n")), "forms")
    root = roots(out.where("form is not null").select("word", "form"))
    return (out.join(root, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) by pointer jumps. n doubles with each form, so a chain has at
    most log2(largest n) words, and the number of rounds is the log of that."""
    at = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        hop = at.select(F.col("word").alias("root"), F.col("root").alias("to"))
        new = materialize(at.join(hop, "root", "left").select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")), "roots")
        if new.where("moved").isEmpty():
            return new.select("word", "root")
        at = new.select("word", "root")


def misspelt(doc_id: Column, word: Column) -> Column:
    """The word as op12 reads it: where 97 divides the crc32 of
    ``<doc_id>:<word>``, the code point at crc32 % length is deleted."""
    h = F.coalesce(F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), word).cast("binary")), F.lit(1))
    at = (h % F.length(word)).cast("int")
    cut = F.concat(F.substr(word, F.lit(1), at), F.substr(word, at + 2))
    return F.when(h % 97 == 0, cut).otherwise(word)


def word_counts(docs: DataFrame, least_length: int = 5, least_n: int = 3) -> DataFrame:
    """(word, n): the letter runs of whole texts, A-Z in lower case, as
    ``misspelt`` leaves them."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.translate(F.col("text").cast("string"), upper, lower), F.lit(LETTERS), 1)).alias("run"))
    words = runs.select(misspelt(F.col("doc_id"), F.col("run")).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
