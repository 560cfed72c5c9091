"""Substring dedup (op7): 13-word windows met at winnowed word anchors.

Every 13-word window holds a winnowed 5-word anchor. Documents that share an
anchor meet in its bucket; there all windows around it are grouped by their
words, in place of an extension word by word, and a window that a smaller
document has too is a match. Adjacent matches unite to the maximal repeats,
whose words are removed. See ``repeats`` for how blocks and buckets talk.

Nulls: a null text has no words; a row without a doc_id is kept whole and
matches nothing. Repeated rows (same doc_id) do not remove each other. Each
input row gives one output row; other columns are not read, so names may clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from baitline.llm import repeats as R
from baitline.llm import words as Wd

WINDOW = 13
SEED = 5


class Words:
    """A text as words, joined by one space; words are what lies between the
    characters 0x20 and 0x09-0x0D."""

    W = WINDOW
    __slots__ = ("canon", "starts", "ends")

    def __init__(self, text: str):
        self.canon = Wd.canonical(text)
        gaps = np.flatnonzero(np.frombuffer(self.canon, np.uint8) == 32)
        self.starts = np.r_[0, gaps + 1] if self.canon else np.empty(0, np.int64)
        self.ends = np.r_[gaps, len(self.canon)] if self.canon else np.empty(0, np.int64)

    def __len__(self):
        return len(self.starts)

    def slice(self, first: int, windows: int) -> bytes:
        return self.canon[self.starts[first]:self.ends[first + windows + WINDOW - 2]]

    def seeds(self, pieces, k):
        bufs = [d.canon[d.starts[at]:d.ends[at + m - 1]] for d, at, m in pieces]
        out = Wd.gram_hashes(Wd.word_hashes(b" ".join(bufs)), k)
        return out, np.array([m for _, _, m in pieces])

    def kept(self, gone: np.ndarray) -> bytes:
        if not gone.any():
            return self.canon
        edge = np.flatnonzero(np.diff(np.r_[True, gone, True].astype(np.int8)))
        return b" ".join(self.canon[self.starts[a]:self.ends[b - 1]] for a, b in zip(edge[::2], edge[1::2]))


def extend(segs: list[bytes], least: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Least document of each window of each segment; windows are grouped byte
    for byte."""
    extents = []
    for seg, c in zip(segs, counts.tolist()):
        gaps = [-1, *np.flatnonzero(np.frombuffer(seg, np.uint8) == 32).tolist(), len(seg)]
        extents += [seg[gaps[a] + 1:gaps[a + WINDOW]] for a in range(c)]
    doc = np.repeat(least, counts).tolist()
    first: dict[bytes, int] = {}
    for e, d in zip(extents, doc):
        if d < first.get(e, 1 << 63):
            first[e] = d
    return np.fromiter((first[e] for e in extents), np.int64, len(extents))


def substring_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, text): text keeps the words that no repeat
    covers, joined by one space."""

    def finish(pdf, units, gone):
        return pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64"),
                             "n_words": [len(u) for u in units],
                             "n_removed": [int(g.sum()) for g in gone],
                             "text": [u.kept(g).decode("utf-8", "surrogatepass") for u, g in zip(units, gone)]})

    return R.remove_repeats(docs, Words, extend, WINDOW, SEED, finish,
                            "doc_id long, n_words long, n_removed long, text string")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
