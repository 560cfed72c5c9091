"""Suffix-array dedup (op8): a run-length index over repeated text.

Segments at shared anchors (see ``repeats``) meet in buckets. A bucket lays its
distinct segments end to end, sorts the suffixes (by doubling, those still alike
only), takes the Burrows-Wheeler transform and keeps its runs, and of each row its run. Runs end where the symbol changes or where
the next 50 bytes do; each run's sample is the least document among its rows, so
all rows whose suffixes agree on 50 bytes are a few whole runs. Then the
segments stream backwards through the index, one LF step a byte, all segments
at once; after 50 bytes the row's runs give the matching statistic: the least
document where the 50 bytes start.

Nulls: a null text is empty; a row without a doc_id is kept whole and matches
nothing. Repeated rows (same doc_id) do not remove each other. Each input row
gives one output row; other columns are not read, so names may clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baitline.llm import repeats as R

WINDOW = 50
SEED = 20


class Bytes:
    """A text as UTF-8 bytes."""

    W = WINDOW
    __slots__ = ("raw",)

    def __init__(self, text: str):
        self.raw = text.encode("utf-8", "surrogatepass")

    def __len__(self):
        return len(self.raw)

    def slice(self, first: int, windows: int) -> bytes:
        return self.raw[first:first + windows + WINDOW - 1]

    def seeds(self, pieces, k):
        """Hash of every 20 bytes, from three overlapping 8-byte words."""
        buf = b"".join(d.raw[at:at + m] for d, at, m in pieces)
        v = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,)).copy()
        n = len(buf) - k + 1
        h = v[:n] * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        h += v[8:8 + n]
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h += v[k - 8:k - 8 + n]
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        return h, np.array([m for _, _, m in pieces])


class RunIndex:
    """Run-compressed BWT of segments with the least document of each run."""

    def __init__(self, segs: list[bytes], least: np.ndarray):
        lens = np.fromiter(map(len, segs), np.int64, len(segs))
        raw = np.frombuffer(b"\0".join(segs) + b"\0", np.uint8)
        n = len(raw)
        self.ends = np.cumsum(lens + 1) - 1
        text = raw.astype(np.uint64) + np.uint64(1)
        text[self.ends] = 0
        # suffixes by their first 7 symbols, then those that are alike by doubling until all differ
        ahead = lambda x, by: np.r_[x[by:], np.zeros(min(by, n), x.dtype)][:n]
        key = text << np.uint64(9) | ahead(text, 1)
        key = key << np.uint64(18) | ahead(key, 2)
        key = key << np.uint64(27) | ahead(key, 4) >> np.uint64(9)
        order, rank = np.argsort(key), np.empty(n, np.int64)
        h, rank28, alike, key = 7, None, np.arange(n), key[order]
        while True:
            new = np.r_[True, key[1:] != key[:-1]]
            first = np.flatnonzero(new)
            rank[order[alike]] = np.repeat(alike[first], np.diff(np.r_[first, len(alike)]))      # the group's first row
            alike = alike[~(new & np.r_[new[1:], True])]
            if h == 28 or not len(alike) and rank28 is None:
                rank28 = rank.copy()
            if not len(alike):
                break
            at = order[alike]
            key = rank[at] * np.int64(n + 1) + np.where(at + h < n, rank[np.minimum(at + h, n - 1)] + 1, 0)
            by = np.argsort(key)
            order[alike], key = at[by], key[by]
            h *= 2
        # rows whose suffixes agree on 50 symbols: 28 and the last 28 of them
        far = np.r_[rank28[22:], np.full(min(22, n), -1)][:n]
        a, b = rank28[order], far[order]
        agree = np.r_[False, (a[1:] == a[:-1]) & (b[1:] == b[:-1])]
        bwt = text[order - 1]
        cut = np.flatnonzero(np.r_[True, bwt[1:] != bwt[:-1]] | ~agree)
        doc = np.repeat(least, lens + 1)[order]
        self.sample = np.minimum.reduceat(doc, cut)                 # runs: least document
        symbol, size = bwt[cut].astype(np.uint16), np.diff(np.r_[cut, n])
        by = np.argsort(symbol, kind="stable")                      # a radix sort on 16 bits
        self.step = np.empty(len(cut), np.int64)                    # and how far LF takes a row
        self.step[by] = np.cumsum(size[by]) - size[by]
        self.step -= cut
        self.run = np.repeat(np.arange(len(cut)), size)             # of each row
        group = np.flatnonzero(~agree[cut])
        self.group_least = np.repeat(np.minimum.reduceat(self.sample, group), np.diff(np.r_[group, len(cut)]))
        row = np.empty(n, np.int64)
        row[order] = np.arange(n)
        self.end_row = row[self.ends]

    def stream(self, counts: np.ndarray) -> np.ndarray:
        """Least document of each window of each segment, flat, first window
        first. All segments step backwards together from their ends."""
        out = np.empty(int(counts.sum()), np.int64)
        last = np.cumsum(counts) - 1
        live, row = np.arange(len(counts)), self.end_row
        run = self.run[row]
        for t in range(1, WINDOW + int(counts.max())):
            row = row + self.step[run]
            run = self.run[row]
            if t >= WINDOW:
                out[last[live] - (t - WINDOW)] = self.group_least[run]
                on = counts[live] > t - WINDOW + 1
                live, row, run = live[on], row[on], run[on]
        return out


def least_documents(segs: list[bytes], least: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return RunIndex(segs, least).stream(counts) if segs else np.empty(0, np.int64)


def suffix_dedup(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary, *carry): kept is the
    bytes that no repeat covers; cutting may split a character."""

    def finish(pdf, units, gone):
        kept = [u.raw if not g.any() else np.frombuffer(u.raw, np.uint8)[~g].tobytes() for u, g in zip(units, gone)]
        out = pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64"),
                            "n_bytes": [len(u) for u in units],
                            "n_removed": [int(g.sum()) for g in gone],
                            "n_spans": [int((np.diff(np.r_[0, g.astype(np.int8)]) == 1).sum()) for g in gone],
                            "kept": kept})
        for c in carry:
            out[c] = pdf[c].to_numpy() if len(pdf) else None
        return out

    kinds = dict(docs.dtypes)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    schema += "".join(f", `{c}` {kinds[c]}" for c in carry)
    return R.remove_repeats(docs, Bytes, least_documents, WINDOW, SEED, finish, schema, carry)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
