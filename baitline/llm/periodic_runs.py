"""Periodic run detection (op11): tiles for each octave of periods.

A run is a stretch of words with smallest period q and at least max(12, 2q)
words that no neighbour extends. Octave P holds the periods from P to 2P - 1.
A document is cut into overlapping tiles around boundaries P words apart: a run
of such a period holds a boundary c with c + q inside, and its part in the tile
around c is two periods long at least. So a tile is solved alone: the Z-function
of the words after the boundary tells for each shift how far they agree with
themselves to the right, that of the words before it, reversed, how far to the
left; a shift q whose two reaches add up to q is a fragment of a run. The same
Z-function tells whether a divisor of q is a period, and then the fragment
belongs to the smaller one.

Before a Z-function is made, hashes of half a period are compared on either side
of the boundary for all tiles of many documents at once: one of the two halves
agrees wherever there is a run, so most tiles end there. Equal hashes only make
a tile be solved; runs come from the words themselves.

Tiles live within the task that read the document, since a table of them would
repeat each text log n times; what is shuffled are fragments, by document and
period, where those that overlap by a period are stitched. Only texts with a
fragment are joined to their runs; all others end in the task that read them.
Work grows as n log n in the words of a document, and memory with the longest.

Nulls: a null text has no words and no runs. Each input row gives one output
row; rows are told apart by doc_id, null too, and text. Other columns are not
read.
"""

from __future__ import annotations

import functools
import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from baitline.llm import words as Wd
from baitline.session import materialize

LEAST = 12              # words of a run
BATCH = 1 << 18         # words solved at once, or one document
RUNS = "array<struct<start:long,length:long,period:long>>"


def z_function(s: list) -> list[int]:
    """For each place, how many items agree with the beginning of s."""
    n, left, right = len(s), 0, 0
    z = [0] * n
    if n:
        z[0] = n
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i], left, right = k, i, i + k
    return z


@functools.lru_cache(maxsize=1 << 16)
def _prime_factors(q: int) -> tuple[int, ...]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return (*out, q) if q > 1 else tuple(out)


def solve_tile(tile: list, c: int, periods: range) -> Iterator[tuple[int, int, int]]:
    """(period, start, end) of the fragments around boundary c of a tile, whose
    smallest period is in ``periods``."""
    most = min(periods.stop - 1, len(tile) - c)
    right = z_function(tile[c:])
    # reversed: what precedes the boundary, a mark, and the tile up to c + most
    back = z_function(tile[:c][::-1] + [None] + tile[:c + most][::-1])
    for q in range(periods.start, most + 1):
        r = right[q] if c + q < len(tile) else 0
        at = c + 1 + most - q
        left = back[at] if at < len(back) else 0
        if left + r < max(q, LEAST - q):
            continue
        # the word of length q at the boundary, or at its mirror, is a power if a divisor is its period
        if any(_is_period(right, back, c, most, q, q // f, left, r) for f in _prime_factors(q)):
            continue
        yield q, c - left, c + q + r


def _is_period(right: list, back: list, c: int, most: int, q: int, d: int, left: int, r: int) -> bool:
    """d, a divisor of q, is a period of the fragment too: shifted by d, the
    words agree from its start to its end."""
    there = right[d] if d < len(right) else 0
    at = c + 1 + most - d
    return (back[at] if at < len(back) else 0) >= left and there >= q + r - d


def _octaves(longest: int) -> Iterator[tuple[int, range, int, int, int]]:
    """(boundary distance, periods, half, words of a tile before and after its
    boundary): the shortest periods in one, then an octave each."""
    if longest >= LEAST:
        yield 4, range(1, 8), 3, 12, 24
    p = 8
    while 2 * p <= longest:
        yield p, range(p, 2 * p), p // 2, 2 * p, 4 * p
        p *= 2


def _spans(h: np.ndarray, by: int) -> np.ndarray:
    """Hashes of twice ``by`` items from those of ``by``."""
    return Wd.mix(h[:-by] * Wd.MULT + h[by:])


def fragments(docs: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
    """(document, period, start, end) of the fragments of all octaves."""
    # documents end to end, each closed by a mark of its own
    size = np.array([len(d) for d in docs], np.int64)
    flat = np.concatenate([x for i, d in enumerate(docs) for x in (d, [-1 - i])])
    first = np.cumsum(size + 1) - size - 1
    h = Wd.mix(flat.astype(np.int64).view(np.uint64) + Wd.MULT)
    hashes = {1: h, 2: _spans(h, 1)}
    out = []
    for step, periods, half, before, after in _octaves(int(size.max(initial=0))):
        if half == 3:
            now = Wd.mix(hashes[2][:-1] * Wd.MULT + h[2:])
        else:
            if half not in hashes:
                hashes = {half: _spans(hashes[half // 2], half // 2)}
            now = hashes[half]
        has = np.flatnonzero(size >= max(2 * periods.start, LEAST))
        # boundaries c with c + (least period) within the document
        count = (size[has] - periods.start) // step + 1
        doc = np.repeat(has, count)
        c = first[doc] + step * (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count))
        hit = np.zeros(len(c), bool)
        for a in range(0, len(c), max(1, BATCH // len(periods))):
            own = c[a:a + max(1, BATCH // len(periods))]
            i = np.repeat(own, len(periods))
            j = i + np.tile(np.arange(periods.start, periods.stop), len(own))
            ok = j < len(now)
            got = np.zeros(len(i), bool)
            got[ok] = now[i[ok]] == now[j[ok]]
            ok = (i >= half) & (j - half < len(now))
            got[ok] |= now[i[ok] - half] == now[j[ok] - half]
            hit[a:a + len(own)] = got.reshape(len(own), -1).any(axis=1)
        for d, at in zip(doc[hit].tolist(), (c - first[doc])[hit].tolist()):
            lo = max(0, at - before)
            tile = docs[d][lo:at + after].tolist()
            out += [(d, q, lo + s, lo + e) for q, s, e in solve_tile(tile, at - lo, periods)]
    return out


def _solved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each document: text holds its words, open says that it has
    fragments; and a row for each fragment."""

    def solve(rows, ids):
        found = fragments(ids)
        open_ = {d for d, *_ in found}
        yield pd.DataFrame({"doc_id": pd.Series([i for i, *_ in rows], dtype="Int64"), "digest": [g for _, g, _ in rows],
                            "text": [t for *_, t in rows], "open": [d in open_ for d in range(len(rows))], "period": None, "start": None, "stop": None})
        for at in range(0, len(found), 1 << 16):
            part = found[at:at + (1 << 16)]
            yield pd.DataFrame({"doc_id": pd.Series([rows[d][0] for d, *_ in part], dtype="Int64"), "digest": [rows[d][1] for d, *_ in part],
                                "text": None, "open": None, "period": [x[1] for x in part], "start": [x[2] for x in part], "stop": [x[3] for x in part]})

    for pdf in frames:
        rows, ids, total, number = [], [], 0, defaultdict(itertools.count().__next__)
        for i, g, t in zip(pdf.doc_id.astype("Int64"), pdf.digest, pdf.text):
            words = t.encode("utf-8", "surrogatepass").split() if isinstance(t, str) else []
            rows.append((i, g, b" ".join(words).decode("utf-8", "surrogatepass")))
            ids.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
            total += len(words)
            if total >= BATCH:
                yield from solve(rows, ids)
                rows, ids, total, number = [], [], 0, defaultdict(itertools.count().__next__)
        if rows:
            yield from solve(rows, ids)


def _collapsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts without the words that a run holds after its first period."""
    for pdf in frames:
        texts = []
        for text, runs in zip(pdf.text, pdf.runs):
            words = text.encode("utf-8", "surrogatepass").split()
            step = np.zeros(len(words) + 1, np.int64)
            for r in runs:
                step[r["start"] + r["period"]] += 1
                step[r["start"] + r["length"]] -= 1
            kept = (np.cumsum(step[:-1]) == 0).tolist()
            texts.append(b" ".join(itertools.compress(words, kept)).decode("utf-8", "surrogatepass"))
        yield pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64"), "runs": pdf.runs, "text": texts})


def stitched(found: DataFrame) -> DataFrame:
    """(doc_id, digest, runs) of fragments (doc_id, digest, period, start, stop):
    those of a document and period that overlap by a period are one run."""
    w = Window.partitionBy("doc_id", "digest", "period").orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    parts = found.withColumn("new", F.coalesce(F.col("start") > reach - F.col("period"), F.lit(True)).cast("int"))
    parts = parts.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = parts.groupBy("doc_id", "digest", "period", "run").agg(F.min("start").alias("start"), (F.max("stop") - F.min("start")).alias("length"))
    one = F.struct("start", "period", "length")
    runs = (runs.where(F.col("length") >= F.greatest(F.lit(LEAST), 2 * F.col("period"))).groupBy("doc_id", "digest")
            .agg(F.sort_array(F.collect_list(one)).alias("runs")))      # as many as one text has
    return runs.withColumn("runs", F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, runs array<struct<start, length, period>> by start and period,
    text): text keeps the words that no run holds after its first period, joined
    by one space; never null."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text.cast("binary")).alias("digest"), text.alias("text"))
    found = materialize(rows.mapInPandas(_solved, "doc_id long, digest string, text string, open boolean, period long, start long, stop long"), "fragments")
    runs = stitched(found.where("period is not null").select("doc_id", "digest", "period", "start", "stop"))
    opened = found.where("open").select("doc_id", "digest", "text").alias("t").join(
        runs.alias("r"), F.col("t.doc_id").eqNullSafe(F.col("r.doc_id")) & F.col("t.digest").eqNullSafe(F.col("r.digest")), "left")
    opened = opened.select("t.doc_id", "t.text", F.coalesce("runs", F.array().cast(RUNS)).alias("runs"))
    return (opened.mapInPandas(_collapsed, f"doc_id long, runs {RUNS}, text string")
            .unionByName(found.where("not open").select("doc_id", F.array().cast(RUNS).alias("runs"), "text")))


def repeated_words(doc_id: Column, text: Column) -> Column:
    """The words of a text as op11 reads them, joined by one space: with h the
    crc32 of doc_id, every tenth text repeats a stretch of its words to its end."""
    # joined as one text, words stay as they are
    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")

    n = F.greatest(F.size(words), F.lit(1)).cast("long")
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    tail = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
    changed = F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(tail, F.lit(1), (n - a).cast("int")))
    again = (h % 10 == 0) & (F.size(words) > 0)
    return F.when(F.coalesce(again, F.lit(False)), F.array_join(changed, " ")).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = periodic_runs(docs.select("doc_id", repeated_words(F.col("doc_id"), F.col("text")).alias("text")))
    # greatest length, then smallest start, then smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", (-F.col("best.s")).alias("start"), F.col("best.l").alias("length"), (-F.col("best.p")).alias("period"),
        F.floor(1000 * F.col("best.l") / -F.col("best.p")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
