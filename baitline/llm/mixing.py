"""Mixing sources to target weights (op6), by blocks of words.

The words of a source, its documents in a fixed order, fill blocks of 64. A
source's target is a number of words; an epoch goes through its blocks once, in
the order of a pseudorandom permutation of the block numbers, and the last,
partial epoch stops in the block where the target is reached. Slots (places in
that order) are dealt to output shards by multinomial draws, chunk by chunk:
which is how independent draws of source counts for each shard fall, given the
sources' totals. Slots join the documents' blocks by index.

Targets: sources by code point, null last, weigh 5, 2, 1 in turn and share 1.5
times all words; a target stops at 2 times its source's words and the excess is
shared again by weight, in closed form over the sorted table of sources (one
row a source: the only window that one task runs).

Nothing depends on the number of partitions or on row order; random draws are
seeded by source and chunk, so reruns agree. A hot source is cut into ``BUCKETS``
shares for its running sums and into chunks of slots. Null texts have no words;
null sources are one source; repeated rows are documents each. An empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from baitline.session import materialize

BLOCK = 64              # words
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
BUCKETS = 1024          # shares of a source for running sums
CHUNK = 1 << 16         # slots drawn at once
SHARD_SLOTS = 1 << 14   # slots of an output shard, about
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame) -> DataFrame:
    """(source, sid, source_size, target) from (source, source_size)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    t = sizes.withColumn("sid", F.row_number().over(by_name).cast("long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(F.col("sid") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    t = t.withColumn("w", weight).withColumn("cap", F.col("source_size") * MOST)
    every = Window.partitionBy()
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    t = (t.withColumn("all", F.sum("source_size").over(every) * SHARE)
         .withColumn("before", F.sum("cap").over(by_cap) - F.col("cap"))
         .withColumn("left", F.sum("w").over(every) - F.sum("w").over(by_cap) + F.col("w"))
         .withColumn("level", (F.col("all") - F.col("before")) / F.col("left"))
         .withColumn("place", F.row_number().over(by_cap)))
    open_at = F.when(F.col("cap") > F.col("level") * F.col("w"), F.struct("place", "level"))
    t = t.withColumn("open", F.min(open_at).over(every))
    target = F.when(F.col("open").isNull() | (F.col("place") < F.col("open.place")), F.col("cap")).otherwise(F.col("w") * F.col("open.level"))
    return t.select("source", "sid", F.col("source_size").cast("long").alias("source_size"), target.cast("double").alias("target"))


def _feistel(x: np.ndarray, half: int, keys, back: bool = False) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    a, b = x >> np.uint64(half), x & mask
    for key in (reversed(keys) if back else keys):
        if back:
            a, b = b, a
        f = (b + key) * np.uint64(0x9E3779B97F4A7C15)
        f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        a = a ^ ((f >> np.uint64(32)) & mask)
        if not back:
            a, b = b, a
    return (a << np.uint64(half)) | b


def permuted(x: np.ndarray, n: int, seed: str, back: bool = False) -> np.ndarray:
    """A permutation of 0..n-1 chosen by ``seed``: Feistel rounds on the next
    even power of two, walking on until the value is below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    keys = [np.uint64(xxhash.xxh64_intdigest(f"{seed}/{r}")) for r in range(6)]
    out = _feistel(x.astype(np.uint64), half, keys, back)
    while (far := out >= n).any():
        out[far] = _feistel(out[far], half, keys, back)
    return out.astype(np.int64)


def _draw(frames):
    """Slots of each chunk: epoch, shard, block and the words taken of it."""
    for pdf in frames:
        for r in pdf.itertuples(index=False):
            n = -(-r.source_size // BLOCK)
            seed = f"{r.name}/{r.epoch}"
            slot = np.arange(r.first, min(r.first + CHUNK, n))
            block = permuted(slot, n, seed)
            tail = int(permuted(np.array([n - 1]), n, seed, back=True)[0])
            short = n * BLOCK - r.source_size
            start = slot * BLOCK - np.where(slot > tail, short, 0)
            take = np.minimum(r.words - start, BLOCK - np.where(block == n - 1, short, 0))
            on = take > 0
            rng = np.random.Generator(np.random.Philox(xxhash.xxh64_intdigest(f"{seed}/{r.first}")))
            counts = rng.multinomial(int(on.sum()), np.full(r.shards, 1 / r.shards))
            shard = np.repeat(np.arange(r.shards), counts)
            yield pd.DataFrame({"sid": r.sid, "epoch": r.epoch, "shard": shard, "slot": slot[on],
                                "block": block[on], "take": take[on]})


def slots(sources: DataFrame) -> DataFrame:
    """(sid, epoch, shard, slot, block, take) of the whole mix."""
    words = F.floor(F.col("target") + 0.5)
    t = sources.where("source_size > 0").withColumn("words", words)
    shards = F.greatest(F.lit(1), F.ceil(F.sum("words").over(Window.partitionBy()) / (BLOCK * SHARD_SLOTS)))
    t = t.withColumn("shards", shards).withColumn("name", F.coalesce(F.concat(F.lit("s:"), "source"), F.lit("null")))
    t = t.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(int(MOST)))))
    # words of this epoch: a whole source, what is left, or none
    t = t.withColumn("words", F.least("source_size", F.col("words") - F.col("epoch") * F.col("source_size"))).where("words > 0")
    # a slot reaches at least slot * BLOCK - BLOCK words, so later chunks of a partial epoch are not needed
    last = F.floor((F.col("words") + 2 * BLOCK) / CHUNK / BLOCK)
    t = t.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn("first", F.col("chunk") * CHUNK)
    # a number, else the few bytes of the chunks are coalesced into one task
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = t.where(F.col("first") * BLOCK < F.col("source_size")).repartition(tasks, "sid", "epoch", "chunk")
    return t.select("sid", "name", "source_size", "epoch", "words", "shards", "first").mapInPandas(
        _draw, "sid long, epoch int, shard int, slot long, block long, take long")


def _tie():
    """Tells rows of one doc_id apart; rows equal in both are the same document twice."""
    return F.xxhash64(F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"))


def placed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents, without their texts, with their place in the words of their
    source, and the table of sources. uid: (sid, bucket, nth)."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                    size.alias("size"), F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(BUCKETS)).alias("bucket"), _tie().alias("tie"))
    d = materialize(d, "mix-docs")
    shares = d.groupBy("source", "bucket").agg(F.sum("size").alias("share"))
    sources = materialize(targets(shares.groupBy("source").agg(F.sum("share").alias("source_size"))), "mix-sources")
    in_source = Window.partitionBy("source").orderBy("bucket")
    shares = shares.withColumn("base", F.sum("share").over(in_source) - F.col("share"))
    shares = shares.alias("a").join(sources.alias("s"), F.col("a.source").eqNullSafe(F.col("s.source"))).select(
        F.col("a.source").alias("_s"), F.col("a.bucket").alias("_b"), "base", "sid", "source_size", "target")
    in_bucket = Window.partitionBy("source", "bucket").orderBy("doc_id", "size", "tie")
    d = (d.withColumn("nth", F.row_number().over(in_bucket))
         .withColumn("_off", F.sum("size").over(in_bucket.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")))
    d = d.join(shares, d["source"].eqNullSafe(F.col("_s")) & (d["bucket"] == F.col("_b")))
    return d.withColumn("off", F.col("base") + F.col("_off")).drop("_s", "_b", "base", "_off"), sources


def taken_pieces(placed_docs: DataFrame, sources: DataFrame) -> DataFrame:
    """(uid, epoch, shard, slot, a, b): words a..b-1 of a document that a slot
    takes. Documents' blocks join slots by (source, block)."""
    last = F.floor((F.col("off") + F.col("size") - 1) / BLOCK)
    p = placed_docs.where("size > 0").select(
        "sid", "bucket", "nth", "off", "size", F.explode(F.sequence(F.floor(F.col("off") / BLOCK), last)).alias("block"))
    j = p.join(slots(sources).hint("merge"), ["sid", "block"])      # slots grow with the input: never broadcast
    a = F.greatest(F.lit(0), F.col("block") * BLOCK - F.col("off"))
    b = F.least("size", F.col("block") * BLOCK + F.col("take") - F.col("off"))
    return j.select("sid", "bucket", "nth", "epoch", "shard", "slot", a.alias("a"), b.alias("b")).where("b > a")


def mix_report(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken)."""
    d, sources = placed(docs)
    uid = ["sid", "bucket", "nth"]
    taken = taken_pieces(d, sources).groupBy(*uid).agg(F.sum(F.col("b") - F.col("a")).alias("taken"))
    return d.join(taken, uid, "left").select("doc_id", "size", "source_size", "target",
                                             F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns doc_id, text, lang, source, n_chars: a
    row for each document and epoch that takes words of it. An epoch that takes
    them all keeps the text as it is; else the taken words, in their order,
    joined by one space."""
    d, sources = placed(docs)
    uid = ["sid", "bucket", "nth"]
    # one row a document and epoch; its pieces are bounded by the document's own length
    parts = (taken_pieces(d, sources).groupBy(*uid, "epoch")
             .agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("parts"), F.sum(F.col("b") - F.col("a")).alias("n")))
    parts = d.select(*uid, F.col("doc_id").alias("_d"), F.col("tie").alias("_t"), "size").join(parts, uid).drop(*uid)
    # texts move once, to their pieces
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _tie().alias("tie"), F.col("text").cast("string").alias("text"),
                        "lang", F.col("source").cast("string").alias("source")).dropDuplicates(["doc_id", "tie"])
    j = texts.join(parts, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("tie") == F.col("_t")))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    some = F.array_join(F.flatten(F.transform("parts", lambda p: F.slice("w", p["a"].cast("int") + 1, (p["b"] - p["a"]).cast("int")))), " ")
    j = j.withColumn("w", F.when(F.col("n") < F.col("size"), words)).withColumn("text", F.when(F.col("n") < F.col("size"), some).otherwise(F.col("text")))
    return j.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
