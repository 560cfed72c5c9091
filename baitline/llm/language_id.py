"""Language ID (op5): bit-sliced Bloom filters of character n-grams.

Slot s of the filter is a word of bits, one bit a language; a 3- or 4-gram sets
its language's bit in two slots. Looking up a gram takes two words and their AND:
all languages that contain it. A text's grams give one popcount a language,
corrected for the filter's false positives, (count - n * fp) / (1 - fp) with
fp = (share of set bits) ** 2; the largest decides, and its share of the sum is
the score.

Learning reads labelled rows whose crc32(doc_id as text) mod 4 is not 2, of each
language about ``SAMPLE`` distinct texts by a hash of the text (a documented bound
for the classifier's sample). A gram, however rare, belongs to the languages in
which it is at least a third as frequent as in its strongest one.

Nulls: a text that is null or has no letter is ``und`` with score 0, as is every
text if no language was learned. A null doc_id is not held out and not learned
from. Ties go to the language with more rows, then to the smaller name.
Repeated rows give a row each; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baitline.session import materialize

SAMPLE = 4000
SLOTS, MOST_SLOTS = 20, 22      # 2 ** 20 slots, more for many grams
FOLDS, HELD = 4, 2
CHUNK = 1 << 20
_M = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xBF58476D1CE4E5B9)


def _letters() -> np.ndarray:
    """Lower case of each letter of the basic plane, else a space."""
    out = np.full(0x10000, 32, np.uint32)
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_LETTER: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """Lower-case letters, everything else one space; a space at both ends."""
    if not _LETTER:
        _LETTER.append(_letters())
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(cp) and cp.max() >= 0x10000:
        high = cp >= 0x10000
        x = np.where(high, cp, _LETTER[0][np.where(high, 0, cp)])
        other = [i for i in np.flatnonzero(high) if not chr(cp[i]).isalpha()]
        x[other] = 32
    else:
        x = _LETTER[0][cp]
    x = np.r_[np.uint32(32), x, np.uint32(32)]
    return x[np.r_[True, (x[1:] != 32) | (x[:-1] != 32)]]


def grams(x: np.ndarray) -> np.ndarray:
    """Hashes of the 3-grams and 4-grams of a letter array."""
    v = x.astype(np.uint64)
    if len(v) < 3:
        return np.empty(0, np.uint64)
    g3 = ((v[:-2] * _M + v[1:-1]) * _M + v[2:]) * _M2
    g4 = (g3[:-1] * _M + v[3:]) * _M
    g = np.r_[g3, g4]
    return (g ^ (g >> np.uint64(29))) * _M


def slots(g: np.ndarray, bits: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    return ((g >> np.uint64(64 - bits)).astype(np.int64),
            ((g * _M2) >> np.uint64(64 - bits)).astype(np.int64))


class Filter:
    """The learned languages and their bit-sliced filter; 64 languages a layer.
    Its size is that of the slots, 2 ** bits, whatever was learned."""

    def __init__(self, langs: list[str], found: dict[int, np.ndarray], bits: int = SLOTS):
        self.langs, self.bits = langs, bits
        self.layers = np.zeros(((len(langs) + 63) // 64, 1 << bits), np.uint64)
        for i, g in found.items():
            bit = np.uint64(1 << (i % 64))
            for s in slots(g, bits):
                self.layers[i // 64][s] |= bit
        self.measure()

    def measure(self):
        n = 1 << self.bits
        self.fp = np.array([float(((self.layers[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).sum() / n) ** 2
                            for i in range(len(self.langs))])

    def predict(self, text) -> tuple[str, float]:
        if not isinstance(text, str) or not self.langs:
            return "und", 0.0
        x = letters(text)
        if not (x != 32).any():
            return "und", 0.0
        count, n = np.zeros(len(self.langs)), 0
        for at in range(0, len(x), CHUNK):
            g = grams(x[at:at + CHUNK + 3])
            if at + CHUNK < len(x):                 # 3-grams that the next chunk holds too
                g = np.r_[g[:CHUNK], g[len(x[at:at + CHUNK + 3]) - 2:]]
            a, b = slots(g, self.bits)
            n += len(g)
            for layer in range(len(self.layers)):
                mask = self.layers[layer][a] & self.layers[layer][b]
                own = range(layer * 64, min(layer * 64 + 64, len(self.langs)))
                if len(own) <= 8:
                    sums = np.bincount(mask.astype(np.uint8), minlength=256)
                    for i in own:
                        count[i] += sums[(np.arange(256) >> (i % 64)) & 1 == 1].sum()
                else:
                    for i in own:
                        count[i] += int(((mask >> np.uint64(i % 64)) & np.uint64(1)).sum())
        right = np.maximum((count - n * self.fp) / (1 - self.fp), 0)
        best = int(np.argmax(right))
        total = right.sum()
        return self.langs[best], float(right[best] / total) if total > 0 else 0.0


def held_out(folds: int, held: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held, F.lit(False))


def learn(docs: DataFrame) -> Filter:
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(FOLDS, HELD))
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    texts = F.count_distinct(F.xxhash64("text")).alias("texts")
    counts = sorted(((r["n"], r["lang"], r["texts"]) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), texts).collect()),
                    key=lambda x: (-x[0], x[1]))
    langs = [x for _, x, _ in counts]
    if not langs:
        return Filter([], {})
    share = F.create_map(*[F.lit(v) for _, x, n in counts for v in (x, min(1.0, SAMPLE / n))])
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)).dropDuplicates(["lang", "text"])

    def counted(frames):
        for pdf in frames:
            for lang, own in pdf.groupby("lang"):
                g, n = np.unique(np.concatenate([grams(letters(t)) for t in own.text]), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": g.view(np.int64), "n": n})

    found = sample.mapInPandas(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = materialize(found, "grams")
    total = {r["lang"]: r["n"] for r in found.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    size = F.create_map(*[F.lit(v) for x in langs for v in (x, float(max(total.get(x, 0), 1)))])
    rate = found.withColumn("rate", F.col("n") / size[F.col("lang")])
    most = rate.groupBy("gram").agg(F.max("rate").alias("most"))
    taken = materialize(rate.join(most, "gram").where("rate * 3 >= most").select("lang", "gram"), "grams")
    largest = max([r["n"] for r in taken.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()], default=1)
    bits = min(MOST_SLOTS, max(SLOTS, (8 * largest - 1).bit_length()))      # a quarter full at most, up to MOST_SLOTS
    place = {x: i for i, x in enumerate(langs)}

    def marked(frames):
        for pdf in frames:
            for lang, own in pdf.groupby("lang"):
                i = place[lang]
                slot = np.unique(np.concatenate(slots(own.gram.to_numpy().view(np.uint64), bits)))
                yield pd.DataFrame({"layer": np.int32(i // 64), "slot": slot, "mask": np.uint64(1 << (i % 64)).astype(np.int64)})

    # the filter's slots, not the grams, come to the driver: its size is bounded
    model = Filter(langs, {}, bits)
    set_ = (taken.mapInPandas(marked, "layer int, slot long, mask long").groupBy("layer", "slot")
            .agg(F.bit_or("mask").alias("mask")).toPandas())
    model.layers[set_["layer"].to_numpy(), set_["slot"].to_numpy()] = set_["mask"].to_numpy().view(np.uint64)
    model.measure()
    return model


def language_id(docs: DataFrame) -> DataFrame:
    """``docs`` with held_out, lang_pred and score."""
    model = learn(docs)
    share = docs.sparkSession.sparkContext.broadcast(model)     # SLOTS words for every 64 languages

    @F.pandas_udf("lang string, score double")
    def predicted(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([share.value.predict(t) for t in text], columns=["lang", "score"])

    # else a filter on lang_pred is pushed below the projection, and every text is read twice
    predicted = predicted.asNondeterministic()
    return (docs.withColumn("held_out", held_out(FOLDS, HELD)).withColumn("_p", predicted(F.col("text").cast("string")))
            .withColumn("lang_pred", F.col("_p.lang")).withColumn("score", F.col("_p.score")).drop("_p"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return language_id(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "lang_pred", "score")
