"""The corpus pipeline: language ID, near-dedup, suffix dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and
returns a DataFrame; all but the last return the columns of documents (doc_id,
text, lang, source, n_chars). ``run`` writes each stage's rows to the shared
folder and reads them again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baitline.llm import bpe, language_id as langid, minhash_dedup as near, mixing, suffix_dedup as suffix
from baitline.session import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without a letter go. lang is
    the predicted language."""
    out = langid.language_id(docs.select(*COLUMNS)).where("lang_pred <> 'und'")
    return out.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of smallest doc_id,
    and one row of it. Texts that are not linked stay apart, whatever their
    ids. Rows without a doc_id stay, one a text, unless linked to one with."""
    docs = docs.select(*COLUMNS)
    kept = near.linked(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "root").distinct()
    # rows are told by doc_id and text
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_key"))
    out = docs.join(kept, same).drop("_id", "_key")
    # of a component the first row by text; texts without words have no component, but an id
    first = F.min(F.struct(F.col("text").isNull(), "text", "lang", "source", "n_chars")).alias("r")
    named = (out.where("doc_id is not null").groupBy("root", "doc_id").agg(first)
             .select("doc_id", "r.text", "r.lang", "r.source", "r.n_chars"))
    return named.unionByName(out.where("doc_id is null").drop("root").dropDuplicates(["text"])).select(*COLUMNS)


def suffix_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat an earlier document; a character
    cut in two becomes U+FFFD. A text of which nothing is left goes."""
    out = suffix.suffix_dedup(docs.select(*COLUMNS), ("lang", "source"))
    out = out.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).where("n_removed < n_bytes or n_bytes = 0")
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each document and epoch that takes words of it."""
    return mixing.mixed(docs.select(*COLUMNS)).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids of the text, their number, and what the
    ids decode to."""
    out = bpe.decode(bpe.encode(docs.select(*COLUMNS), carry=("lang", "source")))
    return out.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "text")


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_removed),
    ("mixing to target weights", mix),
    ("BPE encoding and decoding", encoded),
]

#: Models, pseudorandom draws and the tokenizer are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
