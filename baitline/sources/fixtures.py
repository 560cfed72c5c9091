"""Reference-shaped inputs derived from the driver tables.

Each function reads the given Parquet tables and returns the DataFrame the
reference's pipeline expects (articles, truth, web articles, run log,
embedding pairs). Only the columns a consumer uses are selected, so the scan
reads just those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.similarity import token_hash
from ..functions.text import words
from ..operators.rowindex import with_parquet_position

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str, with_file_row: bool = False) -> DataFrame:
    """Article corpus (id, targetTitle, targetParagraphs) from ``documents``:
    first line = title, the other lines = paragraphs.

    ``with_file_row`` adds ``file_row`` = the record's position across the
    Parquet files (J3: the reader's row index plus per-file offsets; no sort)."""
    docs = table(spark, sf_dir, "documents")
    if with_file_row:
        docs = with_parquet_position(docs.select("doc_id", "text"), "file_row")
    docs = docs.select("doc_id", "text", *(["file_row"] if with_file_row else []))
    cols = [F.col("doc_id").alias("id"), F.split("text", "\n").alias("_lines")]
    if with_file_row:
        cols.append("file_row")
    d = docs.select(*cols)
    out = [F.col("id"), F.element_at("_lines", 1).alias("targetTitle"),
           F.slice("_lines", 2, F.greatest(F.size("_lines") - 1, F.lit(0))).alias("targetParagraphs")]
    if with_file_row:
        out.append("file_row")
    return d.select(*out)


def truth(spark: SparkSession, sf_dir: str, with_file_row: bool = False) -> DataFrame:
    """Truth corpus (id, truthMode) from ``labels``: the four annotator levels
    0, 1/3, 2/3, 1 as ``((1 - quality) * 2 + toxic) / 3``."""
    lab = table(spark, sf_dir, "labels")
    if with_file_row:
        lab = with_parquet_position(lab.select("doc_id", "quality", "toxic"), "file_row")
    cols = [F.col("doc_id").alias("id"),
            (((F.lit(1) - F.col("quality")) * 2 + F.col("toxic")).cast("double") / F.lit(3.0))
            .alias("truthMode")]
    if with_file_row:
        cols.append("file_row")
    return lab.select(*cols)


def web_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles from raw ``pages`` HTML: <title> and the texts of all <p>
    elements, with attributes, inner tags or no end tag as they may be."""
    p = table(spark, sf_dir, "pages")
    parts = F.split("html", r"<p(?:\s[^>]*)?>")

    def inner(x):
        return F.regexp_replace(F.regexp_replace(x, r"(?s)</(?:p|article|body)\s*>.*$", ""), "<[^>]*>", "")

    return p.select(F.col("page_id").alias("id"),
                    F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("targetTitle"),
                    F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), inner).alias("targetParagraphs"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training run log (run, epoch, step, loss, artifact) from ``events``.

    run = event_type, epoch = user_id % 4, step = event_id, loss = value;
    artifact = run-epoch, with '.part' for unfinished saves (user_id % 7 = 0).
    """
    e = table(spark, sf_dir, "events")
    epoch = (F.col("user_id") % 4)
    name = F.concat(F.col("event_type"), F.lit("-"), epoch.cast("string"))
    return e.select(F.col("event_type").alias("run"), epoch.alias("epoch"),
                    F.col("event_id").alias("step"), F.col("value").alias("loss"),
                    F.when(F.col("user_id") % 7 == 0, F.concat(name, F.lit(".part")))
                    .otherwise(name).alias("artifact"))


def embedding_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of consecutive embedding vectors (vec_id, vec_id + 1): an
    equi-join on a computed key, shuffled on the key (no broadcast: the table
    grows with the data)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    a = e.select(F.col("vec_id").alias("id_a"), F.col("embedding").alias("emb_a"))
    b = e.select((F.col("vec_id") - 1).alias("id_a"), F.col("vec_id").alias("id_b"),
                 F.col("embedding").alias("emb_b"))
    return a.join(b, "id_a", "inner")


def word_vectors(spark: SparkSession, sf_dir: str, buckets: int = 64) -> DataFrame:
    """A word-vector table (token, vector of 64) for the tokens of ``documents``:
    a token has the vector of least vec_id with vec_id % ``buckets`` = its hash
    bucket; tokens of a bucket without a vector have none."""
    t = table(spark, sf_dir, "documents").select(F.explode(words("text")).alias("token")).distinct()
    e = table(spark, sf_dir, "embeddings").groupBy((F.col("vec_id") % buckets).alias("bucket")).agg(F.min_by("embedding", "vec_id").alias("vector"))
    return t.withColumn("bucket", token_hash("token", buckets)).join(e, "bucket").select("token", "vector")


def pair_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence embeddings of pairs (row_id, real_vector, gen_vector): those of
    vec_id = row_id and of row_id + 1."""
    return embedding_pairs(spark, sf_dir).select(F.col("id_a").alias("row_id"), F.col("emb_a").alias("real_vector"), F.col("emb_b").alias("gen_vector"))


def document_parts(spark: SparkSession, sf_dir: str, n_parts: int = 3) -> list[DataFrame]:
    """The corpus as ``n_parts`` source files, the last lacking ``source``
    (exercises by-name union with missing columns)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    parts = []
    for k in range(n_parts):
        p = d.filter(F.col("doc_id") % n_parts == k)
        if k == n_parts - 1:
            p = p.drop("source")
        parts.append(p)
    return parts
