"""Registered queries: one per operator family of the reference.

Each takes ``(spark, sf_dir)`` and returns a DataFrame over the whole driver
tables. Floats are rounded to 6 places (5 for float32 vectors) and arrays are
returned as md5 digests, so that results compare exactly with the SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as tx
from ..functions import tokens as tk
from ..operators import encode, filters, models, report, rowindex, scorers, split, vectors
from ..operators import evaluate as ev_ops
from ..operators.evaluate import (METRIC_COLUMNS, extractive_headline, pair_token_metrics, valid_pairs,
                                   with_text_metrics)
from ..operators.prepare import prepare_articles, union_by_name
from ..session import materialize, scratch_path
from ..sources import datasets, fixtures, runs
from . import headline as hp
from . import jobs


def _r(c, n: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# ------------------------------------------------------------- prepare ----

def prepare_by_key(spark: SparkSession, d: str) -> DataFrame:
    p = hp.prepared_set(spark, d)
    return p.select("row_id", "Title", "Body", "Summary", _r("Score").alias("Score"))


def prepare_by_position(spark: SparkSession, d: str) -> DataFrame:
    p = hp.prepared_set(spark, d, by_position=True)
    return p.select("row_id", "Title", "Body", "Summary", _r("Score").alias("Score"))


def union_sources(spark: SparkSession, d: str) -> DataFrame:
    parts = [p.withColumn("part", F.lit(i)) for i, p in enumerate(fixtures.document_parts(spark, d))]
    return union_by_name(parts).select("doc_id", "lang", "source", "n_chars", "part")


def web_articles(spark: SparkSession, d: str) -> DataFrame:
    w = fixtures.web_articles(spark, d)
    return w.select(F.col("id").alias("page_id"), F.col("targetTitle").alias("title"),
                    F.size("targetParagraphs").cast("bigint").alias("n_paragraphs"),
                    tx.flatten_paragraphs("targetParagraphs").alias("body"))


def lead_summary(spark: SparkSession, d: str) -> DataFrame:
    a = fixtures.articles(spark, d)
    body = tx.flatten_paragraphs("targetParagraphs")
    return a.select(F.col("id").alias("row_id"), tx.lead_summary(body).alias("Summary"),
                    F.length(tx.char_prefix(body, 500)).cast("bigint").alias("prefix_chars"))


# --------------------------------------------------------------- split ----

def split_hash(spark: SparkSession, d: str) -> DataFrame:
    docs = fixtures.table(spark, d, "documents").select(F.col("doc_id").alias("row_id"))
    return split.split_by_hash(docs, "row_id")


def split_exact(spark: SparkSession, d: str) -> DataFrame:
    docs = fixtures.table(spark, d, "documents").select(F.col("doc_id").alias("row_id"))
    return split.split_exact(docs, "row_id")


def wanted_scores(spark: SparkSession, d: str) -> DataFrame:
    p = hp.prepared_set(spark, d)
    return filters.with_scores(p, [0, 1]).select("row_id", _r("Score").alias("Score"))


def resolve_split_rows(spark: SparkSession, d: str) -> DataFrame:
    p = split.split_by_hash(hp.prepared_set(spark, d), "row_id")
    want = filters.resolve_split("te")
    return p.filter(F.col("split") == want).select("row_id", "split", _r("Score").alias("Score"))


# -------------------------------------------------------------- encode ----

def _prepared_ids(spark: SparkSession, d: str) -> DataFrame:
    p = hp.prepared_set(spark, d)
    return p.select("row_id", "Title", "Body", "Summary", "Score",
                    tk.encode_text("Body").alias("body_ids"), tk.encode_text("Title").alias("title_ids"))


def pack_sequences(spark: SparkSession, d: str) -> DataFrame:
    p = _prepared_ids(spark, d).select("row_id", tk.pack("body_ids", "title_ids").alias("pk"))
    return p.select("row_id", tk.ids_digest("pk.sequence").alias("seq_md5"),
                    F.size("pk.sequence").cast("bigint").alias("seq_len"),
                    F.aggregate("pk.title_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("mask_sum"),
                    F.col("pk.body_len").cast("bigint").alias("body_len"))


def pack_right(spark: SparkSession, d: str) -> DataFrame:
    p = _prepared_ids(spark, d).select("row_id", tk.pack_right("body_ids", "title_ids").alias("pk"))
    return p.select("row_id", tk.ids_digest("pk.sequence").alias("seq_md5"),
                    F.aggregate("pk.attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("attn_sum"))


def seq2seq_encode(spark: SparkSession, d: str) -> DataFrame:
    p = hp.prepared_set(spark, d).select("row_id", tk.seq2seq_encode("Body", "Title", "Summary").alias("e"))
    return p.select("row_id",
                    tk.ids_digest("e.sequences").alias("sequences_md5"),
                    tk.ids_digest("e.titles").alias("titles_md5"),
                    tk.ids_digest("e.summaries").alias("summaries_md5"),
                    tk.ids_digest(tk.pad_to_ignore("e.summaries")).alias("labels_md5"),
                    F.aggregate("e.sequence_masks", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("seq_mask_sum"),
                    F.aggregate("e.title_masks", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("title_mask_sum"),
                    F.aggregate("e.summary_masks", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("summary_mask_sum"))


def mask_shift(spark: SparkSession, d: str) -> DataFrame:
    p = _prepared_ids(spark, d).select("row_id", tk.pack("body_ids", "title_ids").alias("pk"))
    sh = tk.shift_right("pk.title_mask")
    return p.select("row_id",
                    tk.ids_digest(sh).alias("shifted_md5"),
                    tk.ids_digest(tk.masked_fill("pk.sequence", sh)).alias("labels_md5"),
                    tk.ids_digest(tk.nonpad_mask("pk.sequence", tk.SEP_ID)).alias("attn_md5"))


def first_zero(spark: SparkSession, d: str) -> DataFrame:
    p = _prepared_ids(spark, d).select(
        "row_id", tk.pad_right(F.slice("title_ids", 1, tk.BATCHED_TITLE_MAX), tk.BATCHED_TITLE_MAX).alias("t"))
    return p.select("row_id", tk.first_zero("t").cast("bigint").alias("title_len"))


def vocab(spark: SparkSession, d: str) -> DataFrame:
    p = hp.prepared_set(spark, d)
    return encode.build_vocab(p, ["Title", "Body"], size=500).select(
        "token", F.col("id").cast("bigint").alias("id"), "count")


def roundtrip_decode(spark: SparkSession, d: str) -> DataFrame:
    p = hp.prepared_set(spark, d)
    v = encode.build_vocab(p, ["Title", "Body"], size=500)
    return encode.roundtrip(p, "row_id", "Title", v).select(
        "row_id", F.md5("decoded").alias("decoded_md5"), F.col("n_unk").cast("bigint").alias("n_unk"),
        F.col("n_tokens").cast("bigint").alias("n_tokens"))


def reencode_pack_right(spark: SparkSession, d: str) -> DataFrame:
    p = hp.prepared_set(spark, d)
    v = encode.build_vocab(p, ["Title", "Body"], size=500)
    re = encode.reencode(p, "row_id", "Title", v)
    j = re.join(p.select("row_id", tk.encode_text("Body").alias("body_ids")), "row_id")
    pk = tk.pack_right("body_ids", "reencoded")
    return j.select("row_id", F.md5("decoded").alias("decoded_md5"), tk.ids_digest(pk["sequence"]).alias("seq_md5"),
                    F.aggregate(pk["attention_mask"], F.lit(0).cast("bigint"), lambda a, x: a + x).alias("attn_sum"))


def batches(spark: SparkSession, d: str) -> DataFrame:
    p = rowindex.with_dense_index(hp.prepared_set(spark, d).select("row_id"), ["row_id"], "pos")
    b = report.batch_rows(p, "pos", 4, ["row_id"])
    return b.select(F.col("batch_id").cast("bigint").alias("batch_id"),
                    F.size("rows").cast("bigint").alias("n_rows"),
                    F.col("rows")[0]["row_id"].alias("first_row_id"),
                    F.md5(F.array_join(F.transform("rows", lambda r: r["row_id"].cast("string")), ","))
                    .alias("rows_md5"))


# ------------------------------------------------------------ evaluate ----

def extractive(spark: SparkSession, d: str) -> DataFrame:
    g = extractive_headline(hp.prepared_set(spark, d))
    return g.select("row_id", "gen_title")


def _pair_eval_rows(spark: SparkSession, d: str) -> DataFrame:
    return hp.headline_eval(spark, d)


def bleu1(spark: SparkSession, d: str) -> DataFrame:
    m = pair_token_metrics(hp.headline_pairs(spark, d), "row_id", "Title", "gen_title")
    return m.select("row_id", _r("bleu_score").alias("bleu_score"))


def rouge12(spark: SparkSession, d: str) -> DataFrame:
    e = _pair_eval_rows(spark, d)
    return e.select("row_id", *[_r(c).alias(c) for c in METRIC_COLUMNS if c.startswith("rouge")])


def bow_cosine(spark: SparkSession, d: str) -> DataFrame:
    m = pair_token_metrics(hp.headline_pairs(spark, d), "row_id", "Title", "gen_title")
    return m.select("row_id", _r("cosine_similarity_spacey").alias("cosine"))


def embedding_cosine(spark: SparkSession, d: str) -> DataFrame:
    p = fixtures.embedding_pairs(spark, d)
    return p.select("id_a", "id_b", _r(sim.array_cosine("emb_a", "emb_b"), 5).alias("cosine"))


def pair_eval(spark: SparkSession, d: str) -> DataFrame:
    e = _pair_eval_rows(spark, d)
    return e.select("row_id", _r("score").alias("score"), "real_title", "gen_title", "body_text",
                    *[_r(c).alias(c) for c in METRIC_COLUMNS])


def word_vector_similarity(spark: SparkSession, d: str) -> DataFrame:
    pairs = hp.headline_pairs(spark, d)
    w = vectors.word_vector_cosine(pairs, "row_id", "Title", "gen_title", fixtures.word_vectors(spark, d), 64, "cosine")
    return w.select("row_id", _r("cosine", 5).alias("cosine"))


def _vector_eval(e: DataFrame) -> DataFrame:
    # vectors are float32: 5 places
    return e.select("row_id", _r("score").alias("score"), "gen_title",
                    *[_r(c, 5 if c.startswith("cosine") else 6).alias(c) for c in METRIC_COLUMNS])


def pair_eval_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = ev_ops.evaluate_pairs(hp.headline_pairs(spark, d), word_vectors=fixtures.word_vectors(spark, d), dim=64,
                              embeddings=fixtures.pair_embeddings(spark, d))
    return _vector_eval(e)


# -------------------------------------------------------------- models ----

def model_summary(spark: SparkSession, d: str) -> DataFrame:
    p = prepare_articles(fixtures.articles(spark, d), fixtures.truth(spark, d), model=models.lead_summarizer)
    return p.select("row_id", "Title", "Body", "Summary", _r("Score").alias("Score"))


def model_failures(spark: SparkSession, d: str) -> DataFrame:
    got = materialize(models.inferred(hp.prepared_set(spark, d), "row_id", "Body", models.lead_summarizer, "Summary"), "inferred")
    return got.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("failed"), 1)).alias("failed"))


def model_pair_eval(spark: SparkSession, d: str) -> DataFrame:
    g, _ = models.with_model(hp.prepared_set(spark, d), "row_id", "Body", models.lead_generator, "gen_title")
    return _vector_eval(ev_ops.evaluate_pairs(g, embeddings=fixtures.pair_embeddings(spark, d)))


def model_embedding(spark: SparkSession, d: str) -> DataFrame:
    a = fixtures.articles(spark, d).select(F.col("id").alias("row_id"), "targetTitle")
    e, _ = models.with_model(a, "row_id", "targetTitle", models.hashing_embedder(64), "embedding", "array<double>")
    return e.select("row_id", F.md5(F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",")).alias("embedding_md5"))


def rejected_pairs(spark: SparkSession, d: str) -> DataFrame:
    return ev_ops.rejected_pairs(hp.headline_pairs(spark, d))


def _rounded_report(r: DataFrame, keys: list[str]) -> DataFrame:
    return r.select(*keys, *[_r(c).alias(c) for c in ("min", "max", "median", "mean", "std")])


def metric_report(spark: SparkSession, d: str) -> DataFrame:
    return _rounded_report(hp.headline_report(spark, d), ["metric"])


def metric_report_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return _rounded_report(hp.headline_report(spark, d, by_lang=True), ["lang", "metric"])


def eval_cap(spark: SparkSession, d: str) -> DataFrame:
    # positions first, then the headline: filters on the position reach below
    # the headline projection, so rows far past the cap are not generated
    g = extractive_headline(rowindex.with_key_position(hp.prepared_set(spark, d), "row_id", "pos"))
    # cap the valid rows first (the reference stops its loop there), then
    # compute the metrics of the kept rows only
    capped = report.eval_cap(valid_pairs(g, key="pos"), "pos", 200)
    ev = with_text_metrics(capped, "pos")
    return ev.select("pos", _r("bleu_score").alias("bleu_score"))


# ------------------------------------------------------------ classify ----

def _predictions(spark: SparkSession, d: str) -> DataFrame:
    p = scorers.score_headlines(hp.prepared_set(spark, d), "Title")
    return p.select("row_id", "Score", "prob", "logit",
                    filters.binary_label("Score").alias("label"),
                    filters.prediction("prob").alias("pred"))


def confusion(spark: SparkSession, d: str) -> DataFrame:
    return report.confusion(_predictions(spark, d))


def rates(spark: SparkSession, d: str) -> DataFrame:
    r = report.rates(report.confusion(_predictions(spark, d)))
    return r.select(*[_r(c).alias(c) for c in report.RATE_NAMES])


def softmax_label(spark: SparkSession, d: str) -> DataFrame:
    p = _predictions(spark, d)
    oh = tk.one_hot("label")
    return p.select("row_id", oh[0].alias("onehot0"), oh[1].alias("onehot1"),
                    _r(tk.softmax_class1(F.lit(0.0), F.col("logit"))).alias("p1"), _r("prob").alias("prob"))


def running_accuracy(spark: SparkSession, d: str) -> DataFrame:
    p = rowindex.with_dense_index(_predictions(spark, d), ["row_id"], "pos")
    p = p.withColumn("ok", (F.col("pred") == F.col("label")).cast("int"))
    r = report.running_accuracy(p, "pos", "ok")
    return r.select("pos", F.col("acc").cast("bigint").alias("acc"), _r("accuracy").alias("accuracy"))


def classifier_fit(spark: SparkSession, d: str) -> DataFrame:
    p = hp.prepared_set(spark, d)
    model = scorers.fit_classifier(p, "Title", "Score")
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(p)
    return scored.select("row_id", F.col("prediction").cast("int").alias("pred"),
                         _r(vector_to_array("probability")[1]).alias("prob"))


def plugin_scorer(spark: SparkSession, d: str) -> DataFrame:
    a = fixtures.articles(spark, d).select(F.col("id").alias("row_id"), "targetTitle")
    return scorers.apply_text_model(a, "targetTitle", scorers.HashingEmbedder, "embedding",
                                    "array<double>")


# ---------------------------------------------------------------- runs ----

def epoch_loss(spark: SparkSession, d: str) -> DataFrame:
    r = report.epoch_loss(fixtures.run_log(spark, d))
    return r.select("run", F.col("epoch").cast("bigint").alias("epoch"),
                    _r("mean_loss").alias("mean_loss"), "steps")


def top_k_runs(spark: SparkSession, d: str) -> DataFrame:
    r = report.top_k_runs(fixtures.run_log(spark, d), 3)
    return r.select("name", _r("train_loss").alias("train_loss"))


def latest_artifact(spark: SparkSession, d: str) -> DataFrame:
    return report.latest_artifact(fixtures.run_log(spark, d))


# ------------------------------------------------------- round trips ----

def encoded_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    p = split.split_by_hash(_prepared_ids(spark, d), "row_id")
    enc = p.select("row_id", "split", "Score", tk.pack("body_ids", "title_ids").alias("pk")).select(
        "row_id", "split", F.col("Score").alias("scores"), F.col("pk.sequence").alias("sequences"),
        F.col("pk.title_mask").alias("title_masks"))
    path = datasets.write_encoded(enc, layout="packed", tokenizer="hash")
    back = datasets.read_encoded(spark, path, layout="packed", tokenizer="hash", split="test", wanted=[0])
    return back.select("row_id", tk.ids_digest("sequences").alias("seq_md5"), _r("scores").alias("scores"))


def prepared_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    p = split.split_by_hash(hp.prepared_set(spark, d), "row_id")
    path = datasets.write_prepared(p)
    back = datasets.read_prepared(spark, path, "dev")
    return back.select("row_id", "Title", _r("Score").alias("Score"))


def jsonl_prepared(spark: SparkSession, d: str) -> DataFrame:
    """The corpora written as three JSON-lines files each, some lines cut short,
    read back and prepared."""
    paths, truths = [], []
    line = F.to_json(F.struct("id", "targetTitle", "targetParagraphs"))
    articles = fixtures.articles(spark, d).withColumn("line", F.when(F.col("id") % 50 == 0, F.substr(line, F.lit(1), F.lit(10))).otherwise(line))
    labels = fixtures.truth(spark, d).withColumn("line", F.to_json(F.struct("id", "truthMode")))
    for k in range(3):
        for df, into in ((articles, paths), (labels, truths)):
            into.append(scratch_path(spark, "jsonl"))
            df.where(F.col("id") % 3 == k).select("line").write.text(into[-1])
    p = prepare_articles(datasets.read_jsonl_union(spark, paths, datasets.ARTICLE_SCHEMA),
                         datasets.read_jsonl_union(spark, truths, datasets.TRUTH_SCHEMA))
    return p.select("row_id", "Title", F.md5("Body").alias("body_md5"), "Summary", _r("Score").alias("Score"))


def jsonl_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a JSON-lines corpus that are no records, by file."""
    line = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("targetTitle")))
    docs = fixtures.table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.substr(line, F.lit(1), F.lit(12))).otherwise(line).alias("line"))
    paths = [scratch_path(spark, "jsonl") for _ in range(3)]
    for k, path in enumerate(paths):
        docs.where(F.col("doc_id") % 3 == k).select("line").write.text(path)
    rejects = scratch_path(spark, "rejects")
    good = datasets.read_jsonl_union(spark, paths, datasets.ARTICLE_SCHEMA, rejects=rejects)
    bad = spark.read.parquet(rejects)
    counts = good.groupBy("file_ordinal").agg(F.count(F.lit(1)).alias("records")).join(
        bad.groupBy("file_ordinal").agg(F.count(F.lit(1)).alias("rejected")), "file_ordinal", "full")
    return counts.select(F.col("file_ordinal").cast("long").alias("file_ordinal"), F.coalesce("records", F.lit(0)).alias("records"),
                         F.coalesce("rejected", F.lit(0)).alias("rejected"))


def report_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rep = hp.headline_report(spark, d)
    path = datasets.write_report(rep, run={"model_type": "extractive", "class_loss": False,
                                           "summ_loss": False, "split": "dev"})
    back = datasets.read_report(spark, path)
    return back.select("model_type", "metric", _r("mean").alias("mean"))


def record_lookup(spark: SparkSession, d: str) -> DataFrame:
    """First, middle and last record of the corpus by position, and its row count."""
    path = f"{d.rstrip('/')}/documents.parquet"
    index = rowindex.write_position_index(spark, path, scratch_path(spark, "positions"))
    n = spark.read.parquet(index).agg(F.sum("n")).first()[0] or 0
    found = [rowindex.record_at_position(spark, path, index, p).select(
        F.lit(p).cast("bigint").alias("pos"), F.lit(n).cast("bigint").alias("n_rows"), "doc_id", F.md5("text").alias("text_md5"))
        for p in sorted({0, n // 2, max(n - 1, 0)})]
    return union_by_name(found)


def first_record(spark: SparkSession, d: str) -> DataFrame:
    """The longest document (ties: the smallest id)."""
    docs = fixtures.table(spark, d, "documents").select("doc_id", "n_chars", "lang")
    return rowindex.first_record(docs, [F.col("n_chars").desc(), F.col("doc_id")])


def mini_prepared(spark: SparkSession, d: str) -> DataFrame:
    """The prepared set of the first 100 articles of the corpus."""
    p = prepare_articles(fixtures.articles(spark, d, with_file_row=True), fixtures.truth(spark, d), mini=100)
    return p.select("row_id", "Title", F.md5("Body").alias("body_md5"), _r("Score").alias("Score"))


def job_runs(spark: SparkSession, d: str) -> DataFrame:
    """The classify job on each split, and the runs that it committed; rows of a
    run without a commit stay unseen."""
    prepared = datasets.write_prepared(split.split_by_hash(hp.prepared_set(spark, d), "row_id"))
    out = scratch_path(spark, "classified")
    for name in split.SPLITS:
        jobs.classify_job(spark, prepared, name, out)
    aborted = spark.read.json(f"{out}/rates").withColumn("run_id", F.lit("aborted"))
    aborted.write.mode("append").json(f"{out}/rates")
    done = runs.read_runs(spark, f"{out}/runs", "classify")
    rates = runs.committed(datasets.read_rates(spark, f"{out}/rates"), done).select("run_id", F.col("Overall Accuracy").alias("accuracy"))
    return done.join(rates, "run_id").select("split", "rows", _r("loss").alias("loss"), _r("accuracy").alias("accuracy"))


REGISTRY = {
    "prepare_by_key": prepare_by_key,
    "prepare_by_position": prepare_by_position,
    "union_sources": union_sources,
    "web_articles": web_articles,
    "lead_summary": lead_summary,
    "split_hash": split_hash,
    "split_exact": split_exact,
    "wanted_scores": wanted_scores,
    "resolve_split_rows": resolve_split_rows,
    "pack_sequences": pack_sequences,
    "pack_right": pack_right,
    "seq2seq_encode": seq2seq_encode,
    "mask_shift": mask_shift,
    "first_zero": first_zero,
    "vocab": vocab,
    "roundtrip_decode": roundtrip_decode,
    "reencode_pack_right": reencode_pack_right,
    "batches": batches,
    "extractive_headline": extractive,
    "bleu1": bleu1,
    "rouge12": rouge12,
    "bow_cosine": bow_cosine,
    "embedding_cosine": embedding_cosine,
    "pair_eval": pair_eval,
    "word_vector_similarity": word_vector_similarity,
    "pair_eval_vectors": pair_eval_vectors,
    "model_summary": model_summary,
    "model_failures": model_failures,
    "model_pair_eval": model_pair_eval,
    "model_embedding": model_embedding,
    "rejected_pairs": rejected_pairs,
    "metric_report": metric_report,
    "metric_report_by_lang": metric_report_by_lang,
    "eval_cap": eval_cap,
    "confusion": confusion,
    "rates": rates,
    "softmax_label": softmax_label,
    "running_accuracy": running_accuracy,
    "epoch_loss": epoch_loss,
    "top_k_runs": top_k_runs,
    "latest_artifact": latest_artifact,
    "classifier_fit": classifier_fit,
    "plugin_scorer": plugin_scorer,
    "encoded_roundtrip": encoded_roundtrip,
    "prepared_roundtrip": prepared_roundtrip,
    "report_roundtrip": report_roundtrip,
    "jsonl_prepared": jsonl_prepared,
    "jsonl_rejects": jsonl_rejects,
    "record_lookup": record_lookup,
    "first_record": first_record,
    "mini_prepared": mini_prepared,
    "job_runs": job_runs,
}
