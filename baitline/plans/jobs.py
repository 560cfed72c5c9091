"""End-to-end Spark jobs for the stages a user of the reference runs:
prepare a split dataset from JSON-lines corpora, encode it, evaluate
generated headlines, train the clickbait classifier and evaluate it.

Each job is a composition of the library's operators with one write at the
end; evaluations and training then commit a row to a run manifest. ``python -m baitline.plans.jobs <stage> ...`` runs them from a shell.
"""

from __future__ import annotations

import argparse
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens as tk
from ..operators import filters, report, split
from ..operators.evaluate import evaluate_pairs, extractive_headline, valid_pairs, with_text_metrics, with_vectors
from ..operators.models import MAX_FAILURE_RATE, with_model
from ..operators.prepare import prepare_articles
from ..operators.rowindex import with_key_position
from ..operators.scorers import fit_classifier, score_headlines
from ..sources import datasets, runs

LAYOUTS = ("packed", "packed_right", "seq2seq")


def prepare_job(spark: SparkSession, article_paths: list[str], truth_paths: list[str], out: str,
                by_position: bool = False, exact: bool = False, mini: int | None = None,
                summarizer: Callable | None = None, max_failure_rate: float = MAX_FAILURE_RATE) -> str:
    """Corpora -> prepared set with a train/dev/test ``split`` column, written
    partitioned by split. Keyed alignment by default, on ids as they are written;
    ``by_position`` aligns records by their position in the listed files.
    ``summarizer`` is a model factory in place of the built-in lead summary; the
    job fails if it fails on more than ``max_failure_rate`` of the rows."""
    arts = datasets.read_jsonl_union(spark, article_paths, datasets.ARTICLE_SCHEMA, with_position=by_position or mini is not None)
    truth = datasets.read_jsonl_union(spark, truth_paths, datasets.TRUTH_SCHEMA, with_position=by_position)
    p = prepare_articles(arts, truth, by_position=by_position, mini=mini, model=summarizer, max_failure_rate=max_failure_rate)
    p = split.split_exact(p, "row_id") if exact else split.split_by_hash(p, "row_id")
    return datasets.write_prepared(p, out)


def encode_job(spark: SparkSession, prepared: str, out: str, layout: str = "packed",
               split_name: str | None = None) -> str:
    """Prepared set -> fixed-length token sequences and masks, written
    partitioned by layout, tokenizer and split."""
    p = datasets.read_prepared(spark, prepared, split_name)
    body, title = tk.encode_text("Body"), tk.encode_text("Title")
    if layout == "packed":
        pk = tk.pack(body, title)
        enc = p.select("row_id", "split", F.col("Score").alias("scores"),
                       pk["sequence"].alias("sequences"), pk["title_mask"].alias("title_masks"))
    elif layout == "packed_right":
        pk = tk.pack_right(body, title)
        enc = p.select("row_id", "split", F.col("Score").alias("scores"),
                       pk["sequence"].alias("sequences"), pk["attention_mask"].alias("attention_masks"))
    elif layout == "seq2seq":
        e = tk.seq2seq_encode("Body", "Title", "Summary")
        enc = p.select("row_id", "split", F.col("Score").alias("scores"), e.alias("e")).select(
            "row_id", "split", "scores", "e.*")
    else:
        raise ValueError(f"layout must be one of {LAYOUTS}")
    return datasets.write_encoded(enc, layout, "hash", out)


def evaluate_job(spark: SparkSession, prepared: str, split_name: str, out: str,
                 wanted: list[float] | None = None, cap: int | None = None, run: dict | None = None,
                 generator: Callable | None = None, headlines: DataFrame | None = None,
                 word_vectors: DataFrame | None = None, dim: int | None = None, embeddings: DataFrame | None = None,
                 max_failure_rate: float = MAX_FAILURE_RATE) -> DataFrame:
    """Headline evaluation of one split: per-row metrics written as outputs,
    five-number report written and returned, the run then committed to
    ``out``/runs.

    Headlines are those of ``headlines`` (row_id, gen_title), else of the model
    factory ``generator``, which may fail on ``max_failure_rate`` of the bodies,
    else of the built-in generator. A row without a headline is left out, as an
    empty text is. ``word_vectors`` and ``embeddings`` as in
    :func:`baitline.operators.evaluate.evaluate_pairs`. ``cap`` keeps the first
    ``cap`` + 1 valid rows as the reference's loop did; by default every row is
    evaluated."""
    # each call is a run of its own, so a repeated evaluation never mixes rows
    run = dict({"model": None}, **run or {}, run_id=uuid.uuid4().hex, split=filters.resolve_split(split_name),
               wanted_scores=None if wanted is None else ",".join(str(w) for w in wanted))
    p = filters.with_scores(datasets.read_prepared(spark, prepared, split_name), wanted)
    key = "row_id"
    if cap is not None:
        p, key = with_key_position(p, "row_id", "pos"), "pos"
    if headlines is not None:
        g = p.join(headlines.select("row_id", "gen_title"), "row_id")
    elif generator is not None:
        g, run["model"] = with_model(p, "row_id", "Body", generator, "gen_title", max_failure_rate=max_failure_rate)[0], getattr(generator, "__name__", "model")
    else:
        g = extractive_headline(p)
    if cap is not None:
        ev = with_text_metrics(report.eval_cap(valid_pairs(g, key="pos"), "pos", cap), "pos")
        if embeddings is not None:
            embeddings = p.select("row_id", "pos").join(embeddings, "row_id").drop("row_id")
        ev = with_vectors(ev, "pos", word_vectors, dim, embeddings)
    else:
        ev = evaluate_pairs(g, word_vectors=word_vectors, dim=dim, embeddings=embeddings)
    # the rows are computed once: written, then read back for the report
    # (only this run's rows; the outputs folder is appended to across runs)
    path = datasets.write_outputs(ev, run, f"{out}/outputs")
    written = datasets.read_outputs(spark, path)
    for k, val in run.items():
        written = written.filter(F.col(k).eqNullSafe(F.lit(None if val is None else str(val)).cast("string")))
    rep = report.describe_metrics(written.select(*[c for c in ev.columns if c != key]))
    datasets.write_report(rep, run, f"{out}/metrics")
    runs.commit_run(spark, f"{out}/runs", run["run_id"], "evaluate", run["model"] or ("built-in" if headlines is None else "supplied"), split=run["split"], rows=written.count())
    return rep


def train_classifier_job(spark: SparkSession, prepared: str, out: str, split_name: str = "train", manifest: str | None = None) -> str:
    """Fit the clickbait classifier on one split (distributed MLlib fit)
    and save the fitted pipeline to ``out``. With ``manifest``, a folder, the run is
    committed there with its mean log loss on that split; the artifact is the last
    part of ``out``, and the run its name up to the last dash."""
    from pyspark.ml.functions import vector_to_array

    p = datasets.read_prepared(spark, prepared, split_name)
    model = fit_classifier(p, "Title", "Score")
    model.write().overwrite().save(out)
    if manifest is not None:
        right = F.element_at(vector_to_array("probability"), filters.binary_label("Score") + 1)
        fit = model.transform(p).agg(F.count(F.lit(1)).alias("rows"), F.avg(-F.log(F.greatest(right, F.lit(1e-15)))).alias("loss")).first()
        artifact = os.path.basename(out.rstrip("/"))
        runs.commit_run(spark, manifest, uuid.uuid4().hex, "train", artifact.rpartition("-")[0] or artifact, artifact,
                        filters.resolve_split(split_name), fit["rows"], fit["loss"])
    return out


def classify_job(spark: SparkSession, prepared: str, split_name: str, out: str,
                 model: str | None = None) -> DataFrame:
    """Classifier evaluation of one split, with a saved fitted model or the
    built-in cue scorer: confusion rates written and returned, running
    accuracy alongside, the run then committed to ``out``/runs with the share of
    wrong predictions as its loss."""
    p = datasets.read_prepared(spark, prepared, split_name)
    if model:
        from pyspark.ml import PipelineModel
        from pyspark.ml.functions import vector_to_array

        scored = PipelineModel.load(model).transform(p).withColumn(
            "prob", vector_to_array("probability")[1])
    else:
        scored = score_headlines(p, "Title")
    pred = scored.select(
        "row_id", filters.binary_label("Score").alias("label"), filters.prediction("prob").alias("pred"))
    counts = report.confusion(pred)
    rates = report.rates(counts)
    run = {"run_id": uuid.uuid4().hex, "split": filters.resolve_split(split_name), "model_type": "mllib" if model else "cues"}
    datasets.write_report(rates, run, f"{out}/rates")
    pos = with_key_position(pred, "row_id", "pos").withColumn(
        "ok", (F.col("pred") == F.col("label")).cast("int"))
    datasets.write_report(report.running_accuracy(pos, "pos", "ok"), run, f"{out}/running_accuracy")
    # counts of an empty split are NULL
    done = counts.selectExpr("coalesce(pp + fn + fp + nn, 0) AS n", "try_divide(fn + fp, pp + fn + fp + nn) AS wrong").first()
    name = os.path.basename(model.rstrip("/")) if model else "cues"
    runs.commit_run(spark, f"{out}/runs", run["run_id"], "classify", run["model_type"], name, run["split"], done["n"], done["wrong"])
    return rates


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="python -m baitline.plans.jobs")
    sub = ap.add_subparsers(dest="stage", required=True)
    a = sub.add_parser("prepare")
    a.add_argument("--articles", nargs="+", required=True)
    a.add_argument("--truth", nargs="+", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--by-position", action="store_true")
    a.add_argument("--exact", action="store_true")
    a.add_argument("--mini", type=int)
    e = sub.add_parser("encode")
    e.add_argument("--prepared", required=True)
    e.add_argument("--out", required=True)
    e.add_argument("--layout", choices=LAYOUTS, default="packed")
    e.add_argument("--split")
    v = sub.add_parser("evaluate")
    v.add_argument("--prepared", required=True)
    v.add_argument("--split", default="dev")
    v.add_argument("--out", required=True)
    v.add_argument("--wanted-scores", nargs="+", type=float)
    v.add_argument("--cap", type=int)
    c = sub.add_parser("classify")
    c.add_argument("--prepared", required=True)
    c.add_argument("--split", default="dev")
    c.add_argument("--out", required=True)
    c.add_argument("--model")
    t = sub.add_parser("train-classifier")
    t.add_argument("--prepared", required=True)
    t.add_argument("--split", default="train")
    t.add_argument("--out", required=True)
    args = ap.parse_args(argv)
    from ..session import build_session

    spark = build_session()
    if args.stage == "prepare":
        prepare_job(spark, args.articles, args.truth, args.out, args.by_position, args.exact, args.mini)
    elif args.stage == "encode":
        encode_job(spark, args.prepared, args.out, args.layout, args.split)
    elif args.stage == "evaluate":
        evaluate_job(spark, args.prepared, args.split, args.out, args.wanted_scores, args.cap).show(truncate=False)
    elif args.stage == "train-classifier":
        train_classifier_job(spark, args.prepared, args.out, args.split)
    else:
        classify_job(spark, args.prepared, args.split, args.out, args.model).show(truncate=False)


if __name__ == "__main__":
    main()
