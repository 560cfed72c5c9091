"""Supplied models and vectors in the prepare and evaluate jobs."""

import os

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from baitline.operators import models, scorers, vectors
from baitline.operators.evaluate import evaluate_pairs
from baitline.plans import jobs

from .test_jobs import _write_corpora


def odd_model():
    """Fails on whole batches with a bad text, and on the bad text alone."""
    def call(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("bad text")
        return [t.upper() for t in texts]

    return call


def short_model():
    return lambda texts: ["x"] * (len(texts) - 1) if len(texts) > 1 else ["y"]


def test_with_model_marks_failed_rows_only(spark):
    rows = [(f"k{i}", "bad" if i % 7 == 0 else f"t{i}") for i in range(200)] + [("null", None), ("empty", "")]
    df = spark.createDataFrame(rows, "id string, text string").repartition(3)
    got, counts = models.with_model(df, "id", "text", odd_model, "out", batch_size=16)
    assert counts == {"rows": 201, "failed": 29}
    out = {r["id"]: r["out"] for r in got.collect()}
    assert out == {k: None if t is None or t == "bad" else t.upper() for k, t in rows}
    with pytest.raises(models.ModelFailureError):
        models.with_model(df, "id", "text", odd_model, "out", max_failure_rate=0.1)
    # a batch with too few results is tried again row by row
    got, counts = models.with_model(df, "id", "text", short_model, "out")
    assert counts["failed"] == 0 and {r["out"] for r in got.where("text is not null").collect()} == {"y"}
    empty, counts = models.with_model(df.limit(0), "id", "text", odd_model, "out")
    assert empty.collect() == [] and counts == {"rows": 0, "failed": 0}


def failing_embedder():
    def call(texts):
        if "no" in set(texts):
            raise ValueError
        return np.array([[len(t), 1.0] for t in texts])

    return call


def test_embedding_models(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, "no"), (4, None)], "id long, text string")
    got, _ = models.with_model(df, "id", "text", failing_embedder, "v", "array<double>")
    assert {r["id"]: r["v"] for r in got.collect()} == {1: [5.0, 1.0], 2: [0.0, 1.0], 3: None, 4: None}
    got, _ = models.with_model(df, "id", "text", models.hashing_embedder(8), "v", "array<double>")
    v = {r["id"]: r["v"] for r in got.collect()}
    assert sum(v[1]) == 3 and max(v[1]) >= 2 and v[2] == [0.0] * 8


def test_model_runs_once_a_row(spark):
    df = spark.createDataFrame([(1, "a")], "id long, text string")
    plan = models.inferred(df, "id", "text", odd_model, "out").where("not failed")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_word_vector_cosine(spark):
    words = {"a": [1.0, 0.0], "b": [0.0, 1.0], "c": [1.0, 1.0]}
    table = spark.createDataFrame(list(words.items()), "token string, vector array<float>")
    rows = [(1, "a b", "c"), (2, "a a b", "a"), (3, "zz", "a"), (4, "", "a"), (5, "a", "b"), (6, None, "a"), (7, "c  zz", "b")]
    got = {r[0]: r[1] for r in vectors.word_vector_cosine(spark.createDataFrame(rows, "id long, real string, gen string"), "id", "real", "gen", table, 2, "s").collect()}

    def mean(t):
        return sum((np.array(words[w]) for w in (t or "").split() if w in words), np.zeros(2))

    for i, r, g in rows:
        x, y = mean(r), mean(g)
        want = x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) if x.any() and y.any() else 0.0
        assert got[i] == pytest.approx(want)


def test_evaluation_takes_supplied_vectors(spark):
    df = spark.createDataFrame([("r1", "one two", "one three", "one two. three", 0.5), ("r2", "x", "y", "x y", 0.1)],
                               "row_id string, Title string, gen_title string, Body string, Score double")
    emb = spark.createDataFrame([("r1", [1.0, 0.0], [1.0, 1.0])], "row_id string, real_vector array<float>, gen_vector array<float>")
    wv = spark.createDataFrame([("one", [1.0, 0.0]), ("two", [0.0, 1.0]), ("three", [0.0, 1.0])], "token string, vector array<double>")
    plain, got = ({r["row_id"]: r for r in e.collect()} for e in (evaluate_pairs(df), evaluate_pairs(df, word_vectors=wv, dim=2, embeddings=emb)))
    assert got["r1"]["cosine_similarity_bert_embed"] == pytest.approx(0.5 ** 0.5) and got["r2"]["cosine_similarity_bert_embed"] is None
    assert got["r1"]["cosine_similarity_spacey"] == pytest.approx(1.0) and got["r2"]["cosine_similarity_spacey"] == 0
    for c in ("bleu_score", "rouge1_f1_score_gen_title", "rouge2_f1_score_real_title"):
        assert got["r1"][c] == plain["r1"][c]
    assert list(got["r1"].asDict()) == list(plain["r1"].asDict())


def test_jobs_with_models(spark, tmpdir_fresh):
    arts, truth = _write_corpora(tmpdir_fresh)
    prepared = jobs.prepare_job(spark, arts, truth, os.path.join(tmpdir_fresh, "prepared"), summarizer=models.lead_summarizer)
    p = spark.read.parquet(prepared)
    assert dict(p.dtypes)["row_id"] == "string"         # ids stay as they are written
    rows = p.collect()
    assert rows and all(r["Summary"] == " ".join(r["Body"][:500].split()[:20]) and len(r["Summary"].split()) >= 5 for r in rows)
    with pytest.raises(models.ModelFailureError):
        jobs.prepare_job(spark, arts, truth, os.path.join(tmpdir_fresh, "never"), summarizer=models.lead_summarizer, max_failure_rate=0.0)
    assert not os.path.exists(os.path.join(tmpdir_fresh, "never"))

    out = os.path.join(tmpdir_fresh, "eval")
    jobs.evaluate_job(spark, prepared, "train", out, generator=models.lead_generator)
    own = p.selectExpr("row_id", "'a headline of my own' AS gen_title")
    jobs.evaluate_job(spark, prepared, "train", out, headlines=own, cap=5)
    got = spark.read.parquet(f"{out}/outputs").collect()
    by_model = {r["row_id"]: r["gen_title"] for r in got if r["model"] == "lead_generator"}
    bodies = {r["row_id"]: r["Body"] for r in rows}
    assert by_model and all(g == " ".join(bodies[i].split()[:10]) for i, g in by_model.items())
    assert {r["gen_title"] for r in got if r["model"] is None} == {"a headline of my own"}
    assert 0 < sum(r["model"] is None for r in got) <= 7


def test_a_fitted_classifier_scores_in_a_session_with_observations(spark):
    """An observation leaves a manager in the session that no task can take along."""
    rows = [(i, "you won" if i % 2 else "council meets", float(i % 2)) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, Title string, Score double")
    seen = Observation("rows")
    assert df.observe(seen, F.count(F.lit(1)).alias("n")).count() == 20 and seen.get == {"n": 20}
    got = scorers.fit_classifier(df).transform(df).select("id", "prediction").collect()
    assert {r["id"]: r["prediction"] for r in got} == {i: s for i, _, s in rows}
