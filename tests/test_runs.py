"""Run manifest and lookup by position."""

import pytest
from pyspark.sql import functions as F

from baitline.operators import report, rowindex
from baitline.plans import jobs
from baitline.sources import datasets, runs


def _prepared(spark, path, n=60):
    rows = [(i, f"You won't believe {i}?" if i % 2 else f"Council meets on item {i}", f"Body {i}. The body of item {i} has some words in it.", "s", float(i % 2), "train")
            for i in range(n)]
    return datasets.write_prepared(spark.createDataFrame(rows, datasets.PREPARED_SCHEMA), path)


def test_no_runs_before_the_first_commit(spark, tmpdir_fresh):
    folder = tmpdir_fresh + "/runs"
    assert runs.read_runs(spark, folder).count() == 0
    runs.commit_run(spark, folder, "a", "train", "clf", "clf-1", rows=0)
    r = runs.read_runs(spark, folder, "train").first()
    assert (r["run_id"], r["artifact"], r["rows"], r["loss"]) == ("a", "clf-1", 0, None) and r["committed_at"] is not None
    assert runs.read_runs(spark, folder, "evaluate").count() == 0


def test_training_runs_rank_by_loss(spark, tmpdir_fresh):
    prep, folder = _prepared(spark, tmpdir_fresh + "/p"), tmpdir_fresh + "/runs"
    jobs.train_classifier_job(spark, prep, tmpdir_fresh + "/clf-0001", manifest=folder)
    jobs.train_classifier_job(spark, prep, tmpdir_fresh + "/clf-0002", manifest=folder)
    runs.commit_run(spark, folder, "worse", "train", "clf", "clf-0000", loss=99.0)
    done = runs.read_runs(spark, folder, "train")
    assert [r["name"] for r in report.top_k_runs(done, 2).collect()] == ["clf-0001", "clf-0002"]
    assert report.latest_artifact(done).collect()[0].asDict() == {"run": "clf", "latest": "clf-0002"}
    assert {r["rows"] for r in done.where("loss < 99").collect()} == {60}


def test_a_failed_job_leaves_no_run(spark, tmpdir_fresh, monkeypatch):
    prep, out = _prepared(spark, tmpdir_fresh + "/p"), tmpdir_fresh + "/e"
    jobs.evaluate_job(spark, prep, "train", out)
    write = datasets.write_report

    def fails(*args, **kwargs):
        raise RuntimeError("disk full")

    monkeypatch.setattr(datasets, "write_report", fails)
    with pytest.raises(RuntimeError):
        jobs.evaluate_job(spark, prep, "train", out)
    monkeypatch.setattr(datasets, "write_report", write)
    done = runs.read_runs(spark, out + "/runs", "evaluate")
    outputs = spark.read.parquet(out + "/outputs")
    assert done.count() == 1 and outputs.select("run_id").distinct().count() == 2
    assert runs.committed(outputs, done).count() * 2 == outputs.count() == done.first()["rows"] * 2


def test_reports_of_the_classify_job_read_back(spark, tmpdir_fresh):
    prep, out = _prepared(spark, tmpdir_fresh + "/p", 250), tmpdir_fresh + "/c"
    rates = jobs.classify_job(spark, prep, "train", out).first()
    back = datasets.read_rates(spark, out + "/rates").first()
    assert all(back[c] == rates[c] for c in report.RATE_NAMES) and back["split"] == "train"
    assert [r["pos"] for r in datasets.read_running_accuracy(spark, out + "/running_accuracy").orderBy("pos").collect()] == [1, 101, 201]
    r = runs.read_runs(spark, out + "/runs").first()
    assert r["rows"] == 250 and abs(r["loss"] + rates["Overall Accuracy"] - 1) < 1e-12
    # a split without rows
    jobs.classify_job(spark, prep, "dev", out)
    assert runs.read_runs(spark, out + "/runs").where("split = 'dev'").first()["rows"] == 0


def test_outputs_of_runs_with_other_columns(spark, tmpdir_fresh):
    out = tmpdir_fresh + "/o"
    for k in range(4):      # whichever file names the writer draws
        datasets.write_outputs(spark.range(2), {"run_id": f"a{k}"}, out)
        datasets.write_outputs(spark.range(3).withColumn("extra", F.lit(1.0)), {"run_id": f"b{k}", "model": "m"}, out)
    back = datasets.read_outputs(spark, out)
    assert back.where("model = 'm' AND extra = 1").count() == 12 and back.where("model IS NULL AND extra IS NULL").count() == 8


def test_every_position_is_found(spark, tmpdir_fresh):
    path = tmpdir_fresh + "/a set"
    spark.range(23).select("id", (F.col("id") % 2).alias("part"), F.concat(F.lit("t"), "id").alias("text")).repartition(3).write.partitionBy("part").parquet(path)
    index = rowindex.write_position_index(spark, path, tmpdir_fresh + "/index")
    want = {r["p"]: (r["id"], r["part"]) for r in rowindex.with_parquet_position(spark.read.parquet(path), "p").collect()}
    assert sorted(want) == list(range(23))
    for p in want:
        found = rowindex.record_at_position(spark, path, index, p)
        assert [(r["id"], r["part"]) for r in found.select("id", "part").collect()] == [want[p]]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString() and len(found.inputFiles()) == 1
    for p in (-1, 23):
        assert rowindex.record_at_position(spark, path, index, p).count() == 0


def test_positions_of_an_empty_set(spark, tmpdir_fresh):
    path = tmpdir_fresh + "/empty"
    spark.createDataFrame([], "id long").write.parquet(path)
    index = rowindex.write_position_index(spark, path, tmpdir_fresh + "/index")
    assert rowindex.record_at_position(spark, path, index, 0).count() == 0
