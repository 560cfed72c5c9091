"""The four end-to-end jobs on JSON-lines corpora derived from the driver
tables (three article files and three truth files, as the reference reads)."""

import json
import os

import duckdb
from pyspark.sql import functions as F

from baitline.plans import jobs

from .conftest import SF_SMALL


def _write_corpora(tmp):
    con = duckdb.connect()
    docs = con.execute(f"SELECT doc_id, text FROM '{SF_SMALL}/documents.parquet' ORDER BY doc_id").fetchall()
    labs = con.execute(f"SELECT doc_id, quality, toxic FROM '{SF_SMALL}/labels.parquet' ORDER BY doc_id").fetchall()
    arts, truth = [], []
    for k in range(3):
        a, t = os.path.join(tmp, f"instances{k}.jsonl"), os.path.join(tmp, f"truth{k}.jsonl")
        with open(a, "w") as f:
            for doc_id, text in docs[k::3]:
                lines = text.split("\n")
                f.write(json.dumps({"id": str(doc_id), "targetTitle": lines[0], "targetParagraphs": lines[1:],
                                    "postText": ["ignored"]}) + "\n")
        with open(t, "w") as f:
            for doc_id, q, x in labs[k::3]:
                f.write(json.dumps({"id": str(doc_id), "truthMode": ((1 - q) * 2 + x) / 3.0,
                                    "truthClass": "clickbait" if q == 0 else "no-clickbait"}) + "\n")
        arts.append(a)
        truth.append(t)
    return arts, truth


def test_jobs_end_to_end(spark, tmpdir_fresh):
    arts, truth = _write_corpora(tmpdir_fresh)
    prepared = jobs.prepare_job(spark, arts, truth, os.path.join(tmpdir_fresh, "prepared"))
    p = spark.read.parquet(prepared)
    from baitline.plans import headline as hp

    assert p.count() == hp.prepared_set(spark, SF_SMALL).count()
    assert {r[0] for r in p.select("split").distinct().collect()} <= {"train", "dev", "test"}

    for layout in jobs.LAYOUTS:
        enc = jobs.encode_job(spark, prepared, os.path.join(tmpdir_fresh, "enc"), layout)
        e = spark.read.parquet(enc).filter(F.col("layout") == layout)
        assert e.count() == p.count()

    rep = jobs.evaluate_job(spark, prepared, "train", os.path.join(tmpdir_fresh, "eval"), cap=20)
    assert rep.count() == 8
    outs = spark.read.parquet(os.path.join(tmpdir_fresh, "eval", "outputs"))
    assert 0 < outs.count() <= 22
    rates = jobs.classify_job(spark, prepared, "train", os.path.join(tmpdir_fresh, "cls")).first()
    assert rates["Overall Accuracy"] is not None

    # positional alignment over the listed files: the files list articles and
    # truth in different orders, so far fewer pairs agree than by key
    by_pos = spark.read.parquet(jobs.prepare_job(spark, arts, truth, os.path.join(tmpdir_fresh, "prep_pos"),
                                                 by_position=True))
    assert by_pos.count() > 0


def test_jobs_command_line(spark, tmpdir_fresh):
    arts, truth = _write_corpora(tmpdir_fresh)
    prep = os.path.join(tmpdir_fresh, "p")
    jobs.main(["prepare", "--articles", *arts, "--truth", *truth, "--out", prep, "--exact"])
    jobs.main(["encode", "--prepared", prep, "--out", os.path.join(tmpdir_fresh, "e"), "--layout", "seq2seq",
               "--split", "train"])
    jobs.main(["evaluate", "--prepared", prep, "--split", "dev", "--out", os.path.join(tmpdir_fresh, "v"),
               "--wanted-scores", "0"])
    jobs.main(["classify", "--prepared", prep, "--split", "test", "--out", os.path.join(tmpdir_fresh, "c")])
    p = spark.read.parquet(prep)
    sizes = {r["split"]: r["count"] for r in p.groupBy("split").count().collect()}
    from baitline.operators.split import exact_sizes

    assert (sizes.get("train", 0), sizes.get("dev", 0), sizes.get("test", 0)) == exact_sizes(p.count())
    e = spark.read.parquet(os.path.join(tmpdir_fresh, "e"))
    assert e.filter(F.size("sequences") != 512).count() == 0 and e.count() == sizes["train"]


def test_train_and_classify_with_model(spark, tmpdir_fresh):
    arts, truth = _write_corpora(tmpdir_fresh)
    prep = jobs.prepare_job(spark, arts, truth, os.path.join(tmpdir_fresh, "p"))
    model = jobs.train_classifier_job(spark, prep, os.path.join(tmpdir_fresh, "model"))
    r = jobs.classify_job(spark, prep, "train", os.path.join(tmpdir_fresh, "c"), model=model).first()
    assert 0.0 <= r["Overall Accuracy"] <= 1.0


def test_layouts_and_splits_share_a_folder(spark, tmpdir_fresh):
    """Writing one layout or split leaves the others in the folder alone, and
    each layout comes back with its own columns."""
    from pyspark.sql import functions as F

    from baitline.plans import jobs
    from baitline.sources import datasets

    rows = [(i, f"title {i}", f"body {i} text", "sum", 1.0, "train" if i % 2 else "dev") for i in range(10)]
    p = datasets.write_prepared(spark.createDataFrame(rows, datasets.PREPARED_SCHEMA), tmpdir_fresh + "/p")
    out = tmpdir_fresh + "/e"
    for layout in jobs.LAYOUTS:
        for name in ("train", "dev"):
            jobs.encode_job(spark, p, out, layout, name)
    for layout in jobs.LAYOUTS:
        back = datasets.read_encoded(spark, out, layout, "hash")
        assert {(r["split"], r["n"]) for r in back.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()} == {("train", 5), ("dev", 5)}
    assert len(datasets.read_encoded(spark, out, "seq2seq", "hash").columns) > 8


def test_repeated_evaluation_keeps_runs_apart(spark, tmpdir_fresh):
    from baitline.plans import jobs
    from baitline.sources import datasets

    rows = [(i, f"some title {i} words", f"some body {i} text with words. And one more sentence here with title {i} words.", "sum", 1.0, "dev")
            for i in range(6)]
    p = datasets.write_prepared(spark.createDataFrame(rows, datasets.PREPARED_SCHEMA), tmpdir_fresh + "/p")
    a, b = ([tuple(round(x, 9) if isinstance(x, float) else x for x in r)
             for r in jobs.evaluate_job(spark, p, "dev", tmpdir_fresh + "/o").orderBy("metric").collect()] for _ in range(2))
    assert a == b and spark.read.parquet(tmpdir_fresh + "/o/outputs").select("run_id").distinct().count() == 2
