"""Sources and sinks: JSON-lines union with file order, prepared/encoded/report
round trips with partition pruning, streaming encode."""

import json
import os

from pyspark.sql import functions as F

from baitline.functions import tokens as tk
from baitline.operators import rowindex, split
from baitline.plans import headline as hp
from baitline.sources import datasets
from baitline.streaming.encode_stream import encode_stream

from .conftest import SF_SMALL


def _write_jsonl(path, rows):
    with open(path, "w") as f:
        for r in rows:
            f.write(json.dumps(r) + "\n")


def test_jsonl_union_keeps_file_order_and_missing_columns(spark, tmpdir_fresh):
    a = os.path.join(tmpdir_fresh, "a.jsonl")
    b = os.path.join(tmpdir_fresh, "b.jsonl")
    _write_jsonl(a, [{"id": "1", "targetTitle": "t1", "targetParagraphs": ["p", "q"]},
                     {"id": "2", "targetTitle": "t2", "targetParagraphs": []}])
    _write_jsonl(b, [{"id": "3", "targetParagraphs": ["r"]}])
    df = datasets.read_jsonl_union(spark, [a, b], datasets.ARTICLE_SCHEMA)
    rows = sorted((r["file_ordinal"], r["id"], r["targetTitle"]) for r in df.collect())
    assert rows == [(0, "1", "t1"), (0, "2", "t2"), (1, "3", None)]
    pos = rowindex.with_file_position(spark.read.schema(datasets.ARTICLE_SCHEMA).json([a, b]))
    assert sorted((r["file_pos"], r["id"]) for r in pos.collect()) == [(0, "1"), (1, "2"), (2, "3")]


def test_prepared_roundtrip_prunes_split(spark, tmpdir_fresh):
    p = split.split_by_hash(hp.prepared_set(spark, SF_SMALL), "row_id")
    path = datasets.write_prepared(p, os.path.join(tmpdir_fresh, "prep"))
    back = datasets.read_prepared(spark, path, "dev")
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "dev" in plan
    assert back.count() == p.filter("split = 'dev'").count()


def test_encoded_roundtrip_pushes_score_range(spark, tmpdir_fresh):
    p = split.split_by_hash(hp.prepared_set(spark, SF_SMALL), "row_id")
    enc = p.select("row_id", "split", F.col("Score").alias("scores"),
                   tk.pack(tk.encode_text("Body"), tk.encode_text("Title")).alias("pk")).select(
        "row_id", "split", "scores", F.col("pk.sequence").alias("sequences"),
        F.col("pk.title_mask").alias("title_masks"))
    path = datasets.write_encoded(enc, "packed", "hash", os.path.join(tmpdir_fresh, "enc"))
    back = datasets.read_encoded(spark, path, "packed", "hash", split="train", wanted=[0])
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "scores" in plan
    want = p.filter("split = 'train' AND abs(Score) < 0.1").count()
    assert back.count() == want
    # another layout in the same folder does not clash
    datasets.write_encoded(enc.limit(1), "other", "hash", path + "_x")
    assert datasets.read_encoded(spark, path, "packed", "hash").count() == enc.count()


def test_report_roundtrip_tags(spark, tmpdir_fresh):
    rep = spark.createDataFrame([("bleu_score_metrics", 0.0, 1.0, 0.5, 0.5, 0.1)],
                                "metric string, min double, max double, median double, mean double, std double")
    path = os.path.join(tmpdir_fresh, "rep")
    datasets.write_report(rep, {"model_type": "T5", "class_loss": False, "summ_loss": True}, path)
    datasets.write_report(rep, {"model_type": "GPT", "class_loss": False, "summ_loss": False}, path)
    back = datasets.read_report(spark, path)
    assert sorted(r[0] for r in back.select("model_type").collect()) == ["GPT", "T5"]


def test_streaming_encode(spark, tmpdir_fresh):
    p = split.split_by_hash(hp.prepared_set(spark, SF_SMALL), "row_id")
    src = os.path.join(tmpdir_fresh, "src")
    p.select("row_id", "Title", "Body", "Summary", "Score", "split").write.parquet(src)
    out = os.path.join(tmpdir_fresh, "out")
    q = encode_stream(spark, src, out, os.path.join(tmpdir_fresh, "ck"))
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    assert got.count() == p.count()
    assert got.filter(F.size("sequences") != 512).count() == 0


def test_outputs_sink_and_record_lookup(spark, tmpdir_fresh):
    from baitline.plans import headline as hp2

    ev = hp2.headline_eval(spark, SF_SMALL)
    path = datasets.write_outputs(ev, {"model_type": "extractive", "split": "dev"},
                                  os.path.join(tmpdir_fresh, "out"))
    back = spark.read.parquet(path)
    assert back.count() == ev.count() and "model_type" in back.columns
    ordered = sorted(r[0] for r in ev.select("row_id").collect())
    assert rowindex.record_at(ev, 3, ["row_id"]).first()["row_id"] == ordered[3]
    assert rowindex.first_record(ev, ["row_id"]).first()["row_id"] == ordered[0]


def test_streaming_evaluate_equals_batch(spark, tmpdir_fresh):
    from baitline.streaming.evaluate_stream import evaluate_stream

    p = split.split_by_hash(hp.prepared_set(spark, SF_SMALL), "row_id")
    src = os.path.join(tmpdir_fresh, "src")
    p.select("row_id", "Title", "Body", "Summary", "Score", "split").write.parquet(src)
    out = os.path.join(tmpdir_fresh, "out")
    q = evaluate_stream(spark, src, out, os.path.join(tmpdir_fresh, "ck"))
    q.awaitTermination(180)
    got = spark.read.parquet(out)
    want = hp.headline_eval(spark, SF_SMALL)
    cols = ["row_id", "gen_title", "bleu_score", "rouge1_f1_score_gen_title"]
    assert sorted(tuple(r) for r in got.select(*cols).collect()) == \
        sorted(tuple(r) for r in want.select(*cols).collect())


class _WordLevelEncoder:
    """A plug-in encoder built offline with the tokenizers library: created once
    per task, applied to Arrow batches."""

    def __init__(self):
        from tokenizers import Tokenizer, models, pre_tokenizers

        vocab = {"[UNK]": 0, "the": 1, "and": 2, "of": 3}
        self.tok = Tokenizer(models.WordLevel(vocab, unk_token="[UNK]"))
        self.tok.pre_tokenizer = pre_tokenizers.WhitespaceSplit()

    def __call__(self, text):
        if text == "boom":
            raise ValueError("model failure")
        return self.tok.encode(text).ids


def test_plugin_encoder_and_failed_rows(spark):
    from baitline.operators.scorers import apply_text_model

    df = spark.createDataFrame([(1, "the cat and the dog"), (2, "boom"), (3, None)], "id long, t string")
    got = {r["id"]: r["ids"] for r in apply_text_model(df, "t", _WordLevelEncoder, "ids", "array<int>").collect()}
    assert got == {1: [1, 0, 2, 1, 0], 2: None, 3: None}


def test_scratch_tables_live_under_the_session_checkpoint_dir(spark):
    from baitline.session import ensure_checkpoint_dir, materialize, scratch_path

    configured = spark.conf.get("spark.checkpoint.dir", None)
    base = ensure_checkpoint_dir(spark)
    if configured:
        assert configured.rstrip("/").split(":")[-1] in base
    path = scratch_path(spark, "t")
    assert path.startswith(base.rstrip("/") + "/t-")
    df = materialize(spark.range(5), "t")

    def bare(u):   # file:/x and file:///x name the same folder
        return u.split(":", 1)[-1].lstrip("/")
    assert df.count() == 5 and bare(df.inputFiles()[0]).startswith(bare(base.rstrip("/")))


def test_bad_json_lines_are_rejects_and_keep_their_places(spark, tmpdir_fresh):
    import json
    import os

    from baitline.sources import datasets

    paths = []
    for k in range(2):
        paths.append(os.path.join(tmpdir_fresh, f"a{k}.jsonl"))
        with open(paths[-1], "w") as f:
            for i in range(6):
                f.write("{\"id\": \"cut\n" if i == 2 else json.dumps({"id": f"{k}-{i}", "targetTitle": "t", "targetParagraphs": ["p"]}) + "\n")
    rejects = os.path.join(tmpdir_fresh, "rejects")
    got = datasets.read_jsonl_union(spark, paths, datasets.ARTICLE_SCHEMA, with_position=True, rejects=rejects)
    assert sorted((r["file_row"], r["id"]) for r in got.collect()) == [(6 * k + i, f"{k}-{i}") for k in range(2) for i in range(6) if i != 2]
    assert sorted(tuple(r) for r in spark.read.parquet(rejects).select("file_ordinal", "line").collect()) == [(k, "{\"id\": \"cut") for k in range(2)]
    assert got.count() == 10 and got.where("file_ordinal = 1").count() == 5
    assert "Join [file_ordinal" not in got._jdf.queryExecution().executedPlan().toString()
