"""Hand-made edge rows for each operator (written as literals)."""

import math

import pytest
from pyspark.sql import functions as F

from baitline.functions import similarity as sim
from baitline.functions import text as tx
from baitline.functions import tokens as tk
from baitline.operators import filters, report, split
from baitline.operators.evaluate import evaluate_pairs


def one(spark, expr, schema, row):
    return spark.createDataFrame([row], schema).select(expr.alias("v")).first()["v"]


def test_flatten_paragraphs(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None), (4, ["a", None])],
                               "id int, p array<string>")
    got = {r["id"]: r["b"] for r in df.select("id", tx.flatten_paragraphs("p").alias("b")).collect()}
    assert got == {1: "a b", 2: "", 3: None, 4: None}


def test_score_filter_edges(spark):
    df = spark.createDataFrame([(0.0999,), (0.1,), (None,), (float("nan"),), (0.95,), (0.5,)], "Score double")
    keep0 = sorted(r[0] for r in filters.with_scores(df, [0]).collect())
    assert keep0 == [0.0999]
    keep01 = sorted(r[0] for r in filters.with_scores(df, [0, 1]).collect())
    assert keep01 == [0.0999, 0.95]
    with pytest.raises(ValueError):
        filters.with_scores(df, [])
    with pytest.raises(ValueError):
        filters.with_scores(df.filter("Score > 2"), [0], require_rows=True)


def test_label_vs_prediction(spark):
    df = spark.createDataFrame([(0.5, 0.5)], "Score double, prob double")
    r = df.select(filters.binary_label("Score").alias("l"), filters.prediction("prob").alias("p")).first()
    assert (r["l"], r["p"]) == (0, 1)


@pytest.mark.parametrize("nt", [0, 64, 65])
@pytest.mark.parametrize("nb", [0, 447, 448, 511, 600])
def test_pack_lengths(spark, nt, nb):
    df = spark.createDataFrame([(list(range(10, 10 + nb)), list(range(5000, 5000 + nt)))],
                               "b array<int>, t array<int>")
    r = df.select(tk.pack("b", "t").alias("pk")).first()["pk"]
    seq, mask, blen = r["sequence"], r["title_mask"], r["body_len"]
    kept_t = min(nt, 64)
    kept_b = min(nb, 512 - kept_t - 1)
    assert len(seq) == 512 and len(mask) == 512
    assert blen == kept_b
    assert sum(mask) == 512 - kept_b
    assert seq[kept_b] == tk.SEP_ID
    assert seq[kept_b + 1: kept_b + 1 + kept_t] == list(range(5000, 5000 + kept_t))
    assert all(x == tk.PAD_ID for x in seq[kept_b + 1 + kept_t:])


@pytest.mark.parametrize("nt,nb", [(0, 10), (64, 10), (10, 600)])
def test_pack_right(spark, nt, nb):
    df = spark.createDataFrame([(list(range(10, 10 + nb)), list(range(5000, 5000 + nt)))],
                               "b array<int>, t array<int>")
    r = df.select(tk.pack_right("b", "t").alias("pk")).first()["pk"]
    seq, att = r["sequence"], r["attention_mask"]
    t = min(nt, 64)
    zone = 511 - t
    assert len(seq) == 512
    assert seq[zone] == tk.SEP_ID          # written, never added to a body id
    assert seq[zone + 1:] == list(range(5000, 5000 + t))
    kept = min(nb, zone)
    assert seq[:kept] == list(range(10, 10 + kept))
    assert all(x == 0 for x in seq[kept:zone])
    assert sum(att) == kept + 1 + t


def test_masks_shift_fill_ignore_firstzero(spark):
    df = spark.createDataFrame([([5, 6, 7, 0, 0], [0, 0, 1, 1, 1])], "ids array<int>, m array<int>")
    r = df.select(tk.shift_right("m").alias("s"), tk.masked_fill("ids", tk.shift_right("m")).alias("f"),
                  tk.pad_to_ignore("ids").alias("g"), tk.first_zero("ids").alias("z"),
                  tk.nonpad_mask("ids").alias("a")).first()
    assert r["s"] == [0, 0, 0, 1, 1]
    assert r["f"] == [0, 0, 0, 0, 0]
    assert r["g"] == [5, 6, 7, -100, -100]
    assert r["z"] == 3
    assert r["a"] == [1, 1, 1, 0, 0]
    full = spark.createDataFrame([([5, 6],)], "ids array<int>").select(tk.first_zero("ids")).first()[0]
    assert full == 2


def test_seq2seq_lengths(spark):
    df = spark.createDataFrame([("w " * 600, "t " * 70, "s")], "b string, t string, s string")
    e = df.select(tk.seq2seq_encode("b", "t", "s").alias("e")).first()["e"]
    assert len(e["sequences"]) == 512 and sum(e["sequence_masks"]) == 512
    assert e["sequences"][-1] == tk.EOS_ID
    assert len(e["titles"]) == 50 and e["titles"][49] == tk.EOS_ID
    assert e["summaries"][1] == tk.EOS_ID and sum(e["summary_masks"]) == 2


def test_rouge_edges(spark):
    df = spark.createDataFrame([("...",), ("abc. ",), ("one",)], "t string")
    rows = df.select("t", sim.rouge_valid("t").alias("ok"), sim.rouge_words("t").alias("w")).collect()
    got = {r["t"]: (r["ok"], r["w"]) for r in rows}
    assert got["..."] == (False, [])
    assert got["abc. "] == (True, ["abc", ""])
    r2 = one(spark, sim.rouge_n_f1(sim.rouge_words("a"), sim.rouge_words("b"), 2), "a string, b string",
             ("one", "one"))
    assert r2 == 0.0
    r1 = one(spark, sim.rouge_n_f1(sim.rouge_words("a"), sim.rouge_words("b"), 1), "a string, b string",
             ("x y", "y z"))
    assert abs(r1 - 2 * 0.25 / (1 + 1e-8)) < 1e-12


def test_bleu_edges(spark):
    s = "r array<string>, h array<string>"
    assert one(spark, sim.bleu1("r", "h"), s, (["a", "b"], ["c", "d"])) == 0.0
    assert one(spark, sim.bleu1("r", "h"), s, (["a", "b"], ["a", "c"])) == 0.5          # equal length
    assert one(spark, sim.bleu1("r", "h"), s, (["a", "b", "c"], ["a", "a", "a", "a"])) == 0.25  # clipped
    short = one(spark, sim.bleu1("r", "h"), s, (["a", "b", "c", "d"], ["a", "b"]))
    assert abs(short - math.exp(1 - 4 / 2)) < 1e-12


def test_cosines(spark):
    s = "a array<string>, b array<string>"
    v = one(spark, sim.bow_cosine("a", "b"), s, (["x", "x", "y"], ["x", "y", "y"]))
    assert abs(v - 4 / 5) < 1e-12
    assert one(spark, sim.bow_cosine("a", "b"), s, ([], ["x"])) == 0.0
    f = "a array<float>, b array<float>"
    assert abs(one(spark, sim.array_cosine("a", "b"), f, ([1.0, 0.0], [1.0, 1.0])) - 1 / math.sqrt(2)) < 1e-9
    assert one(spark, sim.array_cosine("a", "b"), f, ([0.0, 0.0], [1.0, 1.0])) is None


def test_rates_empty_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 1)], "label int, pred int")
    r = report.rates(report.confusion(df)).first()
    assert r["True Postive"] is None and r["False Negative"] is None
    assert r["True Negative"] == 0.5 and r["Overall Accuracy"] == 0.5


@pytest.mark.parametrize("n,sizes", [(10, (8, 1, 1)), (399, (319, 40, 40)), (10000, (7999, 1001, 1000))])
def test_exact_split_sizes(spark, n, sizes):
    assert split.exact_sizes(n) == sizes
    df = spark.range(n).withColumnRenamed("id", "row_id")
    got = {r["split"]: r["count"] for r in split.split_exact(df, "row_id").groupBy("split").count().collect()}
    assert (got.get("train", 0), got.get("dev", 0), got.get("test", 0)) == sizes


def test_eval_cap(spark):
    df = spark.range(300).select(F.col("id").alias("pos"))
    assert report.eval_cap(df, "pos", 200).count() == 202
    skipped = df.filter("pos != 201")
    got = sorted(r[0] for r in report.eval_cap(skipped, "pos", 200).collect())
    assert len(got) == 202 and got[-1] == 202


def test_pair_validity_rejects(spark):
    df = spark.createDataFrame([(1, 0.0, "Title", "gen", "body."), (2, 0.0, "Title", "", "b"),
                                (3, 0.0, "...", "gen", "body")],
                               "row_id long, Score double, Title string, gen_title string, Body string")
    assert [r["row_id"] for r in evaluate_pairs(df).collect()] == [1]


def test_resolve_split():
    assert filters.resolve_split("TRAIN") == "train"
    assert filters.resolve_split("d") == "dev"
    assert filters.resolve_split("te") == "test"
    with pytest.raises(ValueError):
        filters.resolve_split("x")


def test_count_stats_matches_brute_force(spark):
    import hashlib
    import random
    from collections import Counter

    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(40)] + ["", "ä", "x y"]
    rows = [([rnd.choice(vocab) for _ in range(rnd.randint(0, 60))],
             [rnd.choice(vocab) for _ in range(rnd.randint(0, 60))]) for _ in range(40)]
    df = spark.createDataFrame(rows, "r array<string>, h array<string>")
    got = df.select(sim.count_stats("r", "h").alias("c")).collect()

    def bucket(t):
        return int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % sim.EMBED_DIM

    for (r, h), g in zip(rows, got):
        cr, ch = Counter(r), Counter(h)
        er, eh = Counter(bucket(t) for t in r), Counter(bucket(t) for t in h)
        c = g["c"]
        assert c["m"] == sum(min(cr[t], ch[t]) for t in cr)
        assert c["dot"] == sum(cr[t] * ch[t] for t in cr)
        assert c["nr"] == sum(v * v for v in cr.values()) and c["ng"] == sum(v * v for v in ch.values())
        assert c["edot"] == sum(er[j] * eh[j] for j in er)
        assert c["enr"] == sum(v * v for v in er.values()) and c["eng"] == sum(v * v for v in eh.values())


def test_mini_cap_and_decode_specials(spark):
    from baitline.functions.tokens import UNK_ID
    from baitline.operators import encode
    from baitline.operators.prepare import prepare_articles

    ids = [608310377143799810 + 7919 * i for i in range(10)]
    arts = spark.createDataFrame([(ids[i], f"t{i}", [f"body {i} words here"], i) for i in range(10)],
                                 "id long, targetTitle string, targetParagraphs array<string>, file_row long")
    truth = spark.createDataFrame([(i, 0.0) for i in ids], "id long, truthMode double")
    p = prepare_articles(arts, truth, mini=4)
    assert sorted(r[0] for r in p.select("row_id").collect()) == ids[:4]

    vocab = spark.createDataFrame([("body", 4, 10), ("words", 5, 9)], "token string, id int, count long")
    texts = spark.createDataFrame([(1, "body x words")], "k long, t string")
    enc = encode.encode_with_vocab(texts, "k", "t", vocab)
    assert sorted((r["pos"], r["id"]) for r in enc.collect()) == [(0, 4), (1, UNK_ID), (2, 5)]
    assert encode.decode_ids(enc, "k", vocab).first()["decoded"] == "body words"
    blank = encode.roundtrip(spark.createDataFrame([(1, "body"), (2, ""), (3, " ")], "k long, t string"), "k", "t", vocab)
    assert sorted(tuple(r) for r in blank.collect()) == [(1, "body", 0, 1), (2, "", 0, 0), (3, "", 0, 0)]
    assert encode.decode_ids(enc, "k", vocab, skip_special=False).first()["decoded"] == "body <unk> words"
