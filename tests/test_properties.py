"""Properties: splits disjoint and complete, packed length, metric bounds,
decode(encode(x)) == x in vocabulary, block prefix sums == simple window,
row positions independent of partitioning."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from baitline.functions import tokens as tk
from baitline.operators import encode, rowindex, split
from baitline.operators.evaluate import METRIC_COLUMNS
from baitline.plans import headline as hp

from .conftest import SF_SMALL


def test_splits_disjoint_complete(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(F.col("doc_id").alias("row_id"))
    n = docs.count()
    for s in (split.split_by_hash(docs, "row_id"), split.split_exact(docs, "row_id")):
        assert s.count() == n
        assert s.select("row_id").distinct().count() == n
        assert set(r[0] for r in s.select("split").distinct().collect()) <= {"train", "dev", "test"}


def test_split_exact_stable_under_partitioning(spark):
    df = spark.range(5000).withColumnRenamed("id", "row_id")
    a = {(r[0], r[1]) for r in split.split_exact(df.repartition(1), "row_id").collect()}
    b = {(r[0], r[1]) for r in split.split_exact(df.repartition(13), "row_id").collect()}
    assert a == b


def test_pack_properties(spark):
    p = hp.prepared_set(spark, SF_SMALL)
    pk = p.select(tk.pack(tk.encode_text("Body"), tk.encode_text("Title")).alias("pk"))
    bad = pk.filter((F.size("pk.sequence") != 512) |
                    (F.aggregate("pk.title_mask", F.lit(0), lambda a, x: a + x) != 512 - F.col("pk.body_len")))
    assert bad.count() == 0


def test_metrics_bounded(spark):
    ev = hp.headline_eval(spark, SF_SMALL)
    cond = None
    for c in METRIC_COLUMNS:
        c_bad = (F.col(c) < -1e-12) | (F.col(c) > 1 + 1e-9)
        cond = c_bad if cond is None else cond | c_bad
    assert ev.filter(cond).count() == 0
    assert ev.count() > 0


def test_decode_encode_roundtrip_in_vocabulary(spark):
    p = hp.prepared_set(spark, SF_SMALL)
    v = encode.build_vocab(p, ["Title", "Body"], size=1_000_000)   # every token is in vocabulary
    rt = encode.roundtrip(p, "row_id", "Title", v)
    joined = rt.join(p.select("row_id", F.array_join(F.filter(F.split("Title", r"[ \t\n\r\f]+"),
                                                                lambda t: t != ""), " ").alias("orig")), "row_id")
    assert joined.filter(F.col("decoded") != F.col("orig")).count() == 0
    assert rt.agg(F.sum("n_unk")).first()[0] == 0


def test_block_running_sum_equals_window(spark):
    df = spark.range(1000).select(F.col("id").alias("pos"), (F.col("id") % 3 == 0).cast("int").alias("ok"))
    blk = rowindex.running_sum(df, "pos", "ok", "acc", block=64)
    simple = df.withColumn("acc2", F.sum("ok").over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    j = blk.join(simple, "pos")
    assert j.filter(F.col("acc") != F.col("acc2")).count() == 0


def test_dense_index_independent_of_partitions(spark):
    base = spark.range(777).select((F.col("id") * 7919 % 1009).alias("k"), F.col("id").alias("u"))
    results = []
    for n in (1, 4, 16):
        d = rowindex.with_dense_index(base.repartition(n), ["k", "u"], "pos", num_partitions=n)
        results.append(sorted((r["k"], r["u"], r["pos"]) for r in d.collect()))
    assert results[0] == results[1] == results[2]
    assert [r[2] for r in results[0]] == list(range(777))


def test_file_position_matches_parquet_row_index(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    d = rowindex.with_file_position(docs.select("doc_id", F.col("_metadata.row_index").alias("ri")))
    assert d.filter(F.col("file_pos") != F.col("ri")).count() == 0


def test_exact_median_with_refinement_and_ties(spark):
    import statistics

    from baitline.operators import report

    rows = [("a", 0.0)] * 700 + [("a", float(i) / 7) for i in range(1300)] + \
           [("b", float((i * 37) % 1001)) for i in range(2000)] + [("c", 5.0)]
    df = spark.createDataFrame(rows, "g string, value double")
    # a tiny sketch accuracy forces several rounds
    got = {r["g"]: r["median"] for r in
           report.describe_metrics(df, ["value"], by=["g"], accuracy=20).collect()}
    for g in ("a", "b", "c"):
        want = statistics.median([v for k, v in rows if k == g])
        assert abs(got[g] - want) < 1e-12, (g, got[g], want)


def test_results_equal_across_partition_counts(spark):
    from baitline.plans import queries as Q

    old = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    try:
        for n in ("1", "4", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(tuple(sorted(tuple(r) for r in Q.REGISTRY[name](spark, SF_SMALL).collect())
                             for name in ("metric_report", "split_exact", "vocab", "running_accuracy")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got[0] == got[1] == got[2]


def test_dense_index_exact_when_range_sampling_is_partial(spark):
    # enough rows per input partition that the range sampler only sees a
    # sample: counts and rows must still agree
    base = spark.range(0, 60000, 1, 8).select(((F.col("id") * 7919) % 60013).alias("k"))
    d = rowindex.with_dense_index(base, ["k"], "pos", num_partitions=8)
    r = d.select((F.max("pos") - F.min("pos") + 1).alias("span"), F.countDistinct("pos").alias("nd"),
                 F.count(F.lit(1)).alias("n")).first()
    assert (r["span"], r["nd"], r["n"]) == (60000, 60000, 60000)
    w = Window.orderBy("k")
    bad = d.withColumn("rk", F.row_number().over(w) - 1).filter(F.col("rk") != F.col("pos")).count()
    assert bad == 0


def test_pack_layouts_random_lengths(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from baitline.functions import tokens as tk

    @settings(max_examples=25, deadline=None)
    @given(st.lists(st.tuples(st.integers(0, 700), st.integers(0, 120)), min_size=1, max_size=8))
    def check(sizes):
        rows = [(list(range(10, 10 + nb)), list(range(9000, 9000 + nt))) for nb, nt in sizes]
        df = spark.createDataFrame(rows, "b array<int>, t array<int>")
        out = df.select(tk.pack("b", "t").alias("p"), tk.pack_right("b", "t").alias("r"),
                        tk.fixed_length("t", 50).alias("f")).collect()
        for (nb, nt), o in zip(sizes, out):
            t = min(nt, 64)
            kept = min(nb, 512 - t - 1)
            assert len(o["p"]["sequence"]) == 512 and sum(o["p"]["title_mask"]) == 512 - kept
            assert len(o["r"]["sequence"]) == 512
            assert sum(o["r"]["attention_mask"]) == min(nb, 511 - t) + 1 + t
            assert len(o["f"]["ids"]) == 50 and sum(o["f"]["mask"]) == min(nt, 49) + 1

    check()


def test_report_medians_on_odd_inputs(spark):
    import math
    import statistics

    from pyspark.sql import functions as F

    from baitline.operators import report

    cols = {"wide": [(-1.0) ** i * 10.0 ** (i % 600 - 300) for i in range(1201)], "two": [0.0, 1.0] * 600 + [float("nan")],
            "none": [None] * 1201, "inf": [math.inf, -math.inf, 2.0] + [None] * 1198, "whole": [2 ** 53 - 1 - i for i in range(1201)]}
    df = spark.createDataFrame(list(zip(range(1201), *cols.values())), "k int, " + ", ".join(f"{c} {'long' if c == 'whole' else 'double'}" for c in cols))
    df = df.withColumn("g", F.when(F.col("k") % 3 > 0, F.col("k") % 3))
    for acc in (20, 10_000):
        got = {r["metric"]: r for r in report.describe_metrics(df.drop("k", "g"), accuracy=acc).collect()}
        assert set(got) == {c + "_metrics" for c in cols} - {"none_metrics"}
        for c in ("wide", "two", "inf", "whole"):
            vals = [v for v in cols[c] if v is not None and not math.isnan(v)]
            r = got[c + "_metrics"]
            assert (r["median"], r["min"], r["max"]) == (statistics.median(vals), min(vals), max(vals)), (acc, c)
    by = {r["g"]: r["median"] for r in report.describe_metrics(df, ["wide"], by=["g"], accuracy=20).collect()}
    for g in (None, 1, 2):
        assert by[g] == statistics.median([v for k, v in enumerate(cols["wide"]) if (k % 3 or None) == g])
    empty = df.where("false")
    assert report.describe_metrics(empty.drop("k"), ["wide"]).count() == 0
    assert report.describe_metrics(empty, ["wide"], by=["g"]).count() == 0


def test_report_exchanges_no_values(spark):
    from baitline.operators import report

    df = spark.range(1000).selectExpr("id / 7.0 as value")
    plan = report.describe_metrics(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
