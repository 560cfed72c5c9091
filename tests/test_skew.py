"""Operators under a hot key: one key / value / token holds a third of all rows."""

import statistics
from collections import Counter

from pyspark.sql import Window
from pyspark.sql import functions as F

from baitline.operators import encode, report, rowindex, split


def test_median_with_hot_value(spark):
    vals = [0.0] * 3000 + [i / 6000 for i in range(6000)]
    df = spark.createDataFrame([("m", v) for v in vals], "metric string, value double")
    got = report.describe_metrics(df.drop("metric"), ["value"], accuracy=50).first()
    assert abs(got["median"] - statistics.median(vals)) < 1e-12
    assert abs(got["std"] - statistics.pstdev(vals)) < 1e-9


def test_exact_split_with_hot_key(spark):
    # a third of the rows share one key; the tiebreak makes the order total
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"),
                                  F.col("id").alias("uid"))
    s = split.split_exact(df, "k", tiebreak=("uid",))
    got = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert (got["train"], got["dev"], got["test"]) == split.exact_sizes(9000)
    again = {(r["uid"], r["split"]) for r in split.split_exact(df.repartition(5), "k", tiebreak=("uid",)).collect()}
    assert again == {(r["uid"], r["split"]) for r in s.collect()}


def test_vocab_with_hot_token(spark):
    texts = [("the " * 50 + f"w{i} x{i % 7}",) for i in range(300)]
    df = spark.createDataFrame(texts, "t string")
    v = {r["token"]: (r["id"], r["count"]) for r in encode.build_vocab(df, ["t"], size=5).collect()}
    c = Counter(w for (t,) in texts for w in t.split())
    top = sorted(c.items(), key=lambda kv: (-kv[1], kv[0]))[:5]
    assert {t: n for t, (_, n) in v.items()} == dict(top)
    assert v["the"] == (4, 15000)


def test_running_sum_with_hot_group(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.lit("cold")).alias("g"),
                                  F.col("id").alias("pos"), (F.col("id") % 2).alias("v"))
    blk = rowindex.running_sum(df, "pos", "v", "acc", block=128, partition_by=("g",))
    ref = df.withColumn("acc2", F.sum("v").over(
        Window.partitionBy("g").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    assert blk.join(ref, ["g", "pos"]).filter(F.col("acc") != F.col("acc2")).count() == 0


def test_approximate_report_option(spark):
    vals = [i / 1000 for i in range(1001)]
    df = spark.createDataFrame([(v,) for v in vals], "value double")
    r = report.describe_metrics(df, exact=False).first()
    assert r["metric"] == "value_metrics" and abs(r["median"] - 0.5) <= 0.002
    assert r["min"] == 0.0 and r["max"] == 1.0
