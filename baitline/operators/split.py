"""Train/dev/test splits.

Both are keyed on a stable hash of the record id, so a record keeps its
split when others are added, and no split needs a global sort:

* :func:`split_by_hash` - fractions, one projection, no shuffle.
* :func:`split_exact` - exact sizes as the two-stage random split produces
  them (``n_test = ceil(f n)``, ``n_dev = ceil(f_dev / (1 - f_test) * rest)``).
  Rows are ranked by ``(hash, id)``; the rank is found through a histogram
  of 2^16 hash buckets (a bounded table collected to the driver), and an
  exact rank is computed only inside the two boundary buckets, with the
  range-partitioned row index (no single-task window).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rowindex import with_dense_index

# Fixed values.
SPLITS = ("train", "dev", "test")
DEV_FRACTION = 0.1
TEST_FRACTION = 0.1
HIST_BITS = 16


def unit_hash(key) -> Column:
    """Record key -> [0, 1): first 32 bits of md5 of its text form."""
    k = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(k.cast("string")), 1, 8), 16, 10).cast("bigint") / F.lit(2.0 ** 32)


def split_by_hash(df: DataFrame, key: str, dev: float = DEV_FRACTION,
                  test: float = TEST_FRACTION, out: str = "split") -> DataFrame:
    """Test if h < test, dev if h < test + dev, else train."""
    h = unit_hash(key)
    return df.withColumn(out, F.when(h < test, "test").when(h < test + dev, "dev").otherwise("train"))


def exact_sizes(n: int, dev: float = DEV_FRACTION, test: float = TEST_FRACTION) -> tuple[int, int, int]:
    """(train, dev, test) sizes of the two-stage split, float arithmetic kept."""
    n_test = math.ceil(test * n)
    rest = n - n_test
    n_dev = math.ceil(dev / (1 - test) * rest)
    return rest - n_dev, n_dev, n_test


def split_exact(df: DataFrame, key: str, dev: float = DEV_FRACTION,
                test: float = TEST_FRACTION, out: str = "split",
                tiebreak: tuple[str, ...] = ()) -> DataFrame:
    """The first ``n_test`` rows by ``(hash, key)`` go to test, the next
    ``n_dev`` to dev, the rest to train."""
    # rows without a key share hash 0 and are ranked like the others
    hk = F.coalesce(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(0))
    d = df.withColumn("_h", hk).withColumn("_b", F.shiftright("_h", 32 - HIST_BITS))
    # histogram: at most 2^16 rows, partial-aggregated before the shuffle
    hist = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).orderBy("_b").collect()
    n = sum(r["_n"] for r in hist)
    _, n_dev, n_test = exact_sizes(n, dev, test)
    cuts = (n_test, n_test + n_dev)
    # bucket -> number of rows in lower buckets
    below, acc = {}, 0
    for r in hist:
        below[r["_b"]] = acc
        acc += r["_n"]
    boundary = []
    for c in cuts:
        for r in hist:
            lo = below[r["_b"]]
            if lo < c < lo + r["_n"]:
                boundary.append(r["_b"])
    boundary = sorted(set(boundary))

    def label_from_rank(rank: Column) -> Column:
        return F.when(rank < cuts[0], "test").when(rank < cuts[1], "dev").otherwise("train")

    # whole buckets: every row of the bucket gets the same label. Buckets are
    # ordered like the ranks, so each split is an interval of bucket ids.
    lows = [(r["_b"], below[r["_b"]], r["_n"]) for r in hist]

    def bucket_label() -> Column:
        expr = None
        for name, lo_rank, hi_rank in (("test", 0, cuts[0]), ("dev", cuts[0], cuts[1])):
            ids = [b for b, lo, m in lows if lo >= lo_rank and lo + m <= hi_rank and m > 0]
            if ids:
                cond = F.col("_b").between(min(ids), max(ids))
                expr = F.when(cond, name) if expr is None else expr.when(cond, name)
        return F.lit("train") if expr is None else expr.otherwise("train")

    whole = d.filter(~F.col("_b").isin(boundary)) if boundary else d
    whole = whole.withColumn(out, bucket_label())
    if not boundary:
        return whole.drop("_h", "_b")
    # boundary buckets (at most two): exact rank inside each through the
    # distributed range index, so even a bucket holding a hot key is split
    # across tasks (ties beyond (hash, key) are broken by ``tiebreak``)
    parts = [whole]
    for b in boundary:
        ranked = with_dense_index(d.filter(F.col("_b") == b), ["_h", key, *tiebreak], "_r0")
        parts.append(ranked.withColumn(out, label_from_rank(F.lit(below[b]) + F.col("_r0"))).drop("_r0"))
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res.drop("_h", "_b")
