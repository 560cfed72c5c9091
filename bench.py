"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line.

Each query is executed in full through the ``noop`` sink (every row and
column is computed, nothing is collected to the driver). The first query
also pays JVM warm-up, so a warm-up pass over the smallest tables runs first.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from baitline.plans import queries as Q  # noqa: E402
from baitline.session import build_session  # noqa: E402

HEADLINE = [
    "prepare_by_key", "split_exact", "pack_sequences", "seq2seq_encode", "vocab",
    "roundtrip_decode", "extractive_headline", "pair_eval", "metric_report",
    "metric_report_by_lang", "rates", "running_accuracy", "embedding_cosine", "epoch_loss",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", int(cpus) * 2,
                          driver_memory=os.environ.get("BENCH_DRIVER_MEMORY"))
    # warm-up: JIT and Python workers, on a tiny table
    Q.epoch_loss(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t0 = time.time()
        Q.REGISTRY[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
