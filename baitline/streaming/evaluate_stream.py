"""Structured Streaming form of the headline evaluation.

The built-in headline, the pair filter and every text metric are per-row
expressions (no aggregation), so evaluation rows can be produced
incrementally as prepared files arrive. The five-number report is a batch
aggregate over the written rows (``report.describe_metrics``).
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.evaluate import evaluate_pairs, extractive_headline
from ..session import scratch_path
from ..sources.datasets import PREPARED_SCHEMA


def evaluate_stream(spark: SparkSession, source_dir: str, sink_dir: str,
                    checkpoint_dir: str | None = None, available_now: bool = True,
                    max_files_per_trigger: int = 1000) -> StreamingQuery:
    """Prepared Parquet files in ``source_dir`` -> evaluation rows (reference
    column names plus ``row_id``) appended to ``sink_dir`` as Parquet."""
    src = (spark.readStream.schema(PREPARED_SCHEMA)
           .option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir))
    rows = evaluate_pairs(extractive_headline(src))
    w = (rows.writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", checkpoint_dir or scratch_path(spark, "eval-stream-ckpt"))
         .outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
