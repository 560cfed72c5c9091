"""Structured Streaming form of the encode stage.

The reference has no unbounded source. Its per-row stages (token ids, packing,
masks, score filter) are stateless expressions, so they run unchanged on a
streaming DataFrame: new prepared files dropped into a folder are encoded
incrementally, exactly once per file (the checkpoint records which files
were done). No state store is involved.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import tokens as tk
from ..operators.filters import wanted_scores_predicate
from ..session import scratch_path
from ..sources.datasets import PREPARED_SCHEMA


def encode_stream(spark: SparkSession, source_dir: str, sink_dir: str,
                  checkpoint_dir: str | None = None, wanted: list[float] | None = None,
                  available_now: bool = True, max_files_per_trigger: int = 1000) -> StreamingQuery:
    """Start a stream: prepared Parquet files in ``source_dir`` -> packed
    sequences in ``sink_dir`` (Parquet, partitioned by split). With
    ``available_now`` the query processes what is there and stops."""
    src = (spark.readStream.schema(PREPARED_SCHEMA)
           .option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir))
    if wanted is not None:
        src = src.filter(wanted_scores_predicate("Score", wanted))
    pk = tk.pack(tk.encode_text("Body"), tk.encode_text("Title"))
    enc = src.select("row_id", "split",
                     F.col("Score").alias("scores"), pk.alias("pk")).select(
        "row_id", "split", "scores", F.col("pk.sequence").alias("sequences"),
        F.col("pk.title_mask").alias("title_masks"))
    w = (enc.writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", checkpoint_dir or scratch_path(spark, "stream-ckpt"))
         .partitionBy("split").outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
