"""Run manifest (S9, S12, L2): one row for each finished run of a job.

A job appends its row after all its data is written. Outputs and reports carry
the run's id, so a reader that keeps to the ids of the manifest sees no row of a
run that failed or is still writing, and the run-log reports rank real runs.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "run_id string, job string, run string, artifact string, split string, rows bigint, loss double, committed_at timestamp"


def commit_run(spark: SparkSession, folder: str, run_id: str, job: str, run: str | None = None, artifact: str | None = None,
               split: str | None = None, rows: int | None = None, loss: float | None = None) -> None:
    """Append a run to the manifest in ``folder``; the last write of a job."""
    known = {"run_id": run_id, "job": job, "run": run, "artifact": artifact, "split": split, "rows": rows, "loss": loss}
    kinds = dict(c.split() for c in MANIFEST.split(", "))
    row = [F.lit(v).cast(kinds[c]).alias(c) for c, v in known.items()]
    spark.range(1).coalesce(1).select(*row, F.current_timestamp().alias("committed_at")).write.mode("append").parquet(folder)


def read_runs(spark: SparkSession, folder: str, job: str | None = None) -> DataFrame:
    """The committed runs, of one job if named; none before the first commit."""
    try:
        runs = spark.read.schema(MANIFEST).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        runs = spark.createDataFrame([], MANIFEST)
    return runs if job is None else runs.where(F.col("job") == job)


def committed(df: DataFrame, runs: DataFrame) -> DataFrame:
    """The rows of outputs or reports whose run is in the manifest."""
    return df.join(runs.select("run_id").distinct(), "run_id", "left_semi")
