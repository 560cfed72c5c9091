"""Sources and sinks (S1-S9): JSON-lines corpora, prepared and encoded sets,
metric reports.

Datasets are Parquet partitioned by ``split`` (and layout/tokenizer for
encoded sets), so reading one split prunes the others at planning time, and
a wanted-score filter reaches the Parquet reader as a range. Reports are JSON
lines tagged with run columns, appended, so runs compare in one query.
Default output folders live under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DoubleType, IntegerType, LongType, StringType,
                               StructField, StructType)

from ..operators.filters import resolve_split, with_scores
from ..operators.prepare import union_by_name
from ..operators.report import RATE_NAMES
from ..operators.rowindex import with_file_position
from ..session import scratch_path

ARTICLE_SCHEMA = StructType([
    StructField("id", StringType()),
    StructField("targetTitle", StringType()),
    StructField("targetParagraphs", ArrayType(StringType())),
])
TRUTH_SCHEMA = StructType([
    StructField("id", StringType()),
    StructField("truthMode", DoubleType()),
    StructField("truthMedian", DoubleType()),
    StructField("truthMean", DoubleType()),
    StructField("truthClass", StringType()),
])
PREPARED_SCHEMA = StructType([
    StructField("row_id", LongType()),
    StructField("Title", StringType()),
    StructField("Body", StringType()),
    StructField("Summary", StringType()),
    StructField("Score", DoubleType()),
    StructField("split", StringType()),
])
PACKED_SCHEMA = StructType([
    StructField("row_id", LongType()),
    StructField("scores", DoubleType()),
    StructField("sequences", ArrayType(IntegerType())),
    StructField("title_masks", ArrayType(IntegerType())),
    StructField("layout", StringType()),
    StructField("tokenizer", StringType()),
    StructField("split", StringType()),
])
REPORT_SCHEMA = StructType([
    StructField("metric", StringType()),
    StructField("min", DoubleType()),
    StructField("max", DoubleType()),
    StructField("median", DoubleType()),
    StructField("mean", DoubleType()),
    StructField("std", DoubleType()),
    StructField("model_type", StringType()),
    StructField("run_id", StringType()),
    StructField("class_loss", StringType()),
    StructField("summ_loss", StringType()),
    StructField("split", StringType()),
    StructField("wanted_scores", StringType()),
])
_RUN_TAGS = [StructField(c, StringType()) for c in ("run_id", "split", "model_type")]
RATES_SCHEMA = StructType([*[StructField(c, DoubleType()) for c in RATE_NAMES], *_RUN_TAGS])
ACCURACY_SCHEMA = StructType([StructField("pos", LongType()), StructField("acc", LongType()), StructField("accuracy", DoubleType()), *_RUN_TAGS])


def read_jsonl_union(spark: SparkSession, paths: list[str], schema: StructType,
                     with_position: bool = False, out: str = "file_row",
                     rejects: str | None = None) -> DataFrame:
    """S1 + U1: several JSON-lines files, union by name, with
    ``file_ordinal`` = index of the file in ``paths`` (a multi-path read does
    not promise file order, the ordinal does).

    A line that is no JSON object of the schema is not a record: it is left out,
    and with ``rejects`` written there first as (file_ordinal, line). Blank lines
    are no lines.

    ``with_position`` adds ``out`` = the record's position in the concatenation
    of the files in ``paths`` order (J3): its position inside its file from the
    scan metadata, plus the lines of the earlier files, which one aggregate
    counts and which enter the plan as constants. Bad lines keep their places."""
    bad = "_bad_line"
    whole = StructType([*schema.fields, StructField(bad, StringType())])
    frames = []
    for i, p in enumerate(paths):
        # as text, since Spark answers no query of a JSON scan that needs its bad-line column alone, a count for one
        f = spark.read.text(p).where(F.trim("value") != "")
        if with_position:
            f = with_file_position(f, "_in_file")
        record = F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})
        frames.append(f.withColumn("_record", record).select("_record.*", *(["_in_file"] if with_position else []), F.lit(i).alias("file_ordinal")))
    df = union_by_name(frames)
    if with_position:
        # one row a file of the list that the caller gave
        count = {r["file_ordinal"]: r["n"] for r in df.groupBy("file_ordinal").agg(F.count(F.lit(1)).alias("n")).collect()}
        before = [sum(count.get(k, 0) for k in range(i)) for i in range(len(paths))]
        df = union_by_name([f.withColumn(out, F.lit(b).cast("long") + F.col("_in_file")) for f, b in zip(frames, before)]).drop("_in_file")
    if rejects is not None:
        df.where(F.col(bad).isNotNull()).select("file_ordinal", F.col(bad).alias("line")).write.mode("overwrite").parquet(rejects)
    return df.where(F.col(bad).isNull()).drop(bad)


def write_prepared(df: DataFrame, path: str | None = None) -> str:
    """S3: prepared set with its ``split`` column, one folder per split; only
    the splits that ``df`` holds are replaced."""
    path = path or scratch_path(df.sparkSession, "prepared")
    (df.select("row_id", "Title", "Body", "Summary", "Score", "split")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split").parquet(path))
    return path


def read_prepared(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """S2 + S6: read a prepared set, one split if named. Columns and types are
    those of ``PREPARED_SCHEMA``, but for ``row_id``: text ids stay text."""
    kind = spark.read.parquet(path).schema["row_id"].dataType
    schema = StructType([StructField("row_id", kind), *PREPARED_SCHEMA.fields[1:]])
    df = spark.read.schema(schema).parquet(path)
    if split is not None:
        df = df.filter(F.col("split") == resolve_split(split))
    return df


def write_encoded(df: DataFrame, layout: str, tokenizer: str, path: str | None = None) -> str:
    """Encoded set, partitioned by layout, tokenizer and split. Only the
    partitions that ``df`` holds are replaced, so other layouts and splits in
    the same folder stay."""
    path = path or scratch_path(df.sparkSession, "encoded")
    (df.withColumn("layout", F.lit(layout)).withColumn("tokenizer", F.lit(tokenizer))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("layout", "tokenizer", "split").parquet(path))
    return path


def read_encoded(spark: SparkSession, path: str, layout: str, tokenizer: str,
                 split: str | None = None, wanted: list[float] | None = None,
                 schema: StructType | None = None) -> DataFrame:
    """S5 + P6: one layout/tokenizer (and split), optionally only rows near a
    wanted score; partition filters prune folders, the score range is pushed
    to the Parquet reader. Layouts differ in their columns: the schema is that
    of the layout's own files unless one is given."""
    if schema is not None:
        df = (spark.read.schema(schema).parquet(path)
              .filter((F.col("layout") == layout) & (F.col("tokenizer") == tokenizer)))
    else:
        df = (spark.read.option("basePath", path).parquet(f"{path}/layout={layout}/tokenizer={tokenizer}")
              .withColumn("split", F.col("split").cast("string")))
    if split is not None:
        df = df.filter(F.col("split") == resolve_split(split))
    return with_scores(df, wanted, score="scores")


def tag_run(df: DataFrame, run: dict) -> DataFrame:
    """Run tags (model type, loss flags, wanted scores, split) as columns."""
    for k, v in run.items():
        df = df.withColumn(k, F.lit(None if v is None else str(v)).cast("string"))
    return df


def write_report(df: DataFrame, run: dict, path: str | None = None) -> str:
    """Append a report (or per-row outputs) tagged with its run."""
    path = path or scratch_path(df.sparkSession, "reports")
    tag_run(df, run).write.mode("append").json(path)
    return path


def write_outputs(df: DataFrame, run: dict, path: str | None = None) -> str:
    """Per-row evaluation outputs (score, texts, metrics), tagged with the
    run and appended as Parquet."""
    path = path or scratch_path(df.sparkSession, "outputs")
    tag_run(df, run).write.mode("append").parquet(path)
    return path


def read_outputs(spark: SparkSession, path: str) -> DataFrame:
    """The outputs of all runs in a folder; runs may differ in their tags and
    metrics, a column that a run lacks is NULL in its rows."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """The rates of the classify job, with their run's tags."""
    return spark.read.schema(RATES_SCHEMA).json(path)


def read_running_accuracy(spark: SparkSession, path: str) -> DataFrame:
    """The running accuracy of the classify job, with its run's tags."""
    return spark.read.schema(ACCURACY_SCHEMA).json(path)


def read_report(spark: SparkSession, path: str, schema: StructType = REPORT_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)
