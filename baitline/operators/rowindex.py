"""Row positions and running sums without a one-task window (J3, W1 scale form).

Spark rows have no order. Where the reference relies on one (positional
alignment, running accuracy, row caps, consecutive batches) we make it
explicit here, once, with distributed algorithms:

* :func:`with_dense_index` - 0-based position under a sort order: range
  partitioning + per-partition counts (a table of one row per partition) +
  offsets. The distributed form of ``zipWithIndex``;
  :func:`with_key_position` builds it on a key column alone and joins back.
* :func:`with_parquet_position` / :func:`with_file_position` - position of a
  record in its source files, from the scan's own metadata (no sort).
* :func:`record_at_position` - lookup by position in a dataset's files, through
  a small index that :func:`write_position_index` makes.
* :func:`record_at`, :func:`first_record` - lookup by position, top-1.
* :func:`running_sum` - prefix sum in blocks: per-block totals (one row per
  block), offsets over that small table, then a window partitioned by block.
"""

from __future__ import annotations

from posixpath import basename
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize

# Largest helper table (rows) we broadcast without asking AQE; one row per
# partition / block, so it is bounded by the partition count we choose.
_BROADCAST_ROWS = 1_000_000


def _maybe_broadcast(df: DataFrame, rows_bound: int) -> DataFrame:
    return F.broadcast(df) if rows_bound <= _BROADCAST_ROWS else df


def with_dense_index(df: DataFrame, order: list, out: str = "pos",
                     num_partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 0-based rank of each row under ``order`` (which must be a
    total order: end it with a unique column).

    Plan: one range exchange whose rows are written once with their
    partition id and counter (one job), a tiny aggregate of per-partition
    counts, a broadcast join. No global sort into one task."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The per-partition counts and the rows must come from one and the same
    # range partitioning, but range bounds are sampled per execution (the
    # sampler is seeded by the RDD id), so two branches would disagree. Each
    # row's partition id and in-partition counter are therefore written once
    # to the shared checkpoint folder and both branches read them back.
    s = materialize(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                    .withColumn("_pid", F.spark_partition_id())
                    .withColumn("_mid", F.monotonically_increasing_id()), "dense-index")
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offs = counts.select("_pid", (F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"))
    offs = offs.fillna(0, subset=["_off"])
    in_part = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (s.join(_maybe_broadcast(offs, n), "_pid")
            .withColumn(out, F.col("_off") + in_part)
            .drop("_pid", "_mid", "_off"))


def with_key_position(df: DataFrame, key: str, out: str = "pos") -> DataFrame:
    """Add ``out`` = 0-based rank of ``key`` (unique) without moving the wide
    rows through the range exchange: the index is built on the key column
    alone and joined back (one shuffle of ``df`` on ``key``)."""
    idx = with_dense_index(df.select(key), [key], out)
    return df.join(idx, key)


def with_file_position(df: DataFrame, out: str = "file_pos") -> DataFrame:
    """Position of each record across its input files (files in path order,
    then byte order inside a file). Works for every file source: it uses the
    split start offset of ``_metadata`` and the in-partition row counter, then
    offsets from a table of one row per split."""
    s = (df.withColumn("_fp", F.col("_metadata.file_path"))
         .withColumn("_bs", F.col("_metadata.file_block_start"))
         .withColumn("_mid", F.monotonically_increasing_id()))
    splits = s.groupBy("_fp", "_bs").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    offs = splits.select("_fp", "_bs", "_m0", F.coalesce(F.sum("_n").over(
        Window.orderBy("_fp", "_bs").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    # one row per file split: at most one trailing piece per file plus one
    # full piece per partition, both known when planning
    try:
        n_splits = len(df.inputFiles()) + df.rdd.getNumPartitions()
    except Exception:  # no RDD view (Spark Connect): let AQE decide
        n_splits = _BROADCAST_ROWS + 1
    return (s.join(_maybe_broadcast(offs, n_splits), ["_fp", "_bs"])
            .withColumn(out, F.col("_off") + F.col("_mid") - F.col("_m0"))
            .drop("_fp", "_bs", "_mid", "_m0", "_off"))


def with_parquet_position(df: DataFrame, out: str = "file_pos") -> DataFrame:
    """Record position across Parquet input files (files in path order):
    the reader's own ``_metadata.row_index`` plus the row count of the
    earlier files (a table of one row per file)."""
    s = df.withColumn("_fp", F.col("_metadata.file_path")).withColumn("_ri", F.col("_metadata.row_index"))
    files = s.groupBy("_fp").agg(F.count(F.lit(1)).alias("_n"))
    offs = files.select("_fp", F.coalesce(F.sum("_n").over(
        Window.orderBy("_fp").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    # one row per input file: the file list (known when planning) bounds it,
    # so broadcast it instead of shuffling the records by file path
    n_files = len(df.inputFiles())
    return (s.join(_maybe_broadcast(offs, n_files), "_fp").withColumn(out, F.col("_off") + F.col("_ri"))
            .drop("_fp", "_ri", "_off"))


def write_position_index(spark: SparkSession, path: str, out: str) -> str:
    """A small index of a Parquet dataset for :func:`record_at_position`: one row
    a file (file, n, start), files in path order, ``start`` the rows of the earlier
    files. The count reads no column. Write it anew when files change."""
    n = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    n.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long"))).write.mode("overwrite").parquet(out)
    return out


def record_at_position(spark: SparkSession, path: str, index: str, position: int) -> DataFrame:
    """The record at a 0-based position of a Parquet dataset, in the order of
    :func:`with_parquet_position`; no row outside it. The index names the one file
    that is opened, the reader's row number the record: nothing is shuffled."""
    at = F.lit(position)
    hit = spark.read.parquet(index).where((F.col("start") <= at) & (at < F.col("start") + F.col("n"))).first()
    if hit is None:
        return spark.read.parquet(path).limit(0)
    file, reader = unquote(hit["file"]), spark.read
    if basename(file) != basename(path.rstrip("/")):   # a file of a folder, which may have partition columns
        reader = reader.option("basePath", path)
    return reader.parquet(file).where(F.col("_metadata.row_index") == position - hit["start"])


def record_at(df: DataFrame, index: int, order: list) -> DataFrame:
    """The record at 0-based position ``index`` under ``order``."""
    return with_dense_index(df, order, "_pos").filter(F.col("_pos") == index).drop("_pos")


def first_record(df: DataFrame, order: list) -> DataFrame:
    """L3: the first record under ``order`` (a top-1, no global sort)."""
    return df.orderBy(*order).limit(1)


def running_sum(df: DataFrame, pos: str, value: Column | str, out: str,
                block: int = 1 << 20, partition_by: tuple = ()) -> DataFrame:
    """``out`` = sum of ``value`` over rows with position <= this row's
    (inclusive prefix sum in ``pos`` order), optionally per ``partition_by``.

    Each window task holds one block (``block`` rows); the only global step
    is a window over the block totals, ``n / block`` rows."""
    v = F.col(value) if isinstance(value, str) else value
    keys = list(partition_by)
    b = df.withColumn("_blk", F.floor(F.col(pos) / F.lit(block))).withColumn("_v", v)
    tot = b.groupBy(*keys, "_blk").agg(F.sum("_v").alias("_bt"))
    w_off = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*keys, "_blk", F.coalesce(F.sum("_bt").over(w_off), F.lit(0)).alias("_boff"))
    w_in = Window.partitionBy(*keys, "_blk").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return (b.join(offs, keys + ["_blk"])
            .withColumn(out, F.col("_boff") + F.sum("_v").over(w_in))
            .drop("_blk", "_v", "_boff"))
