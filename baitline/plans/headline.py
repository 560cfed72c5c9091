"""End-to-end plans over the driver tables.

Each function returns a lazy DataFrame; nothing runs until the caller acts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluate import evaluate_pairs, extractive_headline
from ..operators.prepare import prepare_articles
from ..operators.report import describe_metrics
from ..sources import fixtures


def prepared_set(spark: SparkSession, sf_dir: str, by_position: bool = False) -> DataFrame:
    """articles aligned with truth, flattened, summarised, cleaned."""
    return prepare_articles(fixtures.articles(spark, sf_dir, with_file_row=by_position),
                            fixtures.truth(spark, sf_dir, with_file_row=by_position),
                            by_position=by_position)


def with_lang(spark: SparkSession, sf_dir: str, df: DataFrame, key: str = "row_id") -> DataFrame:
    """Attach the document language (for grouped reports)."""
    langs = fixtures.table(spark, sf_dir, "documents").select(F.col("doc_id").alias(key), "lang")
    return df.join(langs, key)


def headline_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared rows with the built-in generated headline."""
    return extractive_headline(prepared_set(spark, sf_dir))


def headline_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: evaluation rows for every valid (body, real, generated) triple."""
    return evaluate_pairs(headline_pairs(spark, sf_dir))


def headline_report(spark: SparkSession, sf_dir: str, by_lang: bool = False) -> DataFrame:
    """A1 over the evaluation rows: the flagship query."""
    ev = headline_eval(spark, sf_dir)
    if by_lang:
        ev = with_lang(spark, sf_dir, ev)
        return describe_metrics(ev.drop("row_id"), by=["lang"])
    return describe_metrics(ev.drop("row_id"))
