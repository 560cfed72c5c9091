"""Prepare stage: align articles with truth, flatten, summarise, clean (P1-P5,
P9, J1-J3, U1).

One lazy plan: scan -> prune -> flatten -> join -> summary -> drop incomplete
-> rename. The join is an equi-join on the record key; AQE chooses broadcast
or sort-merge from runtime sizes, so nothing here forces a broadcast of a
table that grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import flatten_paragraphs, lead_summary
from .models import MAX_FAILURE_RATE, with_model

# Canonical column names of a prepared set.
TITLE, BODY, SCORE, SUMMARY = "Title", "Body", "Score", "Summary"
ROW_ID = "row_id"


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL by column name; a column missing in one input is NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def prepare_articles(articles: DataFrame, truth: DataFrame, key: str = "id",
                     by_position: bool = False,
                     summarizer: Callable[[Column], Column] | None = lead_summary,
                     mini: int | None = None, model: Callable | None = None, max_failure_rate: float = MAX_FAILURE_RATE) -> DataFrame:
    """Prepared set ``row_id, Title, Body, Summary, Score``.

    ``by_position`` aligns by file position (J1, opt-in) instead of by key.
    ``summarizer`` maps the body column to a summary column (built-in lead
    summary by default). ``model`` is the factory of a summariser instead (see
    :mod:`baitline.operators.models`): it runs at once, on the complete rows only;
    rows it fails on are dropped, and above ``max_failure_rate`` of them
    ``ModelFailureError`` is raised. ``mini`` keeps
    only the first ``mini`` articles by their position ``file_row`` (P5; off
    by default), whatever their ids are.
    """
    rid = "file_row" if by_position else key
    if mini is not None:
        if "file_row" not in articles.columns:
            raise ValueError("mini needs the position column file_row")
        articles = articles.filter(F.col("file_row") < mini)
    a = articles.select(F.col(rid).alias(ROW_ID), F.col("targetTitle").alias(TITLE),
                        flatten_paragraphs("targetParagraphs").alias(BODY))
    t = truth.select(F.col(rid).alias(ROW_ID), F.col("truthMode").alias(SCORE))
    j = a.join(t, ROW_ID, "inner")
    if model is not None:
        j, _ = with_model(j.na.drop("any"), ROW_ID, BODY, model, SUMMARY, max_failure_rate=max_failure_rate)
    elif summarizer is not None:
        j = j.withColumn(SUMMARY, summarizer(F.col(BODY)))
    else:
        j = j.withColumn(SUMMARY, F.col(BODY))
    return j.select(ROW_ID, TITLE, BODY, SUMMARY, SCORE).na.drop("any")
