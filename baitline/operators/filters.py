"""Row filters and label predicates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

# Fixed values.
SCORE_TOLERANCE = 0.1      # |wanted - score| < 0.1
LABEL_THRESHOLD = 0.5      # label = score > 0.5 (strict)
PREDICT_THRESHOLD = 0.5    # prediction = prob >= 0.5 (non-strict)


def wanted_scores_predicate(score: str, wanted: Iterable[float], tol: float = SCORE_TOLERANCE) -> Column:
    """P6 + U2: any ``abs(w - score) < tol``. NULL/NaN scores are not kept.

    Each term carries its implied range ``w - tol < score < w + tol`` as well,
    which Parquet can push down; the exact ``abs`` test stays, so results do
    not change."""
    ws = [float(w) for w in wanted]
    if not ws:
        raise ValueError("wanted scores must not be empty")
    s = F.col(score)
    terms = [(s > F.lit(w - tol - 1e-9)) & (s < F.lit(w + tol + 1e-9)) & (F.abs(F.lit(w) - s) < F.lit(tol))
             for w in ws]
    cond = terms[0]
    for t in terms[1:]:
        cond = cond | t
    return cond & ~F.isnan(s)


def with_scores(df: DataFrame, wanted: Iterable[float] | None, score: str = "Score",
                tol: float = SCORE_TOLERANCE, require_rows: bool = False) -> DataFrame:
    """Keep rows whose score is within ``tol`` of a wanted score.
    ``require_rows`` runs a job to check that some row is left."""
    if wanted is None:
        return df
    out = df.filter(wanted_scores_predicate(score, wanted, tol))
    if require_rows and out.isEmpty():
        raise ValueError("no row has a wanted score")
    return out


def non_empty_text(*cols: str) -> Column:
    """Every text column is a non-empty string (no trim)."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & (F.col(c) != F.lit(""))
    return cond


def binary_label(score: str = "Score", threshold: float = LABEL_THRESHOLD) -> Column:
    """Score > threshold, as int."""
    return (F.col(score) > F.lit(threshold)).cast("int")


def prediction(prob: str = "prob", threshold: float = PREDICT_THRESHOLD) -> Column:
    """Prob >= threshold, as int."""
    return (F.col(prob) >= F.lit(threshold)).cast("int")


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Numeric columns, from the schema (not from a sample value)."""
    ex = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in ex]


def resolve_split(name: str) -> str:
    """S6: 'tr*' -> train, 'd*' -> dev, 'te*' -> test (case-insensitive)."""
    n = (name or "").lower()
    if n.startswith("tr"):
        return "train"
    if n.startswith("d"):
        return "dev"
    if n.startswith("te"):
        return "test"
    raise ValueError(f"unknown split {name!r}: use train, dev or test")
