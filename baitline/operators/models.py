"""Batch inference with supplied models.

A model is a factory: called once in each Python worker (load weights there), it
gives a function from a numpy array of texts to as many results. Batches go
through ``predict_batch_udf``. Only (key, text) travel to the model; results
are written to the shared folder with their failures counted on the way, and
joined back by key, so a model never runs twice on a row.

A batch whose call raises is tried row by row, and a row that raises becomes
NULL, which the drop of incomplete rows removes; a rate of failures above
``max_failure_rate`` stops the job instead of emptying its output.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, StructField, StructType, _parse_datatype_string

from ..functions.text import WHITESPACE
from ..session import materialize

BATCH_SIZE = 64
MAX_FAILURE_RATE = 0.5

# Fixed values of the built-in models.
SUMMARY_CHARS, SUMMARY_MIN_TOKENS, SUMMARY_MAX_TOKENS = 500, 5, 20
HEADLINE_TOKENS = 10


class ModelFailureError(RuntimeError):
    """More calls of a model failed than the job allows."""


def _column(values: list) -> np.ndarray:
    """Scalars as they are."""
    out = np.empty(len(values), object)
    out[:] = values
    return out


def _rows(values: list) -> np.ndarray:
    """Vectors of one length; a failed one is of zeros, which ``inferred`` makes NULL."""
    dim = max((len(v) for v in values if v is not None), default=0)
    return np.array([np.zeros(dim) if v is None else v for v in values], float).reshape(len(values), dim)


def _guarded(make_model: Callable, columns: Callable):
    """The factory ``predict_batch_udf`` wants, with P9's rule for failures."""

    def make():
        model = make_model()

        def one(text):
            try:
                return model(np.array([text], object))[0], False
            except Exception:  # P9: a failed row becomes NULL
                return None, True

        def predict(texts: np.ndarray):
            try:
                found = [(x, False) for x in model(texts)]
                if len(found) != len(texts):
                    raise ValueError("a model gives one result for each text")
            except Exception:
                found = [one(t) for t in texts]
            return {"value": columns([x for x, _ in found]), "failed": np.array([bad for _, bad in found], np.int8)}

        return predict

    return make


def inferred(df: DataFrame, key: str, text: str, make_model: Callable, out: str, out_type: str = "string",
             batch_size: int = BATCH_SIZE) -> DataFrame:
    """(key, out, failed), lazily: the model's result for each row whose text
    is not NULL."""
    kind = _parse_datatype_string(out_type)
    schema = StructType([StructField("value", kind, True), StructField("failed", ByteType(), False)])
    call = predict_batch_udf(_guarded(make_model, _rows if isinstance(kind, ArrayType) else _column), return_type=schema, batch_size=batch_size)
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    # one column, not to be evaluated again for each of its fields or below a filter on them
    got = rows.select("_key", call.asNondeterministic()("_text").alias("_got"))
    return got.select(F.col("_key").alias(key), F.when(F.col("_got.failed") == 0, F.col("_got.value")).alias(out), (F.col("_got.failed") == 1).alias("failed"))


def with_model(df: DataFrame, key: str, text: str, make_model: Callable, out: str, out_type: str = "string",
               batch_size: int = BATCH_SIZE, max_failure_rate: float = MAX_FAILURE_RATE) -> tuple[DataFrame, dict]:
    """``df`` with the column ``out`` = model(text), and {"rows", "failed"}.

    ``key`` is unique in ``df``. Runs the model as one job: the results are
    written under the shared checkpoint folder and the failures observed by that
    write. NULL texts are not sent and give NULL."""
    seen = Observation("model-calls")
    got = inferred(df, key, text, make_model, out, out_type, batch_size).observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("failed"), 1)).alias("failed"))
    got = materialize(got, "inferred")
    counts = seen.get
    if counts["failed"] > max_failure_rate * counts["rows"]:
        raise ModelFailureError(f"{counts['failed']} of {counts['rows']} calls failed; at most {max_failure_rate:.0%} may")
    return df.drop(out).join(got.where("not failed").select(key, out), key, "left"), counts


# ------------------------------------------------------ built-in models ----

def _tokens(text: str) -> list[str]:
    """As ``functions.text.words``."""
    return [t for t in re.split(WHITESPACE, text) if t]


def lead_summarizer():
    """The first tokens of the first characters; a text too short to be
    summarised is an error, as it is to a summariser with a least length."""

    def summarise(text: str) -> str:
        found = _tokens(text[:SUMMARY_CHARS])
        if len(found) < SUMMARY_MIN_TOKENS:
            raise ValueError("too short to summarise")
        return " ".join(found[:SUMMARY_MAX_TOKENS])

    return lambda texts: [summarise(t) for t in texts]


def lead_generator():
    """The first tokens of the body."""
    return lambda texts: [" ".join(_tokens(t)[:HEADLINE_TOKENS]) for t in texts]


def hashing_embedder(dim: int = 64):
    """I4: a factory of counts of md5 token buckets."""
    def make():
        bucket: dict[str, int] = {}

        def embed(text: str) -> np.ndarray:
            at = []
            for t in _tokens(text):
                if t not in bucket:
                    if len(bucket) >= 1_000_000:
                        bucket.clear()
                    bucket[t] = int(hashlib.md5(t.encode("utf-8")).hexdigest()[:8], 16) % dim
                at.append(bucket[t])
            return np.bincount(at, minlength=dim).astype(float) if at else np.zeros(dim)

        return lambda texts: [embed(t) for t in texts]

    return make
