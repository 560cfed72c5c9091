"""Model scoring surface.

Built-in scorers are Catalyst expressions that work offline. A pretrained
model is a plug-in: a class whose instance is created once per task and
applied to Arrow batches with ``mapInPandas``; a row that fails becomes NULL
(and the drop of incomplete rows removes it), as the reference's
try/except did.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import WHITESPACE, words
from ..session import scratch_path
from .filters import binary_label

# Fixed values of the built-in clickbait cue scorer (a closed-form logistic).
CUE_BIAS = -0.5
CUE_QUESTION = 1.4
CUE_EXCLAIM = 0.9
CUE_LEADING_DIGIT = 0.8
CUE_SECOND_PERSON = 0.7
CUE_SHORT = 0.6
CUE_SHORT_MAX_TOKENS = 6
CUE_PER_TOKEN = -0.02
CUE_TOKEN_CAP = 50
SECOND_PERSON_PATTERN = "(^|[^a-z])(you|your)([^a-z]|$)"


def cue_logit(title):
    t = F.col(title) if isinstance(title, str) else title
    n = F.size(words(t))
    return (F.lit(CUE_BIAS)
            + F.lit(CUE_QUESTION) * t.contains("?").cast("double")
            + F.lit(CUE_EXCLAIM) * t.contains("!").cast("double")
            + F.lit(CUE_LEADING_DIGIT) * t.rlike("^[0-9]").cast("double")
            + F.lit(CUE_SECOND_PERSON) * F.lower(t).rlike(SECOND_PERSON_PATTERN).cast("double")
            + F.lit(CUE_SHORT) * (n <= CUE_SHORT_MAX_TOKENS).cast("double")
            + F.lit(CUE_PER_TOKEN) * F.least(n, F.lit(CUE_TOKEN_CAP)).cast("double"))


def score_headlines(df: DataFrame, title: str = "Title", out: str = "prob") -> DataFrame:
    """I3 built-in: clickbait probability of each headline, rounded to 6, plus
    its logit (class-0 logit is 0, so softmax class 1 = sigmoid(logit))."""
    z = cue_logit(title)
    return df.withColumn("logit", z).withColumn(
        out, F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("logit"))), 6))


def fit_classifier(df: DataFrame, text: str = "Title", score: str = "Score",
                   num_features: int = 1 << 18, max_iter: int = 20):
    """Distributed fit of tokenizer -> HashingTF -> LogisticRegression, label
    = score > 0.5. Returns a fitted PipelineModel (``transform`` scores rows), as
    read back from the shared folder: a model fresh from ``fit`` carries its
    training summary and with it the session, which no longer serializes to tasks
    once anything in it has been observed (``DataFrame.observe``)."""
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, RegexTokenizer

    data = df.withColumn("label", binary_label(score).cast("double"))
    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=WHITESPACE, toLowercase=False),
        HashingTF(inputCol="_tokens", outputCol="features", numFeatures=num_features),
        LogisticRegression(maxIter=max_iter, featuresCol="features", labelCol="label"),
    ])
    path = scratch_path(df.sparkSession, "classifier")
    pipe.fit(data).write().save(path)
    return PipelineModel.load(path)


class HashingEmbedder:
    """Built-in offline embedder (I4 stand-in): counts of md5 token buckets."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, text: str):
        v = [0.0] * self.dim
        for t in text.split():
            v[int(hashlib.md5(t.encode("utf-8")).hexdigest()[:8], 16) % self.dim] += 1.0
        return v


def apply_text_model(df: DataFrame, col: str, model_factory, out: str, out_type: str) -> DataFrame:
    """I1-I4 plug-in hook: add ``out`` = model(text) for each row.

    ``model_factory()`` is called once per task (load weights there, not per
    row); batches arrive through Arrow. A row whose call raises gets NULL (P9).
    """
    from pyspark.sql.types import StructField, StructType
    from pyspark.sql.types import _parse_datatype_string

    schema = StructType(df.schema.fields + [StructField(out, _parse_datatype_string(out_type), True)])

    def run(batches):
        model = model_factory()
        for pdf in batches:
            vals = []
            for x in pdf[col]:
                try:
                    vals.append(None if x is None else model(x))
                except Exception:  # a failed row becomes NULL, as in the reference
                    vals.append(None)
            pdf[out] = vals
            yield pdf

    return df.mapInPandas(run, schema)
