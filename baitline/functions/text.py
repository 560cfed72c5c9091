"""String column functions (P2, P10, P11, T1 tokenisation, I1 lead summary).

All are Catalyst expressions: they run inside whole-stage codegen or as
interpreted higher-order functions, never in Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values shared with the SQL oracle.
# White space that separates tokens (what str.split() treats as blank for
# ASCII text); the same class is used by the DuckDB oracle.
WHITESPACE = r"[ \t\n\r\f]+"
# Sentence separator used by ROUGE and by the extractive headline.
SENTENCE_SEP = r"\."
# Prompt prefix of the seq2seq layout.
SUMMARIZE_PREFIX = "summarize: "


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text) -> Column:
    """Whitespace tokens, empty tokens dropped (``str.split()`` semantics)."""
    return F.filter(F.split(_c(text), WHITESPACE), lambda t: t != F.lit(""))


def flatten_paragraphs(paragraphs) -> Column:
    """Join a list of paragraphs with one blank.

    NULL list -> NULL; a NULL element -> NULL (a bare ``array_join`` would skip
    it silently); empty list -> ''.
    """
    p = _c(paragraphs)
    return F.when(F.exists(p, lambda x: x.isNull()), F.lit(None).cast("string")) \
        .otherwise(F.array_join(p, " "))


def char_prefix(text, n: int) -> Column:
    """First ``n`` code points (P10)."""
    return F.substring(_c(text), 1, n)


def with_prompt(text, prefix: str = SUMMARIZE_PREFIX) -> Column:
    """Prompt prefix."""
    return F.concat(F.lit(prefix), _c(text))


def lead_summary(body, max_chars: int = 500, max_tokens: int = 20) -> Column:
    """Built-in summariser (I1): the first ``max_tokens`` whitespace tokens of
    the first ``max_chars`` characters; '' when there is no token. NULL is kept
    for a NULL body (or a failed model call), which the drop of incomplete
    rows removes."""
    t = words(char_prefix(body, max_chars))
    return F.array_join(F.slice(t, 1, max_tokens), " ")
