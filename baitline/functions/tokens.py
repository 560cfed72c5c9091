"""Token-sequence column functions.

Every function returns a Catalyst expression over ``array<int>`` columns, so
encoding a corpus is one projection: no UDF, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SUMMARIZE_PREFIX, words

# Reserved token ids of our vocabularies.
PAD_ID = 0
SEP_ID = 1
EOS_ID = 2
UNK_ID = 3
N_RESERVED = 4
RESERVED_TOKENS = ["<pad>", "<sep>", "</s>", "<unk>"]
# Hashed vocabulary size and layout lengths.
HASH_BUCKETS = 32768
BLOCK_SIZE = 512
PACKED_TITLE_MAX = BLOCK_SIZE // 8      # 64
SEQ2SEQ_TEXT_MAX = 50
BATCHED_TITLE_MAX = 64
IGNORE_INDEX = -100


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def token_hash(tok, buckets: int = HASH_BUCKETS) -> Column:
    """Stable 32-bit hash of a token string: first 8 hex digits of its md5,
    mapped into ``[0, buckets)``."""
    return (F.conv(F.substring(F.md5(_c(tok)), 1, 8), 16, 10).cast("bigint") % F.lit(buckets))


def hash_ids(tokens, buckets: int = HASH_BUCKETS, offset: int = N_RESERVED) -> Column:
    """Token array -> ids by hash bucket, shifted past the reserved ids."""
    return F.transform(_c(tokens), lambda t: (token_hash(t, buckets) + F.lit(offset)).cast("int"))


def encode_text(text, buckets: int = HASH_BUCKETS) -> Column:
    """Whitespace tokens of ``text`` as hashed ids."""
    return hash_ids(words(text), buckets)


def head(ids, n) -> Column:
    """First ``n`` ids (``n`` int or Column)."""
    return F.slice(_c(ids), 1, n)


def pad_right(ids, n: int, pad: int = PAD_ID) -> Column:
    """T5: pad with ``pad`` up to length ``n`` (input must not be longer)."""
    a = _c(ids)
    return F.concat(a, F.array_repeat(F.lit(pad), F.lit(n) - F.size(a)))


def length_mask(length, n: int) -> Column:
    """``length`` ones then zeros, ``n`` long."""
    ln = _c(length)
    return F.concat(F.array_repeat(F.lit(1), ln), F.array_repeat(F.lit(0), F.lit(n) - ln))


def pack(body_ids, title_ids, block: int = BLOCK_SIZE, title_max: int | None = None,
         sep: int = SEP_ID, pad: int = PAD_ID) -> Column:
    """T4 + T5 + T6: struct(sequence, title_mask, body_len).

    The title keeps its first ``block/8`` ids, the body the first
    ``block - size(title) - 1``; layout ``body, SEP, title, pad...``. The
    title mask is 1 from the separator on, padding included.
    """
    tmax = block // 8 if title_max is None else title_max
    t = F.slice(_c(title_ids), 1, tmax)
    b = F.slice(_c(body_ids), 1, F.lit(block) - F.size(t) - F.lit(1))
    content = F.concat(b, F.array(F.lit(sep)), t)
    seq = F.concat(content, F.array_repeat(F.lit(pad), F.lit(block) - F.size(content)))
    blen = F.size(b)
    mask = F.concat(F.array_repeat(F.lit(0), blen), F.array_repeat(F.lit(1), F.lit(block) - blen))
    return F.struct(seq.alias("sequence"), mask.alias("title_mask"), blen.alias("body_len"))


def pack_right(body_ids, title_ids, block: int = BLOCK_SIZE,
               title_max: int = BATCHED_TITLE_MAX, sep: int = SEP_ID) -> Column:
    """Body, zero fill, SEP, title flush with the block end.

    The body zone is ``block - 1 - t`` long (``t`` title ids after the
    ``title_max`` cut); SEP sits at index ``block - 1 - t`` and is written,
    never added to a body id. Attention mask = id != 0 (T8).
    """
    t = F.slice(_c(title_ids), 1, title_max)
    zone = F.lit(block - 1) - F.size(t)
    b = F.slice(_c(body_ids), 1, zone)
    seq = F.concat(b, F.array_repeat(F.lit(0), zone - F.size(b)), F.array(F.lit(sep)), t)
    return F.struct(seq.alias("sequence"), nonpad_mask(seq, 0).alias("attention_mask"))


def fixed_length(ids, n: int, eos: int = EOS_ID, pad: int = PAD_ID) -> Column:
    """T14 building block: first ``n-1`` ids + EOS, padded to ``n``; with its
    attention mask (T7)."""
    content = F.concat(F.slice(_c(ids), 1, n - 1), F.array(F.lit(eos)))
    return F.struct(pad_right(content, n, pad).alias("ids"),
                    length_mask(F.size(content), n).alias("mask"))


def seq2seq_encode(body, title, summary, block: int = BLOCK_SIZE,
                   text_max: int = SEQ2SEQ_TEXT_MAX) -> Column:
    """Body with the prompt prefix to ``block``; title and summary to
    ``text_max``; each with its mask."""
    b = fixed_length(encode_text(F.concat(F.lit(SUMMARIZE_PREFIX), _c(body))), block)
    t = fixed_length(encode_text(title), text_max)
    s = fixed_length(encode_text(summary), text_max)
    return F.struct(b["ids"].alias("sequences"), b["mask"].alias("sequence_masks"),
                    s["ids"].alias("summaries"), s["mask"].alias("summary_masks"),
                    t["ids"].alias("titles"), t["mask"].alias("title_masks"))


def nonpad_mask(ids, pad_id: int = PAD_ID) -> Column:
    """1 where id != ``pad_id``."""
    return F.transform(_c(ids), lambda x: (x != F.lit(pad_id)).cast("int"))


def shift_right(mask) -> Column:
    """Roll right by one, first position 0."""
    m = _c(mask)
    return F.concat(F.array(F.lit(0)), F.slice(m, 1, F.greatest(F.size(m) - 1, F.lit(0))))


def masked_fill(ids, mask, fill: int = 0) -> Column:
    """``fill`` where mask == 0."""
    return F.zip_with(_c(ids), _c(mask), lambda x, m: F.when(m == 0, F.lit(fill)).otherwise(x))


def pad_to_ignore(ids, pad_id: int = PAD_ID, ignore: int = IGNORE_INDEX) -> Column:
    """Pad id -> ignore index."""
    return F.transform(_c(ids), lambda x: F.when(x == F.lit(pad_id), F.lit(ignore)).otherwise(x))


def first_zero(ids) -> Column:
    """Index of the first 0 (the unpadded length); size if none."""
    a = _c(ids)
    p = F.array_position(a, 0)
    return F.when(p > 0, p - 1).otherwise(F.size(a).cast("long"))


def one_hot(label) -> Column:
    """[1-label, label]."""
    lb = _c(label).cast("int")
    return F.array(F.lit(1) - lb, lb)


def softmax_class1(logit0, logit1) -> Column:
    """Probability of class 1 of a two-class softmax."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(_c(logit0) - _c(logit1)))


def ids_digest(ids) -> Column:
    """md5 of the comma-joined ids, to compare whole arrays cheaply."""
    return F.md5(F.array_join(F.transform(_c(ids), lambda x: x.cast("string")), ","))
