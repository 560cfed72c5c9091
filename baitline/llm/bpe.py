"""BPE encoding and decoding (op10): a table of distinct words.

Blocks of documents (see ``blocks``) split their texts into words as the
tokenizer's normaliser and pre-tokeniser do, and send each distinct word once to
its word bucket. A bucket joins the words of all blocks, encodes each distinct
one once, and sends the ids back. The block joins the ids to its words by
position. Decoding joins ids to the table of pieces, whose size is that of the
vocabulary; without a decoder in the file, pieces are joined by one space.

Added tokens written in a text are found first, in the raw text, as the library
does. Texts of plain letters are split by a compiled pattern; a text with any
character outside ``FAST`` is normalised and split by the tokenizer itself.

Nulls: a null text is empty, with no ids; doc_id may be null or repeated; each
input row gives one output row. Other columns are not read.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baitline.llm import blocks as B

# Characters on which the fast split and the library agree: ASCII without the
# separators 0x1C-0x1F, and the precomposed letters of Latin-1 and Latin
# Extended-A whose lower case is one character.
FAST = re.compile("[\t-\r -~\xa1-\xbf\xc0-įĲ-ňŊ-ž]*")
# Letters and digits within FAST; superscript and fraction digits are numbers.
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d"
                  "|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-ž]+"
                  "|[0-9\xb2\xb3\xb9\xbc-\xbe]"
                  "|[^\\s0-9a-z\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-ž]+")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=2)
def load(path: str):
    """The tokenizer, its added tokens as a pattern, and the ids of those. One
    copy a Python worker."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    t = Tokenizer.from_file(path)
    pattern = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
    return t, pattern, added


def pieces(path: str) -> list[str]:
    """The id-to-piece table."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    vocab = file["model"]["vocab"] | {t["content"]: t["id"] for t in file["added_tokens"]}
    out = [""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        out[i] = piece
    return out


def words(text: str, path: str) -> list[str]:
    """Words in order; an added token is a word of its own."""
    t, pattern, added = load(path)
    out: list[str] = []
    for part in (pattern.split(text) if pattern else [text]):
        if part in added:
            out.append(part)
        elif FAST.fullmatch(part):
            out += WORD.findall(part.lower())
        else:
            norm = t.normalizer.normalize_str(part)
            out += [norm[a:b] for _, (a, b) in t.pre_tokenizer.pre_tokenize_str(norm)]
    return out


def encode_word(word: str, path: str) -> np.ndarray:
    t, _, added = load(path)
    if word in added:
        return np.array([added[word]], np.int32)
    from tokenizers.pre_tokenizers import ByteLevel

    shown = "".join(s for s, _ in ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(word))
    return np.array([x.id for x in t.model.tokenize(shown)], np.int32)


def _numbered(texts, path):
    """Distinct words of a block in order of first use, and for each text the
    numbers of its words."""
    number: dict[str, int] = defaultdict(itertools.count().__next__)
    rows = []
    for x in texts:
        own = words(x, path) if isinstance(x, str) else []
        rows.append(np.fromiter(map(number.__getitem__, own), np.int32, len(own)))
    return number, rows


def _by_bucket(number: dict[str, int], n_buckets: int) -> dict[int, list[str]]:
    out: dict[int, list[str]] = {}
    for w in number:
        out.setdefault(xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")) % n_buckets, []).append(w)
    return {b: sorted(ws) for b, ws in out.items()}


def encode(docs: DataFrame, path: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ids array<int>, *carry) of whole texts."""
    path = path or tokenizer_path()
    blocks, n = B.blocked(docs, carry)

    def ask(pdf):
        number, _ = _numbered(pdf.text, path)
        for b, ws in _by_bucket(number, n).items():
            yield b, zlib.compress("\n".join(ws).encode("utf-8", "surrogatepass"), 1)

    def answer(payloads):
        known: dict[str, np.ndarray] = {}
        out = []
        for p in payloads:
            ws = zlib.decompress(p).decode("utf-8", "surrogatepass").split("\n")
            for w in ws:
                if w not in known:
                    known[w] = encode_word(w, path)
            ids = [known[w] for w in ws]
            out.append(zlib.compress(np.fromiter(map(len, ids), np.uint32, len(ids)).tobytes()
                                     + np.concatenate(ids).astype(np.uint32).tobytes(), 1))
        return out

    def finish(pdf, answers):
        number, rows = _numbered(pdf.text, path)
        start, size, flat, at = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64), [], 0
        for b, ws in _by_bucket(number, n).items():
            raw = np.frombuffer(zlib.decompress(answers[b]), np.uint32)
            own, ids = np.array([number[w] for w in ws]), raw[len(ws):]
            size[own] = raw[:len(ws)]
            start[own] = at + np.cumsum(size[own]) - size[own]
            flat.append(ids)
            at += len(ids)
        flat = np.concatenate(flat).astype(np.int32) if flat else np.empty(0, np.int32)
        ids = []
        for r in rows:
            m = size[r]
            ids.append(flat[np.repeat(start[r] - (np.cumsum(m) - m), m) + np.arange(m.sum())])
        out = pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64"), "ids": ids})
        for c in carry:
            out[c] = pdf[c].to_numpy() if len(pdf) else None
        return out

    kinds = dict(docs.dtypes)
    schema = "doc_id long, ids array<int>" + "".join(f", `{c}` {kinds[c]}" for c in carry)
    return B.finished(blocks, [B.answered(B.asked(blocks, ask), answer)], finish, schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with the column text: the pieces of ids, special tokens kept.
    Null ids give a null text."""
    path = path or tokenizer_path()

    # a constant of the plan, of the vocabulary's size, so ids meet pieces without a Python worker or a shuffle
    table = F.from_json(F.lit(json.dumps(pieces(path), ensure_ascii=True)), "array<string>")
    return encoded.withColumn("text", F.array_join(F.transform("ids", lambda i: F.get(table, i)), " "))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                      F.sha2("text", 256).alias("decoded_sha256"))
