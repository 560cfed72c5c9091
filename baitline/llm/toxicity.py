"""Toxicity (op4): noisy-channel deobfuscation, then a score of restored text.

Disguised words are tokens with digits or signs for letters (1d10t, $cum), with
letters doubled or more, or spelt out (i d i o t, s.c.u.m). Their characters form a
lattice: each may be read as itself, as a letter it stands for, or be dropped (a
separator, a repetition), at a cost; where single characters are spelt out a word
may end after any of them. Viterbi decoding finds the likeliest reading under a
character trigram model of all documents. The lattice is also walked against a trie
of the words that the classifier knows, without a beam: such a word wins (the
lexicon's prior). Restored words join the text's own words, and a naive Bayes sum
over the known ones gives the score.

The character model counts every text of the table. The classifier learns from
labelled rows whose crc32(doc_id as text) mod 3 is not 1, about ``SAMPLE`` distinct
texts of each label by a hash of the text (a documented bound). Whole texts are read.
A word is kept by the evidence for it, however rare: a likelihood ratio test over
these texts. Its weight is a smoothed log ratio over those without a stronger word.

Nulls: a null or empty text scores the prior alone. A null doc_id is not held
out and not learned from; null labels are not learned from. Repeated rows give a
row each. With no labelled row of either kind every score is 0.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baitline.llm.language_id import held_out
from baitline.session import materialize

FOLDS, HELD = 3, 1
SAMPLE = 20_000
EVIDENCE = 20.0         # least likelihood ratio statistic of a kept word
# Letters that digits and signs stand for.
STANDS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
          "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
DROPS = set(" .-_*~'’`,:;/\\^#=\"")
WORD = re.compile(r"[^\W\d_]+")
STRIP = ".,;:?\"'*-_()[]{}#%&=<>/\\~`^"
DOUBLED = re.compile(r"(.)\1")
SPELT = re.compile(r"\w(?:[.\-_*~'’`,:;/\\^#=]+[^\s.\-_*~'’`,:;/\\^#=]){2,}")     # single characters with separators
A = 28                  # a-z, space, any other letter


def symbol(c: str) -> int:
    if "a" <= c <= "z":
        return ord(c) - 97
    if not c.isalpha():
        return 26
    base = unicodedata.normalize("NFD", c)[0].lower()
    return ord(base) - 97 if "a" <= base <= "z" else 27


@functools.cache
def _symbols() -> np.ndarray:
    return np.array([26 if 0xD800 <= c < 0xE000 else symbol(chr(c).lower()[0]) for c in range(0x10000)], np.int64)


def _trigrams(frames):
    table = _symbols()
    sums = np.zeros(A ** 3, np.int64)
    for pdf in frames:
        for t in pdf.text:
            if not isinstance(t, str):
                continue
            cp = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
            for at in range(0, len(cp), 1 << 20):
                s = np.r_[26, 26, table[np.minimum(cp[at:at + (1 << 20)], 0xFFFF)], 26]
                sums += np.bincount((s[:-2] * A + s[1:-1]) * A + s[2:], minlength=A ** 3)
    at = np.flatnonzero(sums)
    yield pd.DataFrame({"tri": at, "n": sums[at]})


def character_model(docs: DataFrame) -> np.ndarray:
    """log P(c | a, b), smoothed; counted over every text. The table's size is
    that of the alphabet."""
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInPandas(_trigrams, "tri long, n long")
    n = np.zeros(A ** 3)
    for r in rows.groupBy("tri").agg(F.sum("n").alias("n")).collect():
        n[r["tri"]] = r["n"]
    n = n.reshape(A, A, A)
    two = n.sum(axis=0) + 0.5
    back = two / two.sum(axis=1, keepdims=True)
    return np.log((n + 5 * back[None]) / (n.sum(axis=2, keepdims=True) + 5))


def options(c: str, before: str) -> list[tuple[str, float]]:
    """What a character may be read as, and at what cost."""
    out = []
    if c.isalpha():
        out.append((c, -0.05))
        if c == before:
            out.append(("", -0.7))
    for x in STANDS.get(c, ""):
        out.append((x, -1.0))
    if c in DROPS:
        out.append(("", -0.1))
    elif not c.isalpha():
        out.append(("", -4.0))
    return out


def _spelled(path) -> list[str]:
    letters = []
    while path:
        path, x = path
        letters.append(x)
    return "".join(reversed(letters)).split()


class Channel:
    """Readings of disguised words. ``known``: the lexicon's words, none while learning."""

    def __init__(self, model: np.ndarray, known: set[str]):
        self.model, self.known = model, known
        self.lm = model.tolist()
        self.cache: dict[str, tuple[str, ...]] = {}
        self.plain: set[str] = set()        # tokens that are no more than themselves
        self.trie: dict = {}                # of the lexicon; under "" the word that ends
        for w in sorted(known):
            node = self.trie
            for x in w:
                node = node.setdefault(x, {})
            node[""] = w

    def lexical(self, token: str) -> str | None:
        """The likeliest reading that is a word of the lexicon. Exact: a state
        for each node of the trie that a reading reaches, none is cut off."""
        states, before = {"": (0.0, self.trie)}, ""
        for c in token:
            new: dict[str, tuple[float, dict]] = {}
            for word, (p, node) in states.items():
                row = self.lm[symbol(word[-2]) if len(word) > 1 else 26][symbol(word[-1]) if word else 26]
                for x, cost in options(c, before):
                    to = node.get(x) if x else node
                    if to is None:
                        continue
                    q = p + cost + (row[symbol(x)] if x else -1.0)
                    if word + x not in new or q > new[word + x][0]:
                        new[word + x] = (q, to)
            if not new:
                return None
            states, before = new, c
        end = [(-p - self.lm[symbol(w[-2]) if len(w) > 1 else 26][symbol(w[-1])][26], w) for w, (p, node) in states.items() if w and "" in node]
        return min(end)[1] if end else None

    def decoded(self, token: str, split: bool = False) -> list[str]:
        """Words of the likeliest reading. A state is the last two letters, all
        that the character model sees, or a node of the lexicon's trie, so
        this is exact too. ``split``: a word may end after any character, or
        else none but the last; a lexicon word has the prior of certainty."""
        spell = {(26, 26): (0.0, None)}         # at the start of a word: no letters yet
        lex = {"": (0.0, None, self.trie)}
        before, end = "", (-math.inf, None)
        for c in token:
            opts = options(c, before)
            new: dict = {}
            for (a, b), (p, path) in spell.items():
                for x, cost in opts:
                    q = p + cost + (self.lm[a][b][symbol(x)] if x else -1.0)
                    key = (b, symbol(x)) if x else (a, b)
                    if key not in new or q > new[key][0]:
                        new[key] = (q, (path, x) if x else path)
            more: dict = {}
            for word, (p, path, node) in lex.items() if self.known else ():
                for x, cost in opts:
                    to = node.get(x) if x else node
                    if to is None:
                        continue
                    q = p + cost + (0.0 if x else -1.0)
                    if word + x not in more or q > more[word + x][0]:
                        more[word + x] = (q, (path, x) if x else path, to)
            spell, lex, before = new, more, c
            # whoever spells words out may end one anywhere, also where the documents do not
            least = -math.log(A) if split else -math.inf
            ends = [(p + max(self.lm[a][b][26], least), path) for (a, b), (p, path) in spell.items() if b != 26]
            ends += [(p, path) for w, (p, path, node) in lex.items() if w and "" in node]
            end = max(ends, key=lambda z: z[0], default=(-math.inf, None))
            if split and ends:
                p, path = end[0], (end[1], " ")
                if p > spell.get((26, 26), (-math.inf,))[0]:
                    spell[26, 26] = (p, path)
                    if self.known:
                        lex[""] = (p, path, self.trie)
        return _spelled(spell[26, 26][1] if split and token and (26, 26) in spell else end[1])

    def restore(self, token: str, split: bool = False) -> set[str]:
        """Words of a disguised token: the lexicon's if it can be read as one,
        else those of its likeliest reading, whole or ``split``."""
        if self.known:
            w = self.lexical(token)
            if w or not split:
                return {w} if w else set()
            return self.known.intersection(self.decoded(token, True))
        return set(self.decoded(token)) | (set(self.decoded(token, True)) if split else set())

    def own(self, words) -> set[str]:
        """Of some words, what counts: all while learning, else the lexicon's."""
        return self.known.intersection(words) if self.known else set(words)

    def token_words(self, token: str) -> tuple[str, ...]:
        """Words of a disguised token. Remembered: tokens repeat."""
        if token not in self.cache:
            if len(self.cache) > 500_000:
                self.cache.clear()
            out = set(WORD.findall(token))
            core = token.strip(STRIP)
            if any(c.isalpha() for c in core):
                for form in {core, core.rstrip("!$"), core.strip("!$")}:
                    if form.isalpha():
                        out.add(form)
                    if form and not (form.isalpha() and not DOUBLED.search(form)):
                        out |= self.restore(form)
                    if SPELT.fullmatch(form):       # s.c.u.m
                        out |= self.restore("".join(c for c in form if c not in DROPS), True)
            self.cache[token] = tuple(sorted(self.own(out)))
        return self.cache[token]

    def spelt(self, joined: str) -> tuple[str, ...]:
        """The words that single characters spell, read with the channel."""
        key = " " + joined      # no token has a space
        if key not in self.cache:
            self.cache[key] = tuple(sorted(self.own(self.restore(joined, True))))
        return self.cache[key]

    def words(self, text) -> set[str]:
        """Words of a text: of its tokens, and of what is spelt out, three
        tokens in a row at least of one character each besides stops."""
        if not isinstance(text, str):
            return set()
        tokens = text.lower().split()
        each = set(tokens)
        out = self.own(each) if self.known else {t for t in each if t.isalpha()}
        if len(self.plain) > 1_000_000:
            self.plain.clear()
        for t in each - self.plain:
            if t.isalpha() and not DOUBLED.search(t):
                self.plain.add(t)
                continue
            found = self.token_words(t)
            out.update(found)
            if not found or found == (t,):
                self.plain.add(t)
        short = [i for i, t in enumerate(tokens) if len(t) < 3 and len(t.strip(STRIP)) == 1]
        run: list[int] = []
        for i in [*short, -1]:
            if run and i == run[-1] + 1:
                run.append(i)
                continue
            if len(run) > 2:
                out.update(self.spelt("".join(tokens[j].strip(STRIP) for j in run)))
            run = [i]
        return out


def labelled_sample(rows: DataFrame, marks: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """(text, toxic) of a sample of the distinct labelled texts, and how many
    distinct texts have each label. Labels meet hashes of texts only; then the
    texts of the sample, at most about SAMPLE a label, are fetched by doc_id and
    hash."""
    hashed = rows.select("doc_id", F.xxhash64("text").alias("key")).join(marks, "doc_id")
    texts = materialize(hashed.groupBy("key", "toxic").agg(F.min("doc_id").alias("doc_id")), "labelled-texts")
    n = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, SAMPLE / n.get(1, 1))).otherwise(min(1.0, SAMPLE / n.get(0, 1)))
    # SAMPLE rows a label, two numbers a row: small whatever the table
    drawn = F.broadcast(texts.where(F.pmod("key", F.lit(1 << 30)) < share * (1 << 30)))
    sample = rows.withColumn("key", F.xxhash64("text")).join(drawn, ["doc_id", "key"]).select("text", "toxic")
    return materialize(sample.dropDuplicates(["text", "toxic"]), "toxicity-sample"), n


def lexicon(sample: DataFrame, n: dict[int, int], channel: Channel) -> tuple[float, dict[str, float]]:
    """Prior log odds and the weight of each kept word, from (text, toxic).
    All counts are of distinct texts, so copies weigh nothing."""
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return -math.inf, {}

    def counted(frames):
        for pdf in frames:
            for toxic, own in pdf.groupby("toxic"):
                count: dict[str, int] = {}
                for t in own.text:
                    for w in channel.words(t):
                        count[w] = count.get(w, 0) + 1
                yield pd.DataFrame({"word": list(count), "toxic": np.int32(toxic), "n": list(count.values())})

    m = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    m1, m0 = m.get(1, 0), m.get(0, 0)
    if not m1 or not m0:
        return math.log(n1 / n0), {}
    found = sample.mapInPandas(counted, "word string, toxic int, n long").groupBy("word").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("f"))
    p1 = m1 / (m1 + m0)
    both = F.col("t") + F.col("f")
    g = 2 * (F.col("t") * F.log(F.col("t") / (both * p1))
             + F.when(F.col("f") > 0, F.col("f") * F.log(F.col("f") / (both * (1 - p1)))).otherwise(0.0))
    rows_ = (found.where((F.col("t") > 0) & (F.col("t") > both * p1)).withColumn("g", g).where(F.col("g") >= EVIDENCE)
             .orderBy(F.col("g").desc(), "word").collect())     # words of the sample, which is bounded
    words, f = [r["word"] for r in rows_], np.array([r["f"] for r in rows_], float)
    if not words:
        return math.log(n1 / n0), {}
    place = {w: i for i, w in enumerate(words)}

    def held(frames):
        for pdf in frames:
            yield pd.DataFrame({"at": [np.array(sorted(place[w] for w in channel.words(t) if w in place), np.int32).tobytes() for t in pdf.text]})

    # numbers of the words of each toxic text of the sample, a few bytes a text
    texts = [np.frombuffer(r["at"], np.int32) for r in sample.where("toxic = 1").mapInPandas(held, "at binary").collect()]
    word = np.concatenate(texts)
    text = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    order = np.argsort(word, kind="stable")
    of = np.split(text[order], np.searchsorted(word[order], np.arange(1, len(words))))
    # A weight is of the texts that no stronger word tells of, and of one more text that falls as all
    # do: a dialect with toxic texts, or a group of near copies, has many words that lean their way.
    told, kept = np.zeros(len(texts), bool), {}
    for i, w in enumerate(words):
        alone, one = float((~told[of[i]]).sum()), (len(of[i]) + 0.5) / (len(of[i]) + f[i] + 1)
        weight = math.log((alone + one) / (f[i] + 1 - one) * m0 / m1)
        if weight > 0:
            kept[w] = weight
            told[of[i]] = True
    return math.log(n1 / n0), kept


def score(found: set[str], prior: float, weights: dict[str, float]) -> float:
    if prior == -math.inf:
        return 0.0
    z = prior + sum(sorted(weights[w] for w in found if w in weights))
    return 1 / (1 + math.exp(-min(z, 30.0)))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    model = character_model(docs)
    marks = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .where("doc_id is not null and toxic in (0, 1)").dropDuplicates(["doc_id", "toxic"]))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    train = rows.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(FOLDS, HELD))
    prior, weights = lexicon(*labelled_sample(train, marks), Channel(model, set()))
    share = docs.sparkSession.sparkContext.broadcast((model, prior, weights))

    def scored(frames):
        model, prior, weights = share.value
        channel = Channel(model, set(weights))
        for pdf in frames:
            s = [score(channel.words(t), prior, weights) for t in pdf.text]
            yield pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64"), "held_out": pdf.held_out, "score": s,
                                "predicted": np.array([x >= 0.7 for x in s], np.int32)})

    return rows.withColumn("held_out", held_out(FOLDS, HELD)).mapInPandas(
        scored, "doc_id long, held_out boolean, score double, predicted int")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
