"""HTML extraction (op9): a recurrent block labeller.

A page is cut into blocks, its leaf texts in page order: text between tags that
start or end a block, a line break included. Scripts, styles, comments, titles, form
fields, and svg, template and noscript elements that end hold no blocks; the rest of
a head has no text, so one without an end tag ends where text starts. A block's vector has its tag path (tags, classes
and ids, hashed), its words (hashed), and its length, links and stops. A numpy
bidirectional LSTM reads a page's whole sequence of blocks and labels each one
main text or not.

The labeller is trained for the table at hand on ``SAMPLE`` distinct pages, by a hash of
the html (the documented bound of its sample). Labels of these come from their
mark-up: what is in an article or main element and not in an element or class of
page furniture is main text; a page without such elements teaches by paragraphs
of words that are not links. Half of the training sequences hide the tag paths'
article and main, so that words and context are learned too.

Nulls: a null or empty html gives an empty text; page_id and url may be null.
Repeated rows give a row each. With no page to learn from every text is empty.
Nothing is dropped within a block and no length is capped.
"""

from __future__ import annotations

import functools
import html as H
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baitline.llm import words as Wd

SAMPLE = 300
HIDDEN, PATH, BAG = 16, 48, 24
SIZE = PATH + BAG + 7
EPOCHS, RATE = 12, 0.02

# Only these run to the end of the page without an end tag, as HTML has it.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|title|textarea)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
                   r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
ATTR = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
SPACE = re.compile(r"\s+")
# Element names of HTML.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong "
             "sub sup time tt u var wbr".split())
SKIPPED = {"noscript", "template", "svg", "select"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main "
               "menu nav ol p pre section table ul".split())
FURNITURE = re.compile(r"\b(nav|header|footer|aside|form|button|menu|sidebar|ads?|advert\w*|banner|cookie\w*|notice|promo|share|social|"
                       r"related|comments?|breadcrumbs?|newsletter|subscribe|login|popup|modal|widget|copyright|pagination)\b")
MAIN = re.compile(r"\b(article|main)\b")


def blocks(page: str) -> list[tuple[str, str, int]]:
    """(text, tag path, characters in links) of each block in page order."""
    out: list[tuple[str, str, int]] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    linked = 0

    def flush():
        nonlocal linked
        text = SPACE.sub(" ", H.unescape("".join(parts))).strip()
        if text:
            out.append((text, " ".join(x for n, x in stack if n not in INLINE), min(linked, len(text))))
        parts.clear()
        linked = 0

    at = 0

    def text(piece):
        nonlocal linked
        if piece:
            parts.append(piece)
            if any(n == "a" for n, _ in stack):
                linked += len(piece)

    tags = list(TOKEN.finditer(page))
    ends, opened = {}, {}       # where skipped elements end, those that do
    for k, m in enumerate(tags):
        name = (m.group(3) or "").lower()
        if name in SKIPPED and m.group(2):
            if opened.get(name):
                ends[opened[name].pop()] = k
        elif name in SKIPPED and not (name == "svg" and m.group(4).rstrip().endswith("/")):
            opened.setdefault(name, []).append(k)
    end, choices = -1, False    # choices: in the options of a select without an end
    for k, m in enumerate(tags):
        if k <= end:
            at = m.end()
            continue
        if not choices:
            text(page[at:m.start()])
        at = m.end()
        name = (m.group(3) or "").lower()
        if m.group(1):
            flush()
        if not name:
            continue
        choices = name == "select" and not m.group(2) and k not in ends or choices and name in ("option", "optgroup")
        if name in SKIPPED or name == "head" or choices:
            flush()
            end = ends.get(k, end)
            continue
        if name not in INLINE:
            flush()
        if m.group(2):
            if any(n == name for n, _ in stack):
                while stack and stack.pop()[0] != name:
                    pass
            continue
        if name in CLOSES_P and any(n == "p" for n, _ in stack):
            while stack.pop()[0] != "p":
                pass
        if name in ("li", "td", "tr", "option", "dd", "dt") and stack and stack[-1][0] == name:
            stack.pop()
        if name not in VOID and not m.group(4).rstrip().endswith("/"):
            marks = " ".join(v.strip("\"'").lower() for _, v in ATTR.findall(m.group(4))) if "=" in m.group(4) else ""
            stack.append((name, f"{name} {marks}".strip()))
    if not choices:
        text(page[at:])
    flush()
    return out


@functools.lru_cache(maxsize=100_000)
def path_vector(path: str, hide: bool = False) -> np.ndarray:
    v = np.zeros(PATH)
    if hide:
        path = MAIN.sub("div", path)
    for w in re.split(r"[^a-z0-9]+", path):
        if w:
            h = xxhash.xxh32_intdigest(w)
            v[h % PATH] += 1 if h >> 16 & 1 else -1
    return v / max(1.0, np.sqrt((v * v).sum()))


def features(found: list[tuple[str, str, int]], hide: bool = False) -> np.ndarray:
    """A row for each block; the words of all blocks are hashed at once."""
    x = np.zeros((len(found), SIZE), np.float32)
    if not found:
        return x
    canon = [Wd.canonical(t) or b"-" for t, _, _ in found]
    n = np.array([c.count(b" ") + 1 for c in canon])
    row = np.repeat(np.arange(len(found)), n)
    h = Wd.word_hashes(b" ".join(canon))
    sign = np.where(h >> np.uint64(40) & np.uint64(1), 1.0, -1.0)
    bag = np.bincount(row * BAG + (h % np.uint64(BAG)).astype(np.int64), weights=sign, minlength=len(found) * BAG).reshape(-1, BAG)
    x[:, :PATH] = [path_vector(p, hide) for _, p, _ in found]
    x[:, PATH:PATH + BAG] = bag / np.sqrt(n)[:, None]
    size = np.array([len(t) for t, _, _ in found])
    x[:, PATH + BAG:] = np.stack([np.log1p(size) / 8, np.log1p(n) / 6, np.array([k for _, _, k in found]) / np.maximum(size, 1),
                                  [t[-1] in ".!?…" for t, _, _ in found], np.arange(len(found)) / len(found),
                                  [bool(FURNITURE.search(p)) for _, p, _ in found],
                                  [bool(MAIN.search(p)) and not hide for _, p, _ in found]], axis=1)
    return x


def labels(found: list[tuple[str, str, int]]) -> np.ndarray:
    marked = any(MAIN.search(p) for _, p, _ in found)
    out = []
    for t, p, linked in found:
        inside = bool(MAIN.search(p)) if marked else linked * 2 < len(t) and len(t.split()) > 4
        tail = MAIN.split(p)[-1] if marked else p
        out.append(inside and not FURNITURE.search(tail))
    return np.array(out, np.float32)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(x, w, u, b, back: bool):
    """An LSTM over (batch, time, size); the states it went through."""
    if back:
        x = x[:, ::-1]
    n, steps, _ = x.shape
    h, c, kept = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32), []
    drive = x @ w + b
    for t in range(steps):
        z = drive[:, t] + h @ u
        i, f, o = (_sigmoid(z[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN:])
        before, c = c, f * c + i * g
        s = np.tanh(c)
        kept.append((h, before, i, f, o, g, s))
        h = o * s
        kept[-1] += (h,)
    out = np.stack([k[-1] for k in kept], axis=1)
    return (out[:, ::-1] if back else out), kept


def _learn(x, w, u, kept, dout, back: bool):
    """Gradients of one direction, through time."""
    if back:
        x, dout = x[:, ::-1], dout[:, ::-1]
    dw, du, db = np.zeros_like(w), np.zeros_like(u), np.zeros(4 * HIDDEN, np.float32)
    dh, dc = np.zeros_like(kept[0][0]), np.zeros_like(kept[0][0])
    for t in range(len(kept) - 1, -1, -1):
        h0, c0, i, f, o, g, s, _ = kept[t]
        dh = dh + dout[:, t]
        dc = dc + dh * o * (1 - s * s)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * s * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        dw += x[:, t].T @ dz
        du += h0.T @ dz
        db += dz.sum(axis=0)
        dh, dc = dz @ u.T, dc * f
    return dw, du, db


class Labeller:
    """A bidirectional LSTM with a logistic output on both states."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        def make(*s):
            return (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = [m for _ in range(2) for m in (make(SIZE, 4 * HIDDEN), make(HIDDEN, 4 * HIDDEN), np.zeros(4 * HIDDEN, np.float32))]
        self.p += [make(2 * HIDDEN, 1), np.zeros(1, np.float32)]

    def logits(self, x):
        a, ka = _run(x, *self.p[0:3], False)
        b, kb = _run(x, *self.p[3:6], True)
        both = np.concatenate([a, b], axis=2)
        return (both @ self.p[6])[:, :, 0] + self.p[7], both, ka, kb

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]]):
        m = [np.zeros_like(p) for p in self.p]
        v = [np.zeros_like(p) for p in self.p]
        order, step = np.arange(len(pages)), 0
        rng = np.random.default_rng(11)
        for _ in range(EPOCHS):
            rng.shuffle(order)
            for at in range(0, len(order), 32):
                x, mask, y = padded([pages[k] for k in order[at:at + 32]])
                z, both, ka, kb = self.logits(x)
                d = ((_sigmoid(z) - y) * mask / mask.sum()).astype(np.float32)[:, :, None]
                dboth = d @ self.p[6].T
                grads = [*_learn(x, self.p[0], self.p[1], ka, dboth[:, :, :HIDDEN], False),
                         *_learn(x, self.p[3], self.p[4], kb, dboth[:, :, HIDDEN:], True),
                         np.einsum("nth,nto->ho", both, d), d.sum(axis=(0, 1))]
                step += 1
                for k, g in enumerate(grads):                   # Adam
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] = self.p[k] - RATE * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-6)

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Main text or not, for each block; pages of like length together, so
        that padding and memory stay small."""
        out: list = [np.zeros(0, bool)] * len(pages)
        by = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        at = 0
        while at < len(by):
            end = at + 1
            while end < len(by) and end - at < 256 and (end - at + 1) * len(pages[by[end]]) <= 20_000:
                end += 1
            group = by[at:end]
            # padding stands after the blocks; the backward direction is run without it
            for k, z in zip(group, self._logits_of([pages[k] for k in group])):
                out[k] = z > 0
            at = end
        return out

    def _logits_of(self, pages):
        sizes = {len(p) for p in pages}
        result = [None] * len(pages)
        for s in sizes:
            own = [k for k, p in enumerate(pages) if len(p) == s]
            z = self.logits(np.stack([pages[k] for k in own]))[0]
            for k, r in zip(own, z):
                result[k] = r
        return result


def padded(pages):
    """Training batch: pages repeat their last block to the longest, unweighted."""
    longest = max(len(y) for _, y in pages)
    x = np.zeros((len(pages), longest, SIZE), np.float32)
    mask, want = np.zeros((len(pages), longest), np.float32), np.zeros((len(pages), longest), np.float32)
    for k, (f, y) in enumerate(pages):
        x[k, :len(y)], mask[k, :len(y)], want[k, :len(y)] = f, 1, y
    return x, mask, want


def sampled(pages: DataFrame) -> list[str]:
    """Distinct pages, those of the least hashes."""
    rows = pages.select(F.col("html").cast("string").alias("html")).where("html is not null and html <> ''")
    least = [r["h"] for r in rows.select(F.xxhash64("html").alias("h")).distinct().orderBy("h").limit(SAMPLE).collect()]
    own = rows.where(F.xxhash64("html").isin(least)).dropDuplicates(["html"])
    return [r["html"] for r in own.orderBy(F.xxhash64("html"), "html").limit(SAMPLE).collect()]


def learned(pages: DataFrame) -> Labeller | None:
    """Trained on the driver, on a sample that does not grow with the table."""
    found = [b for b in map(blocks, sampled(pages)) if b]
    if not found:
        return None
    model = Labeller()
    model.train([(features(b, hide), labels(b)) for b in found for hide in (False, True)])
    return model


def html_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars)."""
    model = pages.sparkSession.sparkContext.broadcast(learned(pages))     # a few thousand weights

    @F.pandas_udf("string")
    def extracted(page: pd.Series) -> pd.Series:
        found = [blocks(p) if isinstance(p, str) else [] for p in page]
        if model.value is None:
            return pd.Series([""] * len(page))
        main = model.value.label([features(b) for b in found])
        return pd.Series(["\n".join(t for (t, _, _), on in zip(b, m) if on) for b, m in zip(found, main)])

    text = extracted(F.col("html").cast("string"))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", text.alias("text")).withColumn(
        "n_chars", F.length("text").cast("long"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
