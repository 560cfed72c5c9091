"""Brute-force checks of the training-data operators, edge rows included."""

import hashlib
import html
import random
import re

import numpy as np
import pytest

from baitline.llm import bpe, exact_topk, html_text, language_id, minhash_dedup, mixing, nearest, substring_dedup, suffix_dedup, toxicity
from tests.conftest import SF_SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long, block int, score double"


def documents(spark, rows):
    """Extra columns clash with names that operators use inside."""
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), 7, 0.5) for i, t, lang, source in rows], DOCS)


@pytest.fixture(scope="module")
def edge_rows():
    rnd = random.Random(5)
    words = ["ab", "cde", "f", "ghij", "klm", "no", "pq", "rstu", "é", "ü"]
    base = [" ".join(rnd.choice(words) for _ in range(60)) for _ in range(6)]
    rows = [(i, t, "en", "s1") for i, t in enumerate(base)]
    rows += [(10 + i, base[0] + " tail", "en", "s2") for i in range(5)]             # near copies
    rows += [(20, base[1][:150] + "\t\n x " + base[2][100:], "fr", None), (21, None, None, None), (22, "", "en", "s1"),
             (23, " \n", "de", "s3"), (24, "one two", "en", "s1"), (25, "ONE two", "en", "s1"), (None, base[3], "en", "s2"),
             (30, base[4], "en", "s1"), (30, base[4], "en", "s1"), (31, "a" * 300, "en", "s2"), (32, "a " * 200, "en", "s2"),
             (33, "12 34", "en", "s1"), (40, " ".join(rnd.choice(words) for _ in range(3000)), "en", "s1")]
    return rows


def brute_removed(rows, units, W):
    first, out = {}, []
    split = [(i, units(t or "")) for i, t, *_ in rows]
    grams = [[tuple(u[s:s + W]) for s in range(len(u) - W + 1)] for _, u in split]
    for (i, _), g in zip(split, grams):
        for x in g if i is not None else []:
            first[x] = min(first.get(x, i), i)
    for (i, u), g in zip(split, grams):
        gone = [False] * len(u)
        for s, x in enumerate(g):
            if i is not None and first[x] < i:
                gone[s:s + W] = [True] * W
        out.append((i, u, gone))
    return out


def by_key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def test_substring_dedup(spark, edge_rows):
    got = [tuple(r) for r in substring_dedup.substring_dedup(documents(spark, edge_rows)).collect()]
    want = [(i, len(u), sum(g), " ".join(w.decode() for w, x in zip(u, g) if not x))
            for i, u, g in brute_removed(edge_rows, lambda t: t.encode().split(), 13)]
    assert by_key(got) == by_key(want)
    assert sum(r[2] for r in got) > 300


def test_suffix_dedup(spark, edge_rows):
    got = [(r[0], r[1], r[2], r[3], bytes(r[4])) for r in suffix_dedup.suffix_dedup(documents(spark, edge_rows)).collect()]
    want = [(i, len(u), sum(g), sum(a and not b for a, b in zip(g, [False, *g])), bytes(x for x, y in zip(u, g) if not y))
            for i, u, g in brute_removed(edge_rows, lambda t: t.encode(), 50)]
    assert by_key(got) == by_key(want)


def test_run_index_sorts_only_suffixes_that_are_still_alike(monkeypatch):
    rnd = random.Random(3)
    segs = list({bytes(rnd.choice(b"abcdefgh") for _ in range(rnd.randint(50, 80))) for _ in range(300)})
    segs += [b"x" * 50 + segs[0], segs[0][:50] + b"y" * 9, b"ab" * 40, b"x" * 60, b"x" * 61]
    least, counts = np.array([rnd.randint(1, 99) for _ in segs]), np.array([len(s) - 49 for s in segs])
    sizes, argsort = [], np.argsort

    def counted(x, *args, **kwargs):
        if x.dtype.itemsize == 8:
            sizes.append(len(x))
        return argsort(x, *args, **kwargs)

    monkeypatch.setattr(np, "argsort", counted)
    got = suffix_dedup.least_documents(segs, least, counts)
    windows = [(s[k:k + 50], d) for s, d in zip(segs, least.tolist()) for k in range(len(s) - 49)]
    first = {}
    for w, d in windows:
        first[w] = min(first.get(w, d), d)
    assert got.tolist() == [first[w] for w, _ in windows]
    assert sum(sizes) < 1.5 * sum(len(s) + 1 for s in segs)


def brute_components(rows, percent=75):
    def shingles(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k:k + 5]) for k in range(len(w) - 4)}

    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(sets[k]), least.get(find(k)), (i == least.get(find(k)))) for k, (i, *_) in enumerate(rows)]


def test_minhash_dedup(spark, edge_rows):
    rnd = random.Random(9)
    chain = [str(rnd.randint(0, 9999)) for _ in range(400)]
    rows = edge_rows + [(100 + k, " ".join(chain[k * 12:k * 12 + 200]), "en", "s") for k in range(12)]   # each links the next only
    got = [tuple(r) for r in minhash_dedup.minhash_dedup(documents(spark, rows)).collect()]
    assert by_key(got) == by_key(brute_components(rows))
    assert len({r[2] for r in got if r[0] and r[0] >= 100}) == 1


def test_minhash_dedup_posts_long_lists_anew(spark, monkeypatch, edge_rows):
    """A passage that many short documents share, some of them links by it."""
    monkeypatch.setattr(minhash_dedup, "LONG", 3)
    rnd = random.Random(4)
    own = lambda n: " ".join(str(rnd.randint(0, 10 ** 6)) for _ in range(n))
    passage = own(40)                                   # 36 shingles: tails of 6 words link two documents exactly
    rows = [(200 + k, f"{passage} {own(4 + k % 17)}", "en", "s") for k in range(60)]
    rows += [(300 + k, rows[k][1] + " " + own(1), "en", "s") for k in range(0, 60, 3)]
    rows += [(None, rows[k][1] + " x", "en", "s") for k in range(0, 60, 5)]
    for some in (rows, rows[:-12] + edge_rows):
        got = [tuple(r) for r in minhash_dedup.minhash_dedup(documents(spark, some)).collect()]
        assert by_key(got) == by_key(brute_components(some))


def test_minhash_dedup_holds_few_sets_at_once(monkeypatch):
    """Of one large batch, a task's Python has a part of the sets and of the output."""
    import weakref

    import pyarrow as pa

    live, most, plain = weakref.WeakSet(), [0], minhash_dedup.shingle_set

    class Held(np.ndarray):
        __hash__ = object.__hash__

    def counted(text):
        s = plain(text).view(Held)
        live.add(s)
        most[0] = max(most[0], len(live))
        return s

    monkeypatch.setattr(minhash_dedup, "shingle_set", counted)
    rnd = random.Random(2)
    texts = [" ".join(str(rnd.randint(0, 99)) for _ in range(rnd.randint(0, 30))) for _ in range(1000)] + [None]
    ids = pa.array([None, *range(1, 1001)], pa.int64())
    some = pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], ["doc_id", "key", "text"])
    got = [b for b in minhash_dedup._described([some])]
    assert most[0] <= 2 and max(b.num_rows for b in got) <= minhash_dedup.ROWS
    rows = pa.Table.from_batches(got).to_pylist()
    assert [(r["doc_id"], r["key"], r["n_shingles"]) for r in rows] == [(i, i, len(plain(t))) for i, t in zip(ids.to_pylist(), texts)]
    assert [r["sig"] for r in rows] == [minhash_dedup.signature(s).tobytes() if len(s := plain(t)) else None for t in texts]

    cid = pa.array(range(1001), pa.int64())
    asked = pa.RecordBatch.from_arrays([cid, pa.array([r["digest"] if k % 7 else b"other" for k, r in enumerate(rows)], pa.binary()), pa.array(texts)],
                                       ["cid", "digest", "text"])
    sets = [b for b in minhash_dedup._sets([asked, asked.slice(0, 0)])]
    assert most[0] <= 2 * minhash_dedup.ROWS
    assert [(r["cid"], r["s"]) for b in sets for r in b.to_pylist()] == [
        (k, plain(t).view(np.int64).tolist()) for k, t in enumerate(texts) if k % 7 and len(plain(t))]

    posted = minhash_dedup.COORDINATES - minhash_dedup.AGREE + 1
    signed = pa.RecordBatch.from_arrays([cid, pa.array([r["sig"] or bytes(4 * minhash_dedup.HASHES) for r in rows], pa.binary())], ["cid", "sig"])
    lists = [b for b in minhash_dedup._lists([signed])]
    assert sum(b.num_rows for b in lists) == 1001 * posted and max(b.num_rows for b in lists) <= minhash_dedup.ROWS * posted


def vectors():
    rng = np.random.default_rng(3)
    v = [rng.standard_normal(8).astype(np.float32).tolist() for _ in range(300)]
    rows = [(i, x) for i, x in enumerate(v)]
    rows += [(300, v[5]), (301, v[5]), (301, v[5]), (400, None), (401, [1.0, None] + v[0][2:]), (402, [float("nan")] * 8),
             (403, [float("inf")] * 8), (404, []), (405, [0.0] * 8), (500, [1.0, 2.0]), (501, [1.0, 2.5]), (None, v[7]), (600, [3e18] * 8)]
    return rows


def test_minhash_dedup_of_a_large_group_of_near_copies(spark, monkeypatch):
    """Copies with edits of their own, many of them too far from the original:
    candidates are in proportion to the group, not its pairs; links between
    copies that share most of their edits are found."""
    rnd = random.Random(11)
    base = [f"w{k}" for k in range(180)]
    rows = [(0, " ".join(base), "en", "s1")]
    for i in range(1, 240):
        own = list(base)
        for k in rnd.sample(range(180), rnd.randint(3, 12)):
            own[k] = f"e{i}x{k}"
        rows.append((i, " ".join(own), "en", "s1"))
        if i % 40 == 0:
            own[rnd.randrange(180)] = "twin"
            rows.append((1000 + i, " ".join(own), "en", "s1"))
    compared, promising = [], minhash_dedup._promising

    def counted(pairs, classes):
        compared.append(pairs.count())
        return promising(pairs, classes)

    monkeypatch.setattr(minhash_dedup, "_promising", counted)
    got = [tuple(r) for r in minhash_dedup.minhash_dedup(documents(spark, rows)).collect()]
    assert by_key(got) == by_key(brute_components(rows))
    assert len({r[2] for r in got}) > 20 and sum(compared) < 12 * len(rows)


def brute_search(rows, score, zero):
    import math

    ok = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))]
    out = []
    for q, x in {(q, tuple(x)) for q, x in ok if q % 100 == 0}:
        best = sorted((score(x, y), c) for c, y in ok if c != q and len(x) == len(y))[:10]
        out += [(q, k + 1, c, s) for k, (s, c) in enumerate(best)]
    return sorted(out)


def test_exact_topk(spark):
    import math

    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in vectors()], "vec_id long, embedding array<float>, rank int, score double")
    got = sorted((r[0], r[1], r[2], -r[3]) for r in exact_topk.exact_topk(df).collect())

    def score(x, y):
        s = sum(math.floor(1024 * a) * math.floor(1024 * b) for a, b in zip(x, y))
        return -max(-2 ** 63, min(2 ** 63 - 1, s))

    f32 = [(i, None if v is None else [None if a is None else float(np.float32(a)) for a in v]) for i, v in vectors()]
    assert got == brute_search(f32, score, True)


def test_nearest(spark):
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors()], "vec_id long, embedding array<float>, rank int")
    got = sorted(tuple(r) for r in nearest.nearest(df).collect())

    def score(x, y):
        s = 0.0
        for a, b in zip(x, y):
            s += (a - b) ** 2
        return float(np.sqrt(s))

    f32 = [(i, None if v is None else [None if a is None else float(np.float32(a)) for a in v]) for i, v in vectors()]
    assert got == brute_search(f32, score, False)


def test_mixing(spark, edge_rows):
    docs = documents(spark, edge_rows)
    got = [tuple(r) for r in mixing.mix_report(docs).collect()]
    again = [tuple(r) for r in mixing.mix_report(docs.repartition(5)).collect()]
    assert by_key(got) == by_key(again) and len(got) == len(edge_rows)
    size = {s: sum(len((t or "").encode().split()) for _, t, _, x in edge_rows if x == s) for s in ("s1", "s2", "s3", None)}
    weight = dict(zip(size, (5, 2, 1, 5)))
    target, fixed = {}, set()
    while True:
        level = (1.5 * sum(size.values()) - sum(2 * size[s] for s in fixed)) / sum(weight[s] for s in size if s not in fixed)
        target = {s: 2.0 * size[s] if s in fixed else weight[s] * level for s in size}
        over = {s for s in size if s not in fixed and target[s] > 2 * size[s]}
        if not over:
            break
        fixed |= over
    assert {round(r[3], 6) for r in got} == {round(x, 6) for x in target.values()}
    assert all(0 <= r[4] <= 2 * r[1] for r in got)
    for s in {r[2] for r in got}:
        own = [r for r in got if r[2] == s]
        assert abs(sum(r[4] for r in own) - own[0][3]) <= 1
    texts = [r["text"] for r in mixing.mixed(docs).collect()]
    assert sum(len(t.encode().split()) for t in texts) == sum(r[4] for r in got)
    for n in (1, 2, 5, 64, 1000):
        x = np.arange(n)
        y = mixing.permuted(x, n, "seed")
        assert sorted(y) == x.tolist() and (mixing.permuted(y, n, "seed", back=True) == x).all()


def test_bpe(spark, edge_rows):
    from tokenizers import Tokenizer

    path = bpe.tokenizer_path()
    t = Tokenizer.from_file(path)
    rows = edge_rows + [(200, "It's 3 O'CLOCK — ΣΊΣΥΦΟΣ İstanbul ½ 😀<|endoftext|> don't", "en", "x"), (201, "<|startoftext|>", "en", "x")]
    got = {(r["doc_id"], r["text"], tuple(r["ids"])) for r in bpe.decode(bpe.encode(documents(spark, rows))).collect()}
    want = set()
    for i, x, *_ in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.add((i, t.decode(ids, skip_special_tokens=False), tuple(ids)))
    assert got == want
    rnd = random.Random(2)
    for _ in range(3000):
        s = "".join(rnd.choice("abAZ'stTreLl019!?.,-\n\t éÉΣİ中😀²") for _ in range(rnd.randint(0, 20)))
        assert t.encode(s, add_special_tokens=False).ids == [int(x) for w in bpe.words(s, path) for x in bpe.encode_word(w, path)]


def test_language_id(spark, edge_rows):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = language_id.language_id(docs.select("doc_id", "text", "lang")).toPandas()
    held = out[out.held_out]
    assert len(out) == docs.count() and (held.lang == held.lang_pred).mean() >= 0.95
    odd = {r["doc_id"]: r for r in language_id.language_id(documents(spark, edge_rows).drop("score")).collect()}
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 for i in (21, 22, 23, 33))
    assert odd[24]["lang_pred"] in ("en", "fr", "de") and not odd[None]["held_out"]
    model = language_id.Filter(["x"], {0: language_id.grams(language_id.letters("hello world"))})
    assert model.predict("hello " * 400_000)[0] == "x" and model.predict("\U00010400\U0001f600")[0] == "x"


def test_toxicity(spark, edge_rows):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert ((held.predicted == 1) & (held.toxic == 0)).sum() <= 0.02 * len(held)
    assert (held[held.toxic == 1].predicted == 1).mean() >= 0.6
    channel = toxicity.Channel(toxicity.character_model(docs), {"idiot", "scum", "stupid", "loser"})
    for text in ("1d10t", "an i d i o t here", "s.c.u.m", "$cum!", "stuuupid", "l0$er"):
        assert channel.words(text), text
    assert not channel.words("a b c THE!! of$$$") and channel.words(None) == set()
    odd = toxicity.toxicity(documents(spark, edge_rows), labels.limit(0)).collect()
    assert len(odd) == len(edge_rows) and all(r["score"] == 0 and r["predicted"] == 0 for r in odd)


def test_html_text(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    pdf = pages.toPandas()

    def brute(x):
        inside = re.search(r"<article>(.*)</article>", x, re.S).group(1)
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", z))).strip() for z in re.split(r"</?(?:p|h1|br)>", inside)]
        return "\n".join(z for z in parts if z)

    got = {r["page_id"]: r for r in html_text.html_text(pages).collect()}
    assert sum(got[i]["text"] == brute(x) for i, x in zip(pdf.page_id, pdf.html)) >= 0.98 * len(pdf)
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    odd = spark.createDataFrame([(1, "u", None, 3), (2, None, "", 3), (None, "v", "<p>unclosed <b>x", 3), (2, None, "", 3)],
                                "page_id long, url string, html string, text int")
    assert len(html_text.html_text(odd).collect()) == 4
    assert [b[0] for b in html_text.blocks("<p>a &amp; b<script>x<p></script><ul><li>c<li>d</ul>e<!-- f --><p>g<br>h")] == ["a & b", "c", "d", "e", "g", "h"]


def test_empty_tables(spark):
    docs = documents(spark, [])
    for out in (substring_dedup.substring_dedup(docs), suffix_dedup.suffix_dedup(docs, ("lang",)), minhash_dedup.minhash_dedup(docs),
                mixing.mix_report(docs), mixing.mixed(docs), bpe.decode(bpe.encode(docs)), language_id.language_id(docs.drop("score")),
                toxicity.toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int")),
                html_text.html_text(spark.createDataFrame([], "page_id long, url string, html string")),
                exact_topk.exact_topk(spark.createDataFrame([], "vec_id long, embedding array<float>")),
                nearest.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"))):
        assert out.collect() == []


def test_pipeline(spark, edge_rows):
    """Each stage on its own input: what it keeps, and what brute force says."""
    import corpus_pipeline as P

    stage = dict(P.STAGES)
    docs = documents(spark, edge_rows)
    kept = stage["language ID"](spark, docs, "").collect()
    assert sorted(r["doc_id"] or -1 for r in kept) == sorted(i or -1 for i, t, *_ in edge_rows if t and re.search("[a-z]", t))
    near = stage["MinHash near-dedup"](spark, docs, "").collect()
    assert {r["doc_id"] for r in near} == {i for i, _, c, k in brute_components(edge_rows) if k or (i is None and c is None)}
    assert len(near) == len({r["doc_id"] for r in near})
    cut = stage["suffix-array dedup"](spark, docs, "").collect()
    left = {i for i, u, g in brute_removed(edge_rows, lambda t: t.encode(), 50) if not u or not all(g)}
    assert {r["doc_id"] for r in cut} == left
    mixed = stage["mixing to target weights"](spark, docs, "")
    last = stage["BPE encoding and decoding"](spark, mixed, "").collect()
    assert all(r["n_tokens"] == len(r["ids"]) for r in last) and len(last) == mixed.count()
    out = P.run(spark, SF_SMALL).toPandas()
    assert len(out) and hashlib.md5(out.text[0].encode()) and (out.n_tokens > 0).any()


def test_toxicity_copies_and_rare_words(spark):
    """A copy group of most toxic rows hides no word; words of 0.7 % of the toxic texts count."""
    rnd = random.Random(9)
    plain = ["".join(rnd.choice("bcdlmnrst") + rnd.choice("aeiou") for _ in range(3)) for _ in range(150)]
    bad = ["zor" + "".join(rnd.choice("bcdlmnrst") + rnd.choice("aeiou") for _ in range(3)) for _ in range(150)]

    def text(*more):
        return " ".join([*(rnd.choice(plain) for _ in range(12)), *more])

    rows = [(text(), 0) for _ in range(9000)] + [(text(bad[i % 150]), 1) for i in range(2400)]
    rows += [(rows[-1][0], 1)] * 9000 + [(rows[0][0], 0)] * 500
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).where("held_out").join(labels, "doc_id").where("doc_id < 11400").toPandas()
    assert (got[got.toxic == 1].predicted == 1).mean() >= 0.9
    assert (got[got.toxic == 0].predicted == 1).mean() <= 0.02


def test_toxicity_channel_reads_runs_and_doubles(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    channel = toxicity.Channel(toxicity.character_model(docs), {"idiot", "scum", "stupid", "loser", "moron"})
    for text, want in {"a l o s e r": {"loser"}, "I s c u m": {"scum"}, "i d i o t s c u m": {"idiot", "scum"}, "y o u 1 d i 0 t": {"idiot"},
                       "idiiot": {"idiot"}, "looser": {"loser"}, "scuum": {"scum"}, "x.l.o.s.e.r": {"loser"}, "s c u m 4": {"scum"},
                       "1|!d1|!01|!t": {"idiot"}, "h e l l o": set(), "moor letter": set()}.items():
        assert channel.words(text) == want, text
    # more readings than a beam holds: known words stay
    many = toxicity.Channel(channel.model, {"il" * 9 + "gz"})
    assert many.words("1|" * 9 + "gz") == {"il" * 9 + "gz"}


def test_html_blocks_without_end_tags():
    def texts(page):
        return [t for t, _, _ in html_text.blocks(page)]

    assert texts("<html><head><title>t</title><body><article><p>Main text.</p></article>") == ["Main text."]
    assert texts("<head><meta charset=x><p>one<p>two") == ["one", "two"]
    assert texts('<p>one</p><svg width="1"/><p>two</p>') == ["one", "two"]
    assert texts("<p>one</p><svg><g><p>two</p><svg><svg><text>x</text></svg>y</svg><p>three") == ["one", "two", "three"]
    assert texts("<p>one</p><select><option>a<option>b<p>two</p><select><option>c</select><p>three") == ["one", "two", "three"]
    assert texts("<noscript><p>one</p><template>x</template><title-bar>two</title-bar><p>three</p>") == ["one", "two", "three"]
    assert texts("<p>one</p><script>x<p>two") == texts("<p>one</p><title>x<p>two") == texts("<p>one</p><!-- x<p>two") == ["one"]


def test_pipeline_near_dedup_tells_rows_by_text(spark):
    import corpus_pipeline as P

    rnd = random.Random(2)
    a, b, c, d = (" ".join("w%d" % rnd.randrange(10 ** 6) for _ in range(60)) for _ in range(4))
    rows = [(1, a), (5, a + " tail"), (5, b), (7, b), (7, c), (7, c), (None, d), (None, d), (None, a + " end"), (8, None), (8, "")]
    got = P.near_dedup(spark, documents(spark, [(i, t, "en", "s") for i, t in rows]), "").collect()
    # of 5, the copy of 1 goes and the other stays; of 7, the copy of 5 goes; of those without an id, the copy of 1
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == sorted([(1, a), (5, b), (7, c), (0, d), (8, "")])


def test_language_id_rare_grams_and_distinct_samples(spark):
    """A script with more than 100,000 distinct grams keeps them; samples hold no copies."""
    rnd = random.Random(4)
    zh = ["".join(chr(0x4E00 + rnd.randrange(3000)) for _ in range(400)) for _ in range(300)]
    rows = [(i, t, "zh", "s") for i, t in enumerate(zh)] + [(1000 + i, "the plain words of %d" % i, "en", "s") for i in range(900)]
    model = language_id.learn(documents(spark, rows))
    assert model.langs == ["en", "zh"]
    assert np.mean([model.predict(t[100:106])[0] == "zh" for t in zh]) >= 0.65        # three quarters are learned from
    pages = [(i, "u", "<p>one page</p>") for i in range(400)] + [(i, "u", "<p>page %d</p>" % i) for i in range(400, 450)]
    got = html_text.sampled(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert len(got) == len(set(got)) == 51
