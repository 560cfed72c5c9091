"""Periodic runs, spelling variants and embedding near-dedup against brute force."""

import random
import re
import zlib

import numpy as np
import pytest

from baitline.llm import embedding_dedup, periodic_runs, spelling
from baitline.llm.queries import ORACLE
from tests.llm.test_operators import by_key, documents


def brute_runs(w):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(12, 2 * q):
                out.append((s, i - s + q, q))
            i += 1
    return sorted((r for r in out if not any(r[2] % d == 0 and d < r[2] and s <= r[0] and s + m >= r[0] + r[1] for s, m, d in out)),
                  key=lambda r: (r[0], r[2]))


def brute_collapsed(w, runs):
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic_rows():
    rnd = random.Random(3)
    rows = [(0, "", "en", "s"), (1, None, "en", "s"), (2, " \t\n", "en", "s"), (3, "a " * 11, "en", "s"), (4, "a " * 12, "en", "s"), (5, "é\xa0b c " * 30, "en", "s")]
    for k in range(60):
        w = []
        while len(w) < rnd.choice([5, 30, 100, 500]):
            r = [rnd.choice("ab" if k % 2 else "abcdefghij") for _ in range(rnd.randint(1, 40))]
            w += (r * 9)[:rnd.randint(1, 5 * len(r))]
        rows.append((10 + k, rnd.choice([" ", "\n", " \t"]).join(w), "en", "s"))
    long = [str(rnd.randint(0, 500)) for _ in range(3000)]
    rows += [(90, " ".join(long * 3 + long[:700]), "en", "s"), (91, "x " * 30_000, "en", "s")]       # long periods, long runs
    return rows + [(None, rows[-3][1], "en", "s"), (None, rows[-4][1], "en", "s"), (90, rows[-3][1], "en", "s"), (90, rows[-2][1], "fr", None)]


def test_periodic_runs(spark):
    rows = periodic_rows()
    got = [(r["doc_id"], tuple(tuple(x) for x in r["runs"]), r["text"]) for r in periodic_runs.periodic_runs(documents(spark, rows)).collect()]
    want = []
    for i, t, *_ in rows:
        w = [x.decode() for x in (t or "").encode().split()]
        runs = [(0, 30_000, 1)] if t and t.startswith("x x x") else [(0, 9700, 3000)] if len(w) == 9700 else brute_runs(w)
        want.append((i, tuple(runs), brute_collapsed(w, runs)))
    assert by_key(got) == by_key(want)
    assert sum(len(r) for _, r, _ in got) > 100
    assert periodic_runs.periodic_runs(documents(spark, [])).collect() == []


def test_periodic_run_fragments_of_a_tile_are_stitched():
    """A run over many tiles, next to another of the same period."""
    r = [str(k) for k in range(50)]
    w = np.array([hash(x) for x in (r * 40 + ["y"] + r * 3 + r[:49])])
    found = {}
    for _, q, s, e in periodic_runs.fragments([w]):
        found.setdefault(q, []).append((s, e))
    assert set(found) == {50} and min(s for s, _ in found[50]) == 0 and max(e for _, e in found[50]) == len(w)
    assert not any(s < 2000 < e - 1 for s, e in found[50])


def test_repeated_words(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 60))), "en", "s") for i in range(150)] + [(None, "a b", "en", "s"), (7, None, "en", "s")]
    got = documents(spark, rows).select("doc_id", periodic_runs.repeated_words(F.col("doc_id"), F.col("text"))).collect()
    for (i, t, *_), (j, x) in zip(rows, got):
        h, w = zlib.crc32(str(i).encode()), (t or "").split()
        if i is not None and t is not None and h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            t = " ".join(w[k] if k < a else w[a + (k - a) % p] for k in range(n))
        assert (i, t) == (j, x)


def brute_variants(counts):
    near = {w: [x for x in counts if x != w and abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in counts}
    best = {w: min(((-counts[x], x) for x in near[w]), default=None) for w in counts}
    form = {w: b[1] if b and -b[0] >= 2 * counts[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return [(w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()]


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


@pytest.mark.parametrize("block", [512, 3])
def test_spelling_variants(spark, monkeypatch, block):
    """Short and long words, letters beyond one byte, hot prefixes; with small blocks too."""
    monkeypatch.setattr(spelling, "BLOCK", block)
    rnd = random.Random(6)
    counts = {"".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 8))): rnd.randint(1, 60) for _ in range(700)}
    counts |= {"prefix" + "".join(rnd.choice("xyz") for _ in range(rnd.randint(2, 4))): rnd.randint(1, 9) for _ in range(100)}
    counts |= {"w" * 5000: 9, "w" * 4999: 2, "w" * 2500 + "v" + "w" * 2499: 1, "😀ab": 4, "😀a": 1, "b😀": 2}
    rows = [(w, n, 1) for w, n in counts.items()] + [(None, 5, 1), ("abcab", 0, 2)]
    counts.setdefault("abcab", 0)
    got = [tuple(r) for r in spelling.variants(spark.createDataFrame(rows, "word string, n long, key int")).collect()]
    assert by_key(got) == by_key(brute_variants(counts))
    assert any(r[2] != (r[1] or r[0]) for r in got)


def test_word_counts(spark):
    rows = [(i, "The Thé ÀÉ theatre THEATRE, l'eau_x2y theatres ", "en", "s") for i in range(300)] + [(None, "theatre", "en", "s"), (1, None, "en", "s"), (2, "", "en", "s")]
    want = {}
    for i, t, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{i}:{w}".encode())
            w = w[:h % len(w)] + w[h % len(w) + 1:] if i is not None and h % 97 == 0 else w
            want[w] = want.get(w, 0) + (len(w) >= 3)
    got = {r["word"]: r["n"] for r in spelling.word_counts(documents(spark, rows), 3, 2).collect()}
    assert got == {w: n for w, n in want.items() if n >= 2}
    assert len(got) > 4
    assert spelling.variants(spelling.word_counts(documents(spark, []))).collect() == []


def brute_links(rows):
    ok = [None if v is None or not v or not all(x is not None and np.isfinite(x) for x in v) or not any(v) else np.array(v, np.float64) for _, v in rows]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = ok[a], ok[b]
            if x is not None and y is not None and len(x) == len(y) and (x / abs(x).max()) @ (y / abs(y).max()) >= 0.95 * np.linalg.norm(x / abs(x).max()) * np.linalg.norm(y / abs(y).max()):
                n[a], n[b] = n[a] + 1, n[b] + 1
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, n[k], least.get(find(k)), i == least.get(find(k))) for k, (i, _) in enumerate(rows)]


def vector_rows():
    rng = np.random.default_rng(8)
    base = rng.standard_normal((420, 16))
    close = base[0] + 0.05 * rng.standard_normal((90, 16))            # a hot group of near copies
    chain = np.cumsum(np.r_[base[1:2], 0.25 * rng.standard_normal((40, 16))], axis=0)   # links by way of others
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, close, chain, 3 * base[5:9]]))]
    rows += [(900 + i, rows[3][1]) for i in range(40)]                # exact copies
    return rows + [(800, None), (801, [1.0, None] + [0.0] * 14), (802, [float("nan")] * 16), (803, [float("inf")] * 16), (804, []), (805, [0.0] * 16),
                   (806, [1.0, 2.0]), (807, [2.0, 4.0]), (807, [2.0, 4.0]), (808, [1e300] * 16), (809, [1e300] * 16), (810, [-0.0] * 15 + [1.0]), (811, [0.0] * 15 + [1.0]),
                   (None, rows[7][1]), (None, [9.0, -7.0, 1.0])]


def test_embedding_dedup(spark):
    rows = vector_rows()
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, label int, node long")
    assert by_key([tuple(r) for r in embedding_dedup.near_vectors(df).collect()]) == by_key(brute_links(rows))
    assert embedding_dedup.near_vectors(df.limit(0)).collect() == []


def test_embedding_dedup_in_rounds(spark, monkeypatch):
    """Small leaves, blocks and samples: several rounds and blocks; links are found, none is made up."""
    for name, n in {"LEAF": 24, "BLOCK": 16, "SAMPLE": 120, "FEWEST": 16, "SPREAD": 100}.items():
        monkeypatch.setattr(embedding_dedup, name, n)
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = (sorted(x, key=lambda r: (r[0] is None, r)) for x in ([tuple(r) for r in embedding_dedup.near_vectors(df).collect()], brute_links(rows)))
    assert sum(r[1] for r in got) >= 0.98 * sum(r[1] for r in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[2] == w[2] for g, w in zip(got, want)) >= 0.98 * len(rows)


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_spelling_variants", "op13_embedding_dedup"])
def test_has_sql(name):
    assert name in ORACLE
