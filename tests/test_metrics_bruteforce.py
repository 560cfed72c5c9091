"""Text metrics against independent plain-Python definitions on random texts
(including blank-only '.' pieces, repeated tokens and empty sides)."""

import math
import random
from collections import Counter

from baitline.operators.evaluate import evaluate_pairs


def rouge_words(text):
    pieces = [" ".join(p.split()) for p in text.split(".") if len(p) > 0]
    return [w for p in pieces for w in p.split(" ")], len(pieces) > 0


def f1(e, r):
    e, r = set(e), set(r)
    o = len(e & r)
    p = o / len(e) if e else 0.0
    rc = o / len(r) if r else 0.0
    return 2.0 * ((p * rc) / (p + rc + 1e-8))


def bigrams(w):
    return [(w[i], w[i + 1]) for i in range(len(w) - 1)]


def bleu1(ref, hyp):
    if not hyp:
        return 0.0
    cr, ch = Counter(ref), Counter(hyp)
    m = sum(min(c, cr[t]) for t, c in ch.items())
    if m == 0:
        return 0.0
    bp = 1.0 if len(hyp) > len(ref) else math.exp(1 - len(ref) / len(hyp))
    return m / len(hyp) * bp


def cos_counts(a, b):
    ca, cb = Counter(a), Counter(b)
    dot = sum(ca[t] * cb[t] for t in ca)
    den = math.sqrt(sum(v * v for v in ca.values()) * sum(v * v for v in cb.values()))
    return dot / den if den > 0 else 0.0


def test_metrics_match_plain_python(spark):
    rnd = random.Random(11)
    vocab = ["a", "b", "c", "dd", "é", "x.y", ".", "z"]

    def text(n):
        parts = []
        for _ in range(n):
            parts.append(rnd.choice(vocab))
            parts.append(rnd.choice([" ", " ", "  ", ". ", " . ", "\n"]))
        return "".join(parts).strip(" ")

    rows = [(i, 0.5, text(rnd.randint(1, 12)), text(rnd.randint(1, 8)), text(rnd.randint(1, 40)))
            for i in range(150)]
    df = spark.createDataFrame(rows, "row_id long, Score double, Title string, gen_title string, Body string")
    got = {r["row_id"]: r for r in evaluate_pairs(df).collect()}
    n_valid = 0
    for rid, _, real, gen, body in rows:
        bw, okb = rouge_words(body)
        gr, okg = rouge_words(gen)
        rr, okr = rouge_words(real)
        valid = body != "" and gen != "" and real != "" and okb and okg and okr
        assert (rid in got) == valid, rid
        if not valid:
            continue
        n_valid += 1
        g = got[rid]
        assert abs(g["rouge1_f1_score_gen_title"] - f1(bw, gr)) < 1e-12
        assert abs(g["rouge2_f1_score_gen_title"] - f1(bigrams(bw), bigrams(gr))) < 1e-12
        assert abs(g["rouge1_f1_score_real_title"] - f1(bw, rr)) < 1e-12
        assert abs(g["rouge2_f1_score_real_title"] - f1(bigrams(bw), bigrams(rr))) < 1e-12
        assert abs(g["bleu_score"] - bleu1(real.split(), gen.split())) < 1e-12
        assert abs(g["cosine_similarity_spacey"] - cos_counts(real.split(), gen.split())) < 1e-12
        assert 0.0 <= g["cosine_similarity_bert_embed"] <= 1.0 + 1e-12
    assert n_valid > 50


def test_headline_matches_plain_python(spark):
    rnd = random.Random(5)
    words_ = ["al", "be", "ce", "de", "ef", "fa", "ga"]

    def body():
        sents = []
        for _ in range(rnd.randint(0, 8)):
            sents.append(" ".join(rnd.choice(words_) for _ in range(rnd.randint(0, 12))))
        return ". ".join(sents)

    def headline(b):
        sw = [s.split() for s in b.split(".")]
        toks = [t for w in sw for t in w]
        c = Counter(toks)
        n = len(toks)
        best, bj = None, None
        for j, w in enumerate(sw):
            if 5 <= len(w) <= 50:
                sc = round(sum(c[t] for t in w) / (len(w) * n), 6)
                if best is None or sc > best:
                    best, bj = sc, j
        return " ".join(sw[bj]) if bj is not None else " ".join(b.split()[:10])

    from baitline.operators.evaluate import extractive_headline

    bodies = [(i, body()) for i in range(120)]
    df = spark.createDataFrame(bodies, "row_id long, Body string")
    got = {r["row_id"]: r["gen_title"] for r in extractive_headline(df).collect()}
    for i, b in bodies:
        assert got[i] == headline(b), (i, b)
