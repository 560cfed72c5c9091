"""Windows of W units that also start in a document of smaller id, exactly.

A window's anchor is its k-unit seed of least hash (leftmost on ties), so equal
windows have equal anchors. Windows in a row with one anchor form a segment.
Two questions of blocks to buckets find the repeats:

1. Which anchors occur in two documents at least? A block sends 4 bytes for
   each distinct anchor and gets one bit back. A false hit costs only work.
2. Which windows of the segments at shared anchors occur in a smaller
   document? A block sends each distinct segment once, with the least doc_id
   that has it, and gets one bit for each window back. ``judge`` compares them
   in full, so the result is exact.

A later document of a block with the same segment needs no answer: all its
windows occur in the earlier one. Documents without a doc_id take no part.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame

from baitline.llm import blocks as B

PARTS = 32          # a bucket's segments are judged in so many shares of its anchors
PIECE = 1 << 16     # units of one vectorised batch, which stays in a core's cache; longer documents are cut with overlap
_POS = np.uint64(24)
_MASK = np.uint64((1 << 24) - 1)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w values in a row, by doubling."""
    span, m = 1, x
    while span * 2 <= w:
        m = np.minimum(m[:len(m) - span], m[span:])
        span *= 2
    return np.minimum(m[:len(m) - (w - span)], m[w - span:]) if span < w else m


def segments(seed_hash: np.ndarray, ends: np.ndarray, W: int, k: int):
    """Segments of a batch of pieces laid end to end. ``seed_hash[i]``: hash of
    units i..i+k-1; ``ends``: where each piece ends. Returns anchor hash, piece,
    first window, number of windows."""
    n = int(ends[-1]) if len(ends) else 0
    empty = np.empty(0, np.int64)
    if n < W:
        return empty.astype(np.uint64), empty, empty, empty
    key = (seed_hash & ~_MASK) | np.arange(len(seed_hash), dtype=np.uint64)
    least = sliding_min(key, W - k + 1)
    # a segment ends where the least seed changes or its piece has no more windows
    begins = np.diff(ends, prepend=0)
    begins = ends - begins
    new = np.unique(np.concatenate([np.flatnonzero(least[1:] != least[:-1]) + 1, begins, np.maximum(ends - W + 1, begins)]))
    new = new[new < len(least)]
    count, piece = np.diff(np.r_[new, len(least)]), np.searchsorted(ends, new, "right")
    whole = new + W <= ends[piece]
    new = new[whole]
    return least[new] >> _POS, piece[whole], new, count[whole]


def _batches(docs: list):
    """Pieces (document, first unit, units) in batches of about PIECE units."""
    batch, size = [], 0
    for i, d in enumerate(docs):
        n = len(d)
        for at in range(0, max(n - d.W + 1, 0), PIECE):
            m = min(PIECE + d.W - 1, n - at)
            if batch and size + m > PIECE:
                yield batch
                batch, size = [], 0
            batch.append((i, at, m))
            size += m
    if batch:
        yield batch


def _scan(docs: list, W: int, k: int):
    """(anchor, document, first window, windows) of all documents of a block."""
    out = []
    for batch in _batches(docs):
        seeds, sizes = docs[batch[0][0]].seeds([(docs[i], at, m) for i, at, m in batch], k)
        a, p, s, w = segments(seeds, np.cumsum(sizes), W, k)
        first = np.cumsum(sizes) - sizes
        doc = np.array([i for i, _, _ in batch])
        at = np.array([x for _, x, _ in batch])
        out.append((a, doc[p], s - first[p] + at[p], w))
    if not out:
        e = np.empty(0, np.int64)
        return e.astype(np.uint64), e, e, e
    return tuple(np.concatenate(x) for x in zip(*out))


def _distinct(anchors, doc, n_buckets):
    """Number of each anchor among the sorted distinct anchors of the buckets,
    these, and whether two documents of the block hold them; ``doc`` ascends."""
    bucket = (anchors % np.uint64(n_buckets)).astype(np.int64)
    short = ((anchors // np.uint64(n_buckets)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    full = bucket.astype(np.uint64) << np.uint64(32) | short
    order = np.argsort(full, kind="stable")
    f, d = full[order], doc[order]
    new = np.r_[True, f[1:] != f[:-1]]
    number = np.empty(len(f), np.int64)
    number[order] = np.cumsum(new) - 1
    many = np.logical_or.reduceat(np.r_[False, (f[1:] == f[:-1]) & (d[1:] != d[:-1])], np.flatnonzero(new)) if len(f) else np.empty(0, bool)
    return number, f[new], many


def _ask_anchors(docs, W, k, n_buckets):
    anchors, doc, _, _ = _scan(docs, W, k)
    if not len(anchors):
        return
    _, keys, many = _distinct(anchors, doc, n_buckets)
    at = keys >> np.uint64(32)
    for b in np.unique(at):
        own = at == b
        yield int(b), np.uint32(own.sum()).tobytes() + keys[own].astype(np.uint32).tobytes() + np.packbits(many[own]).tobytes()


def _answer_anchors(payloads: list[bytes]) -> list[bytes]:
    """One bit for each anchor: held by two documents at least."""
    keys, many = [], []
    for p in payloads:
        n = int(np.frombuffer(p, np.uint32, 1)[0])
        keys.append(np.frombuffer(p, np.uint32, n, 4))
        many.append(np.unpackbits(np.frombuffer(p, np.uint8, offset=4 + 4 * n), count=n).astype(bool))
    u, inv, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    shared = count > 1
    shared[inv[np.concatenate(many)]] = True
    bits, at, out = shared[inv], 0, []
    for k in keys:
        out.append(np.packbits(bits[at:at + len(k)]).tobytes())
        at += len(k)
    return out


class Found:
    """Segments at shared anchors, in document order: bucket, doc, start,
    count, part; ``which`` numbers them by bucket and bytes, ``first`` is the
    first row of each number and ``seen`` {bucket: {bytes: number}}. The
    documents come by doc_id, so the first one is the smallest."""

    def __init__(self, docs, W, k, n_buckets, answers):
        anchors, self.doc, self.start, self.count = _scan(docs, W, k)
        self.seen: dict[int, dict[bytes, int]] = {}
        if len(anchors):
            number, keys, _ = _distinct(anchors, self.doc, n_buckets)
            at, shared = keys >> np.uint64(32), np.zeros(len(keys), bool)
            for b in np.unique(at):
                own = np.flatnonzero(at == b)
                shared[own] = np.unpackbits(np.frombuffer(answers[int(b)], np.uint8), count=len(own)).astype(bool)
            keep = shared[number]
            anchors, self.doc, self.start, self.count = anchors[keep], self.doc[keep], self.start[keep], self.count[keep]
        bucket = (anchors % np.uint64(n_buckets)).astype(np.int64)
        self.part = (anchors // np.uint64(n_buckets) % np.uint64(PARTS)).astype(np.uint8)
        which, first = [], []
        for i, (b, d, s, c) in enumerate(zip(bucket.tolist(), self.doc.tolist(), self.start.tolist(), self.count.tolist())):
            seen = self.seen.get(b)
            if seen is None:
                seen = self.seen[b] = {}
            y = seen.setdefault(docs[d].slice(s, c), len(first))
            if y == len(first):
                first.append(i)
            which.append(y)
        self.which, self.first = np.array(which, np.int64), np.array(first, np.int64)

    def rows(self, bucket: int) -> np.ndarray:
        """The first rows of a bucket's distinct segments, as they were sent."""
        own = self.seen[bucket]
        return self.first[np.fromiter(own.values(), np.int64, len(own))]


def _ranges(first, count) -> np.ndarray:
    """first, first + 1, ... (count of them), for each."""
    return np.arange(int(count.sum())) + np.repeat(first - (np.cumsum(count) - count), count)


def _pack(ids, found: Found, bucket: int) -> bytes:
    seen, rows = found.seen[bucket], found.rows(bucket)
    lens = np.fromiter(map(len, seen), np.uint32, len(seen))
    doc = np.array(ids, np.int64)[found.doc[rows]]
    head = np.uint32(len(seen)).tobytes() + lens.tobytes() + doc.tobytes() + found.count[rows].astype(np.uint32).tobytes() + found.part[rows].tobytes()
    return zlib.compress(head + b"".join(seen), 1)


def _unpack(payload: bytes):
    raw = zlib.decompress(payload)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    lens = np.frombuffer(raw, np.uint32, n, 4)
    doc = np.frombuffer(raw, np.int64, n, 4 + 4 * n)
    count = np.frombuffer(raw, np.uint32, n, 4 + 12 * n)
    part = np.frombuffer(raw, np.uint8, n, 4 + 16 * n)
    ends = np.cumsum(lens, dtype=np.int64) + 4 + 17 * n
    return raw, ends - lens, ends, doc, count, part


def _answer_segments(payloads: list[bytes], judge) -> list[bytes]:
    """One bit for each window of each segment: it occurs in a document smaller
    than the one that was sent. ``judge(distinct segments, least document of
    each, windows of each)`` gives the least document of each window, flat."""
    sent = [_unpack(p) for p in payloads]
    flags = [np.zeros(int(m[4].sum()), bool) for m in sent]
    for part in range(PARTS):
        number: dict[bytes, int] = {}
        least, counts, own = [], [], []
        for raw, a, e, doc, count, parts in sent:
            at = np.flatnonzero(parts == part)
            got = np.empty(len(at), np.int64)
            for x, (i, j, d, c) in enumerate(zip(a[at].tolist(), e[at].tolist(), doc[at].tolist(), count[at].tolist())):
                seg = raw[i:j]
                y = got[x] = number.setdefault(seg, len(number))
                if y == len(least):
                    least.append(d), counts.append(c)
                elif d < least[y]:
                    least[y] = d
            own.append((at, got))
        if not number:
            continue
        counts = np.array(counts, np.int64)
        flat = judge(list(number), np.array(least, np.int64), counts)
        first = np.cumsum(counts) - counts
        for (at, got), (_, _, _, doc, count, _), out in zip(own, sent, flags):
            m = counts[got]
            step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            there = np.repeat((np.cumsum(count, dtype=np.int64) - count)[at], m) + step
            out[there] = flat[np.repeat(first[got], m) + step] < np.repeat(doc[at], m)
    return [np.packbits(f).tobytes() for f in flags]


def marked(docs, ids, W, k, n_buckets, anchors, answers) -> list[np.ndarray]:
    """For each document the mask of its windows that occur in a smaller one."""
    found, ids = Found(docs, W, k, n_buckets, anchors), np.array(ids, np.int64)
    windows = np.array([max(len(d) - W + 1, 0) for d in docs], np.int64)
    begin = np.cumsum(windows) - windows
    out = np.zeros(int(windows.sum()), bool)
    to = begin[found.doc] + found.start
    for b in found.seen:
        rows = found.rows(b)
        at = _ranges(to[rows], found.count[rows])
        out[at] = np.unpackbits(np.frombuffer(answers[b], np.uint8), count=len(at)).astype(bool)
    # the answer is for the first document with a segment; in a later one all its
    # windows occur in that, and a repeated row of the first has the same answer
    first = found.first[found.which]
    later = ids[found.doc] > ids[found.doc[first]]
    again = ~later & (first != np.arange(len(first)))
    out[_ranges(to[again], found.count[again])] = out[_ranges(to[first[again]], found.count[again])]
    out[_ranges(to[later], found.count[later])] = True
    return np.split(out, begin[1:]) if len(docs) else []


def covered(mask: np.ndarray, n: int, W: int) -> np.ndarray:
    """Units under a marked window."""
    step = np.zeros(n + 1, np.int32)
    if len(mask):
        step[:len(mask)] += mask
        step[W:W + len(mask)] -= mask
    return np.cumsum(step[:n]) > 0


def remove_repeats(docs: DataFrame, reader, judge, W: int, k: int, finish, schema: str,
                   carry: tuple[str, ...] = (), block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """``reader(text or None)`` gives a document of units with ``seeds`` and
    ``slice``; ``finish(pdf, documents, masks of removed units)`` the result.
    All documents come back, those without a doc_id unchanged."""
    blocks, n = B.blocked(docs, carry, block_bytes)
    n_buckets = n

    def read(pdf):
        pdf = pdf[pdf.doc_id.notna() & pdf.text.notna()]
        ids = [int(x) for x in pdf.doc_id]
        return [reader(x) for x in pdf.text], ids

    def ask1(pdf):
        return _ask_anchors(read(pdf)[0], W, k, n_buckets)

    def ask2(pdf, answers):
        own, ids = read(pdf)
        found = Found(own, W, k, n_buckets, answers)
        return [(b, _pack(ids, found, b)) for b in found.seen]

    def done(pdf, anchors, answers):
        take = (pdf.doc_id.notna() & pdf.text.notna()).to_numpy()
        own, ids = read(pdf)
        masks = marked(own, ids, W, k, n_buckets, anchors, answers)
        gone = iter(covered(m, len(d), W) for m, d in zip(masks, own))
        read_docs = iter(own)
        units, removed = [], []
        for i, text in enumerate(pdf.text):
            u = next(read_docs) if take[i] else reader(text if isinstance(text, str) else "")
            units.append(u)
            removed.append(next(gone) if take[i] else np.zeros(len(u), bool))
        return finish(pdf, units, removed)

    anchors = B.answered(B.asked(blocks, ask1), _answer_anchors)
    answers = B.answered(B.asked(blocks, ask2, anchors), lambda ps: _answer_segments(ps, judge))
    return B.finished(blocks, [anchors, answers], done, schema)
