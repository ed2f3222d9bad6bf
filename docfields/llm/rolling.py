"""Vectorised word hashing, polynomial prefix hashes and winnowing over flat symbol arrays.

A text is a run of 64-bit symbols (bytes, or hashes of words).  A *window* is
``n`` consecutive symbols of one document.  Each window selects one *anchor*: the
``k``-gram with the smallest hash inside it, the last one among equals.  Equal
windows select the same anchor at the same place, so a repeat of ``n`` symbols
always shares an anchor.  The windows that select the same anchor position form an
*extent*; windows of one extent are all different.
"""
from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
BASE1, BASE2 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}
POS_BITS = 18
CHUNK = 1 << POS_BITS
POS_MASK = U(CHUNK - 1)


def _powers(base: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POW.get(base)
    if have is None or len(have[0]) < m:
        m = max(m, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(m, b, U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _POW[base] = (out[0], out[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(31))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(29)
    h *= U(0x94D049BB133111EB)
    return h ^ (h >> U(32))


class Prefix:
    """Hash of any range of ``sym`` in constant time."""

    def __init__(self, sym: np.ndarray, base: int = BASE1):
        m = len(sym)
        pw, self.inv = _powers(base, m + 1)
        self.sum = np.zeros(m + 1, U)
        np.cumsum(sym * pw[:m], out=self.sum[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sum[end] - self.sum[start]) * self.inv[start])

    def grams(self, k: int) -> np.ndarray:
        m = len(self.sum) - k
        return mix((self.sum[k:] - self.sum[:-k]) * self.inv[:m])


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(data: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE):
    """Starts and ends (byte positions) of the words, and word offsets by document."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inner = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    first = inner.copy()
    first[1:] &= ~inner[:-1] | edge[1:-1]
    last = inner
    last[:-1] &= ~(last[1:].copy()) | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int = CHUNK) -> np.ndarray:
    """64-bit hash of each byte range; ranges ascend.  Works through blocks of about ``limit`` bytes."""
    out = np.empty(len(starts), U)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + limit, side="right")))
        lo = starts[a]
        p = Prefix(data[lo:ends[b - 1]].astype(U) + U(1))
        out[a:b] = p.ranges(starts[a:b] - lo, ends[a:b] - lo)
        a = b
    return out


LONG = 64


def content_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each range.  Ranges of up to ``LONG`` bytes are mixed eight bytes at a
    time, each step a bijection of the state and of the bytes (so no two ranges of one length up to eight
    collide, and nothing is linear in the bytes); longer ones go through xxh3."""
    size = ends - starts
    h = mix(size.astype(U) + U(BASE1))
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    at, left = np.arange(len(starts)), size
    for i in range(LONG // 8):
        if not len(at):
            break
        part = eight[starts[at] + 8 * i].view("<u8")[:, 0] if len(at) else np.zeros(0, U)
        part &= U(2**64 - 1) >> (U(64) - U(8) * np.clip(left, 1, 8).astype(U))
        h[at] = mix((h[at] ^ part) * U(BASE2) + U(i))
        more = left > 8
        at, left = at[more], left[more] - 8
    for i in at:
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i]:ends[i]].tobytes())
    return h


def symbol_chunks(off: np.ndarray, n: int, limit: int = CHUNK):
    """(lo, hi) ranges of the flat symbols: whole documents, or overlapping parts of one long
    document (overlap n - 1, so that each window lies in exactly one part)."""
    for a, b in _doc_groups(off, limit):
        lo, hi = int(off[a]), int(off[b])
        if hi - lo <= limit:
            yield lo, hi
            continue
        while True:
            yield lo, min(lo + limit, hi)
            if lo + limit >= hi:
                break
            lo += limit - n + 1


def _doc_groups(off: np.ndarray, limit: int):
    n, a = len(off) - 1, 0
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1))
        yield a, b
        a = b


def sliding_min(key: np.ndarray, w: int) -> np.ndarray:
    pad = -len(key) % w
    g = np.concatenate([key, np.full(pad, U(2**64 - 1))]).reshape(-1, w)
    left = np.minimum.accumulate(g, axis=1).ravel()
    right = np.minimum.accumulate(g[:, ::-1], axis=1)[:, ::-1].ravel()
    m = len(key) - w + 1
    return np.minimum(right[:m], left[w - 1:w - 1 + m])


def extents(sym: np.ndarray, off: np.ndarray, n: int, k: int, chunk: int = CHUNK):
    """All extents of a batch: (document, start, windows, anchor distance, anchor hash, extent hash).

    ``start`` counts symbols of the document; the extent covers symbols
    [start, start + windows - 1 + n)."""
    parts = []
    w = n - k + 1
    for lo, hi in symbol_chunks(off, n, chunk):
        m = hi - lo
        if m < n:
            continue
        s = sym[lo:hi].astype(U)
        g = Prefix(s).grams(k)
        key = (g & ~POS_MASK) | (POS_MASK - np.arange(len(g), dtype=U))
        at = (POS_MASK - (sliding_min(key, w) & POS_MASK)).astype(np.int64)
        nw = m - n + 1
        d0 = int(np.searchsorted(off, lo, side="right")) - 1
        d1 = int(np.searchsorted(off, hi, side="left"))
        edges = np.clip(off[d0:d1 + 1], lo, hi) - lo
        doc = np.repeat(np.arange(d0, d1), np.diff(edges))
        ok = doc[:nw] == doc[n - 1:]
        new = np.ones(nw, bool)
        new[1:] = (at[1:] != at[:-1]) | ~ok[:-1]
        end = np.ones(nw, bool)
        end[:-1] = new[1:] | ~ok[1:]
        st, en = np.flatnonzero(new & ok), np.flatnonzero(end & ok)
        if len(st) == 0:
            continue
        p2 = Prefix(s, BASE2)
        rel = (at[st] - st).astype(U) * U(BASE1) + (en - st).astype(U)
        eh = mix(p2.ranges(st, en + n) ^ rel)
        dd = doc[st]
        parts.append((dd, st + lo - off[dd], en - st + 1, at[st] - st, g[at[st]], eh))
    if not parts:
        z = np.zeros(0, np.int64)
        return z, z, z, z, np.zeros(0, U), np.zeros(0, U)
    return tuple(np.concatenate(x) for x in zip(*parts))


def merge_spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted disjoint union of [lo, hi) spans; touching spans join."""
    if len(lo) == 0:
        return lo, hi
    o = np.argsort(lo, kind="stable")
    lo, hi = lo[o], np.maximum.accumulate(hi[o])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    at = np.flatnonzero(new)
    return lo[at], hi[np.append(at[1:], len(lo)) - 1]
