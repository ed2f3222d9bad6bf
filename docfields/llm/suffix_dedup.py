"""Byte-level dedup with blockwise suffix sorting by a difference cover.

A block of text is held by one task at a time: the suffixes of a bucket are sorted by their
first 32 bytes; longer ties are resolved by the ranks of a precomputed sample.  The sample
holds the positions p with p mod 31 in a perfect difference set D, so for any two suffixes
i, j there is one d < 31 with both i + d and j + d in the sample; their order is then the
order of those two ranks.  Sample ranks come from doubling (32, 62, 124, ... bytes) and stop
once they cover the threshold.  Memory is bounded by the block, not by the corpus.

Blocks are formed by ``repeats``: a suffix can only share ``n`` bytes with suffixes whose
window selects the same winnowed anchor, so that anchor names its bucket, and buckets with
one distinct extent need no sort.  This loses no repeat and keeps the shuffle small.

Defined results: null text = empty, nothing removed; a null ``doc_id`` is a row like any other;
rows that repeat id and text are copies of each other; texts of any length are cut into
overlapping parts; an empty table gives no rows; other columns are carried along in a struct.
"""
from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docfields.llm.common import freed, with_text
from docfields.llm.repeats import repeated_spans, spans_of, with_spans

N_BYTES, ANCHOR_BYTES = 400, 100
#: A perfect difference set modulo 31.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
_IN = np.zeros(PERIOD, bool)
_IN[list(COVER)] = True
#: Bit d of entry a: a + d lies in the cover.
_SHIFTS = np.array([sum(1 << d for d in range(PERIOD) if _IN[(a + d) % PERIOD]) for a in range(PERIOD)], np.int64)
PREFIX = 32


def _dense(keys: tuple[np.ndarray, ...], order: np.ndarray) -> np.ndarray:
    """Rank of each item, equal keys alike; ``order`` sorts the items by ``keys``."""
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def _heads(text: np.ndarray) -> np.ndarray:
    """Big-endian 64-bit word that starts at each byte (zero behind the end)."""
    t = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    w = np.zeros(len(text), np.uint64)
    for j in range(8):
        w |= t[j:j + len(text)] << np.uint64(56 - 8 * j)
    return np.concatenate([w, np.zeros(PREFIX, np.uint64)])


def sample_ranks(text: np.ndarray, heads: np.ndarray, depth: int) -> np.ndarray:
    """Rank of every sample position (by at least its first ``depth`` bytes), -1 elsewhere."""
    p = np.flatnonzero(_IN[np.arange(len(text)) % PERIOD])
    full = np.full(len(text) + PERIOD * 32, -1, np.int64)
    if not len(p):
        return full
    words = tuple(heads[p + 8 * j] for j in range(PREFIX // 8))
    rank = _dense(words, np.lexsort(words[::-1]))
    reach = PREFIX - 1
    while reach < depth and int(rank.max()) < len(p) - 1:
        full[p] = rank
        nxt = np.minimum(p + reach, len(full) - 1)
        key = rank * (len(p) + 2) + full[nxt] + 1
        rank = _dense((key,), np.argsort(key, kind="stable"))
        reach *= 2
    full[p] = rank
    return full


def sort_block(text: np.ndarray, pos: np.ndarray, bucket: np.ndarray, n: int):
    """Sort the suffixes ``pos`` of a block by (bucket, content) and group those that share their
    first ``n`` bytes.  Returns (group ids, order of ``pos``): neighbours in the order with the same
    id have a common prefix of ``n`` bytes or more."""
    heads = _heads(text)
    w = tuple(heads[pos + 8 * j] for j in range(PREFIX // 8))
    order = np.lexsort((*w[::-1], bucket))
    tie = _dense((bucket, *w), order)[order]
    size = np.bincount(tie)
    long = np.flatnonzero(size[tie] > 1)
    if len(long) == 0:
        return np.arange(len(pos)), order
    rank = sample_ranks(text, heads, n)
    item = order[long]
    group = tie[long]
    first = np.ones(len(group), bool)
    first[1:] = group[1:] != group[:-1]
    at = np.flatnonzero(first)
    common = np.bitwise_and.reduceat(_SHIFTS[pos[item] % PERIOD], at)
    low = common & -common  # lowest shift that leads every member into the sample
    shift = np.where(common > 0, np.log2(np.maximum(low, 1)).astype(np.int64), 0)
    g = np.cumsum(first) - 1
    key = rank[pos[item] + shift[g]]
    item = item[np.lexsort((key, g))]
    for x in np.flatnonzero(common == 0):  # three phases or more without a common shift: compare pairwise
        a, z = at[x], at[x + 1] if x + 1 < len(at) else len(item)
        item[a:z] = sorted(item[a:z].tolist(), key=functools.cmp_to_key(lambda i, j: _compare(pos[i], pos[j], rank)))
    order = order.copy()
    order[long] = item
    same = np.zeros(len(pos), bool)
    nxt = np.flatnonzero(tie[1:] == tie[:-1])
    step = max(1, (8 << 20) // n)
    rows = np.lib.stride_tricks.sliding_window_view(text, n)
    for c in range(0, len(nxt), step):
        j = nxt[c:c + step]
        same[j + 1] = (rows[pos[order[j]]] == rows[pos[order[j + 1]]]).all(axis=1)
    return np.cumsum(~same) - 1, order


def _compare(i: int, j: int, rank: np.ndarray) -> int:
    both = int(_SHIFTS[i % PERIOD] & _SHIFTS[j % PERIOD])
    d = (both & -both).bit_length() - 1
    return int(rank[i + d] - rank[j + d])


def _sorted(x, bucket: np.ndarray, n: int):
    return sort_block(x.sym, x.pos, bucket[x.row], n)


def repeated_byte_spans(docs: DataFrame, n: int = N_BYTES, k: int | None = None) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, tkey, spans of byte positions)."""
    return repeated_spans(docs, n, k or max(1, n // 4), False, _sorted, "suffix")


def kept_bytes(raw: bytes, lo: np.ndarray, hi: np.ndarray) -> bytes:
    if not len(lo):
        return raw
    cuts = [0, *np.stack([lo, hi], 1).ravel().tolist(), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2]))


def _digest(batches):
    for b in batches:
        text, spans = b.column("text"), b.column("spans")
        size, removed, runs, sha = [], [], [], []
        for i in range(b.num_rows):
            raw = text[i].as_py().encode()
            lo, hi = spans_of(spans, i)
            kept = kept_bytes(raw, lo, hi)
            size.append(len(raw))
            removed.append(len(raw) - len(kept))
            runs.append(len(lo))
            sha.append(hashlib.sha256(kept).hexdigest())
        whole = [pa.array(x, pa.int64()) for x in (size, removed, runs)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *whole, pa.array(sha, pa.string())],
                                         names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def suffix_digest(docs: DataFrame, n: int = N_BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = with_spans(docs.select("doc_id", "text"), repeated_byte_spans(docs, n))
    return rows.select("doc_id", "text", "spans").mapInArrow(
        freed(_digest), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeated_bytes(docs: DataFrame, n: int = N_BYTES) -> DataFrame:
    """docs with the repeated bytes taken out of ``text``; a character of which a part went goes too."""
    def run(batches):
        for b in batches:
            out = []
            for i in range(b.num_rows):
                lo, hi = spans_of(b.column("spans"), i)
                t = b.column("text")[i].as_py()
                out.append(kept_bytes(t.encode(), lo, hi).decode("utf-8", "ignore") if len(lo) else t)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(out, pa.string())], names=["row", "new_text"])
    rows = with_spans(docs, repeated_byte_spans(docs, n))
    out = rows.select("row", "text", "spans").mapInArrow(
        freed(run), f"row {rows.schema['row'].dataType.simpleString()}, new_text string")
    return with_text(out, docs.columns, "row", "new_text")
