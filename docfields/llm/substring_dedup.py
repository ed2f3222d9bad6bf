"""Substring dedup on words: seed and extend.

Documents meet on winnowed anchors (``repeats``).  The occurrences of an anchor are aligned at it and
extended: their right sides are sorted outward from the anchor, word by word, and so are their left sides;
the words that neighbours in such an order share (their common prefix) say how far any two occurrences
agree on that side.  A stretch of ``n`` words around the anchor is a repeat if another occurrence agrees
far enough on both sides; neighbouring stretches join to the maximal repeats, which are kept.  Every
repeat of ``n`` words holds a shared anchor, so none is lost.  (Extents that are equal as a whole, and the
anchors that ``repeats`` calls hot, are settled by hashes instead.)  A word stands for its xxh3 hash.

Defined results: null or blank text = no words, nothing removed; a null ``doc_id`` is a row
like any other; rows that repeat id and text are copies of each other (all their windows
repeat); a text of any length is worked through in overlapping parts; an empty table gives
no rows; further columns of ``docs`` are carried in a struct, so their names never clash.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docfields.llm.common import freed, with_text
from docfields.llm.repeats import repeated_spans, spans_of, with_spans

N_WORDS, ANCHOR_WORDS = 35, 11


def _side(sym: np.ndarray, edge: np.ndarray, size: np.ndarray, step: int, depth: int, bucket: np.ndarray) -> np.ndarray:
    """Class of each occurrence at each depth: at depth d, occurrences of one bucket have the same class if their
    first d words outward from ``edge`` agree.  Words behind the end of an occurrence count as 0."""
    reach = np.arange(depth)
    inside = reach < size[:, None]
    words = sym[np.where(inside, edge[:, None] + step * reach, 0)] * inside
    order = np.lexsort((*words.T[::-1], bucket))
    w, b = words[order], bucket[order]
    agree = np.concatenate([w[1:] == w[:-1], np.zeros((len(w) - 1, 1), bool)], axis=1)
    common = np.where(b[1:] == b[:-1], agree.argmin(axis=1), -1)  # words shared with the neighbour before
    cls = np.zeros((len(w), depth + 1), np.int64)
    cls[order[1:]] = np.cumsum(common[:, None] < np.arange(depth + 1), axis=0)
    return cls


def extend(x, bucket: np.ndarray, n: int):
    """Extend the occurrences of each bucket's anchor to both sides.  Returns the class of every stretch of
    ``n`` words (windows of the extents ``x``) and the order of the windows by class."""
    depth = int(max(x.rel.max(), (x.cnt - 1 + n - x.rel - x.k).max(), 0))
    anchor, total = x.first + x.rel, x.cnt - 1 + n
    left = _side(x.sym, anchor - 1, x.rel, -1, depth, bucket)
    right = _side(x.sym, anchor + x.k, total - x.rel - x.k, 1, depth, bucket)
    away = x.rel[x.row] - x.i  # words of the window before the anchor
    a, b = left[x.row, away], right[x.row, n - x.k - away]
    order = np.lexsort((b, a, away))
    new = np.zeros(len(order), np.int64)
    for key in (away, a, b):
        new[1:] |= key[order][1:] != key[order][:-1]
    return np.cumsum(new), order


def repeated_word_spans(docs: DataFrame, n: int = N_WORDS, k: int | None = None) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, tkey, spans of word numbers)."""
    return repeated_spans(docs, n, k or max(1, n // 3), True, extend, "substring")


def kept_words(text: str, lo: np.ndarray, hi: np.ndarray) -> tuple[list[bytes], int]:
    """Words left after the removal of the (disjoint, sorted) spans, and the number of words before."""
    words = (text or "").encode().split()
    if not len(lo):
        return words, len(words)
    kept, at = [], 0
    for a, b in zip(lo.tolist(), hi.tolist()):
        kept += words[at:a]
        at = b
    return kept + words[at:], len(words)


def _digest(batches):
    for b in batches:
        text, spans = b.column("text"), b.column("spans")
        total, removed, sha = [], [], []
        for i in range(b.num_rows):
            lo, hi = spans_of(spans, i)
            kept, n = kept_words(text[i].as_py(), lo, hi)
            total.append(n)
            removed.append(n - len(kept))
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def substring_digest(docs: DataFrame, n: int = N_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    rows = with_spans(docs.select("doc_id", "text"), repeated_word_spans(docs, n))
    return rows.select("doc_id", "text", "spans").mapInArrow(
        freed(_digest), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeated_words(docs: DataFrame, n: int = N_WORDS) -> DataFrame:
    """docs with the repeated words taken out of ``text`` (words joined by one space where cut)."""
    def run(batches):
        for b in batches:
            out = []
            for i in range(b.num_rows):
                lo, hi = spans_of(b.column("spans"), i)
                t = b.column("text")[i].as_py()
                out.append(b" ".join(kept_words(t, lo, hi)[0]).decode() if len(lo) else t)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(out, pa.string())], names=["row", "new_text"])
    rows = with_spans(docs, repeated_word_spans(docs, n))
    out = rows.select("row", "text", "spans").mapInArrow(
        freed(run), f"row {rows.schema['row'].dataType.simpleString()}, new_text string")
    return with_text(out, docs.columns, "row", "new_text")
