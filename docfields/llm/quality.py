"""Quality rules: in-text counts plus a log-likelihood ratio of hashed n-grams.

Two multinomials over ``BUCKETS`` hash buckets of 4-byte n-grams: the *raw* one from all documents,
the *target* one from trusted documents (labelled quality 1), taken from at most ``TRUSTED`` labelled
ids in hash order.  A document's score is the mean log ratio of its n-grams (so length does not
matter), in integer millionths, summed exactly; it is kept if the base rules hold and the score
reaches ``THRESHOLD``.  What reaches the driver is two tables of ``BUCKETS`` counts.

Defined results: null or blank text has no words and fails the base rules; texts under four bytes
score 0; null ids are never trusted; rows that repeat are judged alike; an empty table gives no
rows; texts of any length are read whole; in the filter all columns of ``docs`` pass unchanged.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.llm import rolling as R
from docfields.llm.common import doc_slices, freed, text_bytes

BUCKETS, GRAM, TRUSTED, THRESHOLD, SCALE = 1 << 16, 4, 20_000, -0.2, 1_000_000
MIN_WORDS, MAX_REPEAT_PCT, WINDOW = 20, 30, 8
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_NOT_LF = np.zeros(256, bool)
_NOT_LF[10] = True
SLICE = 512 << 10


def buckets(data: np.ndarray) -> np.ndarray:
    """Bucket of the n-gram that starts at each byte (the last GRAM - 1 bytes start none)."""
    m = len(data) - GRAM + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    d = data.astype(np.uint64)
    g = np.zeros(m, np.uint64)
    for j in range(GRAM):
        g |= d[j:j + m] << np.uint64(8 * j)
    return ((g * np.uint64(R.BASE1)) >> np.uint64(48)).astype(np.int64)


def _starts(off: np.ndarray) -> np.ndarray:
    """Which bytes start an n-gram inside one document."""
    n = int(off[-1])
    ok = np.ones(n + 1, bool)
    for j in range(1, GRAM):
        ok[np.maximum(off[1:] - j, off[:-1])[np.diff(off) > 0]] = False
        short = (np.diff(off) >= j)
        ok[off[1:][short] - j] = False
    return ok[:max(0, n - GRAM + 1)]


def doc_sums(values: np.ndarray, at: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of ``values`` (at ascending positions ``at``) by document."""
    c = np.concatenate([[0], np.cumsum(values)])
    return c[np.searchsorted(at, off[1:])] - c[np.searchsorted(at, off[:-1])]


def _repeats(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For items of equal document and hash: the group id in order and the order."""
    order = np.lexsort((h, doc))
    new = np.ones(len(order), bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (h[order][1:] != h[order][:-1])
    return np.cumsum(new) - 1, order


def base_counts(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each document of a slice."""
    nd = len(off) - 1
    st, en, woff = R.word_bounds(data, off)
    n_words = np.diff(woff)
    inner = ~R.SPACE[data] & ((data & 0xC0) != 0x80)
    chars = np.flatnonzero(inner)
    sym = np.flatnonzero(_IS_SYMBOL[data])
    out = {"n_words": n_words,
           "word_chars": np.searchsorted(chars, off[1:]) - np.searchsorted(chars, off[:-1]),
           "n_symbols": np.searchsorted(sym, off[1:]) - np.searchsorted(sym, off[:-1])}
    # lines: ranges between line feeds that hold a word
    ls, le, loff = R.word_bounds(data, off, _NOT_LF)
    has = np.searchsorted(st, le) > np.searchsorted(st, ls)
    doc = np.repeat(np.arange(nd), np.diff(loff))[has]
    group, _ = _repeats(doc, R.content_hashes(data, ls[has], le[has]))
    distinct = np.zeros(nd, np.int64)
    if len(doc):
        first = np.ones(len(group), bool)
        first[1:] = group[1:] != group[:-1]
        distinct = np.bincount(np.sort(doc)[first], minlength=nd)
    out["n_dup_lines"] = np.bincount(doc, minlength=nd) - distinct
    # words covered by windows that occur twice or more in the document
    covered = np.zeros(nd, np.int64)
    if len(st) >= WINDOW:
        h = R.content_hashes(data, st, en)
        wdoc = np.repeat(np.arange(nd), n_words)
        m = len(st) - WINDOW + 1
        w = np.flatnonzero(wdoc[:m] == wdoc[WINDOW - 1:])
        grams = R.Prefix(h).ranges(w, w + WINDOW)
        group, order = _repeats(wdoc[w], grams)
        twice = w[order[np.bincount(group)[group] > 1]] if len(group) else w
        mark = np.zeros(len(st) + 1, np.int64)
        np.add.at(mark, twice, 1)
        np.add.at(mark, twice + WINDOW, -1)
        hit = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
        covered = np.bincount(wdoc[hit], minlength=nd)
    out["n_repeat_words"] = covered
    return out


def trusted_ids(labels: DataFrame, bound: int = TRUSTED) -> DataFrame:
    """At most ``bound`` labelled ids of quality 1, in hash order."""
    return labels.where("quality = 1 and doc_id is not null").select(
        F.col("doc_id").cast("long").alias("trusted_id")).distinct().orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(bound)


def log_ratios(docs: DataFrame, labels: DataFrame, bound: int = TRUSTED) -> np.ndarray:
    """Integer log ratio (times SCALE) of each bucket; counts cover all documents."""
    def count(batches):
        total = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            data, off = text_bytes(b.column("text"))
            trusted = b.column("trusted").to_numpy(zero_copy_only=False).astype(bool)
            for x, y in doc_slices(off, SLICE):
                o = off[x:y + 1] - off[x]
                ok = _starts(o)
                g = buckets(data[off[x]:off[y]])
                mine = np.repeat(trusted[x:y], np.diff(o))[:len(g)]
                total[0] += np.bincount(g[ok], minlength=BUCKETS)
                total[1] += np.bincount(g[ok & mine], minlength=BUCKETS)
        used = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[0][used]), pa.array(total[1][used])],
                                         names=["bucket", "raw", "target"])
    t = F.broadcast(trusted_ids(labels, bound))  # at most ``bound`` ids
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    d = d.join(t, d["doc_id"] == t["trusted_id"], "left").select("text", F.col("trusted_id").isNotNull().alias("trusted"))
    rows = d.mapInArrow(freed(count), "bucket long, raw long, target long").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    c = np.zeros((2, BUCKETS))
    for r in rows:
        c[:, r["bucket"]] = r["raw"], r["target"]
    raw, target = np.log((c + 1) / (c.sum(axis=1, keepdims=True) + BUCKETS))
    ratio = target - raw if c[1].sum() else np.zeros(BUCKETS)  # nothing trusted: no verdict either way
    return np.rint(ratio * SCALE).astype(np.int64)


def judge(column: pa.Array, ratio: np.ndarray, threshold: float = THRESHOLD) -> dict[str, np.ndarray]:
    """All counts, the score and the verdict of each text of an Arrow column."""
    data, off = text_bytes(column)
    parts = []
    for x, y in doc_slices(off, SLICE):
        d, o = data[off[x]:off[y]], off[x:y + 1] - off[x]
        r = base_counts(d, o)
        ok = np.flatnonzero(_starts(o))
        n = np.searchsorted(ok, o[1:]) - np.searchsorted(ok, o[:-1])
        total = doc_sums(ratio[buckets(d)[ok]], ok, o)
        r["base_failed"] = (r["n_words"] < MIN_WORDS) | (100 * r["n_repeat_words"] > MAX_REPEAT_PCT * r["n_words"])
        r["score"] = total / np.maximum(n, 1) / SCALE
        r["kept"] = ~r["base_failed"] & (total >= np.ceil(threshold * SCALE) * n)
        parts.append(r)
    if not parts:
        return {}
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def quality_verdicts(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document with the counts, base_failed, kept and the score."""
    ratio = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, labels))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]

    def run(batches):
        for b in batches:
            r = judge(b.column("text"), ratio.value, threshold)
            if r:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(r[c]) for c in names)],
                                                 names=["doc_id", *names])
    kinds = ", ".join(f"{c} long" for c in names[:5])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, f"doc_id long, {kinds}, base_failed boolean, kept boolean, score double")


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose verdict is kept, all columns unchanged."""
    ratio = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, labels))

    def run(batches):
        for b in batches:
            r = judge(b.column("text"), ratio.value, threshold)
            if r:
                yield b.filter(pa.array(r["kept"]))
    return docs.mapInArrow(freed(run), docs.schema)  # the text crosses once
