"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's tokens are runs of ASCII letters and digits (lower case) and bytes above 127; features are
the distinct hashed unigrams, bigrams and pairs with one or two tokens between, so length does not
matter.  FTRL-proximal learns row by row, with a rate of its own for every coordinate, so one task
walks the training rows: at most ``SAMPLE`` labelled rows in hash order, written once and read again in
each of ``ROUNDS`` rounds, which start from the state of the round before.  L1 leaves few weights; only
those that are not zero are broadcast (``DIM`` at most), and every document is scored in one pass without
a shuffle.

Defined results: null or empty text has no features and gets the score of the intercept; rows without
a label or with a null doc_id never train; a doc_id that is labelled twice trains with its larger
label; repeated rows score alike; null ids are not held out; an empty table gives no rows, and without
labels every score is 0.5; texts of any length are read whole.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.llm import rolling as R
from docfields.llm.common import doc_slices, text_bytes, write_table

BITS = 18
DIM = 1 << BITS
SAMPLE, ROUNDS = 24_000, 8
ALPHA, BETA, L1 = 2.0, 1.0, 5.0
CUT = 0.7
_ALNUM = [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[_ALNUM] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_GAPS = (1, 2, 3)


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every feature of a slice, repeats included."""
    st, en, toff = R.word_bounds(data, off, _SEPARATOR)
    if not len(st):
        z = np.zeros(0, np.int64)
        return z, z
    h = R.range_hashes(_LOWER[data], st, en)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(toff))
    docs, codes = [doc], [h]
    for gap in _GAPS:
        ok = np.flatnonzero(doc[gap:] == doc[:-gap])
        docs.append(doc[ok])
        codes.append(R.mix(h[ok] * np.uint64(R.BASE1) + h[ok + gap] + np.uint64(gap)))
    return np.concatenate(docs), (np.concatenate(codes) >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """Per-coordinate FTRL-proximal state; the last coordinate is the intercept (no L1)."""

    def __init__(self, z: np.ndarray, n: np.ndarray):
        self.z, self.n = z, n

    def weights(self, i) -> np.ndarray:
        z = self.z[i]
        l1 = np.where(np.asarray(i) == DIM, 0.0, L1)
        w = (np.sign(z) * l1 - z) / ((BETA + np.sqrt(self.n[i])) / ALPHA)
        return np.where(np.abs(z) > l1, w, 0.0)

    def learn(self, i: np.ndarray, y: int) -> None:
        w = self.weights(i)
        g = sigmoid(w.sum()) - y
        n = self.n[i]
        more = n + g * g
        self.z[i] += g - (np.sqrt(more) - np.sqrt(n)) / ALPHA * w
        self.n[i] = more


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(toxic, feats) of the bounded sample, in hash order."""
    chosen = F.broadcast(labels.where("doc_id is not null and toxic is not null").select(
        F.col("doc_id").cast("long").alias("labelled"), F.col("toxic").cast("int").alias("toxic")).where(
        F.pmod(F.crc32(F.col("labelled").cast("string").cast("binary")), F.lit(3)) != 1).groupBy("labelled").agg(
        F.max("toxic").alias("toxic")).orderBy(F.xxhash64("labelled"), "labelled").limit(SAMPLE))  # SAMPLE rows at most
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = d.join(chosen, d["doc_id"] == chosen["labelled"]).select("doc_id", "toxic", "text")

    def extract(batches):
        for b in batches:
            data, off = text_bytes(b.column("text"))
            for x, y in doc_slices(off, 512 << 10):
                doc, code = features(data[off[x]:off[y]], off[x:y + 1] - off[x])
                pair = np.unique(doc * DIM + code)
                cut = np.searchsorted(pair, np.arange(y - x + 1) * DIM)
                body = (pair % DIM).astype("<i4")
                feats = pa.array([body[a:z].tobytes() for a, z in zip(cut, cut[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(x, y - x), b.column("toxic").slice(x, y - x), feats],
                    names=["doc_id", "toxic", "feats"])
    out = rows.mapInArrow(extract, "doc_id long, toxic int, feats binary")
    place = F.xxhash64("doc_id", "feats")
    return out.withColumn("place", place).repartition(1).sortWithinPartitions("place").select("toxic", "feats")


def train(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """DIM + 1 weights (the last one is the intercept), most of them zero."""
    rows = write_table(training_rows(docs, labels), "toxic-rows")
    sc = docs.sparkSession.sparkContext
    z, n = np.zeros(DIM + 1), np.zeros(DIM + 1)
    for _ in range(ROUNDS):
        state = sc.broadcast((z, n))

        def walk(batches):
            z0, n0 = state.value
            f = Ftrl(z0.copy(), n0.copy())
            for b in batches:
                for y, x in zip(b.column(0).to_pylist(), b.column(1)):
                    f.learn(np.append(np.frombuffer(x.as_py(), "<i4").astype(np.int64), DIM), y)
            i = np.flatnonzero(f.n - n0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.tobytes()], pa.binary()) for x in (i, (f.z - z0)[i], (f.n - n0)[i])], names=["i", "z", "n"])
        for c in rows.coalesce(1).mapInArrow(walk, "i binary, z binary, n binary").collect():  # one row
            i = np.frombuffer(c["i"], np.int64)
            z[i] += np.frombuffer(c["z"])
            n[i] += np.frombuffer(c["n"])
    return Ftrl(z, n).weights(np.arange(DIM + 1))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    learned = train(docs, labels)
    live = np.flatnonzero(learned).astype(np.int32)
    sparse = docs.sparkSession.sparkContext.broadcast((live, learned[live]))

    def score(batches):
        weight = np.zeros(DIM + 1)
        weight[sparse.value[0]] = sparse.value[1]
        for b in batches:
            data, off = text_bytes(b.column("text"))
            total = np.full(b.num_rows, weight[DIM])
            for x, y in doc_slices(off, 512 << 10):
                doc, code = features(data[off[x]:off[y]], off[x:y + 1] - off[x])
                hit = np.flatnonzero(weight[code])
                pair = np.unique(doc[hit] * DIM + code[hit])
                total[x:y] += np.bincount(pair // DIM, weights=weight[pair % DIM], minlength=y - x)
            s = sigmoid(total)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= CUT).astype(np.int32))],
                                             names=["doc_id", "score", "predicted"])
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        score, "doc_id long, score double, predicted int")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")
