"""Whitening of embeddings: distributed centred covariance, broadcast projection.

Each entry c becomes the integer x = floor(1024 c) + 100000, so counts, sums and deviations are exact.
Spark sums x by dimension; a second pass centres each vector by that mean and sums the products of
every pair of dimensions, task by task, then by pair.  Only that dim x dim matrix reaches the driver, where
``eigen`` finds the leading components; they are broadcast (components x dim doubles) and every vector
is projected in one pass.  The covariance of the result is measured afterwards with ``covar_pop``.

Defined results: vectors that are null or empty, hold null or non-finite entries, or have another
length than the most common one (the longer at a tie) are dropped; entries beyond +-2^43 count as that
bound; a null ``vec_id`` is a row like any other; repeated rows count and appear as often as they
occur; components whose eigenvalue is zero to working precision are left out, so equal vectors give
no rows; an empty table gives no rows; other columns are not read.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.llm import eigen
from docfields.llm.common import write_table

SCALE, SHIFT, LIMIT = 1024.0, 100_000, float(1 << 53)
COMPONENTS = 8
#: Eigenvalues below this part of the largest one count as zero.
ZERO = 1e-12
ROWS = 4096


@dataclass
class Whitening:
    """n vectors, exact sums by dimension, falling eigenvalues, unit components (rows), trace of the covariance."""
    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """Rows (vec_id, embedding) that can be whitened, and the length of their vectors."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(
        F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", bad))
    size = F.size("embedding")
    top = v.groupBy(size.alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = top["dim"] if top else 0
    return v.where(size == dim), dim


def _integers(column: pa.Array, dim: int) -> np.ndarray:
    c = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return np.clip(np.floor(SCALE * c), -LIMIT, LIMIT).astype(np.int64) + SHIFT


def _slices(batches, dim: int):
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            part = b.slice(at, ROWS)
            yield part, _integers(part.column("embedding"), dim)


def fit(v: DataFrame, dim: int, k: int = COMPONENTS) -> Whitening:
    """Two passes over the vectors: exact sums, then centred products."""
    def sums(batches):
        n, low, high = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for _, x in _slices(batches, dim):  # two halves: no sum of a task leaves 64 bits
            n += len(x)
            low += (x & 0xFFFFFFFF).sum(axis=0)
            high += (x >> 32).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array([n] * dim, pa.int64()),
                                          pa.array(low), pa.array(high)], names=["i", "n", "low", "high"])
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    by_dim = v.select("embedding").mapInArrow(sums, "i int, n long, low long, high long").groupBy("i").agg(
        F.sum("n").alias("n"), wide("low"), wide("high")).orderBy("i").collect()  # dim rows
    if not by_dim or not by_dim[0]["n"]:
        return Whitening(0, [], np.zeros(0), np.zeros((0, dim)), 0.0)
    n = by_dim[0]["n"]
    total = [int(r["high"]) * (1 << 32) + int(r["low"]) for r in by_dim]
    whole, rest = zip(*(divmod(s, n) for s in total))
    at, part = np.array(whole, np.int64), np.array([r / n for r in rest])
    upper = np.triu_indices(dim)

    def products(batches):
        m = np.zeros((dim, dim))
        for _, x in _slices(batches, dim):
            y = (x - at) - part  # the whole part of the mean leaves exactly
            m += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)),
                                          pa.array(m[upper])], names=["i", "j", "p"])
    pairs = v.select("embedding").mapInArrow(products, "i int, j int, p double").groupBy("i", "j").agg(
        F.sum("p").alias("p")).collect()  # dim * (dim + 1) / 2 rows
    cov = np.zeros((dim, dim))
    for r in pairs:
        cov[r["i"], r["j"]] = cov[r["j"], r["i"]] = r["p"] / n
    values, components = eigen.leading(cov, k)
    real = values > max(ZERO * values[0], 0.0)
    return Whitening(n, total, values[real], components[real], float(np.trace(cov)))


def project(v: DataFrame, dim: int, w: Whitening) -> DataFrame:
    """(vec_id, deviation decimal(38,0), w1, w2, ...): exact squared distance to the mean times n^2, whitened values."""
    names = [f"w{i + 1}" for i in range(len(w.values))]
    shared = v.sparkSession.sparkContext.broadcast(
        (w.n, w.sums, (w.components / np.sqrt(w.values)[:, None]).T if len(w.values) else np.zeros((dim, 0))))

    def run(batches):
        n, sums, matrix = shared.value
        peak = max(map(abs, sums), default=0) // max(n, 1) + 1
        for b, x in _slices(batches, dim):
            top = max(abs(int(x.max())), abs(int(x.min())))
            d = x * n - np.array(sums, np.int64) if (top + peak) * n < 1 << 62 else None
            if d is not None and dim * max(int(d.max()), -int(d.min())) ** 2 < 1 << 63:
                dev = pa.array((d * d).sum(axis=1)).cast(pa.decimal128(38, 0))
                y = d / n
            else:  # Python integers: exact at any size
                d = x.astype(object) * n - np.array(sums, object)
                y = (d / n).astype(float)
                big = [int(t) for t in (d * d).sum(axis=1)]
                dev = pa.array([t if t < 10 ** 38 else None for t in big], pa.decimal128(38, 0))
            z = y @ matrix
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), dev, *(pa.array(c) for c in np.ascontiguousarray(z.T))],
                                             names=["vec_id", "deviation", *names])
    kind = v.schema["vec_id"].dataType.simpleString()
    return v.mapInArrow(run, ", ".join([f"vec_id {kind}", "deviation decimal(38,0)", *(f"{c} double" for c in names)]))


def identity_error(white: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of w1..wk minus the identity."""
    pairs = [(i, j) for i in range(1, k + 1) for j in range(1, i + 1)]
    row = white.agg(*[F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs]).first()
    return max(abs((c or 0.0) - (i == j)) for (i, j), c in zip(pairs, row))


def whiten(vectors: DataFrame, k: int = COMPONENTS) -> tuple[DataFrame, Whitening, float]:
    """vectors (vec_id, embedding) -> whitened rows of ``project`` (written), the fit and its identity error."""
    v, dim = usable(vectors)
    w = fit(v, dim, k)
    white = write_table(project(v, dim, w), "whitened")
    return white, w, identity_error(white, len(w.values)) if len(w.values) else 0.0


def whitened_components(vectors: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation (null beyond a long), whitened,
    explained, identity_error."""
    white, w, error = whiten(vectors, k)
    if not len(w.values):
        none = white.limit(0)
        return none.select("vec_id", F.lit(1).alias("component"), F.lit(0).cast("long").alias("n"),
                           F.col("deviation").cast("long").alias("deviation"), F.lit(0.0).alias("whitened"),
                           F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error"))
    each = F.explode(F.array(*[
        F.struct(F.lit(i + 1).alias("component"), F.col(f"w{i + 1}").alias("whitened"),
                 F.lit(float(e / w.trace)).alias("explained")) for i, e in enumerate(w.values)]))
    out = white.select("vec_id", "deviation", each.alias("c"))
    return out.select("vec_id", "c.component", F.lit(w.n).cast("long").alias("n"),
                      F.expr("try_cast(deviation AS bigint)").alias("deviation"), "c.whitened", "c.explained",
                      F.lit(error).alias("identity_error"))
