"""Embedding near-dedup by sorted projection passes.

Each pass draws its own random hyperplanes, orders the distinct vectors of a label
lexicographically by the concatenated sign bits, and compares each with the next ``window``
ones; pairs whose cosine reaches the threshold are united across passes.  Direct links are then
counted exactly inside each component, in blocks: a link never leaves its component.

The order is total: by the whole key, equal keys by a hash of node and pass.  It is cut into ranges with
an overlap of ``window`` rows, so one label (or one dense group with a common head of the key) is spread
over many tasks and each vector still meets its ``window`` successors.  Equal vectors are one class with a
multiplicity before any comparison.

Defined results: a null label, a null or zero vector, one with null or non-finite components, or
a row without ``vec_id`` links with nothing (n_links 0, its own component); vectors of different
length never link; repeated rows are vectors of their own; an empty table gives no rows; other
columns are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docfields.llm.common import write_table
from docfields.llm.components import connected_components, np_components
from docfields.llm.simhash import Forest

THRESHOLD, PASSES, BITS, WINDOW = 0.98, 16, 62, 1_024
RANGE_ROWS, RANGES_A_TASK, BLOCK = 4_096, 32, 2_000


def unit_rows(col: pa.Array) -> np.ndarray:
    """Unit vectors in double precision of a list column whose lists have one length."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(col), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def classes(vectors: DataFrame) -> DataFrame:
    """Distinct (label, embedding) of the rows that can link: node (smallest vec_id), copies, dim."""
    e = F.col("embedding")
    good = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    some = F.exists(e, lambda v: v != 0)
    return vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & good & some).groupBy(
        "label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")).withColumn(
        "dim", F.size("embedding"))


def _keys(passes: int, bits: int, seed: int):
    """Sort key of each vector in each pass: the sign bits of its projections."""
    def run(batches):
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                x = unit_rows(part.column("embedding"))
                for p in range(passes):
                    planes = np.random.default_rng([seed, p, int(dim)]).standard_normal((int(dim), bits))
                    sign = x @ planes > 0
                    key = (sign * (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))).sum(axis=1)
                    m = part.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [part.column("label"), part.column("dim"), pa.array(np.full(m, p, np.int32)), pa.array(key),
                         part.column("node")], names=["label", "dim", "pass", "key", "node"])
    return run


def _places(window: int, range_rows: int):
    """A partition of the total order -> range, place in it, and whether the row is among its last ``window``."""
    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        run_of = [t[c].to_numpy() for c in ("label", "dim", "pass")]
        new = np.ones(t.num_rows, bool)
        new[1:] = np.any([r[1:] != r[:-1] for r in run_of], axis=0)
        lo = np.flatnonzero(new)
        size = np.diff(np.append(lo, t.num_rows))
        own = np.repeat(np.arange(len(lo)), size)
        at = np.arange(t.num_rows) - lo[own]
        ranges = np.maximum(1, size // range_rows)  # the last range takes the rest: none is shorter than the window
        k = np.minimum(at // range_rows, ranges[own] - 1)
        stop = np.where(k == ranges[own] - 1, size[own], (k + 1) * range_rows)
        first = np.cumsum(ranges) - ranges
        number = (np.int64(TaskContext.get().partitionId()) << 32) + first[own] + k
        out = pa.Table.from_arrays(
            [t["label"], t["dim"], t["pass"], pa.array(number), pa.array((at - k * range_rows).astype(np.int32)),
             pa.array(stop - at <= window), t["node"]], names=["label", "dim", "pass", "range", "place", "tail", "node"])
        yield from out.to_batches(max_chunksize=10_000)
    return run


def _compare(window: int, threshold: float):
    """Rows sorted by (label, dim, pass, range, place): spanning links of each range."""
    def links(t: pa.Table):
        t = t.combine_chunks()
        run = [t[c].to_numpy() for c in ("label", "dim", "pass", "range")]
        node = t["node"].to_numpy()
        new = np.ones(len(node), bool)
        new[1:] = np.any([r[1:] != r[:-1] for r in run], axis=0)
        seg = np.cumsum(new)
        forest = Forest(len(node))
        dims = run[1]
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            x = unit_rows(t["embedding"].take(pa.array(at)).combine_chunks())
            same = seg[at]
            i = np.flatnonzero(same[1:] == same[:-1])  # neighbours first: a group of copies is one component then
            for c in range(0, len(i), 50_000):
                j = i[c:c + 50_000]
                j = j[np.einsum("ij,ij->i", x[j], x[j + 1]) >= threshold]
                forest.link(at[j], at[j + 1])
            step = min(256, window)
            for c in range(0, len(at), step):
                d = min(len(at), int(np.searchsorted(same, same[min(c + step, len(at)) - 1], side="right")), c + step + window)
                hit = x[c:c + step] @ x[c:d].T >= threshold
                i, j = np.nonzero(hit)
                a, b = at[c + i], at[c + j]
                ok = (j > i) & (j - i <= window) & (forest.label[a] != forest.label[b])
                ok &= seg[a] == seg[b]
                forest.link(a[ok], b[ok])
        i = np.flatnonzero(forest.label != np.arange(len(node)))
        if len(i):
            u, v = np_components(node[i], node[forest.label[i]])  # a spanning forest says as much
            u, v = u[u != v], v[u != v]
            for c in range(0, len(u), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(u[c:c + 100_000]), pa.array(v[c:c + 100_000])],
                                                 names=["u", "v"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= 20_000:
                t = pa.Table.from_batches(held).combine_chunks()
                keys = [t[c].to_numpy() for c in ("label", "dim", "pass", "range")]
                other = np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0))
                cut = int(other[-1]) + 1 if len(other) else 0
                if cut:
                    yield from links(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                n -= cut
        if held and n:
            yield from links(pa.Table.from_batches(held))
    return run


def _degrees(threshold: float):
    """Rows sorted by block pair: for each vector of the first chunk, the copies it links to in the second."""
    def count(t: pa.Table):
        t = t.combine_chunks()
        x = unit_rows(t["embedding"].combine_chunks() if t["embedding"].num_chunks == 1 else
                      pa.concat_arrays(t["embedding"].chunks))
        side, node, copies = t["side"].to_numpy(), t["node"].to_numpy(), t["copies"].to_numpy()
        a, b = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
        out = np.zeros(len(a), np.int64)
        for c in range(0, len(a), 500):
            hit = x[a[c:c + 500]] @ x[b].T >= threshold
            hit &= node[a[c:c + 500]][:, None] != node[b][None, :]
            out[c:c + 500] = hit @ copies[b]
        return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(out)], names=["node", "links"])

    def run(batches):
        held, key = [], None
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in ("component", "label", "dim", "ci", "cj")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                now = tuple(keys[:, s])
                if key is not None and now != key:
                    yield count(pa.Table.from_batches(held))
                    held = []
                key = now
                held.append(b.slice(s, e - s))
        if held:
            yield count(pa.Table.from_batches(held))
    return run


def embedding_links(vectors: DataFrame, threshold: float = THRESHOLD, passes: int = PASSES, bits: int = BITS,
                    window: int = WINDOW, seed: int = 7, range_rows: int = RANGE_ROWS) -> DataFrame:
    """vectors (vec_id, embedding, label) -> (vec_id, n_links, component_id, kept), one row per vector."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding",
                       F.col("label").cast("long").alias("label"))
    cls = write_table(classes(v), "vector-classes")
    # Only ids and keys are ordered; the vectors are joined to their places afterwards.
    slim = write_table(cls.select("label", "dim", "node", "embedding").mapInArrow(
        _keys(passes, bits, seed), "label long, dim int, pass int, key long, node long"), "vector-keys")
    range_rows = max(range_rows, window)
    tasks = max(1, -(-slim.count() // (range_rows * RANGES_A_TASK)))
    order = ["label", "dim", "pass", "key", F.xxhash64("pass", "node"), "node"]
    placed = write_table(slim.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(
        _places(window, range_rows),
        "label long, dim int, pass int, range long, place int, tail boolean, node long"), "vector-places")
    # The last ``window`` rows of a range are compared with the next range too.
    ranges = placed.select("label", "dim", "pass", "range").distinct().withColumn(
        "next", F.lead("range").over(Window.partitionBy("label", "dim", "pass").orderBy("range")))
    spread = placed.join(ranges, ["label", "dim", "pass", "range"]).withColumn("to", F.explode(F.when(
        F.col("tail") & F.col("next").isNotNull(), F.array("range", "next")).otherwise(F.array("range"))))
    first = (F.col("to") == F.col("range")).cast("int").alias("turn")  # rows of the range before come first
    rows = spread.select("label", "dim", "pass", F.col("to").alias("range"), first, "place", "node").join(
        cls.select("label", "dim", "node", "embedding"), ["label", "dim", "node"])
    edges = rows.repartition("label", "dim", "pass", "range").sortWithinPartitions(
        "label", "dim", "pass", "range", "turn", "place").mapInArrow(_compare(window, threshold), "u long, v long")
    comp = write_table(connected_components(edges, "vectors"), "vector-components")
    member = cls.join(comp, "node")
    size = write_table(comp.groupBy("component").agg(F.count("*").alias("m")), "vector-sizes")
    chunks = F.ceil(F.col("m") / BLOCK).cast("long")
    dealt = member.join(size, "component").withColumn("s", chunks).withColumn(
        "c", F.pmod(F.xxhash64("node"), "s"))
    other = F.sequence(F.lit(0).cast("long"), F.col("s") - 1)
    blocks = dealt.withColumn("pair", F.explode(F.flatten(F.transform(other, lambda o: F.when(
        o == F.col("c"), F.array(F.struct(F.col("c").alias("ci"), F.col("c").alias("cj"), F.lit(0).alias("side")))).otherwise(
        F.array(F.struct(F.col("c").alias("ci"), o.alias("cj"), F.lit(1).alias("side")),
                F.struct(o.alias("ci"), F.col("c").alias("cj"), F.lit(2).alias("side")))))))).select(
        "component", "label", "dim", "pair.ci", "pair.cj", "pair.side", "node", "copies", "embedding")
    degree = blocks.repartition("component", "label", "dim", "ci", "cj").sortWithinPartitions(
        "component", "label", "dim", "ci", "cj").mapInArrow(
        _degrees(threshold), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    info = cls.select("label", "embedding", "node", "copies").join(comp, "node", "left").join(degree, "node", "left")
    out = v.join(info, ["label", "embedding"], "left")
    mine = F.col("vec_id").isNotNull() & F.col("node").isNotNull()
    comp_id = F.when(mine, F.coalesce("component", "node")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(mine, F.col("copies") - 1 + F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast(
        "long").alias("n_links"), comp_id.alias("component_id"),
        F.coalesce(F.col("vec_id") == comp_id, F.lit(False)).alias("kept"))
