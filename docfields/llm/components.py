"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is two grouped minima and two equi-joins.  The minima are written before
they are joined, so a node with very many neighbours is pre-aggregated and AQE can
split its rows; rounds grow with the logarithm of the longest path.  Edges never reach the driver.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.llm.common import write_table

EDGE = "u long, v long"


def np_components(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node reachable from each, for edges held in memory."""
    nodes, inv = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = inv[:len(u)], inv[len(u):]
    lab = np.arange(len(nodes))
    while True:
        m = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, lab[a], m)
        np.minimum.at(new, lab[b], m)
        while True:
            nxt = new[new]
            if np.array_equal(nxt, new):
                break
            new = nxt
        if np.array_equal(new, lab):
            return nodes, nodes[lab]
        lab = new


def _contract(batches):
    """Replace the edges of a partition by stars with the same components."""
    u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in batches:
        u = np.concatenate([u, b.column(0).to_numpy()])
        v = np.concatenate([v, b.column(1).to_numpy()])
        if len(u) > 500_000:
            u, v = np_components(u, v)
            u, v = u[u != v], v[u != v]
    if len(u):
        u, v = np_components(u, v)
        for i in range(0, len(u), 100_000):
            x, y = u[i:i + 100_000], v[i:i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(x[x != y]), pa.array(y[x != y])], names=["u", "v"])


def connected_components(edges: DataFrame, tag: str) -> DataFrame:
    """edges (u long, v long) -> (node, component): the smallest node reachable, for every node
    that has an edge to another node.  Self links, repeated links and an empty table are allowed;
    rows with a null end are ignored."""
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(
        F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    e = write_table(e.mapInArrow(_contract, EDGE), f"{tag}-edges")
    before = None
    while True:
        both = e.union(e.select("v", "u")).toDF("u", "v")
        low = write_table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")),
                          f"{tag}-low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(
            "u != v").distinct()
        large = write_table(large, f"{tag}-large")
        low2 = write_table(large.groupBy("u").agg(F.min("v").alias("m")), f"{tag}-low2")
        small = large.join(low2, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m")), F.struct(F.col("v").alias("u"), F.col("m")))).alias("s")).select(
            F.col("s.u").alias("u"), F.col("s.m").alias("v")).where("u != v").distinct()
        e = write_table(small, f"{tag}-round")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
