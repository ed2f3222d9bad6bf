"""Cases that cuts by group size, id or step count used to lose."""
import random

import numpy as np
from llm_models import words
from pyspark.sql import functions as F

from docfields.llm import embedding_dedup, mixing, simhash


def test_embeddings_dense_group(spark):
    """Small groups of links in one dense group: a common head of the key, told apart by later bits only."""
    planes = np.random.default_rng([7, 0, 2]).standard_normal((2, 48))
    turn = np.arctan2(planes[1], planes[0])
    cuts = np.concatenate([turn + np.pi / 2, turn - np.pi / 2]) % (2 * np.pi)
    heads = np.sort(np.concatenate([cuts[:20], cuts[48:68]]))
    inner = [np.sort(cuts[(cuts >= a) & (cuts <= z)]) for a, z in zip(heads, heads[1:])]
    edges = max(inner, key=len)
    middle = (edges[1:] + edges[:-1]) / 2
    middle = middle[np.diff(edges) > 2e-3]
    rows = [(6 * i + k, [float(np.cos(m + k * 1e-5)), float(np.sin(m + k * 1e-5))], 1)
            for i, m in enumerate(middle) for k in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = embedding_dedup.embedding_links(df, 1 - 1e-8, passes=1, bits=48, window=8, range_rows=4).collect()
    assert len(middle) > 3
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in got} == {(v, 5, v // 6 * 6) for v, _, _ in rows}


def test_simhash_keeps_rows_by_id_and_text(spark):
    """Unrelated rows without an id, and texts that share an id, stay; near-duplicates go."""
    rng = random.Random(2)
    a, b, c, d, e, f = (" ".join(words(rng, 200, 5_000)) for _ in range(6))
    rows = [(None, a), (None, b), (None, b), (None, c), (1, c), (2, d), (2, e), (2, e), (3, e), (4, f), (5, f), (5, a + " x"),
            (6, a + " x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, simhash.keep_representatives(df).collect()), key=str)
    fp = [simhash.fingerprint(t) for _, t in rows]
    near = (fp[0] ^ fp[-1]).bit_count() <= 4
    want = [(None, b), (1, c), (2, d), (2, e), (4, f), (5, a + " x")] + ([] if near else [(None, a)])
    assert got == sorted(want, key=str)


def test_mixing_reaches_slow_targets(spark):
    """A rare domain whose mass is spread thinly over many documents; targets that no document fits."""
    rng = np.random.default_rng(4)
    odds = np.exp(np.stack([np.zeros(4_000), rng.normal(-7, 1.5, 4_000), rng.normal(-4.5, 1.5, 4_000)], axis=1))
    p = odds / odds.sum(axis=1, keepdims=True)
    n = rng.integers(20, 500, 4_000)
    df = spark.createDataFrame([(int(k), 1, *map(float, q)) for k, q in zip(n, p)],
                               "n_words long, copies long, p_clean double, p_low double, p_toxic double")
    goal = np.array([mixing.TARGETS[k] for k in mixing.DOMAINS])
    rate = np.maximum(0, 1 - p @ mixing.solve_rates(df, mixing.TARGETS))
    assert np.abs((n * rate) @ p / n.sum() - goal).max() < mixing.TOLERANCE
    flat = df.withColumn("p_clean", F.lit(1.0)).withColumn("p_low", F.lit(0.0)).withColumn("p_toxic", F.lit(0.0))
    g = mixing.solve_rates(flat, mixing.TARGETS)
    assert abs(max(0, 1 - g[0]) - 0.9) < 1e-4
