"""U3 fuzzy de-duplication of reference lists, and of whole tables of references.

similarity(a, b) = 100 * 2 * LCS(a, b) / (len a + len b)  (100 when both are empty),
computed with a bit-parallel LCS (one machine-word-style big-int step per
character).  Greedy rule: if more than one entry, sort by length descending
(stable) and keep an entry unless it is >= threshold similar to one already kept.

No built-in Spark expression computes an LCS ratio (``levenshtein`` counts
substitutions), so this runs as an Arrow-batched pandas UDF over the lists,
which are per-field and small.

The corpus form (``fuzzy_dedupe_table``) keeps no list in one row.  Distinct references of a scope meet by an
equi-join on their rarest grams (prefix filter), pairs within the length bound are measured, a batch at
a time in numpy, and the greedy rule is settled in rounds over the similar pairs alone.
"""
from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from docfields.session import cut_lineage


def lcs_len(a: str, b: str) -> int:
    if not a or not b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, ch in enumerate(b):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(b)) - 1
    s = full
    for ch in a:
        m = masks.get(ch, 0)
        u = s & m
        s = ((s + u) | (s - u)) & full
    return len(b) - bin(s).count("1")


def similarity(a: str, b: str) -> float:
    n = len(a) + len(b)
    if n == 0:
        return 100.0
    return 100.0 * 2 * lcs_len(a, b) / n


def fuzzy_dedupe(refs: list[str], threshold: float = 85) -> list[str]:
    """Longest first, every entry that resembles no entry kept before it."""
    if len(refs) < 2:
        return list(refs)
    # the ratio cannot reach the threshold if the shorter text is below this share of the longer one
    share = threshold / (200 - threshold)

    def resembles(short: str, kept: list[str]) -> bool:
        return any(similarity(short, k) >= threshold for k in kept if len(short) >= share * len(k))
    return reduce(lambda kept, r: kept if resembles(r, kept) else [*kept, r], sorted(refs, key=lambda r: -len(r)), [])


def fuzzy_dedupe_col(refs: Column | str, threshold: float = 85) -> Column:
    """Column form: array<string> -> array<string> through an Arrow pandas UDF."""

    @F.pandas_udf(Ty.ArrayType(Ty.StringType()))
    def _dedupe(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else fuzzy_dedupe(list(v), threshold))

    return _dedupe(F.col(refs) if isinstance(refs, str) else refs)


# ----------------------------------------------------------------------------- corpus form
#: Common pairs of characters that two longer references must show among their rarest ones.
WITNESSES = 4


def _lcs_words(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """LCS lengths of pairs, b up to 64 characters each, one 64-bit word a pair (bit-parallel over the batch)."""
    n, width = len(a), max(map(len, b))
    left = np.full((n, max(map(len, a))), -1, np.int64)
    right = np.full((n, width), -2, np.int64)
    for i, (x, y) in enumerate(zip(a, b)):
        left[i, :len(x)], right[i, :len(y)] = x, y
    bits = np.uint64(1) << np.arange(width, dtype=np.uint64)
    state = np.full(n, ~np.uint64(0))
    for column in left.T:
        mask = ((right == column[:, None]) * bits).sum(axis=1, dtype=np.uint64)
        hit = state & mask
        state = (state + hit) | (state & ~mask)
    return ((~state[:, None] & bits) != 0).sum(axis=1)


def similarities(a: pd.Series, b: pd.Series) -> np.ndarray:
    """``similarity`` of every pair; pairs with a text of at most 64 characters are measured together."""
    x, y = a.to_numpy(), b.to_numpy()
    n = np.array([len(s) for s in x]), np.array([len(s) for s in y])
    out, low = np.zeros(len(x)), np.minimum(*n)
    for i in np.flatnonzero(low > 64):
        out[i] = lcs_len(x[i], y[i])
    short = np.flatnonzero((low > 0) & (low <= 64))
    short = short[np.argsort(np.maximum(*n)[short], kind="stable")]  # texts of a like length together
    code = lambda s: np.frombuffer(s.encode("utf-32-le"), "<u4").astype(np.int64)
    for at in range(0, len(short), 2048):
        part = short[at:at + 2048]
        pairs = [(x[i], y[i]) if n[0][i] >= n[1][i] else (y[i], x[i]) for i in part]
        out[part] = _lcs_words([code(p) for p, _ in pairs], [code(q) for _, q in pairs])
    total = n[0] + n[1]
    return np.where(total > 0, 200.0 * out / np.maximum(total, 1), 100.0)


def _grams(ref: Column, q: int) -> Column:
    """The q-grams of a text, repeats told apart by their number: ``gram#1``, ``gram#2``, ..."""
    grams = F.transform(F.sequence(F.lit(1), F.length(ref) - q + 1), lambda i: F.substring(ref, i, F.lit(q)))
    grams = F.when(F.length(ref) >= q, grams).otherwise(F.array().cast("array<string>"))
    # in a sorted list, the number of a repeat is its place behind the first of its kind
    ordered = F.array_sort(grams)
    return F.transform(ordered, lambda g, i: F.concat(F.lit(f"{q}:"), g, F.lit("#"), (i + 2 - F.array_position(ordered, g)).cast("string")))


def similar_pairs(refs: DataFrame, threshold: float, keys: list[str]) -> DataFrame:
    """refs (keys, ref), distinct -> (keys, a, b), a < b: all pairs of one scope at least ``threshold`` similar.

    With s = threshold / 100, a pair of l and m characters needs a common subsequence of s (l + m) / 2, so
    m >= l s / (2 - s), at least that many common characters, and -- an edit destroys at most two pairs of
    neighbours -- at least (1.5 s - 1)(l + m) - 1 common pairs.  Two texts that share c of their n grams share k
    of their n - c + k rarest (grams ordered by how many references hold them, then by name): one for
    characters (short references), ``WITNESSES`` for pairs."""
    s = threshold / 100.0
    share = s / (2.0 - s)
    rate = (1.5 * s - 1) * (1 + share)
    n = F.length("ref")

    def grams(d: DataFrame, q: int, need: Column, witnesses: int) -> DataFrame:
        size = n - q + 1
        return d.select(*keys, "ref", n.alias("n"), F.explode(_grams(F.col("ref"), q)).alias("gram"), F.lit(q).alias("q"),
                        (size - F.ceil(need - 1e-9) + witnesses).cast("int").alias("prefix"), F.lit(witnesses).alias("k"))
    single = n * F.lit(s / 2 * (1 + share))
    if rate > 0:  # of a pair, both have pairs enough, or both are short
        least = (WITNESSES + 1) / rate
        rows = grams(refs.where(n <= least / share), 1, single, 1).unionByName(
            grams(refs.where(n >= least), 2, n * F.lit(rate) - 1, WITNESSES))
    else:
        rows = grams(refs, 1, single, 1)
    rows = cut_lineage(rows)
    often = rows.groupBy("q", "gram").agg(F.count(F.lit(1)).alias("often"))
    # one text's grams are bounded by its length; ordered by rarity its prefix is what may join
    prefix = rows.join(often, ["q", "gram"]).groupBy(*keys, "ref", "n", "q", "k", "prefix").agg(
        F.array_sort(F.collect_list(F.struct("often", "gram"))).alias("sorted"))
    prefix = prefix.select(*keys, "ref", "n", "q", "k", F.explode(F.slice("sorted", F.lit(1), F.col("prefix"))["gram"]).alias("gram"))
    prefix = cut_lineage(prefix)
    a = prefix.select(*keys, "q", "k", "gram", F.col("ref").alias("a"), F.col("n").alias("na"))
    b = prefix.select(*keys, "q", "gram", F.col("ref").alias("b"), F.col("n").alias("nb"))
    like = (F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(share - 1e-9))
    pairs = a.join(b, [*keys, "q", "gram"]).where((F.col("a") < F.col("b")) & like).groupBy(*keys, "q", "k", "a", "b").agg(
        F.count(F.lit(1)).alias("shared")).where("shared >= k").select(*keys, "a", "b").distinct()

    @F.pandas_udf("double")
    def measure(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(similarities(x, y))

    return pairs.where(measure("a", "b") >= threshold)


def fuzzy_dedupe_table(refs: DataFrame, threshold: float = 85, keys: list[str] | None = None, order: str = "seq") -> DataFrame:
    """U3 over a table: refs (keys, ref, seq), any number of references a scope -> those kept by the greedy rule:
    longest first (then by ``order``), every reference that resembles none kept before it.  Of equal references
    the first is meant.  Null references are ignored.

    A reference is kept once all its similar predecessors are dropped, and dropped once one of them is kept;
    each round settles every reference whose predecessors are settled, and works on open pairs only."""
    keys = keys or []
    first = cut_lineage(refs.where(F.col("ref").isNotNull()).groupBy(*keys, "ref").agg(F.min(order).alias(order)))
    place = lambda c, o: F.struct(-F.length(c), F.col(o))
    pairs = similar_pairs(first.select(*keys, "ref"), threshold, keys)
    named = pairs.join(first.select(*keys, F.col("ref").alias("a"), F.col(order).alias("oa")), [*keys, "a"]).join(
        first.select(*keys, F.col("ref").alias("b"), F.col(order).alias("ob")), [*keys, "b"])
    forward = place("a", "oa") < place("b", "ob")
    open_pairs = cut_lineage(named.select(*keys, F.when(forward, F.col("a")).otherwise(F.col("b")).alias("early"),
                                          F.when(forward, F.col("b")).otherwise(F.col("a")).alias("late")))
    dropped = None
    while True:
        late = open_pairs.select(*keys, F.col("late").alias("early")).distinct()
        # an early reference that waits for no other one is kept, and what resembles it goes
        now = cut_lineage(open_pairs.join(late, [*keys, "early"], "left_anti").select(*keys, F.col("late").alias("ref")).distinct())
        if now.isEmpty():
            break
        dropped = now if dropped is None else dropped.unionByName(now)
        gone = lambda c: now.withColumnRenamed("ref", c)
        open_pairs = cut_lineage(open_pairs.join(gone("late"), [*keys, "late"], "left_anti").join(
            gone("early"), [*keys, "early"], "left_anti").select(*keys, "early", "late"))
    return first if dropped is None else first.join(dropped, [*keys, "ref"], "left_anti")
