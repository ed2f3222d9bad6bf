"""SimHash near-dedup: fingerprints by word shingles, linked by a binary-trie self-join.

Distinct fingerprints meet in tables that each fix some bits: 64 bits are cut into six parts,
and of two fingerprints with at most four differing bits at least two parts agree, so they meet
in one of the 15 tables that fix two parts.  Inside a bucket the sorted fingerprints form an
implicit binary trie; node pairs are traversed together, differing bits are added up, and a pair
is dropped once it exceeds the budget -- or once both nodes lie in one component already, so a
dense group costs its size and emits a spanning forest instead of all pairs.  A bucket of more
than ``BUCKET`` fingerprints is dealt over several tasks by pairs of chunks.

Defined results: null or blank text has no words and fingerprint zero; repeated rows and null
ids are rows like any other (a component of null ids only has a null component_id); an empty
table gives no rows; only ``doc_id`` and ``text`` are read, other columns ride in a struct.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.llm.common import keyed, same_row, write_table
from docfields.llm.components import connected_components, np_components

SHINGLE, MAX_BITS, SEED = 4, 4, 42
BUCKET = 16_384
FRONTIER = 200_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text: a bit is set if it is set in over half of the shingle hashes."""
    words = (text or "").encode().lower().split()  # bytes.lower changes A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    m = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    stops = (ends[min(shingle, len(words)) - 1:] - 1).tolist()
    starts = [0, *ends[:m - 1].tolist()]
    hashed = xxhash.xxh64_intdigest
    h = np.array([hashed(joined[a:z], SEED) for a, z in zip(starts, stops)], np.uint64)
    total = np.zeros(64, np.int64)
    for c in range(0, m, 1 << 16):
        rows = h[c:c + (1 << 16)].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(total * 2 > m, bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, tkey, fp): row key and the fingerprint as a signed long, one row per input row."""
    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))],
                                             names=["doc_id", "tkey", "fp"])
    return keyed(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(
        run, "doc_id long, tkey long, fp long")


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


class Forest:
    """Components of the positions 0..n-1 while links arrive."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self._edges()

    def _edges(self):
        self.breaks = np.zeros(len(self.label), np.int64)
        np.cumsum(self.label[1:] != self.label[:-1], out=self.breaks[1:])

    def link(self, i: np.ndarray, j: np.ndarray):
        a, b = self.label[i], self.label[j]
        diff = a != b
        if not diff.any():
            return
        nodes, root = np_components(a[diff], b[diff])
        to = np.arange(len(self.label))
        to[nodes] = root
        self.label = to[self.label]
        self._edges()

    def joined(self, alo, ahi, blo, bhi):
        """Both ranges lie in one component."""
        br = self.breaks
        return (br[ahi - 1] == br[alo]) & (br[bhi - 1] == br[blo]) & (self.label[alo] == self.label[blo])


def trie_links(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, budget: int) -> np.ndarray:
    """Component label (a position) of every item of the runs x[lo:hi], each sorted and distinct, when
    items of one run with at most ``budget`` differing bits are linked."""
    forest = Forest(len(x))
    near = np.flatnonzero(popcount(x[1:] ^ x[:-1]) <= budget)  # neighbours in the order, within a run
    inside = np.zeros(len(x), np.int64)
    inside[lo] = 1
    run = np.cumsum(inside)
    near = near[run[near] == run[near + 1]]
    forest.link(near, near + 1)
    ones: dict[int, np.ndarray] = {}

    def mid(a, z, bit):
        if bit not in ones:
            c = np.zeros(len(x) + 1, np.int32)
            np.cumsum((x >> np.uint64(63 - bit)) & np.uint64(1), out=c[1:])
            ones[bit] = c
        c = ones[bit]
        return z - (c[z] - c[a])

    big = hi - lo > 1
    stack = [(0, lo[big], hi[big], lo[big], hi[big], np.zeros(int(big.sum()), np.int64))]
    while stack:
        bit, alo, ahi, blo, bhi, err = stack.pop()
        live = ~forest.joined(alo, ahi, blo, bhi) if len(alo) else np.zeros(0, bool)
        single = live & (ahi - alo == 1) & (bhi - blo == 1)
        if single.any():
            i, j = alo[single], blo[single]
            ok = popcount(x[i] ^ x[j]) <= budget
            forest.link(i[ok], j[ok])
        live &= ~single
        if not live.any():
            continue
        alo, ahi, blo, bhi, err = (v[live] for v in (alo, ahi, blo, bhi, err))
        if len(alo) > FRONTIER:
            h = len(alo) // 2
            stack.append((bit, alo[h:], ahi[h:], blo[h:], bhi[h:], err[h:]))
            stack.append((bit, alo[:h], ahi[:h], blo[:h], bhi[:h], err[:h]))
            continue
        am, bm = mid(alo, ahi, bit), mid(blo, bhi, bit)
        own = (alo == blo) & (ahi == bhi)
        parts = []
        for a0, a1, b0, b1, add, keep in ((alo, am, blo, bm, 0, True), (am, ahi, bm, bhi, 0, True),
                                          (alo, am, bm, bhi, 1, True), (am, ahi, blo, bm, 1, ~own)):
            ok = (a1 > a0) & (b1 > b0) & (err + add <= budget) & keep
            ok &= ~((a0 == b0) & (a1 == b1) & (a1 - a0 == 1))
            parts.append((a0[ok], a1[ok], b0[ok], b1[ok], err[ok] + add))
        stack.append((bit + 1, *(np.concatenate(v) for v in zip(*parts))))
    return forest.label


def _join(budget: int):
    """Rows sorted by bucket: spanning links of each bucket's fingerprints."""
    def links(keys, fp):
        x = fp.view(np.uint64)
        new = np.ones(len(x), bool)
        new[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
        order = np.lexsort((x, np.cumsum(new)))
        x = x[order]
        lo = np.flatnonzero(new)
        label = trie_links(x, lo, np.append(lo[1:], len(x)), budget)
        i = np.flatnonzero(label != np.arange(len(x)))
        s = x.view(np.int64)
        for c in range(0, len(i), 100_000):
            j = i[c:c + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(s[j]), pa.array(s[label[j]])], names=["u", "v"])

    def run(batches):
        held, fps = [], []
        for b in batches:
            held.append(np.stack([b.column(c).to_numpy() for c in ("t", "key", "ci", "cj")]))
            fps.append(b.column("fp").to_numpy())
            if sum(map(len, fps)) >= 100_000:
                keys, fp = np.concatenate(held, axis=1), np.concatenate(fps)
                other = np.flatnonzero((keys != keys[:, -1:]).any(axis=0))
                cut = int(other[-1]) + 1 if len(other) else 0  # the last bucket may go on
                if cut:
                    yield from links(keys[:, :cut], fp[:cut])
                held, fps = [keys[:, cut:]], [fp[cut:]]
        if fps and sum(map(len, fps)):
            yield from links(np.concatenate(held, axis=1), np.concatenate(fps))
    return run


def part_masks(budget: int) -> list[int]:
    """Bit masks of the tables: 64 bits in budget + 2 parts, two of which must agree."""
    n = budget + 2
    edges = [round(64 * i / n) for i in range(n + 1)]
    parts = [((1 << (z - a)) - 1) << a for a, z in zip(edges, edges[1:])]
    return [a | b for a, b in combinations(parts, 2)]


def link_fingerprints(distinct: DataFrame, budget: int = MAX_BITS) -> DataFrame:
    """distinct (fp long) -> (node, component): fingerprints connected by steps of at most ``budget`` bits."""
    signed = [m - (1 << 64) if m >> 63 else m for m in part_masks(budget)]
    tables = F.array(*[F.struct(F.lit(i).cast("long").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                       for i, m in enumerate(signed)])
    rows = distinct.select("fp", F.explode(tables).alias("e")).select("fp", "e.t", "e.key")
    # written first: both sides of the join are then plain exchanges that AQE can split
    size = write_table(rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    rows = rows.join(size, ["t", "key"]).withColumn("s", F.ceil(F.col("n") / BUCKET).cast("long"))
    rows = rows.withColumn("c", F.pmod(F.xxhash64("fp"), "s")).withColumn(
        "o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1)))
    dealt = rows.select("t", "key", F.least("c", "o").alias("ci"), F.greatest("c", "o").alias("cj"), "fp")
    edges = dealt.repartition("t", "key", "ci", "cj").sortWithinPartitions("t", "key", "ci", "cj").mapInArrow(
        _join(budget), "u long, v long")
    return connected_components(edges, "simhash")


def row_components(docs: DataFrame, shingle: int = SHINGLE, budget: int = MAX_BITS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tkey, fp), one row per input row, and (fp, root, low): the component of each distinct
    fingerprint, named by a fingerprint, and the smallest doc_id of the fingerprint."""
    f = write_table(fingerprints(docs, shingle), "fingerprints")
    own = f.groupBy("fp").agg(F.min("doc_id").alias("low"))
    comp = link_fingerprints(own.select("fp"), budget)
    return f, own.join(comp, own["fp"] == comp["node"], "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("root"))


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, budget: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id), one row per input row; component_id is the smallest doc_id that
    links of at most ``budget`` differing bits reach."""
    f, named = row_components(docs, shingle, budget)
    low = write_table(named.groupBy("root").agg(F.min("low").alias("component_id")), "component-ids")
    classes = named.select("fp", "root").join(low, "root").select("fp", "component_id")
    return f.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_representatives(docs: DataFrame, shingle: int = SHINGLE, budget: int = MAX_BITS) -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest (doc_id, tkey) stays, a row
    without an id only where no row of its component has one; of rows that repeat id and text one stays."""
    f, named = row_components(docs, shingle, budget)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "tkey"))
    # the first row of each distinct fingerprint is written, so a hot component is small when it is joined
    own = write_table(f.groupBy("fp").agg(first.alias("first")), "first-rows")
    kept = own.join(named.select("fp", "root"), "fp").groupBy("root").agg(F.min("first").alias("first")).select(
        "first.doc_id", "first.tkey")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tkey"))
    hit = rows.join(kept, same_row(rows, kept), "left_semi")
    return hit.dropDuplicates(["doc_id", "tkey"]).select("row.*")
