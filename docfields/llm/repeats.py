"""Find every window of ``n`` symbols that starts at two places of a table of texts.

Seeds: each document's winnowed anchors (``rolling.extents``), two hashes a seed.
Seeds whose anchor hash occurs once are done.  Where all occurrences of an anchor
have the same extent, the extent is a repeat as it stands.  Only the *distinct*
extents of the remaining anchors are fetched from the texts and compared inside
blocks by the caller's ``resolve`` (extension to both sides for words, suffix sorting for
bytes).

An anchor with more distinct extents than ``BLOCK_EXTENTS`` is *hot* and never meets in
one task.  Its windows are matched by grouped counts over groups of neighbouring
windows (equal distance to the anchor, rounded down): the part all windows of a group
share, and the stretch they cover together.  A shared part that occurs once rules the
whole group out; a covered stretch that occurs twice settles the whole group; only
what is left, a few windows at the edges of a repeat, is counted window by window.

Grouped counts combine before the shuffle.  What they yield is written before it is
joined, so that both sides of a join are plain exchanges that AQE can split: an anchor
shared by a third of all documents stays spread.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.llm import rolling as R
from docfields.llm.common import doc_slices, freed, keyed, rest_and_text, same_row, text_bytes, write_table

BLOCK_EXTENTS = 1024
BLOCK_SYMBOLS = 150_000
SHAPE_BITS = 20  # an extent's shape: windows << SHAPE_BITS | distance of the anchor from its start
SEED = "doc_id long, tkey long, ghash long, ehash long, start long, shape long"
CUT = "doc_id long, tkey long, start long, shape long, ghash long, hot boolean, content binary"
GROUP = ("doc_id long, tkey long, start long, windows int, ghash long, place int, common long, covered long, "
         "keys binary")
FOUND = "doc_id long, tkey long, lo long, hi long"
BATCH_BYTES = 1 << 20


def _symbols(data: np.ndarray, off: np.ndarray, words: bool):
    if not words:
        return data, off
    st, en, woff = R.word_bounds(data, off)
    return R.content_hashes(data, st, en), woff


def _seeds(words: bool, n: int, k: int) -> Callable:
    def run(batches):
        for b in batches:
            data, off = text_bytes(b.column("text"))
            ids, keys = b.column("doc_id"), b.column("tkey")
            for x, y in doc_slices(off, BATCH_BYTES):
                sym, so = _symbols(data[off[x]:off[y]], off[x:y + 1] - off[x], words)
                doc, start, cnt, rel, g, e = R.extents(sym, so, n, k)
                if len(doc):
                    take = pa.array(doc + x)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(take), keys.take(take), pa.array(g.view(np.int64)), pa.array(e.view(np.int64)),
                         pa.array(start), pa.array(cnt << SHAPE_BITS | rel)],
                        names=["doc_id", "tkey", "ghash", "ehash", "start", "shape"])
    return run


def _cut(words: bool, n: int) -> Callable:
    def run(batches):
        for b in batches:
            ids, keys = b.column("doc_id"), b.column("tkey")
            data, off = text_bytes(b.column("text"))
            asked = b.column("want")
            ends = np.asarray(asked.offsets) - asked.offsets[0].as_py()
            flat = asked.flatten()
            want = {f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)}
            for x, y in doc_slices(off, BATCH_BYTES):
                sym, so = _symbols(data[off[x]:off[y]], off[x:y + 1] - off[x], words)
                a, z = ends[x], ends[y]
                doc = np.repeat(np.arange(x, y), np.diff(ends[x:y + 1]))
                lo = so[doc - x] + want["start"][a:z]
                hi = lo + (want["shape"][a:z] >> SHAPE_BITS) - 1 + n
                raw = np.ascontiguousarray(sym).view(np.uint8)
                size = sym.dtype.itemsize
                body = pa.array([raw[p * size:q * size].tobytes() for p, q in zip(lo, hi)], pa.binary())
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(take), keys.take(take), pa.array(want["start"][a:z]), pa.array(want["shape"][a:z]),
                     pa.array(want["ghash"][a:z]), pa.array(want["hot"][a:z].astype(bool)), body],
                    names=["doc_id", "tkey", "start", "shape", "ghash", "hot", "content"])
    return run


class _Extents:
    """The extents of a table of ``CUT`` rows: symbols, and every window by row and place in it."""

    def __init__(self, t: pa.Table, words: bool, k: int = 0):
        self.k = k  # symbols of the anchor
        body = t["content"].combine_chunks()
        raw, off = text_bytes(body)
        self.sym = raw.view(np.uint64) if words else raw
        self.first = off[:-1] // (8 if words else 1)
        shape = t["shape"].to_numpy()
        self.cnt, self.rel = shape >> SHAPE_BITS, shape & ((1 << SHAPE_BITS) - 1)
        self.row = np.repeat(np.arange(len(shape)), self.cnt)
        self.i = np.arange(len(self.row)) - np.repeat(np.cumsum(self.cnt) - self.cnt, self.cnt)
        self.pos = self.first[self.row] + self.i
        ids = t["doc_id"].combine_chunks()
        self.ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
        self.keys, self.start, self.ghash = (t[c].to_numpy() for c in ("tkey", "start", "ghash"))


def _blocks(resolve: Callable, words: bool, n: int, k: int) -> Callable:
    """Rows come sorted by ghash; whole buckets are gathered into blocks of bounded size."""
    def found(t: pa.Table):
        x = _Extents(t, words, k)
        bucket = np.zeros(len(x.ghash), np.int64)
        bucket[1:] = np.cumsum(x.ghash[1:] != x.ghash[:-1])
        cls, order = resolve(x, bucket, n)  # class of each window in `order`
        rep = np.zeros(len(x.pos), bool)
        rep[order] = np.bincount(cls)[cls] > 1
        i = np.flatnonzero(rep)  # runs of repeated windows of one extent
        if len(i):
            cut = np.ones(len(i), bool)
            cut[1:] = (i[1:] != i[:-1] + 1) | (x.row[i[1:]] != x.row[i[:-1]])
            a = np.flatnonzero(cut)
            z = np.append(a[1:], len(i)) - 1
            r = x.row[i[a]]
            yield pa.RecordBatch.from_arrays(
                [x.ids.take(pa.array(r)), pa.array(x.keys[r]), pa.array(x.start[r] + x.i[i[a]]),
                 pa.array(x.start[r] + x.i[i[z]] + n)], names=["doc_id", "tkey", "lo", "hi"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        load = 0
        for b in batches:
            g = b.column("ghash").to_numpy()
            weight = np.cumsum((b.column("shape").to_numpy() >> SHAPE_BITS) + n) + load
            new = np.flatnonzero(g[1:] != g[:-1]) + 1
            if held and held[-1].column("ghash")[-1].as_py() != int(g[0]):
                new = np.append(0, new)
            at = base = 0
            for p in new:  # a bucket ends before p
                before = weight[p - 1] if p else load
                if before - base >= BLOCK_SYMBOLS:
                    if p > at:
                        held.append(b.slice(at, p - at))
                    yield from found(pa.Table.from_batches(held))
                    held, at, base = [], int(p), before
            if at < b.num_rows:
                held.append(b.slice(at))
            load = weight[-1] - base
        if held:
            yield from found(pa.Table.from_batches(held))
    return run


def _hot_groups(words: bool, n: int, width: int) -> Callable:
    """Extents of hot anchors -> one row per group of windows whose distance to the anchor, divided by
    ``width``, is ``place``: hash of the part they share, hash of the stretch they cover (null where the
    extent holds only some windows of the group) and the hashes of the single windows."""
    def run(batches):
        for b in batches:
            for c in range(0, b.num_rows, 256):
                x = _Extents(pa.Table.from_batches([b.slice(c, 256)]), words)
                s = x.sym.astype(np.uint64)
                p1, p2 = R.Prefix(s), R.Prefix(s, R.BASE2)
                away = x.rel[x.row] - x.i  # from the window's start to the anchor
                place = away // width
                cut = np.ones(len(away), bool)
                cut[1:] = (place[1:] != place[:-1]) | (x.row[1:] != x.row[:-1])
                a = np.flatnonzero(cut)
                z = np.append(a[1:], len(away)) - 1
                r, pl = x.row[a], place[a]
                anchor = x.first[r] + x.rel[r]
                near, far = pl * width, pl * width + width - 1
                common = p1.ranges(anchor - near, anchor + n - far)
                full = (away[a] == far) & (away[z] == near)
                lo, hi = np.where(full, anchor - far, 0), np.where(full, anchor + n - near, 0)
                w = np.stack([p1.ranges(x.pos, x.pos + n), p2.ranges(x.pos, x.pos + n)], axis=1)
                keys = pa.array([w[i:j + 1].tobytes() for i, j in zip(a, z)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [x.ids.take(pa.array(r)), pa.array(x.keys[r]), pa.array(x.start[r] + x.i[a]),
                     pa.array((z - a + 1).astype(np.int32)), pa.array(x.ghash[r]), pa.array(pl.astype(np.int32)),
                     pa.array(common.view(np.int64)), pa.array(p2.ranges(lo, hi).view(np.int64), mask=~full), keys],
                    names=[c.split()[0] for c in GROUP.split(", ")])
    return run


def _single_windows(n: int) -> Callable:
    def run(batches):
        for b in batches:
            cnt = b.column("windows").to_numpy()
            row = np.repeat(np.arange(b.num_rows), cnt)
            i = np.arange(len(row)) - np.repeat(np.cumsum(cnt) - cnt, cnt)
            raw, _ = text_bytes(b.column("keys"))
            w = raw.view(np.int64).reshape(-1, 2)
            take, lo = pa.array(row), b.column("start").to_numpy()[row] + i
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(take), b.column("tkey").take(take), pa.array(lo), pa.array(lo + n),
                 pa.array(w[:, 0].copy()), pa.array(w[:, 1].copy())], names=["doc_id", "tkey", "lo", "hi", "w1", "w2"])
    return run


def _hot_spans(extents: DataFrame, n: int, k: int, words: bool, tag: str) -> DataFrame:
    """Repeated windows of the extents of hot anchors, as spans."""
    width = max(2, round((n - k + 1) ** 0.5))
    groups = write_table(extents.mapInArrow(freed(_hot_groups(words, n, width)), GROUP), f"{tag}-groups")
    part = ["ghash", "place", "common"]
    shared = write_table(groups.groupBy(*part).agg(F.count("*").alias("c")).where("c > 1").select(*part), f"{tag}-shared")
    live = write_table(groups.join(shared, part), f"{tag}-live")
    me = F.struct("doc_id", "tkey", "start")
    stretch = write_table(live.where("covered is not null").groupBy(*part, "covered").agg(
        F.count("*").alias("c"), F.min(me).alias("one")).where("c > 1"), f"{tag}-stretch")
    known = live.join(stretch, [*part, "covered"], "left")
    settled = known.where("c is not null").select(
        "doc_id", "tkey", F.col("start").alias("lo"), (F.col("start") + F.col("windows") - 1 + n).alias("hi"))
    # One group of each settled stretch speaks for its windows.
    speak = known.where(F.col("c").isNull() | (F.col("one").eqNullSafe(me))).select("doc_id", "tkey", "start", "windows", "keys")
    single = write_table(speak.mapInArrow(
        _single_windows(n), "doc_id long, tkey long, lo long, hi long, w1 long, w2 long"), f"{tag}-windows")
    twice = write_table(single.groupBy("w1", "w2").agg(F.count("*").alias("c")).where("c > 1").select("w1", "w2"),
                        f"{tag}-twice")
    return settled.union(single.join(twice, ["w1", "w2"]).select("doc_id", "tkey", "lo", "hi"))


def repeated_spans(docs: DataFrame, n: int, k: int, words: bool, resolve: Callable, tag: str) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, tkey, spans): for each row with a repeat, the [lo, hi) ranges of
    symbols covered by windows that also start anywhere else (ranges may overlap)."""
    d = keyed(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    seeds = d.mapInArrow(freed(_seeds(words, n, k)), SEED)  # cheaper to compute twice than to store
    often = write_table(seeds.groupBy("ghash").agg(
        F.count("*").alias("tot"), F.min("ehash").alias("e0"), F.max("ehash").alias("e1")).where("tot > 1").select(
        "ghash", (F.col("e0") != F.col("e1")).alias("mixed")), f"{tag}-often")
    x = write_table(seeds.join(often, "ghash"), f"{tag}-seeds")
    end = F.col("start") + F.shiftright("shape", SHAPE_BITS) - 1 + n
    span = lambda df: df.select("doc_id", "tkey", F.col("start").alias("lo"), end.alias("hi"))
    whole = span(x.where("not mixed"))
    mixed = x.where("mixed")
    kinds = write_table(mixed.groupBy("ghash", "ehash").agg(
        F.count("*").alias("times"), F.min(F.struct("doc_id", "tkey", "start", "shape")).alias("at")), f"{tag}-kinds")
    again = span(mixed.join(kinds.where("times > 1").select("ghash", "ehash"), ["ghash", "ehash"]))
    hot = write_table(kinds.groupBy("ghash").agg(F.count("*").alias("m")).where(
        F.col("m") > BLOCK_EXTENTS).select("ghash", F.lit(True).alias("many")), f"{tag}-hot")
    asked = kinds.join(hot, "ghash", "left").select("at.*", "ghash", F.col("many").isNotNull().alias("hot"))
    want = asked.groupBy("doc_id", "tkey").agg(
        F.collect_list(F.struct("start", "shape", "ghash", "hot")).alias("want"))
    cut = write_table(d.join(want.hint("shuffle_hash"), same_row(d, want)).select(
        d["doc_id"], d["tkey"], "text", "want").mapInArrow(freed(_cut(words, n)), CUT), f"{tag}-extents")
    sort = cut.where("not hot").repartition("ghash").sortWithinPartitions("ghash")
    found = write_table(sort.mapInArrow(freed(_blocks(resolve, words, n, k)), FOUND), f"{tag}-found")
    spans = whole.union(again).union(found).union(_hot_spans(cut.where("hot"), n, k, words, tag))
    return spans.groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs (any columns) -> (row struct without text, doc_id, text, spans): every row once, spans null where
    nothing repeats."""
    rest, text = rest_and_text(docs)
    d = docs.select(rest.alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                    F.xxhash64(text).alias("tkey"), text.alias("text"))
    return d.join(spans.hint("shuffle_hash"), same_row(d, spans), "left").select("row", d["doc_id"], "text", "spans")


def spans_of(col: pa.Array, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Merged spans of row ``i`` of a list<struct<lo, hi>> column."""
    v = col[i]
    if not v.is_valid:
        z = np.zeros(0, np.int64)
        return z, z
    f = v.values
    return R.merge_spans(f.field(0).to_numpy(), f.field(1).to_numpy())
