"""Language-model scores from a probabilistic suffix tree over words.

A state of the tree is a context: the last d words, d up to ``DEPTH``.  The root's distribution is the
smoothed unigram model.  A context that occurs at least ``MIN_COUNT`` times in the training documents
and whose suffix and inner part (s without its first and last word) are states becomes a state if its
next-symbol distribution diverges from that of its suffix: the log-likelihood ratio of its own successors under the two distributions, each successor
left out of its own count, must exceed ``GAIN`` nats.  (A successor seen once speaks against a state,
so contexts that only repeat noise go.)  A state s smooths its counts with the distribution of its suffix:

    P(w | s) = (c(s, w) + k * P(w | suffix of s)) / (c(s) + k)

with that k of ``KAPPAS`` under which it diverges most, and each token is scored in the longest suffix of
its history that is a state.

How it runs.  Documents are tokenized once into *blocks* of about ``BLOCK`` tokens (a row each: word numbers
and the distinct words' hashes), written bucketed by block, so that no later join moves them.  Whatever
a block must know about the whole corpus -- the count of a word or of a context with its successor, the
verdict on a context -- it *asks*: its distinct keys, sorted, are cut by key range into a quarter as many parts
as there are blocks, parts of one range meet in one task, are summed by key, and the answers go back in key order.
Blocks of one task ask together: a key that several of them hold is sent once, with their amounts summed and a bit
a block; each still gets its own answer.
A word in every document costs each block one key, so hot words, copies and sources are no hot groups.
The tree is spread over the key ranges; nothing of it is collected or broadcast, and no count is dropped.
Only two numbers, training tokens and distinct words, reach the driver.

Keys are 64-bit hashes of the word's bytes, mixed along the context.  n distinct keys collide with
probability about n^2 / 2^65 (3e-2 for 10^9).

Defined results: null or blank text = the end token alone; a null ``doc_id`` is not held out and trains;
repeated rows train and are scored each; without training tokens every probability is that of an
unknown token, 1; texts of any length are read whole (a block holds one document at least); an empty
table gives no rows; only ``doc_id`` and ``text`` are read.
"""
from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.llm import rolling as R
from docfields.llm.common import doc_slices, finished_shuffles_go, freed, shared_path, text_bytes, write_table

DEPTH, MIN_COUNT, GAIN = 2, 8, 4.0
KAPPAS = (3.0, 30.0, 300.0, 3000.0)
FOLDS, HELD_OUT = 5, 1
BLOCK = 500_000
#: Blocks' worth of keys that meet in one task.
BLOCKS_A_PART = 4
#: Blocks of a task that ask together: at most so many, with so many keys between them (but one block at least).
GROUP_BLOCKS, GROUP_KEYS = 8, 2_500_000
END = R.content_hashes(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(1, np.int64))[0]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
BLOCKS = "block long, docs array<long>, held array<boolean>, sizes array<int>, words binary, seq binary"
ASK = "bucket int, blocks array<long>, keys binary, amounts binary, askers binary"
SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
          "score double")


def _pack(a: np.ndarray) -> bytes:
    """The bytes of an array that is kept, all first bytes first: sorted keys and small counts compress well that way."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _unpack(raw: bytes, kind) -> np.ndarray:
    """Inverse of ``_pack``."""
    size = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8).reshape(size, len(raw) // size).T.copy().view(kind).ravel()


def _squeeze(raw: bytes) -> bytes:
    """zstd behind the length: in byte planes most of what is left is skewed, which the codec of shuffles does not see."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _expand(raw: bytes) -> bytes:
    """Inverse of ``_squeeze``."""
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as their gaps, which are shorter the more keys there are."""
    return _squeeze(_pack(np.diff(keys, prepend=np.uint64(0))))


def _unpack_keys(raw: bytes) -> np.ndarray:
    """Inverse of ``_pack_keys``."""
    return np.cumsum(_unpack(_expand(raw), np.uint64), dtype=np.uint64)


def _pack_gains(a: np.ndarray) -> bytes:
    """A bit a row, whether it has an entry but 0, and those rows: a block speaks for few of the contexts it asks for."""
    some = a.any(axis=1)
    return np.packbits(some).tobytes() + _pack(a[some].ravel())


def _unpack_gains(raw: bytes, n: int, width: int) -> np.ndarray:
    """Inverse of ``_pack_gains``: n rows."""
    head = -(-n // 8)
    out = np.zeros((n, width), np.float32)
    out[np.unpackbits(np.frombuffer(raw, np.uint8, head), count=n).astype(bool)] = _unpack(raw[head:], np.float32).reshape(-1, width)
    return out


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of each document and one end token each; tokens by document."""
    data = _LOWER[data]
    st, en, woff = R.word_bounds(data, off)
    sizes = np.diff(woff) + 1
    out = np.full(int(sizes.sum()), END, np.uint64)
    word = np.ones(len(out), bool)
    word[np.cumsum(sizes) - 1] = False
    out[word] = R.content_hashes(data, st, en)
    return out, sizes


def _tokenize(limit: int):
    def block(number, ids, held, sizes, parts):
        words, seq = np.unique(np.concatenate(parts), return_inverse=True)
        often = np.argsort(-np.bincount(seq), kind="stable")  # frequent words first: small numbers compress well
        rank = np.empty(len(words), np.int32)
        rank[often] = np.arange(len(words))
        cols = [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())),
                pa.array([np.concatenate(sizes).astype(np.int32)], pa.list_(pa.int32())),
                pa.array([_pack(words[often])], pa.binary()), pa.array([_pack(rank[seq])], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in BLOCKS.split(", ")])

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        ids, held, sizes, parts, load = [], [], [], [], 0
        for b in batches:
            data, off = text_bytes(b.column("text"))
            doc, out = b.column("doc_id").to_pylist(), b.column("held").to_pylist()
            for x, y in doc_slices(off, 1 << 20):
                t, n = tokens(data[off[x]:off[y]], off[x:y + 1] - off[x])
                if load and load + len(t) > limit:
                    yield block(number, ids, held, sizes, parts)
                    number += 1
                    ids, held, sizes, parts, load = [], [], [], [], 0
                ids, held = ids + doc[x:y], held + out[x:y]
                sizes.append(n)
                parts.append(t)
                load += len(t)
        if load:
            yield block(number, ids, held, sizes, parts)
    return run


class Block:
    """The tokens of a block and what has been answered so far.

    Level d knows the distinct grams of d + 1 words that may matter, ``keys`` (level 0: the words), which of
    them ends at each position, ``of``, and how often it occurs in the training documents, ``total``.  The
    context of depth d of a position is the gram of level d - 1 that ends just before it, so its count
    is known; ``prob`` is a position's probability if the tree ended at the level reached."""

    def __init__(self, row: dict, answers: list, totals: tuple[int, int], options: dict):
        words = _unpack(row["words"], np.uint64)
        order = np.argsort(words)
        place = np.empty(len(words), np.int32)
        place[order] = np.arange(len(words))
        words, seq = words[order], place[_unpack(row["seq"], np.int32)]
        self.sizes = np.asarray(row["sizes"], np.int64)
        self.held = np.asarray(row["held"], bool)
        self.ends = np.cumsum(self.sizes)
        self.known = len(answers)
        train = np.repeat(~self.held, self.sizes)
        if not answers:
            self.question = words, np.bincount(seq[train], minlength=len(words))
            return
        self.seen = (answers[0] > 1)[seq]
        self.prob = (((answers[0] >> 1) + 0.5) / (totals[0] + 0.5 * (totals[1] + 1)))[seq]
        self.base = self.prob if len(answers) == 1 else self.prob.copy()
        keys, of, total = words, seq, answers[0] >> 1
        ok = np.ones(len(seq), bool)
        for d in range(1, options["depth"] + 1):
            first = self.ends - self.sizes + d - 1  # a context does not reach over the start of a document
            ok[first[self.sizes >= d]] = False
            before = np.zeros(len(total) + 1, bool)  # the last entry: no gram of this level
            before[:-1] = total >= options["min_count"]
            ok[1:] &= before[of[:-1]]
            at = np.flatnonzero(ok)
            context = of[at - 1]
            gram = R.mix(keys[context] * np.uint64(R.BASE2) + words[seq[at]] + np.uint64(d))
            grams, mine = np.unique(gram, return_inverse=True)
            if len(answers) == 2 * d - 1:
                self.question = grams, np.bincount(mine[train[at]], minlength=len(grams))
                return
            answer = answers[2 * d - 1]
            used = np.zeros(len(keys), bool)
            used[context] = True
            place = np.cumsum(used) - 1
            if len(answers) == 2 * d:
                self.question = keys[used], self._gains(
                    answer, mine, place[context], total[context], self.prob[at], options["kappas"], int(used.sum()))
                return
            verdict = answers[2 * d][place[context]]
            state = verdict > 0
            n, k = total[context][state], np.array(options["kappas"])[verdict[state] - 1]
            here = at[state]
            self.prob[here] = ((answer >> 1)[mine[state]] + k * self.prob[here]) / (n + k)
            ok[at[~state]] = False
            keys, total = grams, answer >> 1
            of = np.full(len(seq), len(grams), np.int32)
            of[at] = mine

    @staticmethod
    def _gains(answer, mine, context, often, prob, kappas, n) -> np.ndarray:
        """Log-likelihood ratio of each context under each kappa, over the successors this block speaks for."""
        first = np.zeros(len(answer), np.int64)
        first[mine[::-1]] = np.arange(len(mine))[::-1]
        first = first[(answer & 1 == 1) & (answer > 1)]
        c, often, q = (answer >> 1)[mine[first]], often[first], prob[first]
        return np.stack([np.bincount(context[first], weights=c * np.log((c - 1 + k * q) / ((often - 1 + k) * q)), minlength=n)
                         for k in kappas], axis=1)


def _answers_of(row: dict, depth_known: int) -> list[np.ndarray]:
    """Answers of a block in key order: counts as 64-bit numbers, verdicts as bytes."""
    def whole(i, kind):
        parts = [_unpack(x["answer"], kind if kind == np.int8 or x["wide"] else np.uint32) for x in row[f"a{i}"]]
        return np.concatenate([np.zeros(0, kind), *parts]).astype(kind, copy=False)
    return [whole(i, np.int64 if i == 0 or i % 2 else np.int8) for i in range(depth_known)]


def _each(batches, known: int, totals, options):
    for b in batches:
        for i in range(b.num_rows):
            row = {c: b.column(c)[i].as_py() for c in b.schema.names if c != "docs"}
            block = Block(row, _answers_of(row, known), totals, options)
            del row
            yield b, i, block


def _ask(known: int, totals, options: dict, buckets: int):
    edges = np.array([-(-i * (1 << 64) // buckets) for i in range(1, buckets)], np.uint64)

    def together(held: list):
        """One row a key range for some blocks: their distinct keys, the amounts summed, who asked for which."""
        size = [len(keys) for _, keys, _ in held]
        keys, of = np.unique(np.concatenate([k for _, k, _ in held]), return_inverse=True)
        amounts = np.concatenate([a for _, _, a in held])
        add = lambda a: np.bincount(of, weights=a, minlength=len(keys))
        gains = amounts.ndim > 1
        amounts = np.stack([add(a) for a in amounts.T], axis=1).astype(np.float32) if gains else add(amounts).astype(np.int64)
        asked = np.zeros((len(held), len(keys)), bool)
        asked[np.repeat(np.arange(len(held)), size), of] = True
        said = _pack_gains if gains else _pack
        cut = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
        at = np.flatnonzero(np.diff(cut))
        spans = [slice(cut[j], cut[j + 1]) for j in at]
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int32)), pa.array([[number for number, _, _ in held]] * len(at), pa.list_(pa.int64())),
             pa.array([_pack_keys(keys[x]) for x in spans], pa.binary()),
             pa.array([_squeeze(said(amounts[x])) for x in spans], pa.binary()),
             pa.array([_squeeze(np.packbits(asked[:, x], axis=1).tobytes()) for x in spans], pa.binary())],
            names=[c.split()[0] for c in ASK.split(", ")])

    def run(batches):
        held, load = [], 0
        for b, i, block in _each(batches, known, totals, options):
            keys, amounts = block.question
            del block
            if held and (len(held) == GROUP_BLOCKS or load + len(keys) > GROUP_KEYS):
                yield from together(held)
                held, load = [], 0
            held.append((b.column("block")[i].as_py(), keys, amounts.astype(np.float32 if amounts.ndim > 1 else np.int32)))
            load += len(keys)
        if load:
            yield from together(held)
    return run


def _reply(gain: float | None, kappas: int):
    """Rows of one bucket come together: sum the amounts by key.  With ``gain``, the bound that makes a context
    a state, the answer is the number of its best kappa from 1, or 0."""
    def total(rows: list[dict]):
        keys = [_unpack_keys(r["keys"]) for r in rows]
        size = np.array([len(k) for k in keys])
        said = [_expand(r["amounts"]) for r in rows]
        amount = np.concatenate([_unpack(a, np.int64) if gain is None else _unpack_gains(a, n, kappas)
                                 for a, n in zip(said, size)])
        distinct, first, of = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        if gain is None:
            s = np.bincount(of, weights=amount, minlength=len(distinct)).astype(np.int64)  # exact below 2^53
            out = s[of] << 1
            out[first] |= 1  # one block speaks for the key
            wide = bool(out.max() >> 32)
            out = out if wide else out.astype(np.uint32)
            figures = [int((s > 0).sum()), int(s.sum())]
        else:
            s = np.stack([np.bincount(of, weights=a.astype(float), minlength=len(distinct)) for a in amount.T])
            best = np.where(s.max(axis=0) > gain, s.argmax(axis=0) + 1, 0).astype(np.int8)
            out, wide, figures = best[of], False, [0, 0]
        number, answer = [], []
        for r, c, k in zip(rows, np.cumsum(size) - size, size):
            mine = out[c:c + k]
            asked = np.frombuffer(_expand(r["askers"]), np.uint8).reshape(len(r["blocks"]), -1)
            for block, bits in zip(r["blocks"], asked):
                some = np.flatnonzero(np.unpackbits(bits, count=k))
                if len(some):
                    number.append(block)
                    answer.append(_pack(mine[some]))
                    if gain is None:
                        mine[some] = mine[some] >> 1 << 1  # the others that asked do not speak for it
        n = len(number)
        return pa.RecordBatch.from_arrays(
            [pa.array(number, pa.int64()), pa.array([rows[0]["bucket"]] * n, pa.int32()),
             pa.array([wide] * n), pa.array(answer, pa.binary()),
             pa.array([figures[0]] + [0] * (n - 1), pa.int64()), pa.array([figures[1]] + [0] * (n - 1), pa.int64())],
            names=["block", "bucket", "wide", "answer", "distinct", "total"])

    def run(batches):
        held: list[dict] = []
        for b in batches:
            for r in b.to_pylist():
                if held and held[-1]["bucket"] != r["bucket"]:
                    yield total(held)
                    held = []
                held.append(r)
        if held:
            yield total(held)
    return run


def _score(known: int, totals, options: dict):
    def run(batches):
        for b, i, x in _each(batches, known, totals, options):
            first = x.ends - x.sizes
            n = len(first)
            yield pa.RecordBatch.from_arrays(
                [b.column("docs")[i].values, pa.array(x.held), pa.array(x.sizes),
                 pa.array(np.add.reduceat(x.seen.astype(np.int64), first)), pa.array([totals[0]] * n, pa.int64()),
                 pa.array(np.add.reduceat(np.log10(x.base), first)), pa.array(np.add.reduceat(np.log10(x.prob), first))],
                names=[c.split()[0] for c in SCORES.split(", ")])
    return run


class _Table:
    """Tables bucketed by block in the shared folder; joins of them by block need no exchange."""

    def __init__(self, docs: DataFrame):
        self.spark = docs.sparkSession
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.names: list[str] = []

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        name = f"docfields_lm_{tag}_{uuid.uuid4().hex}"
        with finished_shuffles_go(self.spark):
            (df.write.format("parquet").option("compression", "zstd").option("path", shared_path(self.spark, f"lm-{tag}"))
             .bucketBy(self.buckets, "block").sortBy("block").saveAsTable(name))
        self.names.append(name)
        return self.spark.table(name)

    def drop(self):
        for name in self.names:  # the files stay with the other tables of the shared folder
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def lm_scores(docs: DataFrame, depth: int = DEPTH, min_count: int = MIN_COUNT, gain: float = GAIN,
              kappas: tuple[float, ...] = KAPPAS, block: int = BLOCK) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    options = {"depth": depth, "min_count": max(1, min_count), "kappas": kappas}
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held"), "text")
    store = _Table(docs)
    try:
        known = store.keep(rows.mapInArrow(freed(_tokenize(block)), BLOCKS), "blocks")
        parts = -(-known.count() // BLOCKS_A_PART) or 1
        totals = (0, 0)
        for step in range(2 * depth + 1):
            verdict = step > 0 and step % 2 == 0
            asked = known.mapInArrow(freed(_ask(step, totals, options, parts)), ASK)
            answers = asked.repartition(parts, "bucket").sortWithinPartitions("bucket", "blocks").mapInArrow(
                freed(_reply(gain if verdict else None, len(kappas))), "block long, bucket int, wide boolean, answer binary, distinct long, total long")
            mine = store.keep(answers.groupBy("block").agg(
                F.array_sort(F.collect_list(F.struct("bucket", "wide", "answer"))).alias(f"a{step}"),
                F.sum("distinct").alias("distinct"), F.sum("total").alias("total")), f"a{step}")
            if step == 0:
                r = mine.agg(F.sum("total"), F.sum("distinct")).first()
                totals = (r[0] or 0, r[1] or 0)
            # a block that asked nothing has no row: its answer is empty
            empty = F.array().cast("array<struct<bucket:int,wide:boolean,answer:binary>>")
            known = known.join(mine.select("block", f"a{step}").hint("merge"), "block", "left").withColumn(
                f"a{step}", F.coalesce(f"a{step}", empty))
        return write_table(known.mapInArrow(freed(_score(2 * depth + 1, totals, options)), SCORES), "lm-scores")
    finally:
        store.drop()
