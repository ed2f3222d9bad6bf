"""Sequence packing with bounded space.

Every partition keeps at most ``OPEN`` open windows of 2048 tokens.  A document is tokenized once,
cut into full windows and one rest; the rest goes into the open window where it leaves the least
room, and when none has room the fullest window is emitted and a new one opened.  The windows still
open at the end are merged by groups of ``FAN_IN`` partitions, round by round, each round again
keeping at most ``OPEN`` windows per group, so no task sees more than ``FAN_IN * OPEN`` windows.

Defined results: null or empty text = the end id alone; null ids and repeated rows are packed like
any other row; long texts are cut freely; an empty table gives no rows; other columns are not read.
"""
from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.llm.common import write_table
from docfields.llm.tokens import tokenizer

LENGTH, OPEN, FAN_IN, END_ID = 2048, 128, 64, 1
PIECE = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
         "sequence_id long, offset long, part long, open boolean")


class Windows:
    """At most ``limit`` open windows; ``put`` tells where a piece goes."""

    def __init__(self, prefix: int, length: int = LENGTH, limit: int = OPEN):
        self.prefix, self.length, self.limit = prefix << 32, length, limit
        self.count = 0
        self.room: list[tuple[int, int]] = []  # (free tokens, window), ascending

    def new(self) -> int:
        self.count += 1
        return self.prefix + self.count - 1

    def put(self, size: int) -> tuple[int, int]:
        """(window, offset) for a piece of ``size`` tokens."""
        at = bisect_left(self.room, (size, -1))
        if at == len(self.room):
            if len(self.room) >= self.limit:
                self.room.pop(0)  # the fullest is emitted
            free, w = self.length, self.new()
        else:
            free, w = self.room.pop(at)
        if free > size:
            insort(self.room, (free - size, w))
        return w, self.length - free


def _pack(tokenizer_path: str, length: int, limit: int):
    def run(batches):
        part = TaskContext.get().partitionId()
        tok, win = tokenizer(tokenizer_path), Windows(part, length, limit)
        for b in batches:
            docs = b.column(0)
            for at, ids, off in tok.groups(b.column(1), END_ID):
                out: list[tuple] = []
                which: list[int] = []
                for i, (x, y) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
                    n = y - x
                    for s in range(0, n, length):
                        m = min(length, n - s)
                        w, offset = win.put(m)
                        out.append((s, m, zlib.crc32(ids[x + s:x + s + m]), n, w, offset))
                        which.append(at + i)
                cols = [docs.take(pa.array(which, pa.int64())), *(pa.array(c, pa.int64()) for c in zip(*out))]
                yield pa.RecordBatch.from_arrays(
                    [*cols, pa.array([part] * len(out), pa.int64())],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part"])
        tok.forget()
        left = [w for _, w in win.room]  # still open: marked by a row of their own
        m = len(left)
        none = pa.nulls(m, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [none, none, pa.array([0] * m, pa.int64()), none, none, pa.array(left, pa.int64()), none,
             pa.array([part] * m, pa.int64())],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part"])
    return run


def _merge(level: int, length: int, limit: int, last: bool):
    """Pack the pieces of the windows that a group of partitions left open, largest first."""
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "sequence_id", "offset"], ascending=[False, True, True], kind="stable")
        win = Windows((level << 24) + int(key[0]), length, len(pdf) + 1)
        place = [win.put(int(m)) for m in pdf["length"]]
        pdf["sequence_id"] = [w for w, _ in place]
        pdf["offset"] = [o for _, o in place]
        open_now = set() if last else {w for _, w in win.room[-limit:]}
        pdf["open"] = pdf["sequence_id"].isin(open_now)
        pdf["part"] = int(key[0])
        return pdf
    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, limit: int = OPEN,
                   fan_in: int = FAN_IN) -> DataFrame:
    """docs (doc_id, text) -> one row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.  The pieces of a sequence lie gapless from offset 0."""
    names = [c.split()[0] for c in PIECE.split(", ")]
    first = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _pack(tokenizer_path, length, limit), PIECE.rsplit(", ", 1)[0])
    pieces = write_table(first, "pieces")
    marks = pieces.where("length = 0").select("sequence_id")
    real = pieces.where("length > 0")
    done = [real.join(marks, "sequence_id", "left_anti").select(names[:-2])]
    rest = real.join(marks, "sequence_id", "left_semi").withColumn("open", F.lit(True)).select(names)
    level = 0
    while True:
        level += 1
        groups = rest.agg(F.max("part")).first()[0]
        groups = 0 if groups is None else int(groups) // fan_in
        merged = rest.withColumn("part", F.floor(F.col("part") / fan_in)).groupBy("part").applyInPandas(
            _merge(level, length, limit, groups == 0), PIECE)
        merged = write_table(merged, "merged")
        done.append(merged.where("not open").select(names[:-2]))
        if groups == 0:
            break
        rest = merged.where("open")
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out
