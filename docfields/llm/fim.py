"""Fill-in-the-middle transformation of documents by repeated-capture matching.

A text is a run of units (here lines, each with its line feed).  One ``regex`` fullmatch of
``(unit)*`` keeps every repetition of the group, so ``match.ends(1)`` is the list of unit ends: its
length is the number of units and two of its entries are the cut offsets.  No loop over lines runs in
Python.  The quantifiers are possessive: units match in one way only, and a long text leaves no
backtracking states behind.

Cut places, form and order come from a digest of ``seed:doc_id`` alone, so any task that sees a row
gives the same result, and nothing is shuffled.  Documents are cut by 1,024 rows a slice, which bounds
the Python objects alive at a time.  Sentinels cannot be ambiguous: a text that holds one stays plain, and
no sentinel can arise across a border, since each begins with the ``<`` it holds nowhere else.

Defined results: null or empty text = empty, form plain, 0 units; a null ``doc_id`` counts as the
empty string in the digest; rows that repeat an id are cut at the same draws; texts of any length are
matched whole; an empty table gives no rows; only ``doc_id`` and ``text`` are read by ``fim_rows``, and
``fim_documents`` carries other columns in a struct, so names never clash.
"""
from __future__ import annotations

import hashlib

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
LINE = r"[^\n]*+\n|[^\n]++"
SEED, FIM_PERCENT, SPM_PERCENT = 7, 100, 50
SLICE = 1024
OUT = "n long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_id, seed: int = SEED) -> list[int]:
    """h1 to h4: the first four 8-digit groups of the digest of ``seed:doc_id``."""
    d = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(d[i:i + 4], "big") for i in range(0, 16, 4)]


class Cutter:
    """(n, form, prefix_chars, middle_chars, output) of single texts."""

    def __init__(self, unit: str = LINE, seed: int = SEED, fim: int = FIM_PERCENT, spm: int = SPM_PERCENT):
        self.units = regex.compile(f"((?:{unit}))*+")
        self.sentinel = regex.compile("|".join(map(regex.escape, (PREFIX, SUFFIX, MIDDLE))))
        self.seed, self.fim, self.spm = seed, fim, spm

    def __call__(self, doc_id, text: str):
        match = self.units.fullmatch(text)
        if match is None:
            raise ValueError(f"the units don't cover the text of document {doc_id}")
        ends = match.ends(1)
        n = len(ends)
        h1, h2, h3, h4 = draws(doc_id, self.seed)
        if not text or self.sentinel.search(text) or h3 % 100 >= self.fim:
            return n, "plain", None, None, text
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = ends[low - 1] if low else 0, ends[high - 1] if high else 0
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if h4 % 100 < self.spm:
            return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
        return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def _cut(options: dict):
    def run(batches):
        cut = Cutter(**options)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                b = batch.slice(at, SLICE)
                rows = [cut(d, t or "") for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())]
                n, form, prefix, middle, out = zip(*rows)
                longs = [pa.array(c, pa.int64()) for c in (n, prefix, middle)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), longs[0], pa.array(form, pa.string()), *longs[1:], pa.array(out, pa.string())],
                    names=[b.schema.names[0], *(c.split()[0] for c in OUT.split(", "))])
    return run


def fim_rows(docs: DataFrame, **options) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n, form, prefix_chars, middle_chars, output), a row each.

    Options of ``Cutter``: unit pattern, seed, percentage transformed (fim) and of those in SPM order (spm)."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return d.mapInArrow(_cut(options), f"doc_id long, {OUT}")


def fim_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with ``text`` replaced by its transformed form; all other columns as they are."""
    d = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"),
                    F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = d.mapInArrow(_cut(options), f"row {d.schema['row'].dataType.simpleString()}, {OUT}")
    return out.select(*[F.col("output").alias("text") if c == "text" else F.col("row").getField(c).alias(c)
                        for c in docs.columns])


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)  # part[0] is the empty start
    return (F.when(form == "psm", F.concat(part[1], part[3], part[2]))
            .when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output))


def fim_digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    return fim_rows(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                                 F.sha2(F.col("output"), 256).alias("output_sha256"),
                                 F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
