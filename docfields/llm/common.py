"""Shared helpers: reading tables, writing intermediate tables, Arrow access to texts.

Rows of ``documents`` are identified by ``(doc_id, xxhash64(text))``: rows that
repeat an id with another text stay apart, rows that repeat both are copies.
"""
from __future__ import annotations

import ctypes
import functools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.session import ensure_checkpoint_dir, finished_shuffles_go  # noqa: F401 (the latter for this package's modules)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/llm-{tag}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return it reread.

    Cuts the lineage: a lost executor costs only the running tasks."""
    path = shared_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, tkey, text): only what the text operators read; null text = empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id"), F.xxhash64(text).alias("tkey"), text.alias("text"))


def same_row(a: DataFrame, b: DataFrame):
    """Null-safe equi-join condition on the row key."""
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["tkey"] == b["tkey"])


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and int64 offsets (n + 1), without copying; null = empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    bufs = col.buffers()
    if n == 0 or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset:col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def release_memory() -> None:
    """Give freed memory of this Python worker back to the machine: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def freed(run):
    """A ``mapInArrow`` function that hands its memory back when its task ends."""
    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()
    return wrapped


def rest_and_text(docs: DataFrame):
    """(struct of all columns but ``text``, text with null as empty): a row that holds its text once."""
    return F.struct(*[c for c in docs.columns if c != "text"]), F.coalesce(F.col("text"), F.lit(""))


def with_text(rows: DataFrame, columns: list[str], row: str, text: str) -> DataFrame:
    """The rows that ``rest_and_text`` split, ``text`` replaced by another column."""
    return rows.select(*[F.col(text).alias("text") if c == "text" else F.col(row).getField(c).alias(c) for c in columns])


def doc_slices(off: np.ndarray, limit: int):
    """Ranges [a, b) of documents with at most ``limit`` bytes together, one document at least."""
    n, a = len(off) - 1, 0
    while a < n:
        b = int(np.searchsorted(off, off[a] + limit, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b
