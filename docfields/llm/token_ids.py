"""Token ids as binary files: frequency-ranked ids in byte-aligned variable-length coding.

Ids are replaced by their rank by corpus frequency (ties by id), so frequent ids take one byte.
A rank takes one to four little-endian bytes; its length sits in two bits of a separate control
byte (four ranks a control byte), so a reader gets all lengths and offsets from one numpy table
lookup.  A *shard* holds a range of documents in ascending order and is a row of blocks:

    magic "TIDS", uint32 documents, uint64 ids, uint64 data bytes            (little endian)
    int64 doc_id per document, uint8 id-is-null per document, uint32 ids per document
    control bytes (ids / 4, rounded up), data bytes

``ranks.bin`` beside the shards maps ranks back to ids (uint32).

Defined results: null or empty text = only the end id; a null ``doc_id`` sorts first; repeated rows
are written once each, equal ids ordered by text; an empty table gives no rows; texts of any
length are written whole; other columns are not read.
"""
from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docfields.llm.common import doc_slices, shared_path, text_bytes, write_table
from docfields.llm.tokens import tokenizer

MAGIC, HEAD = b"TIDS", struct.Struct("<4sIQQ")
END_ID = 1
BLOCK_BYTES = 512 << 10
FILE_BYTES = 32 << 20
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """uint32 ranks -> (control bytes, data bytes)."""
    r = np.ascontiguousarray(ranks, "<u4")
    size = 1 + (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    code = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    code[:len(r)] = size - 1
    control = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    data = r.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """Inverse of :func:`encode_ranks` by table lookup."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n].astype(np.int64)
    at = np.cumsum(size) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    if n and int(at[-1] + size[-1]) != len(data):
        raise ValueError("control bytes and data bytes disagree")
    word = sum(raw[at + j].astype(np.uint32) << np.uint32(8 * j) for j in range(4)) if n else np.zeros(0, np.uint32)
    return word & _MASKS[size]


def pack_block(doc_ids: list[int | None], counts: list[int], ranks: np.ndarray) -> bytes:
    control, data = encode_ranks(ranks)
    ids = np.array([d if d is not None else 0 for d in doc_ids], "<i8")
    null = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([HEAD.pack(MAGIC, len(ids), len(ranks), len(data)), ids.tobytes(), null.tobytes(),
                     np.array(counts, "<u4").tobytes(), control, data])


def read_blocks(buf: bytes):
    """(doc_ids, null flags, counts, ranks) of each block of a shard; raises on a broken one."""
    at = 0
    while at < len(buf):
        magic, docs, n, size = HEAD.unpack_from(buf, at)
        if magic != MAGIC:
            raise ValueError("not a token-id block")
        at += HEAD.size
        ids = np.frombuffer(buf, "<i8", docs, at)
        null = np.frombuffer(buf, np.uint8, docs, at + 8 * docs).astype(bool)
        counts = np.frombuffer(buf, "<u4", docs, at + 9 * docs).astype(np.int64)
        at += 13 * docs
        ctl = -(-n // 4)
        if at + ctl + size > len(buf) or counts.sum() != n:
            raise ValueError("truncated token-id block")
        yield ids, null, counts, decode_ranks(buf[at:at + ctl], buf[at + ctl:at + ctl + size], n)
        at += ctl + size


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path of the shared folder, seen from a Python worker."""
    return fs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else "file://" + path[5:])


def tokenized(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, k, ids) written to the shared folder: each text is tokenized once.  ``k`` is the hash of
    the text; ids are little-endian, of two bytes where the vocabulary allows it."""
    def run(batches):
        tok = tokenizer(tokenizer_path)
        kind = np.dtype(id_type(tok.vocab_size))
        for b in batches:
            for at, ids, off in tok.groups(b.column("text"), END_ID):
                part, width = b.slice(at, len(off) - 1), kind.itemsize
                cells = pa.Array.from_buffers(pa.large_binary(), len(part), [
                    None, pa.py_buffer(off * width), pa.py_buffer(ids.astype(kind))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("k"), cells],
                                                 names=["doc_id", "k", "ids"])
        tok.forget()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("k"), "text")
    return write_table(rows.mapInArrow(run, "doc_id long, k long, ids binary"), "tokenized")


def id_type(vocab_size: int) -> str:
    return "<u2" if vocab_size <= 1 << 16 else "<u4"


def frequency_ranks(ids: DataFrame, vocab_size: int) -> np.ndarray:
    """ids[rank]: ids by falling count over all documents, unused ids last.  What reaches the driver
    is bounded by the vocabulary."""
    def count(batches):
        total = np.zeros(vocab_size, np.int64)
        for b in batches:
            raw, off = text_bytes(b.column(0))
            for x, y in doc_slices(off, 4 << 20):
                part = np.frombuffer(raw[off[x]:off[y]].tobytes(), id_type(vocab_size))
                total += np.bincount(part, minlength=vocab_size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])
    rows = ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(vocab_size, np.int64)
    for r in rows:
        total[r["id"]] = r["n"]
    return np.lexsort((np.arange(vocab_size), -total)).astype(np.uint32)


def write_token_ids(docs: DataFrame, path: str, tokenizer_path: str) -> None:
    """Write ``ranks.bin`` and the shards of ``docs`` (doc_id, text) below ``path``.

    A task writes its documents in order into files of about ``FILE_BYTES`` under a temporary name and
    renames them; the content depends on the rows only, so a repeated task writes the same files."""
    vocab_size = tokenizer(tokenizer_path).vocab_size
    rows = tokenized(docs, tokenizer_path)
    ids = frequency_ranks(rows, vocab_size)
    store, root = filesystem(path)
    store.create_dir(root)
    with store.open_output_stream(f"{root}/ranks.bin") as f:
        f.write(ids.astype("<u4").tobytes())
    rank = np.empty(len(ids), np.uint32)
    rank[ids] = np.arange(len(ids), dtype=np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast(rank)

    def write(batches):
        store, root = filesystem(path)
        rank, part, kind = shared.value, TaskContext.get().partitionId(), id_type(vocab_size)
        names, held, load, size, out, temp = [], [], 0, 0, None, ""

        def flush():
            nonlocal size, held, load
            all_ids = np.frombuffer(b"".join(x for _, x in held), kind)
            width = all_ids.dtype.itemsize
            block = pack_block([d for d, _ in held], [len(x) // width for _, x in held], rank[all_ids])
            out.write(block)
            size, held, load = size + len(block), [], 0

        def close():
            nonlocal out, size
            if held:
                flush()
            out.close()
            names.append(f"{root}/shard-{part:08d}-{len(names):05d}.tids")
            store.move(temp, names[-1])
            out, size = None, 0
        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), b.column(1)):
                if out is None:
                    temp = f"{root}/.{uuid.uuid4().hex}.tmp"
                    out = store.open_output_stream(temp)
                held.append((d, x.as_py()))
                load += len(held[-1][1])
                if load >= BLOCK_BYTES:
                    flush()
                    if size >= FILE_BYTES:
                        close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["file"])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, "doc_id", "k").sortWithinPartitions("doc_id", "k", "ids")
    dealt.select("doc_id", "ids").mapInArrow(write, "file string").agg(F.count("*")).collect()


def read_token_ids(spark, path: str) -> DataFrame:
    """(file, number, doc_id, n_tokens, ids_crc32, ids) of every document of the shards below ``path``."""
    store, root = filesystem(path)
    with store.open_input_stream(f"{root}/ranks.bin") as f:
        ids = spark.sparkContext.broadcast(np.frombuffer(f.read(), "<u4"))

    def decode(batches):
        for b in batches:
            for i in range(b.num_rows):
                file, number = b.column(0)[i].as_py().rsplit("/", 1)[-1], 0
                for doc, null, counts, ranks in read_blocks(b.column(1)[i].as_py()):
                    raw = ids.value[ranks].astype("<u4").tobytes()
                    ends = np.cumsum(counts) * 4
                    parts = [raw[z - 4 * c:z] for z, c in zip(ends.tolist(), counts.tolist())]
                    m = len(doc)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file] * m), pa.array(np.arange(number, number + m)),
                         pa.array(doc, mask=null), pa.array(counts),
                         pa.array([zlib.crc32(x) for x in parts], pa.int64()), pa.array(parts, pa.binary())],
                        names=["file", "number", "doc_id", "n_tokens", "ids_crc32", "ids"])
                    number += m
    kind = "file string, number long, doc_id long, n_tokens long, ids_crc32 long, ids binary"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tids").schema(
        "path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select("path", "content").mapInArrow(decode, kind)


def token_id_digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the files, read them back: doc_id, start, n_tokens, ids_crc32 per document.

    ``start`` is a sum over the files before (a row each) plus a running sum inside the file."""
    spark = docs.sparkSession
    path = shared_path(spark, "token-ids")
    write_token_ids(docs, path, tokenizer_path)
    rows = read_token_ids(spark, path).drop("ids")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("size"))
    before = files.select("file", (F.sum("size").over(Window.orderBy("file")) - F.col("size")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("number")) - F.col("n_tokens")
    return rows.withColumn("inside", inside).join(before, "file").select(
        "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
