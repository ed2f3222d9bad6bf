"""WARC archives compressed with Zstandard, one frame per record.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary all its
record frames need, itself Zstandard-compressed; the dictionary is trained on the first
``SAMPLE`` payloads of the archive (a bound, whatever the archive holds).  The reader loads it,
walks the block headers of each frame to find where it ends, decodes one frame per record, and
checks the version line, mandatory headers, Content-Length, block digest and the closing blank
lines.  A broken record is reported with its error and reading goes on at the next frame.

Defined results: null html = an empty payload; rows that repeat a page are pages of their own and
keep the role of their id; null page ids never become the response of a group that has an id;
blank or odd characters of a url are percent-encoded; an empty table gives no rows; payloads of
any length are written whole; other columns are not read.
"""
from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.llm.common import shared_path, write_table
from docfields.llm.token_ids import filesystem

DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
MIN_REVISIT = 100
SAMPLE, DICT_BYTES, LEVEL = 256, 32 << 10, 3
FILE_BYTES = 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # fixed: pages carry no fetch time, and archives must not vary by run
RECORD = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, "
          "payload_digest string, error string")


def record_bytes(page_id, url, payload: bytes, kind: str, refers_to, digest_hex: str, size: int) -> bytes:
    name = "null" if page_id is None else str(page_id)
    b32 = base64.b32encode(bytes.fromhex(digest_hex)).decode()
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{name}>"), ("WARC-Date", DATE),
            ("WARC-Target-URI", quote(url or "about:blank", safe="!#$%&'()*+,/:;=?@[]~-._")),
            ("WARC-Payload-Digest", f"sha256:{b32}")]
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>"),
                 ("X-Payload-Length", str(size))]
        payload = b""
    block = base64.b32encode(hashlib.sha256(payload).digest()).decode()
    head += [("WARC-Block-Digest", f"sha256:{block}"), ("Content-Type", "text/html"),
             ("Content-Length", str(len(payload)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + payload + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers and block of one record; raises ValueError on anything out of form."""
    top, sep, rest = raw.partition(b"\r\n\r\n")
    lines = top.decode("utf-8").split("\r\n")
    if not sep or not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC version line")
    head = {}
    for x in lines[1:]:
        k, colon, v = x.partition(":")
        if not colon:
            raise ValueError("header without a colon")
        head[k.strip().lower()] = v.strip()
    for k in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if k not in head:
            raise ValueError(f"missing {k}")
    n = int(head["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("Content-Length does not fit")
    block = rest[:n]
    if "warc-block-digest" in head and head["warc-block-digest"] != "sha256:" + base64.b32encode(
            hashlib.sha256(block).digest()).decode():
        raise ValueError("block digest does not fit")
    return head | {"block": block}


def frame_end(buf: bytes, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, from its block headers."""
    if len(buf) - at < 6:
        raise ValueError("truncated frame")
    info = zstandard.get_frame_parameters(buf[at:at + 18])
    pos = at + zstandard.frame_header_size(buf[at:at + 18])
    while True:
        if pos + 3 > len(buf):
            raise ValueError("truncated block")
        h = int.from_bytes(buf[pos:pos + 3], "little")
        pos += 3 + (1 if h >> 1 & 3 == 1 else h >> 3)
        if h & 1:
            break
    pos += 4 * bool(info.has_checksum)
    if pos > len(buf):
        raise ValueError("truncated frame")
    return pos


class ArchiveWriter:
    def __init__(self, sink, samples: list[bytes]):
        self.sink, self.size = sink, 0
        data = b""
        if sum(map(len, samples)) >= 8 * 1024 and len(samples) >= 8:
            try:
                data = zstandard.train_dictionary(DICT_BYTES, samples, level=LEVEL).as_bytes()
            except zstandard.ZstdError:  # too little in common: an archive without a dictionary
                data = b""
        self.comp = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(data) if data else None,
                                             write_checksum=True, write_content_size=True)
        if data:
            body = zstandard.ZstdCompressor(level=LEVEL).compress(data)
            self._put(struct.pack("<II", DICT_MAGIC, len(body)) + body)

    def _put(self, x: bytes):
        self.sink.write(x)
        self.size += len(x)

    def write(self, record: bytes):
        self._put(self.comp.compress(record))


def read_archive(buf: bytes):
    """(header dict with ``block``) or (error text) per frame of an archive."""
    at, decoder = 0, zstandard.ZstdDecompressor()
    if len(buf) >= 8 and struct.unpack_from("<I", buf)[0] == DICT_MAGIC:
        n = struct.unpack_from("<I", buf, 4)[0]
        data = buf[8:8 + n]
        if data[:4] == struct.pack("<I", FRAME_MAGIC):
            data = zstandard.ZstdDecompressor().decompress(data, max_output_size=16 << 20)
        decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))
        at = 8 + n
    while at < len(buf):
        if 0x184D2A50 <= struct.unpack_from("<I", buf.ljust(at + 4, b"\0"), at)[0] <= 0x184D2A5F:
            at += 8 + struct.unpack_from("<I", buf, at + 4)[0]
            continue
        try:
            end = frame_end(buf, at)
        except (ValueError, zstandard.ZstdError) as e:
            yield f"{e}"
            return  # no later frame can be found
        try:
            yield parse_record(decoder.decompress(buf[at:end]))
        except (ValueError, zstandard.ZstdError, UnicodeDecodeError) as e:
            yield f"{e}"
        at = end


def with_roles(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                     payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"),
                     F.sha2(payload, 256).alias("payload_digest"))
    first = p.where(F.col("payload_bytes") >= MIN_REVISIT).groupBy("payload_digest", "payload_bytes").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select(
        "payload_digest", "payload_bytes", "first")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return p.join(first, ["payload_digest", "payload_bytes"], "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str) -> list[str]:
    """Write ``*.warc.zst`` archives below ``path`` (one or more a task, renamed when complete) and return the
    names of those that count.  Every attempt of a task names its files anew; the names of the attempt that Spark
    took are the manifest, so files of a repeated or lost attempt are never read."""
    store, root = filesystem(path)
    store.create_dir(root)

    def write(batches):
        store, root = filesystem(path)
        part, number, names = f"{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}", 0, []
        out = writer = None
        temp = ""

        def close():
            nonlocal out, writer, number
            out.close()
            names.append(f"{root}/pages-{part}-{number:05d}.warc.zst")
            store.move(temp, names[-1])
            out = writer = None
            number += 1
        for b in batches:
            cols = [b.column(c) for c in ("page_id", "url", "payload", "record_type", "refers_to", "payload_digest",
                                          "payload_bytes")]
            for i in range(b.num_rows):
                if writer is None:
                    temp = f"{root}/.{uuid.uuid4().hex}.tmp"
                    out = store.open_output_stream(temp)
                    samples = [x.as_py()[:DICT_BYTES] for x in b.column("payload").slice(i, SAMPLE)]
                    writer = ArchiveWriter(out, [x for x in samples if x])
                writer.write(record_bytes(*(c[i].as_py() for c in cols)))
                if writer.size >= FILE_BYTES:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([n.rsplit("/", 1)[1] for n in names], pa.string())], names=["file"])
    done = write_table(with_roles(pages).mapInArrow(write, "file string"), "warc-manifest")
    return [f"{path.rstrip('/')}/{r['file']}" for r in done.collect()]  # one name an archive, as in Spark's own listing


def _page(urn: str | None):
    x = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return None if x in ("", "null") else int(x)


def read_archives(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per record of the archives below ``path``, or of the given archives; ``error`` tells why a record
    was refused."""
    def read(batches):
        for b in batches:
            for i in range(b.num_rows):
                rows = []
                for r in read_archive(b.column(0)[i].as_py()):
                    if isinstance(r, str):
                        rows.append((None, None, None, None, None, None, r))
                        continue
                    kind, block = r["warc-type"], r["block"]
                    said = base64.b32decode(r["warc-payload-digest"].removeprefix("sha256:")).hex()
                    size, error = len(block), None
                    if kind == "revisit":
                        size = int(r["x-payload-length"])
                    elif hashlib.sha256(block).hexdigest() != said:
                        error = "payload digest does not fit"
                    rows.append((_page(r["warc-record-id"]), r.get("warc-target-uri"), kind,
                                 _page(r.get("warc-refers-to")), size, said, error))
                if rows:
                    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                     names=[x.split()[0] for x in RECORD.split(", ")])
    if not path:
        return spark.createDataFrame([], RECORD)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").schema(
        "path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select("content").mapInArrow(read, RECORD)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, error."""
    path = shared_path(pages.sparkSession, "warc")
    return read_archives(pages.sparkSession, write_archives(pages, path)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")
