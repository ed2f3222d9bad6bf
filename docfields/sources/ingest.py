"""S3 document ingest: files in a folder -> (path, text, tables) rows.

Spark lists and reads the files (``binaryFile``, splittable over many executors);
each Arrow batch is parsed with a small standard-library zip/XML reader inside
``mapInPandas``.  Unreadable files give empty text and no tables instead of failing
the job.  Text clean-up (S4) and table shaping stay native Spark expressions.
"""
from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from docfields.functions.text import cell_text, clean_markdown, py_strip
from docfields.sources.arrivals import run_batches

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
INGEST_SCHEMA = Ty.StructType([
    Ty.StructField("path", Ty.StringType()),
    Ty.StructField("raw_text", Ty.StringType()),
    Ty.StructField("ok", Ty.BooleanType()),
    Ty.StructField("cells", Ty.ArrayType(Ty.StructType([
        Ty.StructField("table_index", Ty.IntegerType()), Ty.StructField("row", Ty.IntegerType()),
        Ty.StructField("col", Ty.IntegerType()), Ty.StructField("paras", Ty.ArrayType(Ty.StringType()))]))),
])


#: Elements of the XML that stand for a character, and containers that are read apart or not at all.
_MARKS = {f"{W}t": None, f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n", f"{W}noBreakHyphen": "-"}
_APART = {f"{W}txbxContent", "{http://schemas.openxmlformats.org/markup-compatibility/2006}Fallback"}


def _said(node) -> Iterator[str]:
    """The characters of a paragraph in order; text boxes in it are read apart."""
    for child in node:
        if child.tag in _APART:
            continue
        if child.tag in _MARKS:
            yield _MARKS[child.tag] or child.text or ""
        else:
            yield from _said(child)


def _boxes(node) -> Iterator:
    """Paragraphs of the text boxes below ``node``; the fallback copy of a box is skipped."""
    for child in node:
        if child.tag == f"{W}txbxContent":
            yield from child.iter(f"{W}p")
        elif child.tag not in _APART:
            yield from _boxes(child)


def _paragraph(p) -> str:
    return "".join(_said(p))


def parse_docx(content: bytes):
    """Text (page headers first, tables as '| a | b |' lines, text boxes behind their paragraph, tabs and line
    breaks kept) and the long cell list of one .docx.  Members of the archive are opened one at a time."""
    import io
    import xml.etree.ElementTree as ET
    import zipfile

    lines, cells, t_idx = [], [], 0
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in sorted(n for n in z.namelist() if re.fullmatch(r"word/header[0-9]*\.xml", n)):
            with z.open(name) as part:
                lines += [t for t in map(_paragraph, ET.parse(part).iter(f"{W}p")) if t.strip()]
        with z.open("word/document.xml") as part:
            body = ET.parse(part).getroot().find(f"{W}body")
    for child in list(body) if body is not None else []:
        if child.tag == f"{W}p":
            lines.append(_paragraph(child))
            lines += [_paragraph(p) for p in _boxes(child)]
        elif child.tag == f"{W}tbl":
            for r_idx, tr in enumerate(child.findall(f"{W}tr")):
                paras = [[_paragraph(p) for p in tc.findall(f"{W}p")] for tc in tr.findall(f"{W}tc")]
                cells += [(t_idx, r_idx, c_idx, p) for c_idx, p in enumerate(paras)]
                lines.append("| " + " | ".join(" ".join(x.strip() for x in p if x.strip()) for p in paras) + " |")
            t_idx += 1
    return "\n".join(lines), cells


def _parse_batches(batches):
    import pandas as pd

    for pdf in batches:
        out = []
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                text, cells = parse_docx(bytes(content))
                out.append((path, text, True, [dict(table_index=t, row=r, col=c, paras=p) for t, r, c, p in cells]))
            except Exception:  # noqa: BLE001 - an unreadable file yields no text/tables
                out.append((path, "", False, []))
        yield pd.DataFrame(out, columns=["path", "raw_text", "ok", "cells"])


def parse_files(files: DataFrame) -> DataFrame:
    """files: binaryFile rows (path, content, ...) -> (path, text, ok, cells)."""
    parsed = files.select("path", "content").mapInPandas(_parse_batches, INGEST_SCHEMA)
    return parsed.withColumn("text", clean_markdown("raw_text")).drop("raw_text")


def document_cells(parsed: DataFrame, key: str = "path") -> DataFrame:
    """The long cells (doc_id, table_index, row, col, paras, display) of parsed files."""
    return parsed.select(F.col(key).alias("doc_id"), F.inline("cells")).withColumn("display", cell_text("paras"))


def document_tables(parsed: DataFrame, key: str = "path") -> DataFrame:
    """S3 -> N1: parsed files with their nested tables (null where a file has none)."""
    from docfields.operators.tables import assemble_tables

    nested = assemble_tables(document_cells(parsed, key)).withColumnRenamed("doc_id", key)
    return parsed.drop("cells").join(nested, key, "left")


def ingest_docx(spark: SparkSession, path: str) -> DataFrame:
    """S3: every ``*.docx`` under ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx") \
        .option("recursiveFileLookup", "true").load(path)
    return parse_files(files)


def upsert_stream(stream: DataFrame, parse: Callable[[DataFrame], DataFrame], keys: list[str], out: str,
                  checkpoint: str, order: str | None = None) -> DataFrame:
    """Rows that arrive are parsed in the background; ``parse`` returns the keys, the result and ``ok``.

    Micro-batch n overwrites the folder ``batch=n`` of the table ``out``: the batch number is its commit marker,
    and a batch that is repeated leaves the same rows.  Of every key the latest row that could be read
    counts (by batch, inside one by the column ``order``); one that never could be read stays pending
    (``ok = false``).  Returns that state."""
    parsed = parse(stream)
    rows = run_batches(parsed, out, checkpoint, mode="append")
    best = F.struct("ok", "batch", *([order] if order else []))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*parsed.columns), best).alias("row")).select("row.*")


def stream_ingest(spark: SparkSession, src: str, out: str, checkpoint: str) -> DataFrame:
    """R4 over docx files: one row a path.  ``availableNow`` runs over what is there and stops."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.docx").load(src)
    return upsert_stream(stream, parse_files, ["path"], out, checkpoint)


def pending(docs: DataFrame, cache: DataFrame, keys: list[str], now: Column, ttl_seconds: int) -> DataFrame:
    """R4 batch form: documents whose text is blank and that no fresh cache row covers.
    cache: (keys, stored_at)."""
    fresh = cache.where(F.col("stored_at") > now - F.make_dt_interval(secs=F.lit(ttl_seconds))).select(*keys)
    blank = F.length(py_strip(F.coalesce("text", F.lit("")))) == 0
    return docs.where(blank).join(fresh, keys, "left_anti")
