"""Streaming = batch, and the docx ingest job."""
import io
import os
import tempfile
import zipfile

from pyspark.sql import functions as F

from docfields.sources import fixtures as FX
from docfields.sources.ingest import ingest_docx, stream_ingest
from docfields.streaming import chat as C

from conftest import SF

DOCX_XML = """<?xml version="1.0" encoding="UTF-8"?>
<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>
<w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t>world</w:t></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>A</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>B</w:t></w:r></w:p></w:tc></w:tr>
<w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p><w:p><w:r><w:t>2</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>
<w:p><w:r><w:t>End</w:t></w:r></w:p></w:body></w:document>"""


def _write_docx(path):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", DOCX_XML)
    with open(path, "wb") as f:
        f.write(buf.getvalue())


def test_ingest_docx(spark):
    d = tempfile.mkdtemp(prefix="docfields-ingest-")
    _write_docx(os.path.join(d, "a.docx"))
    with open(os.path.join(d, "bad.docx"), "wb") as f:
        f.write(b"not a zip")
    rows = {os.path.basename(r.path): r for r in ingest_docx(spark, d).collect()}
    assert rows["a.docx"].text == "Hello world\n| A | B |\n| 1 2 |  |\nEnd"
    assert len(rows["a.docx"].cells) == 4 and rows["a.docx"].cells[2].paras == ["1", "2"]
    assert rows["bad.docx"].ok is False and rows["bad.docx"].cells == []
    out = stream_ingest(spark, d, os.path.join(d, "out"), os.path.join(d, "ckpt"))
    assert out.count() == 2


def test_fold_stream_equals_batch(spark):
    from docfields.plans.q_stream import r2_fold_messages, r2_fold_messages_stream

    a = r2_fold_messages(spark, SF)
    b = r2_fold_messages_stream(spark, SF)
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


def test_parse_frames_remainder(spark):
    df = spark.createDataFrame([('data: {"type": "token", "content": "a"}\n\ndata: {bad\n\ndata: {"ty',)], "chunk string")
    got = C.parse_frames(df).collect()
    assert [(r.type, r.content) for r in got] == [("token", "a")]
    assert df.select(C.remainder().alias("r")).first().r == 'data: {"ty'


def test_entry_smoke(spark):
    import __spark_entry__ as E

    out = E.entry(spark)
    assert out.count() >= 0 and "field_key" in out.columns
