"""Long inputs, callables and mutations that the table queries do not reach."""
import itertools
import time

import pytest
from pyspark.sql import functions as F

from docfields.functions import text as T
from docfields.operators import fields as FLD
from docfields.operators import lifecycle as LC
from docfields.operators import locate as L
from docfields.operators import report as RP


def test_running_starts_any_length(spark):
    rows = [(n, [(7 * i) % 11 for i in range(n)]) for n in (0, 1, 2, 3, 4, 5, 15, 16, 17, 100, 101, 1000)]
    df = spark.createDataFrame(rows, "n int, l array<int>")
    for r in df.select("l", T.running_starts("l").alias("s")).collect():
        assert list(r.s) == [0, *itertools.accumulate(r.l)][:len(r.l)]


def test_line_offsets_of_a_long_document(spark):
    text = "\n".join("x" * (i % 5) for i in range(100_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    t0 = time.time()
    got = L.explode_lines(df).agg(F.count(F.lit(1)), F.max("line_start"), F.sum("line_start")).first()
    took = time.time() - t0
    starts = [0, *itertools.accumulate(i % 5 + 1 for i in range(99_999))]
    assert tuple(got) == (100_000, starts[-1], sum(starts))
    assert took < 15


def test_anchor_form_equals_broadcast_form(spark):
    docs = spark.createDataFrame([(None, "aaa bb ccc dd\nbb"), (2, "aaa  bb ccc aaaa\n\nbb bb"), (3, None), (4, "")],
                                 "doc_id long, text string")
    refs = spark.createDataFrame([(1, "aa"), (2, "a bb ccc a"), (3, "b"), (4, ""), (5, "  "), (6, "bb ccc dd"), (7, "bb")],
                                 "ref_id int, ref string")
    a, b = (sorted(map(repr, L.locate(docs, refs, strategy=s).collect())) for s in ("broadcast", "anchor"))
    assert a == b and len(a) > 10


def test_callable_sees_every_window_of_the_text(spark):
    text = "a" * 29_000 + " END=42 " + "b" * 1_000

    def extractor(name, part, instructions):
        if "boom" in part:
            raise ValueError("no answer")
        if name == "schema":
            return {"$schema": "x", "properties": {"k": {"label": "K", "references": ["v"]}}}
        refs = ["END=42"] if "END=42" in part else []
        return 'text {"f": {"label": "F", "references": ' + str([part[0], *refs]).replace("'", '"') + '}, "odd": 3} tail'

    docs = spark.createDataFrame([("w", 1, "n", text), ("w", 2, "n", "boom"), ("w", 3, "schema", "t")],
                                 "workspace_id string, doc_id long, name string, text string")
    got = {r.doc_id: r for r in FLD.extract_fields_udf(docs, extractor, fuzzy=False).collect()}
    assert set(got) == {1, 3}
    assert "END=42" in got[1].refs and got[1].refs[0] == "a" and got[1].field_key == "f"
    assert (got[3].field_key, got[3].label, got[3].refs) == ("k", "K", ["v"])


def test_instructions_and_paths_are_hashed_whole(spark):
    d = spark.createDataFrame([("w", 1, "a", "t", "p")], "workspace_id string, doc_id long, name string, text string, path string")
    long = "i" * 600
    digests = {LC.fingerprint(d, instructions=i, paths_col=p).first()["fingerprint"]
               for i in (long + "1", long + "2") for p in (None, "path")}
    assert len(digests) == 4
    import hashlib
    assert hashlib.sha256(("a:tdocx:puser_instructions:" + long).encode()).hexdigest() == \
        LC.fingerprint(d, instructions=f" {long} ", paths_col="path").first()["fingerprint"]


def test_revoke(spark):
    k = spark.createDataFrame([(1, "x", "active"), (1, "y", "active"), (2, "x", "active")],
                              "user_id int, provider string, status string")
    got = {(r.user_id, r.provider): r.status for r in LC.revoke(k, 1, "x").collect()}
    assert got == {(1, "x"): "revoked", (1, "y"): "active", (2, "x"): "active"}
    with pytest.raises(ValueError):
        LC.revoke(k, 3, "x")


def test_row_numbers_follow_the_order(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5003).alias("v"))
    rows = RP.number_rows(df, [F.col("v").desc()], col="n").collect()
    assert [r.n for r in sorted(rows, key=lambda r: -r.v)] == list(range(1, 5001))
    assert RP.number_rows(df.limit(0), [F.col("v")], col="n").count() == 0


def test_missing_columns_come_from_the_first_document_that_names_them(spark):
    docs = spark.createDataFrame([("w", 2, "Email: b@x\nPhone: 1"), ("w", 1, "no\n  EMAIL : a@x "), ("w", 3, None)],
                                 "workspace_id string, doc_id long, text string")
    miss = spark.createDataFrame([("w", "Email"), ("w", "Phone"), ("w", "Other"), ("v", "Email")],
                                 "workspace_id string, column string")
    got = {(r.workspace_id, r.column): r.value for r in RP.resolve_from_docs(docs, miss).collect()}
    assert got == {("w", "Email"): "a@x", ("w", "Phone"): "1", ("w", "Other"): None, ("v", "Email"): None}
