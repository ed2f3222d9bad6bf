"""Streams over several micro-batches, corpus-wide fuzzy de-duplication, callables, sinks, ids of any size."""
import io
import os
import random
import tempfile
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docfields.functions import text as T
from docfields.operators import fields as FLD
from docfields.operators import fuzzy
from docfields.operators import locate as L
from docfields.operators import report as RP
from docfields.sources import ingest
from docfields.sources.arrivals import arrival_stream, write_arrivals
from docfields.streaming import chat as C

from conftest import SF


# ----------------------------------------------------------------------------- streams
def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_arrivals_keep_order(spark):
    d = tempfile.mkdtemp(prefix="docfields-arrivals-")
    df = spark.range(100).select(F.col("id").alias("seq"), (F.col("id") % 3).alias("k"))
    assert write_arrivals(df, "seq", "k", d, 4) == 1
    files = sorted((os.path.getmtime(os.path.join(d, f)), f) for f in os.listdir(d) if f.endswith(".parquet"))
    seen = [spark.read.parquet(os.path.join(d, f)).agg(F.min("seq"), F.max("seq")).first() for _, f in files]
    assert [tuple(r) for r in seen] == [(0, 24), (25, 49), (50, 74), (75, 99)]
    empty = tempfile.mkdtemp(prefix="docfields-arrivals-")
    assert write_arrivals(df.limit(0), "seq", "k", empty, 2) == 1


@pytest.mark.parametrize("name", ["R1_parse_frames_stream", "R2_fold_messages_stream", "R3_activity_stream", "Q6_chat_stream"])
def test_streams_take_several_batches(spark, name, monkeypatch):
    """One micro-batch or five: the same rows."""
    from docfields.plans import load_all, q_stream

    run = load_all()[0][name]
    monkeypatch.setattr(q_stream, "ARRIVALS", 1)
    one = rows_of(run(spark, SF))
    monkeypatch.setattr(q_stream, "ARRIVALS", 5)
    assert rows_of(run(spark, SF)) == one and one


def test_r3_stream_equals_batch(spark):
    from docfields.plans import load_all

    q = load_all()[0]
    assert rows_of(q["R3_activity"](spark, SF)) == rows_of(q["R3_activity_stream"](spark, SF))


def test_frame_split_across_batches(spark):
    frames = [(1, 0, 'data: {"type": "tok'), (1, 1, 'en", "content": "a"}\n'), (1, 2, '\n: ping\n\ndata: {bad}\n\ndata: 7\n\nda'),
              (1, 3, 'ta: {"type": "error",\ndata: "content": "x"}\n\ndata: {"never')]
    chunks = spark.createDataFrame(frames, "thread_id long, chunk_no long, chunk string")
    stream = arrival_stream(chunks, "chunk_no", "thread_id", 4, "test")
    d = tempfile.mkdtemp(prefix="docfields-frames-")
    from docfields.sources.arrivals import run_batches

    out = run_batches(C.frames_stream(stream), f"{d}/out", f"{d}/ckpt", mode="append")
    assert [tuple(r)[:4] for r in out.orderBy("pos").collect()] == [(1, 0, "token", "a"), (1, 1, "error", "x")]
    assert out.select("batch").distinct().count() == 2


def test_response_fold():
    r = C.FRESH
    for kind, content in [("token", "lost"), ("thinking", " a "), ("thinking", "a"), ("tool_start", "t"), ("token", "x"),
                          ("tool_start", ""), ("token", None), ("tool_end", "t"), ("error", "no"), ("done", None), ("thinking", " ")]:
        r = C._apply(r, kind, content)
    assert (r["text"], r["n_tokens"], r["n_hints"], r["error"]) == ("x", 2, 1, "no")
    assert r["open"] == ["thinking:a", "tool_start:Calling tool"] and C.FRESH["open"] == []


def _docx(text, headers=()):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f'<w:document {w} xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006">'
                                        f"<w:body>{text}</w:body></w:document>")
        for i, h in enumerate(headers):
            z.writestr(f"word/header{i + 1}.xml", f"<w:hdr {w}><w:p><w:r><w:t>{h}</w:t></w:r></w:p></w:hdr>")
    return buf.getvalue()


def _write(folder, name, data):
    with open(os.path.join(folder, name), "wb") as f:
        f.write(data)


def test_ingest_is_an_upsert(spark):
    d = tempfile.mkdtemp(prefix="docfields-upsert-")
    src, out = os.path.join(d, "in"), os.path.join(d, "out")
    os.makedirs(src)
    _write(src, "a.docx", _docx("<w:p><w:r><w:t>one</w:t></w:r></w:p>"))
    _write(src, "bad.docx", b"no archive")
    state = lambda df: {os.path.basename(r.path): (r.ok, r.text) for r in df.collect()}
    first = state(ingest.stream_ingest(spark, src, out, os.path.join(d, "c1")))
    assert first == {"a.docx": (True, "one"), "bad.docx": (False, "")}
    # the same batch again, as after a failure before its commit: the same rows
    assert state(ingest.stream_ingest(spark, src, out, os.path.join(d, "c2"))) == first
    _write(src, "b.docx", _docx("<w:p><w:r><w:t>two</w:t></w:r></w:p>"))
    assert state(ingest.stream_ingest(spark, src, out, os.path.join(d, "c2"))) == {**first, "b.docx": (True, "two")}


def test_docx_parts_and_tables(spark):
    body = ('<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c</w:t></w:r><w:r><mc:AlternateContent><mc:Choice>'
            '<w:txbxContent><w:p><w:r><w:t>box</w:t></w:r></w:p></w:txbxContent></mc:Choice><mc:Fallback><w:txbxContent>'
            '<w:p><w:r><w:t>box</w:t></w:r></w:p></w:txbxContent></mc:Fallback></mc:AlternateContent></w:r></w:p>'
            '<w:tbl><w:tr><w:tc><w:p><w:r><w:t>H1</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr>'
            '<w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl>')
    d = tempfile.mkdtemp(prefix="docfields-parts-")
    _write(d, "t.docx", _docx(body, ["Page head"]))
    _write(d, "plain.docx", _docx("<w:p><w:r><w:t>none</w:t></w:r></w:p>"))
    rows = {os.path.basename(r.path): r for r in ingest.document_tables(ingest.ingest_docx(spark, d)).collect()}
    assert rows["t.docx"].text == "Page head\na\tb\nc\nbox\n| H1 |  |\n| x y |"
    t = rows["t.docx"].tables
    assert len(t) == 1 and (t[0]["rows"], t[0]["columns"]) == (2, 2)
    assert t[0]["preview"] == [["H1", ""], ["x\ny"]] and t[0]["paragraphs"] == [[["H1"], [""]], [["x", "y"]]]
    assert rows["plain.docx"].tables is None


# ----------------------------------------------------------------------------- U3
def test_similarities_are_exact():
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcé\U0001F600") for _ in range(n))
    pairs = [(word(rng.randrange(0, 90)), word(rng.randrange(0, 90))) for _ in range(300)] + [("", ""), ("a", "")]
    got = fuzzy.similarities(pd.Series([a for a, _ in pairs]), pd.Series([b for _, b in pairs]))
    assert got.tolist() == pytest.approx([fuzzy.similarity(a, b) for a, b in pairs])


@pytest.mark.parametrize("threshold", [85, 60, 95])
def test_fuzzy_table_equals_the_list_rule(spark, threshold):
    rng = random.Random(threshold)
    base = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 30))) for _ in range(25)]
    refs = []
    for _ in range(160):
        r = list(rng.choice(base))
        for _ in range(rng.randrange(0, 4)):
            r[rng.randrange(len(r))] = rng.choice("abcdefghz")
            if rng.random() < 0.3:
                r.insert(rng.randrange(len(r) + 1), rng.choice("xyz"))
        refs.append("".join(r))
    rows = [("k" if i % 2 else "j", i, r) for i, r in enumerate(refs)] + [("k", 500, None), ("k", 501, ""), ("j", 502, refs[0])]
    df = spark.createDataFrame(rows, "scope string, seq long, ref string")
    got = {s: sorted(r["ref"] for r in fuzzy.fuzzy_dedupe_table(df, threshold, ["scope"]).where(F.col("scope") == s).collect())
           for s in ("j", "k")}
    for s in got:
        assert got[s] == sorted(fuzzy.fuzzy_dedupe([r for k, _, r in rows if k == s and r is not None], threshold))
    assert fuzzy.fuzzy_dedupe_table(df.limit(0), threshold).count() == 0


def test_fuzzy_corpus_query_equals_all_pairs(spark):
    from docfields.plans import load_all
    from docfields.plans.q_fields import doc_fields
    from docfields.sources import fixtures as FX

    sf = SF.replace("0.001", "0.01")
    lists = {}
    for r in doc_fields(spark, sf).orderBy("seq").collect():
        lists.setdefault((r["workspace_id"], r["field_key"]), []).extend(r["refs"])
    want = sorted((*k, r) for k, refs in lists.items() for r in fuzzy.fuzzy_dedupe(refs, 85))
    got = load_all()[0]["U3_fuzzy_corpus"](spark, sf).drop("seq")
    assert rows_of(got) == sorted(want, key=str) and want
    lines = FX.refs_many(spark, SF)
    kept = fuzzy.fuzzy_dedupe([r["ref"] for r in lines.orderBy("ref_id").collect()], 85)
    assert sorted(r["ref"] for r in fuzzy.fuzzy_dedupe_table(lines, 85, order="ref_id").collect()) == sorted(kept) and len(kept) < lines.count()


# ----------------------------------------------------------------------------- ids, lineage, callables, sinks
def test_ids_of_any_size(spark):
    top = 2**62 + 5
    d = spark.createDataFrame([("w", top, "n", "mail a@b.org " * 8), ("w", top + 1, "n", "mail c@b.org a@b.org " * 8)],
                              "workspace_id string, doc_id long, name string, text string")
    fields = FLD.extract_fields_rules(d)
    m = FLD.merge_fields(fields).collect()
    assert [(r["refs"], r["source_docs"]) for r in m] == [(["a@b.org", "c@b.org"], [top, top + 1])]
    got = FLD.extract_fields_udf(d, lambda n, t, i: {"k": {"label": "K", "references": [t[5:12]]}}, fuzzy=False)
    assert FLD.merge_fields(got).first()["refs"] == ["a@b.org", "c@b.org"]


def test_long_lineage_equals_arrays(spark):
    from docfields.plans.q_fields import doc_fields
    from docfields.sources import fixtures as FX

    d = doc_fields(spark, SF)
    docs = FX.documents(spark, SF)
    m = FLD.merge_fields(d)
    a, la = L.field_locations(m, docs)
    b, lb = L.field_locations_long(FLD.merge_fields(d, sources=False), FLD.field_lineage(d), docs)
    cols = ["workspace_id", "field_key", "frequency"]
    assert rows_of(a.select(cols)) == rows_of(b.select(cols))
    at = ["workspace_id", "field_key", "doc_id", "ref", "line_index", "char_start"]
    assert rows_of(la.select(at)) == rows_of(lb.select(at))
    # a field without lineage is looked for in all documents of its workspace
    free, _ = L.field_locations_long(FLD.merge_fields(d, sources=False), FLD.field_lineage(d).limit(0), docs)
    assert free.agg(F.sum("frequency")).first()[0] >= b.agg(F.sum("frequency")).first()[0]
    one, long = FLD.reattach_lineage_long(m.drop("source_docs"), m, FLD.field_lineage(d))
    whole = FLD.reattach_lineage(m.select("workspace_id", "field_key", "label", "refs", "seq"), m)
    pick = ["workspace_id", "field_key", "doc_frequency", "n_source_docs", "source_docs"]
    assert rows_of(FLD.sources_of(one, long).select(pick)) == rows_of(whole.select(pick))


def test_callable_batches_and_failures(spark):
    asked = spark.createDataFrame([(i, f"c{i}", [("x", "hint"), ("y", None)]) for i in range(10)] + [(99, None, [("x", None)])],
                                  "k long, context string, columns array<struct<name:string,description:string>>")

    def fn(requests):
        if len(requests) > 1 and any(r.context == "c3" for r in requests):
            raise RuntimeError("the batch fails")
        if requests[0].context == "c5":
            raise RuntimeError("and so does one request")
        return [{"x": f" {r.context} ", "y": "" if r.columns[0][1] else 3} for r in requests]
    got = {(r["k"], r["column"]): r["value"] for r in RP.ask(asked, fn, ["k"], batch=4).collect()}
    assert len(got) == 21
    assert all(got[i, "x"] == (None if i == 5 else f"c{i}") and got[i, "y"] is None for i in range(10)) and got[99, "x"] is None
    short = {r["value"] for r in RP.ask(asked, lambda r: [], ["k"]).collect()}
    assert short == {None}


def test_document_resolver(spark):
    docs = spark.createDataFrame([("w", 1, "nothing"), ("w", 2, "two"), ("w", 3, "three"), ("v", 4, "four")],
                                 "workspace_id string, doc_id long, text string")
    missing = spark.createDataFrame([("w", "A"), ("v", "A"), ("w", "B")], "workspace_id string, column string")
    hints = spark.createDataFrame([("A", "say it", 1)], "name string, description string, order int")

    def fn(requests):
        return [{"A": r.context if r.context in ("two", "three") and dict(r.columns)["A"] == "say it" else None} for r in requests]
    got = {(r["workspace_id"], r["column"]): r["value"] for r in RP.document_resolver(fn, hints)(docs, missing).collect()}
    assert got == {("w", "A"): "two", ("v", "A"): None, ("w", "B"): None}


def test_report_sink_is_one_sheet(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="docfields-report-"), "sheet")
    wide = spark.createDataFrame([(i, ["a", "b"], f'say "x", \n{i}' if i % 2 else None) for i in range(200, 0, -1)],
                                 "`S.No` int, `L` array<string>, `T x` string")
    cols = ["S.No", "T x", "L"]
    RP.write_report(wide, cols, d, title="T")
    files = sorted(f for f in os.listdir(d) if f.endswith(".csv"))
    whole = io.StringIO("".join(open(os.path.join(d, f), encoding="utf-8", newline="").read() for f in files))
    sheet = pd.read_csv(whole, escapechar=None, doublequote=True)
    assert list(sheet.columns) == cols and sheet["S.No"].tolist() == list(range(1, 201)) and set(sheet["L"]) == {"a, b"}
    back = RP.read_report(spark, cols, d).collect()
    assert len(back) == 200 and {r["T x"] for r in back if r["S.No"] == "7"} == {'say "x", \n7'}


def test_requests(spark):
    row = spark.range(1).select(
        RP.build_request("{a}-{b}{a}. {c}", a=F.lit(" x "), b=F.lit(None).cast("string")).alias("r"),
        RP.hint_lines(F.array(F.struct(F.lit("n").alias("name"), F.lit("h").alias("description")),
                              F.struct(F.lit("m").alias("name"), F.lit(None).cast("string").alias("description")))).alias("h")).first()
    assert row.r == "x-x. {c}" and row.h == "- n (Hint: h)\n- m"


def test_caller_tokenizer(spark):
    from docfields.plans.q_text import bpe_counter

    texts = ["a b", "", None, "née " * 50]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")

    def broken():
        raise OSError("no file")

    def failing():
        def count(texts):
            raise ValueError
        return count
    got = df.orderBy("i").select(T.token_count("t", bpe_counter).alias("a"), T.token_count("t", broken).alias("b"),
                                 T.token_count("t", failing).alias("c")).collect()
    count = bpe_counter()
    assert [r.a for r in got] == [None if t is None else count([t])[0] for t in texts]
    assert [r.b for r in got] == [r.c for r in got] == [None if t is None else len(t) // 4 + 1 for t in texts]


def test_generate_without_runs_equals_runs(spark):
    from docfields.plans.generate import generate
    from docfields.plans.q_edits import user_values
    from docfields.plans.q_fields import merged_fields
    from docfields.sources import fixtures as FX

    fields, docs = merged_fields(spark, SF), FX.documents(spark, SF)
    blank = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("para_idx", "line")).where("line = ''").select(
        "doc_id", "para_idx", F.lit(0).alias("run_idx"), F.col("line").alias("text"))
    runs = FX.runs(spark, SF).where(F.col("doc_id") % 2 == 0).unionByName(blank.where(F.col("doc_id") % 2 == 0))
    cols = ["doc_id", "text", "total_replacements"]
    a, b = generate(docs, fields, user_values(fields)), generate(docs, fields, user_values(fields), runs=runs)
    assert rows_of(a.select(cols)) == rows_of(b.select(cols))
    assert a.agg(F.sum("total_replacements")).first()[0] > 0


def test_carry_replacements(spark):
    values = spark.createDataFrame([("w", "f", "a", "A"), ("w", "f", "b", ""), ("w", "f", "n2", "gives way"), ("w", "g", "x", "X")],
                                   "workspace_id string, field_key string, ref string, value string")
    log = [(1, "a", " n1 "), (2, "n1", "n2"), (3, "b", "n3"), (4, "c", "n4"), (5, "n3", "  "), (6, "n4", "n4")]
    edits = spark.createDataFrame([("w", "f", s, "rename", o, n, None) for s, o, n in log] + [("w", "h", 9, "rename", "q", "r", None)],
                                  "workspace_id string, field_key string, seq long, op string, ref string, new_ref string, label string")
    got = {(r["field_key"], r["ref"]): r["value"] for r in FLD.carry_replacements(values, edits).collect()}
    assert got == {("f", "n2"): "A", ("f", "n3"): "n3", ("f", "n4"): "n4", ("g", "x"): "X", ("h", "r"): "r"}


def test_group_fingerprint_streams(spark):
    import hashlib

    from docfields.operators import lifecycle as LC

    rows = [("w", 2, "b", "two", "p2"), ("w", 1, "a", None, "p1"), ("v", 3, "c", "three", None), (None, 4, "d", "x", "y")]
    df = spark.createDataFrame(rows, "workspace_id string, doc_id long, name string, text string, path string").repartition(4)
    got = {r["workspace_id"]: r["fingerprint"] for r in LC.fingerprint(df, instructions=" i ", paths_col="path").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {"w": sha("a:b:twodocx:p1docx:p2user_instructions:i"), "v": sha("c:threeuser_instructions:i")}


@pytest.mark.parametrize("most", [0, 200_000])
def test_anchor_forms_agree(spark, monkeypatch, most):
    """Few references are broadcast with their anchors, many meet the lines by key; duplicates count twice."""
    monkeypatch.setattr(L, "ANCHOR_MAX_REFS", most)
    docs = spark.createDataFrame([(1, "x a@b.org, a@b.org.\n(555) 1-2 é è à\n\naaa"), (2, "a@b.org"), (3, None)], "doc_id long, text string")
    refs = spark.createDataFrame([(1, "a@b.org"), (1, "a@b.org"), (2, "aa"), (3, "é è"), (4, "(555) 1"), (5, ""), (6, "b.org, a")],
                                 "ref_id long, ref string")
    a = L.locate(docs, refs, strategy="anchor")
    assert rows_of(a) == rows_of(L.locate(docs, refs, strategy="broadcast")) and a.count() == 11
    assert L.locate(docs, refs.limit(0), strategy="anchor").count() == 0


# ----------------------------------------------------------------------------- whole jobs of N4 and P6
def test_cell_edits_give_every_cell(spark):
    """N4 gives a row a cell (not a digest a table), edited or not."""
    from docfields.plans import load_all
    from docfields.sources import fixtures as FX

    out = load_all()[0]["N4_apply_cell_edits"](spark, SF)
    assert set(out.columns) == {"doc_id", "table_index", "row", "col", "display", "n_applied"}
    assert out.count() == FX.cells(spark, SF).count()
    assert {r["display"] for r in out.where("n_applied > 0").select("display").distinct().collect()} >= {"Returned", "Returned (set)"}


def test_fresh_clock_keeps_the_whole_table(spark, tmp_path):
    """P6 at its first clock: every entry after 2024-01-01 00:00 is younger than 24 h, that of the very second is not."""
    from docfields.plans import load_all

    spark.sql("""SELECT * FROM VALUES (1L, timestamp_ntz'2024-01-01 00:00:00'), (2L, timestamp_ntz'2024-01-01 00:00:01'),
        (3L, timestamp_ntz'2024-01-02 12:00:00'), (4L, null) AS t(event_id, ts)""").write.parquet(str(tmp_path / "events.parquet"))
    assert rows_of(load_all()[0]["P6_fresh"](spark, str(tmp_path))) == [(2,), (3,)]


# ----------------------------------------------------------------------------- steps that grow with the input
def test_two_neighbouring_runs_are_the_anchor(spark, monkeypatch):
    """J1 by anchors: pairs of runs, runs and grams, broadcast or exchanged, short lines or long, give what ``find`` gives."""
    rnd = random.Random(7)
    words = ["ab", "b1", "é", "x-y", "zz", "c\U0001f600d", "th"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60))) + "\n" + "thth anan" * rnd.randint(0, 3) for _ in range(30)]
    refs = sorted({" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 5))) for _ in range(40)} | {"th", "anan", "h", "\U0001f600d ab"})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = spark.createDataFrame(list(enumerate(refs)), "ref_id bigint, ref string")
    want = sorted((i, k, n, at) for i, t in enumerate(texts) for n, line in enumerate(t.split("\n")) for k, r in enumerate(refs)
                  for at in range(len(line)) if line.startswith(r, at))
    kinds = {r["kind"] for r in L.ref_anchors(rows, []).select("kind").distinct().collect()}
    assert {L.PAIR, L.RUN, 1, 2} <= kinds and want
    for most, carried, probed in ((200_000, 2_000, 32), (0, 2_000, 0), (0, 50, 0), (200_000, 2_000, 0)):
        monkeypatch.setattr(L, "ANCHOR_MAX_REFS", most)
        monkeypatch.setattr(L, "CARRY_MAX_CHARS", carried)
        monkeypatch.setattr(L, "PROBE_MAX_REFS", probed)
        got = L.locate(docs, rows, strategy="anchor").select("doc_id", "ref_id", "line_index", "line_char_start")
        assert sorted(map(tuple, got.collect())) == want


def test_line_type_is_found_once_a_line(spark):
    """What belongs to the line is computed below the expansion of its occurrences."""
    docs = spark.createDataFrame([(1, "| th th")], "doc_id bigint, text string")
    refs = spark.createDataFrame([(1, "th")], "ref_id bigint, ref string")
    plan = L.locate(docs, refs, strategy="broadcast")._jdf.queryExecution().optimizedPlan().toString()
    above = plan[:plan.index("Generate explode(at")]
    assert "regexp_replace" not in above and "regexp_replace" in plan


def test_marks_that_reach_into_each_other(spark):
    """X23 piece by piece equals wrapping in the whole text again and again."""
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abc é\U0001f600") for _ in range(rnd.randint(0, 40))) for _ in range(60)]
    marks = [(i, s, s + rnd.randint(0, 9), rnd.choice(["x", "yy", ""])) for i, t in enumerate(texts) if i % 9
             for s in (rnd.randint(-1, len(t)) for _ in range(rnd.randint(1, 12)))]

    def wrapped(i, t):
        for _, s, e, r in sorted((-s, s, e, r) for j, s, e, r in marks if j == i):
            if 0 <= s < e <= len(t):
                t = t[:s] + "<mark>" + r + "</mark>" + t[e:]
        return t

    got = L.highlight(spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id bigint, text string"),
                      spark.createDataFrame(marks, "doc_id bigint, char_start int, char_end int, ref string"))
    assert dict(map(tuple, got.collect())) == {**{i: wrapped(i, t) for i, t in enumerate(texts)}, 99: None}


def test_runs_and_texts_by_workspace_take_pairs_that_arise(spark):
    """X22 with one list or a list a workspace, X20: a later pair may apply to what an earlier one wrote."""
    from docfields.operators import edits as E
    from docfields.plans.generate import _replace_text

    pairs = [(1, "a@b.example", "Q 7"), (2, "Q 7!", "z"), (3, "nowhere at all", "n")]
    lines = {1: "to a@b.example! and a@b.example", 2: "nothing Q 8", 3: ""}
    runs = spark.createDataFrame([(d, 0, k, t[i:i + 5]) for d, t in lines.items() for k, i in enumerate(range(0, max(len(t), 1), 5))],
                                 "doc_id bigint, para_idx int, run_idx int, text string").withColumn("ws", F.lit("w"))
    plain = spark.createDataFrame(pairs, "seq bigint, old string, new string")
    one = rows_of(E.replace_runs(runs, plain).select("doc_id", F.array_join("runs", "|"), "count"))
    own = rows_of(E.replace_runs(runs, plain.withColumn("ws", F.lit("w")), key="ws").select("doc_id", F.array_join("runs", "|"), "count"))
    assert one == own == [(1, "to z |and Q| 7||||", 3), (2, "nothi|ng Q |8", 0), (3, "", 0)]
    held = E.attach_candidate_pairs(spark.createDataFrame([(d, "w", t) for d, t in lines.items()], "doc_id bigint, ws string, text string"),
                                    plain.withColumn("ws", F.lit("w")), "ws", F.col("text"))
    assert rows_of(held.select("doc_id", F.size("pairs"))) == [(1, 3), (2, 0), (3, 0)]
    docs = spark.createDataFrame([(d, "w", t) for d, t in lines.items()], "doc_id bigint, workspace_id string, text string")
    assert rows_of(_replace_text(docs, plain.withColumn("workspace_id", F.lit("w")))) == [
        (1, "to z and Q 7", 3), (2, "nothing Q 8", 0), (3, "", 0)]


def test_scopes_meet_only_the_latest_documents(spark):
    """T2 for many scopes: the plan ranks a workspace's documents before scopes join them; a scope may have two workspaces."""
    from docfields.operators import retrieve as R

    docs = spark.createDataFrame([(i, f"w{i % 3}", i // 2) for i in range(60)], "doc_id bigint, workspace_id string, upload_date int")
    scopes = spark.createDataFrame([(m, f"w{m % 3}") for m in range(9)] + [(0, "w1")], "msg bigint, workspace_id string")
    out = R.latest_docs_per_scope(docs, scopes, "msg", 4)
    want = [(m, d) for m in range(9) for d in [59 - i for i in range(60) if (59 - i) % 3 in ({0, 1} if m == 0 else {m % 3})][:4]]
    assert sorted(map(tuple, out.select("msg", "doc_id").collect())) == sorted(want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan[plan.index("Join"):]
