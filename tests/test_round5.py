"""Findings of round 4: disk of Q2_generate_full and J1_locate_many."""
import random

from pyspark.sql import functions as F


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_indexed_pairs_equal_all_pairs_in_order(spark, monkeypatch):
    """X22 with a list a workspace: the index of pairs, the join of pairs and every pair in turn give the same runs and counts."""
    from docfields.operators import edits as E

    rnd = random.Random(5)
    words = ["ab", "c-d", "é", "x.y", "7", "ab\U0001f600", " ", "  ", "-", "n1", "n2"]
    text = lambda n: "".join(rnd.choice(words) for _ in range(n))
    pairs = [(w, k, text(rnd.randint(1, 4)), rnd.choice([text(rnd.randint(1, 3)), "", None])) for w in ("u", "v") for k in range(40)] + [
        ("u", 99, "", "never"), (None, 1, "ab", "never")]
    paras = [(d, rnd.choice(["u", "v", "none"]), p, text(rnd.randint(0, 40))) for d in range(12) for p in range(3)]
    of = {d: w for d, w, _, _ in paras}
    cut = lambda t: [t[i:i + 7] for i in range(0, max(len(t), 1), 7)]

    def edited(key, rs):
        count = 0
        for _, _, old, new in sorted((x for x in pairs if x[0] == key), key=lambda x: x[1]):
            whole = "".join(rs)
            if old and old in whole:
                count, whole, at, out = count + whole.count(old), whole.replace(old, new or ""), 0, []
                for r in rs[:-1]:
                    out.append(whole[at:at + len(r)])
                    at += len(r)
                rs = [*out, whole[at:]]
        return rs, count

    runs = spark.createDataFrame([(d, p, k, r) for d, _, p, t in paras for k, r in enumerate(cut(t))],
                                 "doc_id bigint, para_idx int, run_idx int, text string")
    owners = spark.createDataFrame(list(of.items()), "doc_id bigint, ws string")
    told = spark.createDataFrame(pairs, "ws string, seq bigint, old string, new string")
    want = sorted((d, p, *edited(of[d], cut(t))) for d, _, p, t in paras)
    assert sum(w[3] for w in want) > 50
    for most in (200_000, 10):
        monkeypatch.setattr(E, "INDEX_MAX_PAIRS", most)
        got = E.replace_runs(runs, told, key="ws", owners=owners).select("doc_id", "para_idx", "runs", "count")
        assert sorted((d, p, list(r), n) for d, p, r, n in got.collect()) == want


def test_pairs_do_not_ride_along_with_paragraphs(spark):
    """X22 with a list a workspace: no paragraph is joined with its workspace's list of pairs, and none is exchanged after Python."""
    from docfields.session import dealt_by_some_keys
    from docfields.operators import edits as E

    runs = spark.createDataFrame([(1, 0, 0, "a b c")], "doc_id bigint, para_idx int, run_idx int, text string")
    pairs = spark.createDataFrame([("w", 1, "b", "B")], "ws string, seq bigint, old string, new string")
    out = E.replace_runs(runs, pairs, key="ws", owners=spark.createDataFrame([(1, "w")], "doc_id bigint, ws string"))
    assert rows_of(out) == [(1, 0, ["a B c"], 1)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "old" not in plan and "Python" in plan
    with dealt_by_some_keys(spark):
        dealt = E.replace_runs(runs.repartition("doc_id"), pairs, key="ws", owners=spark.createDataFrame([(1, "w")], "doc_id bigint, ws string"))
        plan = dealt.groupBy("doc_id").agg(F.collect_list("runs"))._jdf.queryExecution().executedPlan().toString().split("\n")
    # above what Python reads there are three exchanges: runs, owners and the paragraphs with a pair
    deep = [i for i, line in enumerate(plan) if "ArrowEvalPython" in line]
    assert deep and sum("Exchange hashpartitioning" in line for line in plan[:deep[0]]) == 3


def test_runs_are_dealt_as_texts(spark, tmp_path):
    """Runs are cut after the exchange, so that grouping them needs no other; blank lines are paragraphs on request."""
    from docfields.operators import edits as E
    from docfields.sources import fixtures as FX

    rows = [(1, "abcdefgh\n\né\U0001f600\U0001f600\r6789\n"), (2, ""), (3, None), (None, "xyz"), (1, "again")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    lines = [(d, p, line) for d, t in rows if t is not None for p, line in enumerate(t.split("\n"))]
    want = [(d, p, i // 7, line[i:i + 7]) for d, p, line in lines for i in range(0, len(line), 7)]
    assert rows_of(FX.runs(spark, str(tmp_path))) == sorted(want, key=str)
    assert rows_of(FX.runs(spark, str(tmp_path), blank=True)) == sorted(want + [(d, p, 0, "") for d, p, line in lines if not line], key=str)
    plan = E.replace_runs(FX.runs(spark, str(tmp_path)), FX.replacements(spark))._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("ObjectHashAggregate"):] if "ObjectHashAggregate" in plan else plan
    assert below.count("Exchange hashpartitioning(doc_id") == 1


def test_cells_of_given_documents(spark, tmp_path):
    """Cells and edits built for some documents are those of all, picked by document."""
    from docfields.sources import fixtures as FX

    sf = str(tmp_path)
    spark.range(60).selectExpr(
        "nullif(id % 9, 3) AS l_orderkey", "id % 4 AS l_linenumber", "id AS l_partkey", "id AS l_suppkey", "1.5D AS l_extendedprice",
        "CAST(id AS double) AS l_quantity", "timestamp_ntz'1996-01-02 00:00:00' AS l_shipdate", "IF(id % 2 = 0, 'R', 'N') AS l_returnflag",
        "'F' AS l_linestatus").write.parquet(f"{sf}/lineitem.parquet")
    own = spark.createDataFrame([(1,), (5,), (5,), (7,), (None,)], "doc_id bigint")
    for table in (FX.cells, FX.table_edits):
        want = table(spark, sf).join(own, "doc_id", "left_semi")
        assert rows_of(table(spark, sf, own)) == rows_of(want)
    assert FX.cells(spark, sf, own).count() > 0 and FX.table_edits(spark, sf, own).count() > 0
    plan = FX.cells(spark, sf, own)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Join LeftSemi")


def test_many_references_are_found_by_windows(spark, monkeypatch):
    """J1 beyond the broadcast limit: windows of bytes give what ``find`` gives; passes over the lines, long lines, rows twice."""
    from docfields.operators import locate as L

    rnd = random.Random(11)
    words = ["ab", "b1", "é", "x-y", "zz", "c\U0001f600d", "th", "a" * 33]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60))) + "\n\n" + "thth anan" * rnd.randint(0, 3) for _ in range(24)] + [""]
    refs = sorted({" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 9))) for _ in range(60)} | {"th", "é", "h", "a" * 33 + " " + "a" * 33})
    rows = [*enumerate(texts), (0, texts[0]), (90, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    asked = [*enumerate(refs), (0, refs[0]), (91, "")]
    want = sorted((i, k, n, at) for i, t in rows if t is not None for n, line in enumerate(t.split("\n")) for k, r in asked if r
                  for at in range(len(line)) if line.startswith(r, at))
    monkeypatch.setattr(L, "ANCHOR_MAX_REFS", 0)
    monkeypatch.setattr(L, "PROBE_MAX_REFS", 0)
    for carried, most in ((2_000, 4_000_000), (60, 25)):
        monkeypatch.setattr(L, "CARRY_MAX_CHARS", carried)
        monkeypatch.setattr(L, "FILTER_MAX_ANCHORS", most)
        got = L.locate(docs, spark.createDataFrame(asked, "ref_id bigint, ref string"), strategy="anchor")
        assert sorted(map(tuple, got.select("doc_id", "ref_id", "line_index", "line_char_start").collect())) == want


def test_only_lines_with_a_reference_are_exchanged(spark, monkeypatch):
    """J1 beyond the broadcast limit: lines that share words with references, but hold none, stay where they are."""
    from docfields.operators import locate as L

    monkeypatch.setattr(L, "ANCHOR_MAX_REFS", 0)
    docs = spark.createDataFrame([(i, f"be it or not to see {i}, that is the question\nit was to be {i}") for i in range(50)], "doc_id bigint, text string")
    refs = L.ref_windows(spark.createDataFrame([(1, "it or not to see 7, that is the question"), (2, "was to be 8"), (3, "was to be 9")], "ref_id bigint, ref string"), [])
    lines = L.explode_lines(docs)
    assert rows_of(L._known_windows(lines, refs, ["doc_id", "line_index"]).select("doc_id", "line_index", "q")) == [(7, 0, 32), (8, 1, 8), (9, 1, 8)]
