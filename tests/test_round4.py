"""Arrivals by bytes, line anchors and positions, texts encoded once."""
import re
import tempfile

from pyspark.sql import functions as F

from docfields.operators import locate as L
from docfields.sources import arrivals as A


def test_arrivals_are_cut_by_bytes(spark, monkeypatch):
    """a file is bounded by the bytes of its rows too, not only by their count."""
    monkeypatch.setattr(A, "BYTES_PER_FILE", 2_000, raising=False)
    d = tempfile.mkdtemp(prefix="docfields-arrivals-")
    df = spark.range(90).select((F.col("id") % 30).alias("k"), F.col("id").alias("seq"), F.repeat(F.lit("é"), 100).alias("text"))
    df = df.unionByName(df.select("k", (F.col("seq") + 90).alias("seq"), F.lit(None).cast("string").alias("text")))
    files = A.write_arrivals(df, "seq", "k", d, 2)
    assert files == 10  # 90 rows of 216 bytes in the larger arrival
    back = spark.read.parquet(d)
    assert back.count() == 180 and back.where("text is null").count() == 90
    late = F.col("seq") >= 90
    homes = back.select("k", late.alias("late"), F.input_file_name().alias("file")).groupBy("k", "late").agg(
        F.count_distinct("file").alias("n"))
    assert homes.agg(F.max("n")).first()[0] == 1


def test_lines_are_cut_once(spark):
    """no filter before the explosion computes the lines once more; null texts still give no line."""
    docs = spark.createDataFrame([(1, "a\nbb"), (2, None), (3, "")], "doc_id long, text string")
    lines = L.explode_lines(docs)
    plan = lines._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [step for step in plan if "Filter" in step and "split(" in step]
    assert sorted(map(tuple, lines.collect())) == [(1, 0, "a", 0), (1, 1, "bb", 2), (3, 0, "", 0)]


def test_line_pairs(spark):
    """neighbouring runs without looking behind at every character; a long last run costs its length."""
    texts = ["", "a", "--a b--c  d", "é1é22é", "x" * 20_000, "a " + "y" * 20_000, "a.b@c", "2024-01-02 $45.99"]
    got = spark.createDataFrame([(t,) for t in texts], "line string").select("line", L._line_anchors(F.col("line"), L.PAIR))
    assert "?<!" not in L.LINE_PAIR
    for line, pairs in got.collect():
        at = [(m.start(), m.end()) for m in re.finditer("[A-Za-z0-9]+", line)]
        assert set(pairs) - {""} == {line[a:d] for (a, _), (_, d) in zip(at, at[1:])}


def test_dates_do_not_meet_on_their_month(spark):
    """references with one inner run take what stands around it, and are found all the same."""
    refs = spark.createDataFrame([(i, f"20{i:02d}-01-{i:02d}") for i in range(10, 29)] + [(99, "$45.99")], "ref_id long, ref string")
    anchors = L.ref_anchors(refs, []).collect()
    assert {r["kind"] for r in anchors} == {L.HALF} and len({r["anchor"] for r in anchors}) == 20
    docs = spark.createDataFrame([(1, "on 2012-01-12 or x2013-01-13y,2013-01-13"), (2, "a  $45.991 $45.9 $45.99")], "doc_id long, text string")
    cols = ["doc_id", "ref_id", "char_start"]
    want = sorted(map(tuple, L.locate(docs, refs, strategy="broadcast").select(*cols).collect()))
    assert sorted(map(tuple, L.locate(docs, refs, strategy="anchor").select(*cols).collect())) == want
    assert len(want) == 5


def test_positions_few_and_many(spark):
    """up to FEW_HITS starts one by one, then all by the pattern; overlaps count."""
    rows = [("a" * n, "aa") for n in range(9)] + [("éaé" * 7, "é"), ("x.y.x.", "."), ("ana" * 5, "anan"), ("\U0001f600a\U0001f600a", "a")]
    got = spark.createDataFrame(rows, "line string, ref string").select("line", "ref", L._positions(F.col("line"), F.col("ref")).alias("p"))
    for line, ref, p in got.collect():
        assert p == [i for i in range(len(line)) if line.startswith(ref, i)]


def test_chunks_are_encoded_once(spark, tmp_path):
    """arrivals are cut from a written table."""
    from docfields.plans import q_stream as Q

    spark.createDataFrame([(i, i % 3, "click", f"p{i}") for i in range(30)], "event_id long, user_id long, event_type string, props string") \
        .withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz")).withColumn("value", F.lit(1.0)) \
        .write.parquet(str(tmp_path / "events.parquet"))
    chunks = Q._chunks(spark, str(tmp_path))
    assert chunks.count() == 60 and all("chunks-" in f for f in chunks.inputFiles())
