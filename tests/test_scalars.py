"""Scalar functions against plain-Python models of the reference semantics."""
import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from docfields.functions import text as T
from docfields.operators.fuzzy import fuzzy_dedupe, lcs_len, similarity

ALPHA = "ab|#-> \nçé"


def py_chunks(text, size=1800, overlap=250):
    """Chunk i starts at i * (size - overlap); the last one is the first to reach the end."""
    step = size - overlap
    n = 1 + max(0, -(-(len(text) - size) // step)) if text else 0
    return [text[i * step:i * step + size] for i in range(n)]


def lcs_dp(a, b):
    dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            dp[i + 1][j + 1] = dp[i][j] + 1 if a[i] == b[j] else max(dp[i][j + 1], dp[i + 1][j])
    return dp[-1][-1]


@given(st.text(alphabet=ALPHA, max_size=40), st.text(alphabet=ALPHA, max_size=40))
@settings(max_examples=200, deadline=None)
def test_lcs_bit_parallel_equals_dp(a, b):
    assert lcs_len(a, b) == lcs_dp(a, b)


def test_fuzzy_dedupe_greedy():
    refs = ["john.doe@example.com", "john.doe@example.co", "x", "jane@example.org"]
    out = fuzzy_dedupe(refs, 85)
    assert out[0] == "john.doe@example.com" and "john.doe@example.co" not in out
    assert similarity("", "") == 100.0


def test_chunks_match_python(spark):
    rnd = random.Random(1)
    texts = ["", "a" * 10, "b" * 1800, "c" * 1801] + ["".join(rnd.choice(ALPHA) for _ in range(rnd.randint(0, 9000)))
                                                     for _ in range(20)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r.id: list(r.c) for r in df.select("id", T.chunks("text").alias("c")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == py_chunks(t), i


def test_line_type_order(spark):
    rows = [("| a",), ("# h",), ("#h",), ("  - x",), ("* y",), ("> q",), ("text",), ("  |x",), ("####### no",)]
    df = spark.createDataFrame(rows, "line string")
    got = [r.t for r in df.select(T.line_type("line").alias("t")).collect()]
    assert got == ["table_row", "header", "paragraph", "list_item", "list_item", "blockquote", "paragraph",
                   "table_row", "paragraph"]


def test_strip_unicode_whitespace(spark):
    df = spark.createDataFrame([(" \t x y \n ",)], "s string")
    assert df.select(T.py_strip("s").alias("s")).first().s == "x y"


def test_replace_ci_and_counts(spark):
    df = spark.createDataFrame([("The cat and THE dog; theme", "the", "A$1")], "t string, o string, n string")
    r = df.select(T.replace_ci("t", F.col("o"), F.col("n")).alias("r"),
                  T.count_nonoverlapping(F.lit("aaaa"), F.lit("aa")).alias("c")).first()
    assert r.r == "A$1 cat and A$1 dog; A$1me"
    assert r.c == 2  # D15: counting does not overlap


def test_multipart_text(spark):
    df = spark.createDataFrame([('["a", {"text": "b"}, {"content": "c"}, 7]',), ('"plain"',), ("{}",)], "j string")
    assert [r.c for r in df.select(T.multipart_text("j").alias("c")).collect()] == ["abc", "plain", ""]
