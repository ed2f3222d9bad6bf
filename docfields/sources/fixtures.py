"""Derived fixtures (FIXTURES.md): the reference's input shapes built from the given tables.

Each fixture is written twice from one rule: a Spark DataFrame function and a
DuckDB CTE (``SQL[name]``) used by the oracle queries.  The two forms must stay
line-for-line equivalent; tests compare them.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docfields.functions import text as T
from docfields.sources.tables import read_spread, read_table, spread

# Fixed values of the fixtures (kept together).
BASE_TS = "2024-01-01 00:00:00"
WS_CREATED = "2024-01-01 14:30:00"
BASE_DATE = "2024-01-01"
EXTRA_WORKSPACES = (90, 91, 92)
OVERLAP_REFS = ((-1, "th"), (-2, "anan"))
REPLACEMENTS = ((1, "the", "THE"), (2, "THE re", "there"), (3, "and", ""))
LINE_MARKS = ("", "# ", "- ", "* ", "> ", "| ")
REPORT_COLUMNS = (
    ("S.No", None), ("Event Name", None), ("Event Date", None),
    ("Contact Email", "email address of the contact"),
    ("Contact Phone", "phone number of the contact"),
    ("License", "license or copyright line"),
)
AS_OF = "2024-01-01 12:00:00"
CHAT_TYPES = (("view", "token"), ("click", "tool_start"), ("purchase", "tool_end"),
              ("error", "thinking"), ("signup", "meta"))
SIX_WORDS = r"^\S+(\s+\S+){5}"
THREE_WORDS = r"^\S+(\s+\S+){2}"


def _ts(s: str):
    return F.lit(s).cast("timestamp_ntz")


# ----------------------------------------------------------------- documents, workspaces
def documents(spark: SparkSession, sf_dir: str, keyed: bool = True) -> DataFrame:
    """``keyed=False`` for work on each text alone: texts are exchanged only if the scan gives the cores too few parts."""
    d = read_spread(spark, sf_dir, "documents", "doc_id") if keyed else _read_whole(spark, sf_dir)
    return d.select(
        "doc_id",
        F.col("source").alias("workspace_id"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".docx")).alias("name"),
        F.timestamp_add("MINUTE", F.col("doc_id"), _ts(BASE_TS)).alias("upload_date"),
        "text",
    )


def _read_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents"), "doc_id", target=spark.sparkContext.defaultParallelism)


def workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = read_table(spark, sf_dir, "documents").select(F.col("source").alias("workspace_id")).distinct()
    extra = spark.createDataFrame([(f"src{k}",) for k in EXTRA_WORKSPACES], "workspace_id string")
    ws = src.unionByName(extra)
    k = F.substring("workspace_id", 4, 10).cast("int")
    return ws.select(
        "workspace_id",
        F.concat(F.lit("Workspace "), k.cast("string")).alias("name"),
        F.when(k % 2 == 0, F.concat(F.lit("Documents of "), F.col("workspace_id"))).alias("description"),
        F.timestamp_add("DAY", k, _ts(WS_CREATED)).alias("created_at"),
        F.when(k % 3 != 0, F.date_add(F.lit(BASE_DATE).cast("date"), k)).alias("event_date"),
        F.concat(F.lit("user"), (k % 2).cast("string")).alias("user_id"),
    )


def orders_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("workspace_id"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("name"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderkey") % 5 != 0, F.to_date("o_orderdate")).alias("event_date"),
    )


def orders_ws_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("workspace_id"), F.col("l_linenumber"))


# ----------------------------------------------------------------- references
def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read_table(spark, sf_dir, "benchmark")
    first = F.split_part(F.col("text"), F.lit("\n"), F.lit(1))
    two = b.select(
        F.col("item_id"),
        first.alias("first_line"),
        F.regexp_extract(first, SIX_WORDS, 0).alias("six"),
    )
    rows = two.select(
        F.inline(F.array(
            F.struct((F.col("item_id") * 10).alias("ref_id"), F.col("first_line").alias("ref")),
            F.struct((F.col("item_id") * 10 + 1).alias("ref_id"), F.col("six").alias("ref")),
        ))
    )
    extra = spark.createDataFrame(list(OVERLAP_REFS), "ref_id bigint, ref string")
    return rows.unionByName(extra).where(F.col("ref") != "")


def refs_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read_whole(spark, sf_dir)
    second = F.split_part(F.col("text"), F.lit("\n"), F.lit(2))
    return (
        d.select("doc_id", second.alias("line"))
        .where(F.length("line") >= 40)
        .select("doc_id", F.substring("line", 1, 40).alias("ref"))
        .groupBy("ref").agg(F.min("doc_id").alias("ref_id"))
        .select("ref_id", "ref")
    )


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read_table(spark, sf_dir, "benchmark")
    return b.select(
        F.col("item_id").alias("workspace_id"),
        F.regexp_extract("text", THREE_WORDS, 0).alias("name"),
    )


def marked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line gets a markdown prefix chosen by line_index % 6."""
    d = documents(spark, sf_dir)
    marks = F.array(*[F.lit(m) for m in LINE_MARKS])
    lines = F.split(F.col("text"), "\n", -1)
    marked = F.transform(lines, lambda l, i: F.concat(F.element_at(marks, (i % 6) + 1), l))
    return d.withColumn("text", F.array_join(marked, "\n"))


# ----------------------------------------------------------------- tables and edits
def cells(spark: SparkSession, sf_dir: str, own: DataFrame | None = None) -> DataFrame:
    """``own`` (doc_id): only the cells of these documents, picked before the lines are numbered and cut."""
    li = read_spread(spark, sf_dir, "lineitem", "l_orderkey")
    if own is not None:
        li = li.join(own.select(F.col("doc_id").alias("l_orderkey")), "l_orderkey", "left_semi")
    w = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    rows = li.select(
        F.col("l_orderkey").alias("doc_id"),
        F.row_number().over(w).alias("row"),
        F.col("l_linenumber").cast("string").alias("c0"),
        F.col("l_quantity").cast("bigint").cast("string").alias("c1"),
        F.col("l_returnflag").alias("c2"),
        F.col("l_linestatus").alias("c3"),
        F.concat(F.lit(" "), F.to_date("l_shipdate").cast("string"), F.lit(" ")).alias("c3b"),
    )
    def cell(row, col, *paras):
        return F.struct(row.alias("row"), F.lit(col).alias("col"), F.array(*paras).alias("paras"))

    # the header goes out with the first row, so the rows of a table are numbered once
    data = F.array(*[cell(F.col("row"), i, *c) for i, c in enumerate((["c0"], ["c1"], ["c2"], ["c3", "c3b"]))])
    header = F.array(*[cell(F.lit(0), i, *map(F.lit, c)) for i, c in enumerate((["Line"], ["Quantity"], ["Flag"], ["Status", ""]))])
    return rows.select("doc_id", F.inline(F.when(F.col("row") == 1, F.concat(header, data)).otherwise(data))).select(
        "doc_id", F.lit(0).alias("table_index"), F.col("row").cast("int"), F.col("col").cast("int"),
        "paras", T.cell_text("paras").alias("display"),
    )


def table_edits(spark: SparkSession, sf_dir: str, own: DataFrame | None = None) -> DataFrame:
    c = cells(spark, sf_dir, own).where((F.col("col") == 2) & (F.col("row") > 0) & (F.col("display") == "R"))
    n = F.col("doc_id") + F.col("row")
    seq = F.col("doc_id") * 1000000 + F.col("row") * 10

    def edit(row, old, new, seq):
        return F.struct(row.alias("row"), F.col("col"), old.alias("old_value"), new.alias("new_value"), seq.alias("seq"))

    base = edit(F.when(n % 11 == 0, F.col("row") + 1000).otherwise(F.col("row")), F.when(n % 5 != 0, F.lit("R")),
                F.when(n % 5 == 0, F.lit("Returned (set)")).otherwise(F.lit("Returned")), seq)
    again = edit(F.col("row"), F.lit("R"), F.lit("Ret."), seq + 1)
    return c.select("doc_id", "table_index", F.inline(F.when(n % 7 == 0, F.array(base, again)).otherwise(F.array(base))))


def runs(spark: SparkSession, sf_dir: str, blank: bool = False) -> DataFrame:
    """``blank``: a line without characters still is a paragraph, with one empty run."""
    # dealt by document as texts: the runs, several times as large, are then grouped where they are
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
    lines = d.select("doc_id", F.posexplode_outer(F.split("text", "\n", -1)).alias("para_idx", "line")).where(F.col("line").isNotNull())
    # one pass over a line (``substring`` at each start costs the square of its length)
    cut = F.regexp_extract_all("line", F.lit("(?s).{1,7}"), F.lit(0))
    if blank:
        cut = F.when(F.col("line") == "", F.array(F.lit(""))).otherwise(cut)
    return lines.select("doc_id", "para_idx", F.posexplode_outer(cut).alias("run_idx", "text")).where(F.col("run_idx").isNotNull())


def replacements(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(REPLACEMENTS), "seq bigint, old string, new string")


def report_columns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(n, d, i) for i, (n, d) in enumerate(REPORT_COLUMNS)], "name string, description string, order int")


# ----------------------------------------------------------------- activity-derived
def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("run_id"), "ts",
        F.floor(F.col("value") * 10).cast("bigint").alias("input_tokens"),
        F.floor("value").cast("bigint").alias("output_tokens"),
        F.length("props").cast("bigint").alias("prompt_chars"),
    )


def chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    typ = F.lit(None).cast("string")
    for src, dst in reversed(CHAT_TYPES):
        typ = F.when(F.col("event_type") == src, F.lit(dst)).otherwise(typ)
    return e.select(
        F.col("user_id").alias("thread_id"), typ.alias("type"), F.col("props").alias("content"),
        "ts", F.col("event_id").alias("seq"),
    )


def chat_stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat events in which hints repeat, tools end again and some responses fail."""
    e = chat_events(spark, sf_dir)
    k = F.regexp_extract("content", "[0-9]+", 0).cast("bigint")
    typ = F.when((F.col("type") == "thinking") & (k % 4 == 3), F.lit("error")).otherwise(F.col("type"))
    tool = F.when(k % 13 == 0, F.lit("")).otherwise(F.concat(F.lit("tool"), (k % 3).cast("string")))
    content = (F.when(F.col("type").startswith("tool"), tool)
               .when(typ == "error", F.concat(F.lit("failed "), k.cast("string")))
               .when(typ == "thinking", F.concat(F.lit(" step "), (k % 2).cast("string"))).otherwise(F.col("content")))
    return e.select("thread_id", "seq", typ.alias("type"), content.alias("content"))


# ----------------------------------------------------------------- DuckDB forms
SQL: dict[str, str] = {
    "docs": f"""docs AS (
  SELECT doc_id, source AS workspace_id, 'doc_' || CAST(doc_id AS VARCHAR) || '.docx' AS name,
         TIMESTAMP '{BASE_TS}' + to_minutes(doc_id) AS upload_date, text
  FROM documents)""",
    "workspaces": f"""ws_src AS (
  SELECT DISTINCT source AS workspace_id FROM documents
  UNION ALL SELECT 'src' || CAST(k AS VARCHAR) FROM (VALUES {", ".join(f"({k})" for k in EXTRA_WORKSPACES)}) t(k)),
workspaces AS (
  SELECT workspace_id,
         'Workspace ' || CAST(k AS VARCHAR) AS name,
         CASE WHEN k % 2 = 0 THEN 'Documents of ' || workspace_id END AS description,
         TIMESTAMP '{WS_CREATED}' + to_days(k) AS created_at,
         CASE WHEN k % 3 <> 0 THEN DATE '{BASE_DATE}' + k END AS event_date,
         'user' || CAST(k % 2 AS VARCHAR) AS user_id
  FROM (SELECT workspace_id, CAST(substring(workspace_id, 4, 10) AS INTEGER) AS k FROM ws_src))""",
    "orders_ws": """orders_ws AS (
  SELECT o_orderkey AS workspace_id, 'Order ' || CAST(o_orderkey AS VARCHAR) AS name,
         o_orderdate AS created_at,
         CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END AS event_date
  FROM orders)""",
    "refs": f"""refs AS (
  SELECT ref_id, ref FROM (
    SELECT item_id * 10 AS ref_id, split_part(text, chr(10), 1) AS ref FROM benchmark
    UNION ALL
    SELECT item_id * 10 + 1, regexp_extract(split_part(text, chr(10), 1), '{SIX_WORDS}', 0) FROM benchmark
    UNION ALL SELECT * FROM (VALUES {", ".join(f"({i}, '{r}')" for i, r in OVERLAP_REFS)}) t(ref_id, ref)
  ) WHERE ref <> '')""",
    "refs_many": """refs_many AS (
  SELECT min(doc_id) AS ref_id, ref FROM (
    SELECT doc_id, substring(split_part(text, chr(10), 2), 1, 40) AS ref FROM documents
    WHERE length(split_part(text, chr(10), 2)) >= 40) GROUP BY ref)""",
    "names": f"""names AS (
  SELECT item_id AS workspace_id, regexp_extract(text, '{THREE_WORDS}', 0) AS name FROM benchmark)""",
    "marked_docs": f"""marked_docs AS (
  SELECT doc_id, workspace_id, name, upload_date,
         array_to_string(list_transform(string_split(text, chr(10)),
           lambda l, i: [{", ".join(repr(m) for m in LINE_MARKS)}][((i - 1) % 6) + 1] || l), chr(10)) AS text
  FROM docs)""",
    "cells": """cell_rows AS (
  SELECT l_orderkey AS doc_id,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                            l_extendedprice, l_quantity, l_shipdate) AS row,
         CAST(l_linenumber AS VARCHAR) AS c0, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS c1,
         l_returnflag AS c2, l_linestatus AS c3, ' ' || CAST(CAST(l_shipdate AS DATE) AS VARCHAR) || ' ' AS c3b
  FROM lineitem),
cells_raw AS (
  SELECT doc_id, row, 0 AS col, [c0] AS paras FROM cell_rows
  UNION ALL SELECT doc_id, row, 1, [c1] FROM cell_rows
  UNION ALL SELECT doc_id, row, 2, [c2] FROM cell_rows
  UNION ALL SELECT doc_id, row, 3, [c3, c3b] FROM cell_rows
  UNION ALL SELECT doc_id, 0, 0, ['Line'] FROM cell_rows WHERE row = 1
  UNION ALL SELECT doc_id, 0, 1, ['Quantity'] FROM cell_rows WHERE row = 1
  UNION ALL SELECT doc_id, 0, 2, ['Flag'] FROM cell_rows WHERE row = 1
  UNION ALL SELECT doc_id, 0, 3, ['Status', ''] FROM cell_rows WHERE row = 1),
cells AS (
  SELECT doc_id, 0 AS table_index, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, paras,
         array_to_string(list_filter(list_transform(paras, lambda p: PYSTRIP(p)), lambda p: p <> ''), chr(10)) AS display
  FROM cells_raw)""",
    "table_edits": """edit_src AS (
  SELECT * FROM cells WHERE col = 2 AND row > 0 AND display = 'R'),
table_edits AS (
  SELECT doc_id, table_index, CASE WHEN (doc_id + row) % 11 = 0 THEN row + 1000 ELSE row END AS row, col,
         CASE WHEN (doc_id + row) % 5 <> 0 THEN 'R' END AS old_value,
         CASE WHEN (doc_id + row) % 5 = 0 THEN 'Returned (set)' ELSE 'Returned' END AS new_value,
         doc_id * 1000000 + row * 10 AS seq
  FROM edit_src
  UNION ALL
  SELECT doc_id, table_index, row, col, 'R', 'Ret.', doc_id * 1000000 + row * 10 + 1
  FROM edit_src WHERE (doc_id + row) % 7 = 0)""",
    "runs": """para_lines AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS para_idx,
         unnest(string_split(text, chr(10))) AS line FROM documents),
runs AS (
  SELECT doc_id, para_idx, CAST(s // 7 AS INTEGER) AS run_idx, substring(line, s + 1, 7) AS text
  FROM (SELECT doc_id, para_idx, line, unnest(range(0, length(line), 7)) AS s FROM para_lines))""",
    "replacements": f"""replacements AS (
  SELECT * FROM (VALUES {", ".join(f"({s}, '{o}', '{n}')" for s, o, n in REPLACEMENTS)}) t(seq, old, new))""",
    "report_columns": """report_columns AS (
  SELECT * FROM (VALUES {}) t(name, description, "order"))""".format(
        ", ".join(f"('{n}', {'NULL' if d is None else repr(d)}, {i})" for i, (n, d) in enumerate(REPORT_COLUMNS))),
    "calls": """calls AS (
  SELECT user_id AS run_id, ts, CAST(floor(value * 10) AS BIGINT) AS input_tokens,
         CAST(floor(value) AS BIGINT) AS output_tokens, CAST(length(props) AS BIGINT) AS prompt_chars
  FROM events)""",
    "chat_events": """chat_events AS (
  SELECT user_id AS thread_id,
         CASE event_type {} END AS type,
         props AS content, ts, event_id AS seq
  FROM events)""".format(" ".join(f"WHEN '{s}' THEN '{d}'" for s, d in CHAT_TYPES)),
    "chat_stream_events": """chat_stream_events AS (
  SELECT thread_id, seq, CASE WHEN type = 'thinking' AND k % 4 = 3 THEN 'error' ELSE type END AS type,
         CASE WHEN type LIKE 'tool%' AND k % 13 = 0 THEN '' WHEN type LIKE 'tool%' THEN 'tool' || CAST(k % 3 AS VARCHAR)
              WHEN type = 'thinking' AND k % 4 = 3 THEN 'failed ' || CAST(k AS VARCHAR)
              WHEN type = 'thinking' THEN ' step ' || CAST(k % 2 AS VARCHAR) ELSE content END AS content
  FROM (SELECT *, CAST(regexp_extract(content, '[0-9]+') AS BIGINT) AS k FROM chat_events))""",
}

# Dependencies between CTEs (a fixture needs those listed before it).
SQL_DEPS = {
    "marked_docs": ["docs"],
    "table_edits": ["cells"],
    "chat_stream_events": ["chat_events"],
}

# DuckDB spelling of Python str.strip() (same class as T.WS_CLASS).
PYSTRIP_SQL = "regexp_replace({0}, '^[\\s\\x0B\\x{{85}}\\p{{Z}}]+|[\\s\\x0B\\x{{85}}\\p{{Z}}]+$', '', 'g')"


def pystrip_sql(expr: str) -> str:
    return PYSTRIP_SQL.format(expr)


def _expand_macros(sql: str) -> str:
    out = sql
    while "PYSTRIP(" in out:
        i = out.index("PYSTRIP(")
        depth, j, in_str = 0, i + len("PYSTRIP"), False
        while True:
            ch = out[j]
            if ch == "'":
                in_str = not in_str
            elif not in_str and ch == "(":
                depth += 1
            elif not in_str and ch == ")":
                depth -= 1
                if depth == 0:
                    break
            j += 1
        inner = out[i + len("PYSTRIP("):j]
        out = out[:i] + pystrip_sql(inner) + out[j + 1:]
    return out


def with_sql(*names: str) -> str:
    """``WITH`` clause holding the named fixture CTEs (and their dependencies)."""
    order: list[str] = []

    def add(n):
        for dep in SQL_DEPS.get(n, []):
            add(dep)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(SQL[n] for n in order)


def oracle(sql: str) -> str:
    """Expand the PYSTRIP(...) macro in an oracle query."""
    return _expand_macros(sql)
