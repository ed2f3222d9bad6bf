"""Queries for retrieval (X19+T3+W5, J7, P2-P4, T1, T2, J13, W6) and Q4."""
from __future__ import annotations

from pyspark.sql import functions as F

from docfields.functions import text as T
from docfields.operators import retrieve as R
from docfields.plans.registry import register
from docfields.sources import fixtures as FX
from docfields.sources.fixtures import with_sql
from docfields.sources.tables import read_spread, read_table

QUESTION = "Which license applies, and what is the contact email or phone of the company?"


def _pack_sql(budget: int) -> str:
    return f"""q AS (SELECT list_distinct(list_filter(regexp_extract_all(lower('{QUESTION}'), '[a-zA-Z0-9_]+'), lambda t: length(t) > 2)) AS qt),
long_docs AS (SELECT doc_id, text FROM documents WHERE length(text) > {budget}),
ch AS (SELECT doc_id, unnest(range(0, (CAST(ceil(greatest(length(text) - 1800, 0) / 1550.0) AS BIGINT)) * 1550 + 1, 1550)) AS s
       FROM long_docs),
sc AS (SELECT ch.doc_id, CAST(ch.s / 1550 AS BIGINT) AS idx, substring(d.text, ch.s + 1, 1800) AS c,
              len(list_intersect(list_distinct(list_filter(regexp_extract_all(lower(substring(d.text, ch.s + 1, 1800)), '[a-zA-Z0-9_]+'), lambda t: length(t) > 2)), q.qt)) AS score
       FROM ch JOIN long_docs d USING (doc_id), q),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) AS rk FROM sc) WHERE rk <= 4),
cum AS (SELECT *, CAST(sum(length(c)) OVER (PARTITION BY doc_id ORDER BY idx) AS BIGINT) AS cum_end FROM top),
kept AS (SELECT doc_id, idx, CASE WHEN cum_end <= {budget} THEN c ELSE substring(c, 1, {budget} - (cum_end - length(c))) END AS part
         FROM cum WHERE cum_end <= {budget} OR (cum_end - length(c) <= {budget} AND {budget} - (cum_end - length(c)) > 200)),
packed AS (SELECT doc_id, string_agg(part, chr(10) || chr(10) || '[...relevant extracted context...]' || chr(10) || chr(10) ORDER BY idx) AS excerpt
           FROM kept GROUP BY ALL),
res AS (SELECT d.doc_id, CASE WHEN length(d.text) <= {budget} THEN d.text
                              ELSE coalesce(p.excerpt, substring(d.text, 1, {budget})) END AS excerpt
        FROM documents d LEFT JOIN packed p USING (doc_id))"""


@register("Q4_retrieve_pack", f"""WITH {_pack_sql(8000)}
SELECT doc_id, length(excerpt) AS n_chars, sha256(excerpt) AS digest FROM res""")
def q4_retrieve_pack(spark, sf_dir):
    """X19 + U2 + T3 + W5: keyword-scored chunks packed to 8000 characters per document."""
    d = read_spread(spark, sf_dir, "documents", "doc_id")
    ex = R.compress(F.col("text"), T.keyword_tokens(F.lit(QUESTION)), budget=8000)
    return d.select("doc_id", F.length(ex).alias("n_chars"), F.sha2(ex, 256).alias("digest"))


@register("W5_pack_budget_4000", f"""WITH {_pack_sql(4000)}
SELECT doc_id, length(excerpt) AS n_chars, sha256(excerpt) AS digest FROM res""")
def w5_pack_budget_4000(spark, sf_dir):
    """W5 with a 4000-character budget (the overflow cut is exercised)."""
    d = read_spread(spark, sf_dir, "documents", "doc_id")
    ex = R.compress(F.col("text"), T.keyword_tokens(F.lit(QUESTION)), budget=4000)
    return d.select("doc_id", F.length(ex).alias("n_chars"), F.sha2(ex, 256).alias("digest"))


@register("T3_best_chunks", f"""WITH {_pack_sql(0)}
SELECT doc_id, idx AS chunk_idx, score FROM top""")
def t3_best_chunks(spark, sf_dir):
    """Top 4 chunks of every document by (score desc, index asc)."""
    d = read_spread(spark, sf_dir, "documents", "doc_id")
    qt = T.keyword_tokens(F.lit(QUESTION))
    ch = d.select("doc_id", F.posexplode(T.chunks("text")).alias("chunk_idx", "c"))
    from pyspark.sql import Window
    sc = ch.select("doc_id", "chunk_idx", T.keyword_overlap(T.keyword_tokens("c"), qt).alias("score"))
    w = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "chunk_idx")
    return sc.withColumn("rk", F.row_number().over(w)).where("rk <= 4").drop("rk")


@register("U2_keyword_overlap", f"""WITH q AS (SELECT list_distinct(list_filter(regexp_extract_all(lower('{QUESTION}'), '[a-zA-Z0-9_]+'), lambda t: length(t) > 2)) AS qt)
SELECT conv_id, turn, len(list_intersect(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-zA-Z0-9_]+'), lambda t: length(t) > 2)), qt)) AS overlap
FROM conversations, q""")
def u2_keyword_overlap(spark, sf_dir):
    """Keyword overlap between each message and the question."""
    c = read_table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", T.keyword_overlap(T.keyword_tokens("text"), T.keyword_tokens(F.lit(QUESTION))).alias("overlap"))


def _j7_messages(spark, sf_dir):
    c = read_spread(spark, sf_dir, "conversations", "conv_id")
    b = FX.names(spark, sf_dir)
    # a message mentions a workspace by name when its turn is even: deterministic suffix
    return c, b


J7_SQL = f"""{with_sql("names")},
nn AS (SELECT workspace_id, trim(regexp_replace(lower(coalesce(name, '')), '[^a-z0-9]+', ' ', 'g')) AS nn FROM names),
nm AS (SELECT conv_id, turn, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) AS nm FROM conversations),
sc AS (SELECT conv_id, turn, workspace_id,
              CASE WHEN contains(nm, nn) THEN 100 + length(nn)
                   ELSE len(list_filter(string_split(nn, ' '), lambda t: length(t) > 2 AND list_contains(string_split(nm, ' '), t))) END AS score
       FROM nm, nn WHERE length(nn) > 0),
pos AS (SELECT * FROM sc WHERE score > 0),
best AS (SELECT conv_id, turn, max(score) AS score FROM pos GROUP BY ALL),
win AS (SELECT p.conv_id, p.turn, count(*) AS n_best, min(p.workspace_id) AS wid, max(p.score) AS score
        FROM pos p JOIN best b ON p.conv_id = b.conv_id AND p.turn = b.turn AND p.score = b.score GROUP BY ALL)
SELECT c.conv_id, c.turn, CASE WHEN n_best = 1 THEN wid END AS workspace_id, CASE WHEN n_best = 1 THEN w.score END AS score
FROM conversations c LEFT JOIN win w ON c.conv_id = w.conv_id AND c.turn = w.turn"""


@register("J7_match_messages", J7_SQL)
def j7_match_messages(spark, sf_dir):
    """The workspace each chat message refers to (unique best name score)."""
    c = read_spread(spark, sf_dir, "conversations", "conv_id")
    return R.match_messages(c.select("conv_id", "turn", "text"), FX.names(spark, sf_dir), ["conv_id", "turn"])


@register("P2_search", """
SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(coalesce(p_type, '')), 'red')""")
def p2_search(spark, sf_dir):
    """Case-insensitive search over name and description columns."""
    p = read_table(spark, sf_dir, "part")
    return R.search(p, "RED", ["p_name", "p_type"]).select("p_partkey", "p_name", "p_type")


@register("P3_search_haystack", f"""{with_sql("orders_ws")}
SELECT workspace_id FROM orders_ws
WHERE contains(lower(name || ' ' || coalesce(CAST(event_date AS VARCHAR), '')), '1996-03')""")
def p3_search_haystack(spark, sf_dir):
    """Search over name + date text."""
    return R.search_haystack(FX.orders_ws(spark, sf_dir), " 1996-03 ").select("workspace_id")


@register("P4_apply_scope", f"""{with_sql("workspaces")}
SELECT workspace_id FROM workspaces
WHERE workspace_id IN ('src1', 'src2', 'src3', 'src90') AND workspace_id IN (SELECT workspace_id FROM workspaces WHERE user_id = 'user1')""")
def p4_apply_scope(spark, sf_dir):
    """Requested ids intersected with the user's allowed ids."""
    ws = FX.workspaces(spark, sf_dir)
    req = spark.createDataFrame([(x,) for x in ("src1", "src2", "src3", "src90")], "workspace_id string")
    allowed = ws.where(F.col("user_id") == "user1").select("workspace_id")
    return R.apply_scope(ws, req, allowed).select("workspace_id")


@register("T1_list_workspaces", f"""{with_sql("workspaces")}
SELECT workspace_id, name FROM workspaces ORDER BY created_at DESC, workspace_id LIMIT 20""")
def t1_list_workspaces(spark, sf_dir):
    """Newest workspaces, clamped limit (default 20)."""
    return R.list_workspaces(FX.workspaces(spark, sf_dir), None).select("workspace_id", "name")


@register("T2_latest_docs", f"""{with_sql("docs")}
SELECT doc_id, workspace_id FROM docs WHERE workspace_id IN ('src1', 'src2')
ORDER BY upload_date DESC, doc_id DESC LIMIT 6""")
def t2_latest_docs(spark, sf_dir):
    """Latest 6 documents over the whole scope."""
    scope = spark.createDataFrame([("src1",), ("src2",)], "workspace_id string")
    return R.latest_docs(FX.documents(spark, sf_dir), scope, 6).select("doc_id", "workspace_id")


@register("J13_scope_documents", f"""{with_sql("docs", "workspaces")},
scopes AS (SELECT workspace_id AS scope_id, workspace_id FROM workspaces WHERE user_id = 'user0')
SELECT scope_id, doc_id FROM (
  SELECT s.scope_id, d.doc_id, row_number() OVER (PARTITION BY s.scope_id ORDER BY d.upload_date DESC, d.doc_id DESC) AS rn
  FROM docs d JOIN scopes s USING (workspace_id)) WHERE rn <= 6""")
def j13_scope_documents(spark, sf_dir):
    """J13 batch form: per scope, its latest documents (row_number per scope)."""
    ws = FX.workspaces(spark, sf_dir)
    scopes = ws.where(F.col("user_id") == "user0").select(F.col("workspace_id").alias("scope_id"), "workspace_id")
    return R.latest_docs_per_scope(FX.documents(spark, sf_dir), scopes, "scope_id", 6).select("scope_id", "doc_id")


@register("V5_documents_context", f"""{with_sql("docs", "workspaces")},
scope AS (SELECT workspace_id FROM workspaces WHERE user_id = 'user1' AND workspace_id IN ('src1', 'src2', 'src3', 'src90')),
top AS (SELECT d.* FROM docs d JOIN scope USING (workspace_id) ORDER BY upload_date DESC, doc_id DESC LIMIT 20)
SELECT doc_id, workspace_id, name, length(coalesce(text, '')) AS text_length,
       sha256(CASE WHEN length(coalesce(text, '')) <= 8000 THEN coalesce(text, '') ELSE NULL END) AS short_digest FROM top""")
def v5_documents_context(spark, sf_dir):
    """V5: excerpts of a scope's latest documents with their whole lengths (more than 20 are never given)."""
    from docfields.plans.chat import documents_context

    ws = FX.workspaces(spark, sf_dir)
    req = spark.createDataFrame([(x,) for x in ("src1", "src2", "src3", "src90")], "workspace_id string")
    out = documents_context(FX.documents(spark, sf_dir), "what about the contact and the license?", max_docs=50,
                            requested=req, allowed=ws.where(F.col("user_id") == "user1"))
    whole = F.when(F.col("text_length") <= R.BUDGET, F.col("excerpt"))
    return out.select("doc_id", "workspace_id", "name", "text_length", F.sha2(whole, 256).alias("short_digest"))


@register("V5_list_workspaces", f"""{with_sql("workspaces")}
SELECT workspace_id, name, description FROM workspaces WHERE user_id = 'user0' ORDER BY created_at DESC, workspace_id LIMIT 5""")
def v5_list_workspaces(spark, sf_dir):
    """V5: the newest workspaces a user may see."""
    from docfields.plans.chat import workspaces_list

    ws = FX.workspaces(spark, sf_dir)
    return workspaces_list(ws, 5, allowed=ws.where(F.col("user_id") == "user0")).select("workspace_id", "name", "description")


@register("V5_tables", f"""{with_sql("cells")},
o AS (SELECT o_orderkey AS doc_id, 'c' || CAST(o_custkey % 10 AS VARCHAR) AS workspace_id, o_orderdate AS upload_date FROM orders),
top AS (SELECT * FROM o WHERE workspace_id IN ('c1', 'c2') ORDER BY upload_date DESC, doc_id DESC LIMIT 6)
SELECT doc_id, workspace_id, count(DISTINCT table_index) AS n_tables, count(*) AS n_cells
FROM top JOIN cells USING (doc_id) GROUP BY ALL""")
def v5_tables(spark, sf_dir):
    """The nested tables of a scope's latest documents."""
    from docfields.operators.tables import assemble_tables
    from docfields.plans.chat import documents_tables

    o = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("c"), (F.col("o_custkey") % 10).cast("string")).alias("workspace_id"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderdate").alias("upload_date"))
    docs = o.join(assemble_tables(FX.cells(spark, sf_dir)), "doc_id", "left")
    scope = spark.createDataFrame([("c1",), ("c2",)], "workspace_id string")
    out = documents_tables(docs, requested=scope)
    cells = F.aggregate(F.flatten(F.transform("tables", lambda t: t["preview"])), F.lit(0), lambda n, r: n + F.size(r))
    return out.select("doc_id", "workspace_id", F.size("tables").alias("n_tables"), cells.alias("n_cells"))


@register("W6_retain", """
SELECT conv_id, turn FROM (
  SELECT conv_id, turn, sum(length(text) // 4 + 1) OVER (PARTITION BY conv_id) AS tt,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS pe FROM conversations)
WHERE tt < 600 OR pe <= 4""")
def w6_retain(spark, sf_dir):
    """Conversation retention with lowered limits (600 tokens, keep 4)."""
    c = read_table(spark, sf_dir, "conversations")
    return R.retain(c, "conv_id", "turn", 600, 4).select("conv_id", "turn")


@register("Q4_retrieve")
def q4_retrieve(spark, sf_dir):
    """Q4: J7 -> P4 -> T2 -> X12/X19/U2 -> T3 -> W5 for every message (J7 decides which ones name a workspace)."""
    from docfields.plans.chat import retrieve_for_messages

    c = read_spread(spark, sf_dir, "conversations", "conv_id")
    # benchmark item k names workspace src(k % 20)
    names = FX.names(spark, sf_dir).select(
        F.concat(F.lit("src"), (F.col("workspace_id") % 20).cast("string")).alias("workspace_id"), "name")
    out = retrieve_for_messages(c, names, FX.documents(spark, sf_dir))
    return out.select("conv_id", "turn", "workspace_id", "doc_id", F.length("excerpt").alias("n_chars"))
