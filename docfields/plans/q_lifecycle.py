"""Queries for scans, mutations, caches, hashing and usage (S1, S2, S5, M1-M10, J8, P6,
X9-X11, W3, A4, A5)."""
from __future__ import annotations

from pyspark.sql import functions as F

from docfields.operators import lifecycle as LC
from docfields.plans.registry import register
from docfields.sources import fixtures as FX
from docfields.sources.fixtures import with_sql
from docfields.sources.tables import read_table

KEY = "0123456789abcdef0123456789abcdef"


@register("S1_scan_workspaces", f"""{with_sql("workspaces")}
SELECT workspace_id, name, description, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
       CAST(event_date AS VARCHAR) AS event_date FROM workspaces""")
def s1_scan_workspaces(spark, sf_dir):
    """All workspaces, newest first."""
    return LC.scan_workspaces(FX.workspaces(spark, sf_dir))


@register("S2_scan_documents", f"""{with_sql("docs")}
SELECT doc_id, name, strftime(upload_date, '%Y-%m-%d %H:%M:%S') AS upload_date FROM docs WHERE workspace_id = 'src3'""")
def s2_scan_documents(spark, sf_dir):
    """Documents of one workspace (filter pushed to parquet)."""
    return LC.scan_documents(FX.documents(spark, sf_dir), "src3").select("doc_id", "name", "upload_date")


@register("S5_lookup", f"""{with_sql("docs")}
SELECT doc_id, name FROM docs WHERE doc_id = 7""")
def s5_lookup(spark, sf_dir):
    """Point lookup by key."""
    return LC.lookup(FX.documents(spark, sf_dir), "doc_id", 7, ["doc_id", "name"])


@register("M1_upsert", f"""{with_sql("workspaces")},
ch AS (SELECT workspace_id, 'Renamed ' || name AS name, description, created_at, event_date, user_id
       FROM workspaces WHERE CAST(substring(workspace_id, 4, 10) AS INTEGER) % 4 = 0
       UNION ALL SELECT 'new1', 'New', NULL, TIMESTAMP '2024-02-01 00:00:00', NULL, 'user0')
SELECT workspace_id, name FROM workspaces WHERE workspace_id NOT IN (SELECT workspace_id FROM ch)
UNION ALL SELECT workspace_id, name FROM ch""")
def m1_upsert(spark, sf_dir):
    """M1: insert-or-replace by key."""
    ws = FX.workspaces(spark, sf_dir)
    k = F.substring("workspace_id", 4, 10).cast("int")
    ch = ws.where(k % 4 == 0).withColumn("name", F.concat(F.lit("Renamed "), F.col("name"))).unionByName(
        spark.createDataFrame([("new1", "New", None, None, None, "user0")],
                              "workspace_id string, name string, description string, created_at timestamp_ntz, event_date date, user_id string")
        .withColumn("created_at", F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")))
    return LC.upsert(ws, ch, ["workspace_id"]).select("workspace_id", "name")


@register("M2_upsert_partial", f"""{with_sql("docs")},
ch AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'renamed_' || name END AS name,
              CASE WHEN doc_id % 3 = 0 THEN 'p/' || CAST(doc_id AS VARCHAR) END AS path
       FROM docs WHERE doc_id % 5 = 0),
b AS (SELECT doc_id, name, NULL AS path, 'ready' AS status FROM docs)
SELECT coalesce(b.doc_id, ch.doc_id) AS doc_id, coalesce(ch.name, b.name) AS name, coalesce(ch.path, b.path) AS path,
       CASE WHEN ch.path IS NOT NULL THEN 'pending' ELSE b.status END AS status
FROM b FULL OUTER JOIN ch ON b.doc_id = ch.doc_id""")
def m2_upsert_partial(spark, sf_dir):
    """M2: partial-column upsert; a supplied path resets the status to pending."""
    d = FX.documents(spark, sf_dir)
    base = d.select("doc_id", "name", F.lit(None).cast("string").alias("path"), F.lit("ready").alias("status"))
    ch = d.where(F.col("doc_id") % 5 == 0).select(
        "doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("renamed_"), F.col("name"))).alias("name"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("p/"), F.col("doc_id").cast("string"))).alias("path"))
    return LC.upsert_partial(base, ch, ["doc_id"], ["name", "path"], reset_when="path", reset={"status": "pending"})


@register("M3_update_where", f"""{with_sql("docs")}
SELECT doc_id, CASE WHEN workspace_id = 'src4' THEN 'archived' ELSE 'ready' END AS status FROM docs""")
def m3_update_where(spark, sf_dir):
    """M3: set a column for matching ids."""
    d = FX.documents(spark, sf_dir).select("doc_id", "workspace_id", F.lit("ready").alias("status"))
    return LC.update_where(d, F.col("workspace_id") == "src4", {"status": "archived"}).select("doc_id", "status")


@register("M4_delete_cascade", f"""{with_sql("docs", "workspaces")}
SELECT 'ws' AS kind, count(*) AS n FROM workspaces WHERE workspace_id NOT IN ('src1', 'src5')
UNION ALL SELECT 'docs', count(*) FROM docs WHERE workspace_id NOT IN ('src1', 'src5')""")
def m4_delete_cascade(spark, sf_dir):
    """M4: delete workspaces and their documents."""
    ids = spark.createDataFrame([("src1",), ("src5",)], "workspace_id string")
    ws, docs = LC.delete_cascade(FX.workspaces(spark, sf_dir), FX.documents(spark, sf_dir), ids)
    return ws.agg(F.count(F.lit(1)).alias("n")).select(F.lit("ws").alias("kind"), "n").unionByName(
        docs.agg(F.count(F.lit(1)).alias("n")).select(F.lit("docs").alias("kind"), "n"))


@register("M5_delete_workspace_docs", f"""{with_sql("docs")},
d AS (SELECT *, 'u/' || workspace_id || '/' || CAST(doc_id AS VARCHAR) AS original_path,
             CASE WHEN doc_id % 2 = 0 THEN 'u/' || workspace_id || '/t' END AS template_path FROM docs)
SELECT DISTINCT p AS path FROM (SELECT original_path AS p FROM d WHERE workspace_id = 'src2'
                                UNION ALL SELECT template_path FROM d WHERE workspace_id = 'src2') WHERE p IS NOT NULL""")
def m5_delete_workspace_docs(spark, sf_dir):
    """M5: distinct storage paths to remove when a workspace's documents are deleted."""
    d = FX.documents(spark, sf_dir).withColumn(
        "original_path", F.concat(F.lit("u/"), F.col("workspace_id"), F.lit("/"), F.col("doc_id").cast("string"))) \
        .withColumn("template_path", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("u/"), F.col("workspace_id"), F.lit("/t"))))
    _, _, paths = LC.delete_workspace_docs(d, spark.createDataFrame([("src2",)], "workspace_id string"))
    return paths


@register("M6_filter_uploads", f"""{with_sql("docs")},
batch AS (SELECT workspace_id, CASE WHEN doc_id % 3 = 0 THEN name ELSE 'new_' || CAST(doc_id % 7 AS VARCHAR) ||
                 CASE WHEN doc_id % 11 = 0 THEN '.pdf' ELSE '.docx' END END AS name, doc_id AS seq FROM docs),
b AS (SELECT *, row_number() OVER (PARTITION BY workspace_id, name ORDER BY seq) AS rn FROM batch WHERE name LIKE '%.docx'),
ex AS (SELECT workspace_id, name, min(doc_id) AS existing_id FROM docs GROUP BY ALL)
SELECT b.workspace_id, b.name, b.seq, ex.existing_id,
       CASE WHEN ex.existing_id IS NOT NULL THEN 'duplicate' WHEN rn > 1 THEN 'duplicate_in_batch' ELSE 'upload' END AS action
FROM b LEFT JOIN ex USING (workspace_id, name)""")
def m6_filter_uploads(spark, sf_dir):
    """M6: upload batch filter (.docx only, existing names and in-batch repeats flagged)."""
    d = FX.documents(spark, sf_dir)
    name = F.when(F.col("doc_id") % 3 == 0, F.col("name")).otherwise(F.concat(
        F.lit("new_"), (F.col("doc_id") % 7).cast("string"),
        F.when(F.col("doc_id") % 11 == 0, F.lit(".pdf")).otherwise(F.lit(".docx"))))
    batch = d.select("workspace_id", name.alias("name"), F.col("doc_id").alias("seq"))
    return LC.filter_uploads(batch, d)


@register("M7_replace_config", """
WITH pri AS (SELECT DISTINCT o_custkey AS user_id, o_orderpriority AS name FROM orders),
st AS (SELECT DISTINCT o_custkey AS user_id, o_orderstatus AS name FROM orders WHERE o_custkey % 3 = 0)
SELECT user_id, name, CAST(NULL AS VARCHAR) AS description,
       row_number() OVER (PARTITION BY user_id ORDER BY name) - 1 AS "order" FROM pri WHERE user_id % 3 <> 0
UNION ALL
SELECT user_id, name, 'status ' || name, row_number() OVER (PARTITION BY user_id ORDER BY name) - 1 FROM st""")
def m7_replace_config(spark, sf_dir):
    """M7: every customer's columns are the priorities of the orders; every third customer sets the statuses instead."""
    o = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderpriority", "o_orderstatus")
    base = o.groupBy("user_id").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("l")) \
        .select("user_id", F.posexplode("l").alias("order", "name")) \
        .select("user_id", "name", F.lit(None).cast("string").alias("description"), "order")
    rows = o.where(F.col("user_id") % 3 == 0).groupBy("user_id").agg(F.transform(
        F.array_sort(F.collect_set("o_orderstatus")),
        lambda s: F.struct(s.alias("name"), F.concat(F.lit("status "), s).alias("description"))).alias("cols"))
    return LC.replace_config(base, rows)


M8_OUTCOME = "CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'error' WHEN 'signup' THEN 'no_config' ELSE 'none' END"


@register("M8_resolve_status", f"""
WITH log AS (SELECT user_id AS doc_id, {M8_OUTCOME} AS outcome, ts, event_id AS seq FROM events),
last AS (SELECT doc_id, arg_max(outcome, (ts, seq)) AS outcome FROM log GROUP BY ALL)
SELECT doc_id, CASE outcome WHEN 'ok' THEN 'ready' WHEN 'failed' THEN 'failed' WHEN 'error' THEN 'error'
                            WHEN 'no_config' THEN 'not_configured' ELSE 'pending' END AS status FROM last""")
def m8_resolve_status(spark, sf_dir):
    """M8: document status from the latest upload outcome."""
    e = read_table(spark, sf_dir, "events")
    outcome = (F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_type") == "error", "failed")
               .when(F.col("event_type") == "click", "error").when(F.col("event_type") == "signup", "no_config")
               .otherwise("none"))
    log = e.select(F.col("user_id").alias("doc_id"), outcome.alias("outcome"), "ts", F.col("event_id").alias("seq"))
    return LC.resolve_status(log)


@register("M9_migrate_summary", f"""{with_sql("docs", "workspaces")}
SELECT w.user_id, count(*) FILTER (WHERE d.doc_id % 4 <> 0) AS moved, count(*) FILTER (WHERE d.doc_id % 4 = 0) AS failed
FROM docs d JOIN workspaces w USING (workspace_id) WHERE d.doc_id % 3 <> 0 GROUP BY ALL""")
def m9_migrate_summary(spark, sf_dir):
    """M9: per user, moved and failed documents among those with a remote id."""
    d = FX.documents(spark, sf_dir).join(FX.workspaces(spark, sf_dir).select("workspace_id", "user_id"), "workspace_id")
    d = d.withColumn("remote_id", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id")))
    out = d.select("doc_id", (F.col("doc_id") % 4 != 0).alias("moved"))
    return LC.migrate_summary(d, out)


@register("M10_classify_changes", """
SELECT c_custkey, CASE WHEN c_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) THEN 'rotated' ELSE 'created' END AS action
FROM customer WHERE c_custkey % 3 = 0""")
def m10_classify_changes(spark, sf_dir):
    """Incoming keys labelled created / rotated against existing rows."""
    c = read_table(spark, sf_dir, "customer")
    base, changes = c.where(F.col("c_custkey") % 2 == 0), c.where(F.col("c_custkey") % 3 == 0)
    return LC.classify_changes(base.select("c_custkey"), changes.select("c_custkey"), ["c_custkey"])


X9_SQL = f"""{with_sql("docs")},
fp AS (SELECT doc_id, sha256(name || ':' || text || 'user_instructions:') AS fingerprint FROM docs),
results AS (SELECT fingerprint, '{{"doc_id": ' || CAST(doc_id AS VARCHAR) || '}}' AS payload,
                   TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS stored_at FROM fp WHERE doc_id % 2 = 0)"""


@register("X9_fingerprint", f"""{X9_SQL}
SELECT doc_id, fingerprint FROM fp""")
def x9_fingerprint(spark, sf_dir):
    """Input fingerprint of each single-document request (whole text, D6)."""
    d = FX.documents(spark, sf_dir)
    return d.select("doc_id", LC.doc_fingerprint(F.col("name"), F.col("text")).alias("fingerprint"))


@register("X9_fingerprint_group", f"""{with_sql("docs")}
SELECT workspace_id, sha256(string_agg(name || ':' || coalesce(text, ''), '' ORDER BY doc_id)
    || string_agg('docx:' || '/files/' || name, '' ORDER BY doc_id) || 'user_instructions:keep dates') AS fingerprint
FROM docs GROUP BY workspace_id""")
def x9_fingerprint_group(spark, sf_dir):
    """One fingerprint for all documents of each workspace, their paths and the trimmed instructions."""
    d = FX.documents(spark, sf_dir).withColumn("path", F.concat(F.lit("/files/"), "name"))
    return LC.fingerprint(d, instructions="  keep dates\n", paths_col="path")


@register("S10_append_log", f"""{with_sql("calls")}
SELECT 'call' AS action, run_id, CAST(input_tokens AS BIGINT) AS amount FROM calls
UNION ALL SELECT 'cost', run_id, CAST(sum(output_tokens) AS BIGINT) FROM calls GROUP BY run_id""")
def s10_append_log(spark, sf_dir):
    """Two appends to an audit log, read back."""
    from docfields.sources.arrivals import shared_folder

    c, path = FX.calls(spark, sf_dir), shared_folder(spark, "audit")
    LC.append(c.select(F.lit("call").alias("action"), "run_id", F.col("input_tokens").alias("amount")), path)
    LC.append(c.groupBy("run_id").agg(F.sum("output_tokens").alias("amount")).select(
        F.lit("cost").alias("action"), "run_id", "amount"), path)
    return spark.read.parquet(path)


@register("J8_split_cached", f"""{X9_SQL},
fr AS (SELECT * FROM results WHERE epoch(TIMESTAMP '{FX.AS_OF}') - epoch(stored_at) < 3600)
SELECT fp.doc_id, CASE WHEN fr.fingerprint IS NULL THEN 0 ELSE 1 END AS cache_hit, fr.payload
FROM fp LEFT JOIN fr USING (fingerprint)""")
def j8_split_cached(spark, sf_dir):
    """J8 + P6: documents with a fresh stored result reuse it; the rest are processed."""
    d = FX.documents(spark, sf_dir)
    fp = d.select("doc_id", LC.doc_fingerprint(F.col("name"), F.col("text")).alias("fingerprint"))
    results = d.where(F.col("doc_id") % 2 == 0).select(
        LC.doc_fingerprint(F.col("name"), F.col("text")).alias("fingerprint"),
        F.concat(F.lit('{"doc_id": '), F.col("doc_id").cast("string"), F.lit("}")).alias("payload"),
        F.col("upload_date").alias("stored_at"))
    hits, misses = LC.split_cached(fp, results, FX.AS_OF, 3600)
    return hits.select("doc_id", F.lit(1).alias("cache_hit"), "payload").unionByName(
        misses.select("doc_id", F.lit(0).alias("cache_hit"), F.lit(None).cast("string").alias("payload")))


@register("P6_fresh", f"""
SELECT event_id FROM events WHERE epoch(TIMESTAMP '2024-01-02 00:00:00') - epoch(ts) < 86400""")
def p6_fresh(spark, sf_dir):
    """Entries younger than the 24 h browser TTL at a fixed clock."""
    e = read_table(spark, sf_dir, "events")
    return LC.fresh(e, "2024-01-02 00:00:00", LC.TTL_BROWSER, ts="ts").select("event_id")


@register("X10_short_hash", """SELECT c_custkey, left(sha256(c_name), 16) AS short_hash FROM customer""")
def x10_short_hash(spark, sf_dir):
    """First 16 hex characters of SHA-256."""
    c = read_table(spark, sf_dir, "customer")
    return c.select("c_custkey", LC.short_hash("c_name").alias("short_hash"))


@register("X11_encrypt_roundtrip", """SELECT c_custkey, c_name AS decrypted, 28 + length(c_name) AS n_bytes FROM customer""")
def x11_encrypt_roundtrip(spark, sf_dir):
    """X11: AES-256-GCM column encryption round trip (nonce 12 + data + tag 16 bytes)."""
    c = read_table(spark, sf_dir, "customer")
    enc = LC.encrypt("c_name", KEY)
    return c.select("c_custkey", LC.decrypt(enc, KEY).alias("decrypted"),
                    F.length(F.unbase64(enc)).cast("bigint").alias("n_bytes"))


W3_SQL = """
WITH k AS (SELECT user_id, CASE event_type WHEN 'view' THEN 'openai' WHEN 'click' THEN 'gemini' WHEN 'purchase' THEN 'groq'
                                   ELSE 'other' END AS provider,
                  CASE WHEN value > 50 THEN 'm-' || event_type END AS model,
                  CASE WHEN event_type <> 'error' THEN 'active' ELSE 'revoked' END AS status,
                  CASE WHEN event_type IN ('view', 'click') THEN ts END AS last_used_at, ts AS created_at FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_used_at DESC NULLS FIRST, created_at DESC NULLS FIRST) AS rn
      FROM k WHERE status = 'active')
SELECT user_id, provider, coalesce(model, CASE provider WHEN 'openai' THEN 'gpt-4.1-mini' WHEN 'gemini' THEN 'gemini-2.0-flash'
                                              WHEN 'groq' THEN 'llama-3.3-70b-versatile' END, 'gpt-4.1-mini') AS model
FROM r WHERE rn = 1"""


@register("W3_latest_active", W3_SQL)
def w3_latest_active(spark, sf_dir):
    """Latest active key row per user (nulls first on desc), default model by provider."""
    e = read_table(spark, sf_dir, "events")
    provider = (F.when(F.col("event_type") == "view", "openai").when(F.col("event_type") == "click", "gemini")
                .when(F.col("event_type") == "purchase", "groq").otherwise("other"))
    k = e.select("user_id", provider.alias("provider"),
                 F.when(F.col("value") > 50, F.concat(F.lit("m-"), F.col("event_type"))).alias("model"),
                 F.when(F.col("event_type") != "error", "active").otherwise("revoked").alias("status"),
                 F.when(F.col("event_type").isin("view", "click"), F.col("ts")).alias("last_used_at"),
                 F.col("ts").alias("created_at"))
    return LC.latest_active(k)


A4_SQL = f"""{with_sql("calls")}
SELECT run_id, count(*) AS calls, sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens,
       sum(input_tokens) + sum(output_tokens) AS total_tokens, sum(prompt_chars) AS prompt_chars,
       CAST(sum(input_tokens) // count(*) AS BIGINT) AS avg_input_tokens,
       CAST(sum(output_tokens) // count(*) AS BIGINT) AS avg_output_tokens
FROM calls GROUP BY run_id"""


@register("A4_usage_summary", A4_SQL)
def a4_usage_summary(spark, sf_dir):
    """A4: model-call usage per run with floor averages."""
    return LC.usage_summary(FX.calls(spark, sf_dir))


@register("A5_cost", f"""{with_sql("calls")}
SELECT run_id, round((sum(input_tokens) * 0.15 + sum(output_tokens) * 0.6) / 1000000, 6) AS cost FROM calls GROUP BY run_id""")
def a5_cost(spark, sf_dir):
    """A5: cost estimate from the usage summary (prices per million tokens)."""
    return LC.cost(LC.usage_summary(FX.calls(spark, sf_dir)), 0.15, 0.6).select("run_id", "cost")
