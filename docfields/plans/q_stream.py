"""Queries for the chat stream (R1, R2, R3, W7), the streaming forms (R1, R2, R3, R4, R5) and Q6."""
from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from docfields.plans.registry import register
from docfields.session import ensure_checkpoint_dir
from docfields.operators import retrieve as R
from docfields.sources import fixtures as FX
from docfields.sources.arrivals import arrival_stream, shared_folder
from docfields.sources.fixtures import with_sql
from docfields.streaming import chat as C


ARRIVALS = 3


def _frames(spark, sf_dir):
    ev = FX.chat_events(spark, sf_dir)
    fr = C.encode_frames(ev)
    # every 10th frame is cut (bad JSON); a trailing partial frame is appended
    bad = F.col("seq") % 10 == 0
    chunk = F.concat(F.when(bad, F.lit("data: {\"type\": \"token\", \"cont\n\n")).otherwise(F.col("frame")),
                     F.lit("data: {\"partial\""))
    return fr.select("thread_id", "seq", chunk.alias("chunk"))


@register("R1_parse_frames", f"""{with_sql("chat_events")}
SELECT thread_id, seq, 0 AS frame_idx, type, content FROM chat_events WHERE seq % 10 <> 0""")
def r1_parse_frames(spark, sf_dir):
    """SSE-style frames parsed back to messages; cut frames skipped."""
    out = C.parse_frames(_frames(spark, sf_dir).withColumnRenamed("seq", "src_seq"), keys=["src_seq"])
    return out.select("thread_id", "seq", "frame_idx", "type", "content")


@register("W7_suppress_repeats", f"""{with_sql("chat_events")},
h AS (SELECT thread_id, seq, CASE WHEN length(PYSTRIP(content)) > 220 THEN substring(PYSTRIP(content), 1, 220) || '...'
                                  ELSE PYSTRIP(content) END AS hint
      FROM chat_events WHERE type = 'thinking'),
k AS (SELECT *, lag(hint) OVER (PARTITION BY thread_id ORDER BY seq) AS prev FROM h WHERE length(hint) > 0)
SELECT thread_id, seq, hint FROM k WHERE prev IS NULL OR prev <> hint""")
def w7_suppress_repeats(spark, sf_dir):
    """Thinking hints shortened and consecutive repeats dropped."""
    return C.suppress_repeats(FX.chat_events(spark, sf_dir)).select("thread_id", "seq", "hint")


R2_SQL = f"""{with_sql("chat_events")},
cut AS (SELECT thread_id, min(seq) AS c FROM chat_events WHERE type = 'tool_start' GROUP BY ALL),
toks AS (SELECT e.thread_id, string_agg(e.content, '' ORDER BY e.seq) AS text, count(*) AS n_tokens
         FROM chat_events e LEFT JOIN cut USING (thread_id)
         WHERE e.type = 'token' AND (cut.c IS NULL OR e.seq > cut.c) GROUP BY ALL),
errs AS (SELECT thread_id, count(*) AS n_errors FROM chat_events WHERE type = 'error' GROUP BY ALL),
meta AS (SELECT thread_id, arg_max(content, seq) AS meta FROM chat_events WHERE type = 'meta' GROUP BY ALL)
SELECT b.thread_id, sha256(coalesce(text, '')) AS digest, coalesce(n_tokens, 0) AS n_tokens,
       coalesce(n_errors, 0) AS n_errors, meta
FROM (SELECT DISTINCT thread_id FROM chat_events) b LEFT JOIN toks USING (thread_id)
LEFT JOIN errs USING (thread_id) LEFT JOIN meta USING (thread_id)"""


@register("R2_fold_messages", R2_SQL)
def r2_fold_messages(spark, sf_dir):
    """R2 batch: message text after the first tool_start, errors and meta per thread."""
    f = C.fold_messages(FX.chat_events(spark, sf_dir))
    return f.select("thread_id", F.sha2("text", 256).alias("digest"), "n_tokens", "n_errors", "meta")


@register("R3_open_activity", f"""{with_sql("chat_events")},
s AS (SELECT thread_id, seq, content AS tool FROM chat_events WHERE type = 'tool_start'),
e AS (SELECT thread_id, content AS tool, max(seq) AS last_end FROM chat_events WHERE type = 'tool_end' GROUP BY ALL)
SELECT s.thread_id, s.seq, s.tool FROM s LEFT JOIN e USING (thread_id, tool) WHERE e.last_end IS NULL OR e.last_end < s.seq""")
def r3_open_activity(spark, sf_dir):
    """Tool activity still open at the end of each thread."""
    return C.open_activity(FX.chat_events(spark, sf_dir))


def _events_stream(spark, sf_dir):
    schema = spark.read.parquet(os.path.join(sf_dir, "events.parquet")).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _ckpt(spark, name):
    return os.path.join(ensure_checkpoint_dir(spark), f"stream-{name}-{uuid.uuid4().hex}")


@register("R2_fold_messages_stream", R2_SQL)
def r2_fold_messages_stream(spark, sf_dir):
    """R2 streaming (applyInPandasWithState) over arrivals of the events; equals the batch fold."""
    ev = arrival_stream(FX.chat_events(spark, sf_dir).drop("ts"), "seq", "thread_id", ARRIVALS, "r2")
    out = C.run_to_table(C.fold_messages_stream(ev), _ckpt(spark, "r2"), keys=["thread_id"])
    return out.select("thread_id", F.sha2("text", 256).alias("digest"), "n_tokens", "n_errors", "meta")


@register("R5_usage_stream", f"""{with_sql("calls")}
SELECT run_id, count(*) AS calls, sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens
FROM calls GROUP BY run_id""")
def r5_usage_stream(spark, sf_dir):
    """Running usage totals from a streaming aggregation (complete result)."""
    e = _events_stream(spark, sf_dir)
    calls = e.select(F.col("user_id").alias("run_id"), F.floor(F.col("value") * 10).cast("bigint").alias("input_tokens"),
                     F.floor("value").cast("bigint").alias("output_tokens"))
    return C.run_to_table(C.usage_stream(calls), _ckpt(spark, "r5"), mode="complete")


R3_ACTIVITY_SQL = f"""{with_sql("chat_stream_events")},
named AS (SELECT thread_id, seq, type, CASE WHEN length(content) > 0 THEN content ELSE 'tool' END AS tool, content
          FROM chat_stream_events),
ends AS (SELECT thread_id, tool, max(seq) AS last_end FROM named WHERE type = 'tool_end' GROUP BY ALL)
SELECT thread_id, seq, 'tool_start' AS kind, 'Calling ' || tool AS label FROM named LEFT JOIN ends USING (thread_id, tool)
WHERE type = 'tool_start' AND (last_end IS NULL OR last_end < seq)
UNION ALL
SELECT thread_id, seq, 'thinking', PYSTRIP(CASE WHEN length(content) > 0 THEN content ELSE 'Thinking' END)
FROM named WHERE type = 'thinking'"""


@register("R3_activity", R3_ACTIVITY_SQL)
def r3_activity(spark, sf_dir):
    """The activity list of each thread: thinking entries and calls that no later tool_end closed."""
    return C.activity(FX.chat_stream_events(spark, sf_dir))


@register("R3_activity_stream", R3_ACTIVITY_SQL)
def r3_activity_stream(spark, sf_dir):
    """R3 streaming over several micro-batches: entries as state, calls removed by a tool_end of a later batch."""
    ev = arrival_stream(FX.chat_stream_events(spark, sf_dir), "seq", "thread_id", ARRIVALS, "r3")
    return C.activity_rows(C.run_to_table(C.activity_stream(ev), _ckpt(spark, "r3"), keys=["thread_id"]))


def _chunks(spark, sf_dir):
    """The byte stream, encoded once and written: its arrivals are cut from the table, not encoded again each."""
    path = shared_folder(spark, "chunks")
    chunks = C.encode_chunks(FX.chat_stream_events(spark, sf_dir))
    chunks.write.parquet(path)
    return spark.read.schema(chunks.schema).parquet(path)


@register("R1_parse_frames_stream", f"""{with_sql("chat_stream_events")}
SELECT thread_id, row_number() OVER (PARTITION BY thread_id ORDER BY seq) - 1 AS pos, type, content FROM chat_stream_events""")
def r1_parse_frames_stream(spark, sf_dir):
    """R1 streaming: every frame is cut by a chunk border, some by the border of two micro-batches."""
    chunks = arrival_stream(_chunks(spark, sf_dir), "chunk_no", "thread_id", ARRIVALS, "r1")
    path = shared_folder(spark, "frames")
    return C.run_batches(C.frames_stream(chunks), path, _ckpt(spark, "r1"), mode="append").drop("batch")


MAX_TOKENS, KEEP = 600, 4


@register("Q6_chat_stream", f"""{with_sql("chat_stream_events")},
e AS (SELECT *, CAST(count(*) FILTER (WHERE type = 'meta') OVER (PARTITION BY thread_id ORDER BY seq) AS BIGINT) AS msg FROM chat_stream_events),
base AS (SELECT DISTINCT thread_id, msg FROM e UNION SELECT DISTINCT thread_id, 0 FROM e),
cut AS (SELECT thread_id, msg, min(seq) AS c FROM e WHERE type = 'tool_start' GROUP BY ALL),
txt AS (SELECT thread_id, msg, string_agg(content, '' ORDER BY seq) AS text, count(*) AS n_tokens FROM e LEFT JOIN cut USING (thread_id, msg)
        WHERE type = 'token' AND (c IS NULL OR seq > c) GROUP BY ALL),
err AS (SELECT thread_id, msg, count(*) AS n_errors, arg_max(content, seq) AS error FROM e WHERE type = 'error' GROUP BY ALL),
hint AS (SELECT thread_id, msg, seq, PYSTRIP(content) AS h, lag(PYSTRIP(content)) OVER (PARTITION BY thread_id, msg ORDER BY seq) AS prev
         FROM e WHERE type = 'thinking'),
named AS (SELECT thread_id, msg, seq, type, CASE WHEN length(content) > 0 THEN content ELSE 'tool' END AS tool FROM e WHERE type LIKE 'tool%'),
ends AS (SELECT thread_id, msg, tool, max(seq) AS last_end FROM named WHERE type = 'tool_end' GROUP BY ALL),
entry AS (SELECT thread_id, msg, seq, 'thinking:' || h AS entry FROM hint WHERE prev IS NULL OR prev <> h
          UNION ALL SELECT thread_id, msg, seq, 'tool_start:Calling ' || tool FROM named LEFT JOIN ends USING (thread_id, msg, tool)
          WHERE type = 'tool_start' AND (last_end IS NULL OR last_end < seq)),
act AS (SELECT thread_id, msg, string_agg(entry, '|' ORDER BY seq) AS activity, count(*) FILTER (WHERE entry LIKE 'thinking:%') AS n_hints
        FROM entry GROUP BY ALL),
m AS (SELECT thread_id, msg, coalesce(text, '') AS text, coalesce(n_tokens, 0) AS n_tokens, coalesce(n_errors, 0) AS n_errors, error,
             coalesce(n_hints, 0) AS n_hints, coalesce(activity, '') AS activity
      FROM base LEFT JOIN txt USING (thread_id, msg) LEFT JOIN err USING (thread_id, msg) LEFT JOIN act USING (thread_id, msg))
SELECT thread_id, msg, sha256(text) AS digest, n_tokens, n_errors, error, n_hints, activity FROM m
QUALIFY sum(length(text) // 4 + 1) OVER (PARTITION BY thread_id) < {MAX_TOKENS}
     OR row_number() OVER (PARTITION BY thread_id ORDER BY msg DESC) <= {KEEP}""")
def q6_chat_stream(spark, sf_dir):
    """Q6: R1 -> W7 -> R2 / R3 in one streaming query over a cut byte stream, then W6 on the messages."""
    chunks = arrival_stream(_chunks(spark, sf_dir), "chunk_no", "thread_id", ARRIVALS, "q6")
    messages = C.chat_stream(chunks, shared_folder(spark, "responses"), _ckpt(spark, "q6"))
    kept = R.retain(messages, "thread_id", "msg", MAX_TOKENS, KEEP)
    return kept.select("thread_id", "msg", F.sha2("text", 256).alias("digest"), "n_tokens", "n_errors", "error", "n_hints",
                       F.array_join("activity", "|").alias("activity"))


PENDING_SQL = """up AS (SELECT doc_id, text || chr(10) || chr(10) || chr(10) || '![logo](a.png) end ' AS raw FROM documents WHERE doc_id % 11 <> 0)"""


@register("R4_stream_ingest", f"""WITH {PENDING_SQL}
SELECT doc_id, 1 AS ok, sha256(PYSTRIP(regexp_replace(regexp_replace(raw, '!\\[[^\\]]*]\\([^)]*\\)', '', 'g'),
                                                    '\\n{{3,}}', chr(10) || chr(10), 'g'))) AS digest FROM up
UNION ALL SELECT doc_id, 0, sha256('') FROM documents WHERE doc_id % 11 = 0""")
def r4_stream_ingest(spark, sf_dir):
    """Uploads arrive in several batches; an unreadable one stays pending until a later upload of the document
    succeeds, and is never put in place of a row that was read."""
    from docfields.sources.ingest import upsert_stream

    d = FX.documents(spark, sf_dir).select("doc_id", "text")
    body = F.concat("text", F.lit("\n\n\n![logo](a.png) end "))
    n = F.col("doc_id")
    first = d.select("doc_id", (n * 2).alias("upload"), F.when((n % 7 != 0) & (n % 11 != 0), body).alias("raw_text"))
    # every seventh document comes again and can be read now; of the others some come again, unreadable
    top = d.agg(F.max("doc_id")).scalar() * 2 + 2
    again = d.where((n % 7 == 0) | (n % 3 == 0)).select(
        "doc_id", (top + n).alias("upload"), F.when((n % 7 == 0) & (n % 11 != 0), body).alias("raw_text"))
    stream = arrival_stream(first.unionByName(again), "upload", "doc_id", ARRIVALS, "r4")
    rows = upsert_stream(stream, _read_upload, ["doc_id"], shared_folder(spark, "uploads"), _ckpt(spark, "r4"), "upload")
    return rows.select("doc_id", F.col("ok").cast("bigint").alias("ok"), F.sha2("text", 256).alias("digest"))


def _read_upload(uploads):
    """Stands for a parser: an upload without text cannot be read."""
    from docfields.functions.text import clean_markdown

    return uploads.select("doc_id", "upload", F.coalesce(clean_markdown("raw_text"), F.lit("")).alias("text"),
                          F.col("raw_text").isNotNull().alias("ok"))


@register("R4_catch_up", f"""WITH {PENDING_SQL}, d AS (
  SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN '  ' ELSE text END AS text FROM documents),
cache AS (SELECT doc_id, TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 48 AS INTEGER)) AS stored_at FROM documents WHERE doc_id % 2 = 0)
SELECT doc_id FROM d WHERE length(PYSTRIP(coalesce(text, ''))) = 0 AND doc_id NOT IN (
  SELECT doc_id FROM cache WHERE stored_at > TIMESTAMP '2024-01-02' - INTERVAL 24 HOUR)""")
def r4_catch_up(spark, sf_dir):
    """R4 batch form: documents whose text is blank and that are not freshly cached."""
    from docfields.sources.ingest import pending

    n = F.col("doc_id")
    d = FX.documents(spark, sf_dir).select("doc_id", F.when(n % 3 == 0, F.lit(None)).when(n % 3 == 1, F.lit("  "))
                                           .otherwise(F.col("text")).alias("text"))
    stored = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=(n % 48).cast("int"))
    cache = d.where(n % 2 == 0).select("doc_id", stored.alias("stored_at"))
    return pending(d, cache, ["doc_id"], F.lit("2024-01-02").cast("timestamp_ntz"), 24 * 3600).select("doc_id")
