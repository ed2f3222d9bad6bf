"""Chat stream operators: R1 frame parse, W7 repeat suppression, R2 message fold,
R3 open tool activity, R5 streaming usage stats, and the chain of them (Q6).

Batch forms are plain DataFrame expressions; the streaming forms use Structured
Streaming (``applyInPandasWithState`` keyed by thread for R1, R2, R3 and the responses of Q6,
a streaming ``groupBy().agg`` in update mode for R5) and give the same result as the batch
form once the input is consumed, however it is cut into micro-batches.  State is what a thread
carries over: the text after its last frame end, the response it is in, its open tools.
"""
from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from docfields.functions import text as T
from docfields.sources.arrivals import latest, run_batches

FRAME_SCHEMA = "struct<type:string, content:string, thread_id:bigint, seq:bigint>"


def encode_frames(events: DataFrame) -> DataFrame:
    """Writer side: one ``data: <json>\\n\\n`` frame per event."""
    return events.select("thread_id", "seq", F.concat(
        F.lit("data: "), F.to_json(F.struct("type", "content", "thread_id", "seq")), F.lit("\n\n")).alias("frame"))


def parse_frames(chunks: DataFrame, text_col: str = "chunk", keys: list[str] | None = None,
                 order: str | None = None) -> DataFrame:
    """Frames end with a blank line; the ``data:`` lines of a frame are trimmed and
    joined by newline, then parsed as JSON; bad frames are skipped; the text after
    the last blank line is an incomplete remainder (returned as ``remainder``).
    With ``order`` the chunks of one stream (``keys``) are put together first, so a frame
    cut by a chunk border is whole again."""
    keys = keys or []
    if order:
        chunks = chunks.groupBy(*keys).agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text_col).alias("t")))),
            lambda x: x["t"]), "").alias(text_col))
    parts = F.split(F.col(text_col), "\n\n", -1)
    complete = F.slice(parts, 1, F.size(parts) - 1)
    ex = chunks.select(*keys, F.posexplode(complete).alias("frame_idx", "frame"))
    lines = F.split("frame", "\n", -1)
    data = F.transform(F.filter(lines, lambda l: l.startswith("data:")), lambda l: T.py_strip(F.substring(l, 6, 1 << 30)))
    payload = F.array_join(data, "\n")
    parsed = F.from_json(payload, FRAME_SCHEMA)
    ok = F.get_json_object(payload, "$").isNotNull() & payload.startswith("{")
    out = ex.select(*keys, "frame_idx", F.when(ok, parsed).alias("msg")).where(F.col("msg").isNotNull())
    return out.select(*keys, "frame_idx", "msg.*")


def remainder(text_col: str = "chunk"):
    """The incomplete text after the last blank line (kept for the next chunk)."""
    return F.element_at(F.split(F.col(text_col), "\n\n", -1), -1)


def suppress_repeats(events: DataFrame, group: str = "thread_id", order: str = "seq") -> DataFrame:
    """Non-empty hint text cut to 220 + '...', dropped when equal to the previous
    emitted value of the same response (consecutive repeats)."""
    h = events.where(F.col("type") == "thinking").withColumn("hint", T.shorten(T.py_strip("content"), T.SHORT_HINT)) \
        .where(F.length("hint") > 0)
    w = Window.partitionBy(group).orderBy(order)
    return h.withColumn("__prev", F.lag("hint").over(w)).where(
        F.col("__prev").isNull() | (F.col("__prev") != F.col("hint"))).drop("__prev")


def fold_messages(events: DataFrame, group: str = "thread_id", order: str = "seq") -> DataFrame:
    """R2 batch: per message the token texts appended in order; the first tool_start
    clears the text so far; errors are counted and the last one's text is kept; meta rows set the thread."""
    first_tool = events.where(F.col("type") == "tool_start").groupBy(group).agg(F.min(order).alias("__cut"))
    e = events.join(first_tool, group, "left")
    toks = e.where((F.col("type") == "token") & (F.col("__cut").isNull() | (F.col(order) > F.col("__cut"))))
    text = toks.groupBy(group).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(order, "content"))), lambda x: x["content"]), "").alias("text"),
        F.count(F.lit(1)).alias("n_tokens"))
    errs = events.where(F.col("type") == "error").groupBy(group).agg(
        F.count(F.lit(1)).alias("n_errors"), F.max_by("content", order).alias("error"))
    meta = events.where(F.col("type") == "meta").groupBy(group).agg(F.max_by("content", order).alias("meta"))
    base = events.select(group).distinct()
    return base.join(text, group, "left").join(errs, group, "left").join(meta, group, "left").select(
        group, F.coalesce("text", F.lit("")).alias("text"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
        F.coalesce("n_errors", F.lit(0)).alias("n_errors"), "meta", "error")


def open_activity(events: DataFrame, group: str = "thread_id", order: str = "seq") -> DataFrame:
    """R3 batch: a tool_start stays open unless a later tool_end of the same tool
    (same content) exists in the thread; thinking entries always stay."""
    starts = events.where(F.col("type") == "tool_start").select(group, order, F.col("content").alias("tool"))
    ends = events.where(F.col("type") == "tool_end").groupBy(group, F.col("content").alias("tool")) \
        .agg(F.max(order).alias("last_end"))
    j = starts.join(ends, [group, "tool"], "left")
    return j.where(F.col("last_end").isNull() | (F.col("last_end") < F.col(order))).select(group, order, "tool")


def activity(events: DataFrame, group: str = "thread_id", order: str = "seq") -> DataFrame:
    """R3 batch with all entries of the activity list: thinking entries, which stay, and the tool calls that no
    later ``tool_end`` of their tool has removed."""
    said = events.where(F.col("type") == "thinking").select(
        group, order, F.lit("thinking").alias("kind"), T.py_strip(_or(F.col("content"), "Thinking")).alias("label"))
    named = events.withColumn("content", _or(F.col("content"), "tool"))
    calls = open_activity(named, group, order).select(
        group, order, F.lit("tool_start").alias("kind"), F.concat(F.lit("Calling "), "tool").alias("label"))
    return said.unionByName(calls)


def _or(c, default: str):
    return F.when(F.coalesce(F.length(c), F.lit(0)) > 0, c).otherwise(F.lit(default))


# ----------------------------------------------------------------------------- streaming forms
FOLD_STATE = Ty.StructType([
    Ty.StructField("text", Ty.StringType()), Ty.StructField("cut", Ty.BooleanType()),
    Ty.StructField("n_tokens", Ty.LongType()), Ty.StructField("n_errors", Ty.LongType()),
    Ty.StructField("meta", Ty.StringType()), Ty.StructField("meta_seq", Ty.LongType()),
    Ty.StructField("error", Ty.StringType()),
])
FOLD_OUT = "thread_id long, text string, n_tokens long, n_errors long, meta string, error string"


def _fold_state(key, pdfs, state):
    if state.exists:
        text, cut, n_tok, n_err, meta, meta_seq, error = state.get
    else:
        text, cut, n_tok, n_err, meta, meta_seq, error = "", False, 0, 0, None, -1, None
    # a call may hand a long thread over in several frames: order them as one
    events = pd.concat(list(pdfs), ignore_index=True).sort_values("seq", kind="stable")
    if not cut and (events["type"] == "tool_start").any():
        text, n_tok, cut = "", 0, True
        first = events.loc[events["type"] == "tool_start", "seq"].iloc[0]
        said = events[(events["type"] == "token") & (events["seq"] > first)]
    else:
        said = events[events["type"] == "token"]
    text += "".join(said["content"].fillna(""))
    n_tok += len(said)
    errs = events[events["type"] == "error"]
    n_err += len(errs)
    error = errs["content"].iloc[-1] if len(errs) else error
    metas = events[(events["type"] == "meta") & (events["seq"] > meta_seq)]
    if len(metas):
        meta, meta_seq = metas["content"].iloc[-1], int(metas["seq"].iloc[-1])
    state.update((text, cut, n_tok, n_err, meta, meta_seq, error))
    yield pd.DataFrame([{"thread_id": key[0], "text": text, "n_tokens": n_tok, "n_errors": n_err, "meta": meta,
                         "error": error}])


def fold_messages_stream(stream: DataFrame) -> DataFrame:
    """R2 streaming: per-thread state with ``applyInPandasWithState`` (update mode).

    Events of one micro-batch are applied in ``seq`` order; a tool_start that arrives
    in a later batch than tokens with a higher seq is outside this fold's contract
    (streams are ordered per thread)."""
    return stream.groupBy("thread_id").applyInPandasWithState(
        _fold_state, FOLD_OUT, FOLD_STATE, "update", "NoTimeout")


def _in_order(pdfs, order: str) -> pd.DataFrame:
    """One thread's rows of one micro-batch."""
    frames = list(pdfs)
    rows = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
    return rows if rows[order].is_monotonic_increasing else rows.sort_values(order, kind="stable")


def _activity_state(key, pdfs, state):
    """Open entries by tool: ``tool_end`` removes all calls of its tool, thinking entries stay."""
    entries = [tuple(e) for e in json.loads(state.get[0])] if state.exists else []
    for row in _in_order(pdfs, "seq").itertuples():
        if row.type == "thinking":
            entries.append((row.seq, "thinking", row.label))
        elif row.type == "tool_start":
            entries.append((row.seq, "tool_start", f"Calling {row.label}"))
        else:
            entries = [e for e in entries if e[1:] != ("tool_start", f"Calling {row.label}")]
    state.update((json.dumps(entries),))
    seqs, kinds, labels = map(list, zip(*entries)) if entries else ([], [], [])
    yield pd.DataFrame({"thread_id": [key[0]], "seqs": [seqs], "kinds": [kinds], "labels": [labels]})


def activity_stream(stream: DataFrame) -> DataFrame:
    """R3 streaming: one row a thread and micro-batch with its open entries (update mode)."""
    label = F.when(F.col("type") == "thinking", T.py_strip(_or(F.col("content"), "Thinking"))).otherwise(
        _or(F.col("content"), "tool"))
    rows = stream.where(F.col("type").isin("thinking", "tool_start", "tool_end")).select(
        "thread_id", "seq", "type", label.alias("label"))
    return rows.groupBy("thread_id").applyInPandasWithState(
        _activity_state, "thread_id long, seqs array<long>, kinds array<string>, labels array<string>",
        "entries string", "update", "NoTimeout")


def activity_rows(lists: DataFrame) -> DataFrame:
    """(thread_id, seq, kind, label) of the latest lists of ``activity_stream``."""
    return lists.select("thread_id", F.inline(F.arrays_zip("seqs", "kinds", "labels"))).toDF(
        "thread_id", "seq", "kind", "label")


# ----------------------------------------------------------------------------- Q6: frames to kept messages
def encode_chunks(events: DataFrame) -> DataFrame:
    """Writer side of a byte stream: (thread_id, chunk_no, chunk).  Every frame is cut at a place of its own, so
    that it ends in the chunk after; now and then a comment or a broken frame stands between."""
    body = F.to_json(F.struct("type", "content", "thread_id", "seq"))
    noise = (F.when(F.col("seq") % 10 == 0, F.lit('data: {"type": "token", "cont\n\n'))
             .when(F.col("seq") % 10 == 5, F.lit(": ping\n\n")).otherwise(F.lit("")))
    frame = F.concat(noise, F.lit("data: "), body, F.lit("\n\n"))
    cut = F.pmod(F.xxhash64("thread_id", "seq"), F.length("frame").cast("long")).cast("int")
    halves = F.array(F.struct((F.col("seq") * 2).alias("chunk_no"), F.substring(F.col("frame"), F.lit(1), F.col("cut")).alias("chunk")),
                     F.struct((F.col("seq") * 2 + 1).alias("chunk_no"),
                              F.substring(F.col("frame"), F.col("cut") + 1, F.length("frame")).alias("chunk")))
    return events.select("thread_id", "seq", frame.alias("frame")).withColumn("cut", cut).select(
        "thread_id", F.inline(halves))


def _messages(text: str) -> tuple[list[tuple], str]:
    """(type, content) of the whole frames of ``text``, and what is left after the last frame end."""
    *frames, rest = text.split("\n\n")
    out = []
    for frame in frames:
        data = [line[5:].strip() for line in frame.split("\n") if line.startswith("data:")]
        try:
            message = json.loads("\n".join(data)) if data else None
        except ValueError:  # a broken frame is skipped
            continue
        if isinstance(message, dict):
            out.append((message.get("type"), message.get("content")))
    return out, rest


def _frames_state(key, pdfs, state):
    """R1 with the text after the last frame end as state."""
    rest, n = state.get if state.exists else ("", 0)
    found, rest = _messages(rest + "".join(_in_order(pdfs, "chunk_no")["chunk"]))
    state.update((rest, n + len(found)))
    yield pd.DataFrame([(key[0], n + i, *m) for i, m in enumerate(found)], columns=["thread_id", "pos", "type", "content"])


def frames_stream(chunks: DataFrame) -> DataFrame:
    """R1 streaming: chunks (thread_id, chunk_no, chunk) -> events (thread_id, pos, type, content)."""
    return chunks.groupBy("thread_id").applyInPandasWithState(
        _frames_state, "thread_id long, pos long, type string, content string", "rest string, n long", "append", "NoTimeout")


RESPONSES = ("thread_id long, msg long, text string, n_tokens long, n_errors long, error string, n_hints long, "
             "activity array<string>")
RESPONSE_COLS = [c.split()[0] for c in RESPONSES.split(", ")]
FRESH = {"text": "", "n_tokens": 0, "n_errors": 0, "error": None, "n_hints": 0, "cut": False, "hint": None, "open": []}


def _apply(r: dict, kind: str, content: str | None) -> dict:
    """One event of a response: W7 on the hints, R2 on text and errors, R3 on the open entries."""
    if kind == "token":
        return {**r, "text": r["text"] + (content or ""), "n_tokens": r["n_tokens"] + 1}
    if kind == "thinking":
        hint = (content or "").strip()
        hint = hint if len(hint) <= T.SHORT_HINT else hint[:T.SHORT_HINT] + "..."
        if not hint or hint == r["hint"]:
            return r
        return {**r, "hint": hint, "n_hints": r["n_hints"] + 1, "open": [*r["open"], f"thinking:{hint}"]}
    if kind == "tool_start":
        first = {} if r["cut"] else {"text": "", "n_tokens": 0, "cut": True}
        return {**r, **first, "open": [*r["open"], f"tool_start:Calling {content or 'tool'}"]}
    if kind == "tool_end":
        return {**r, "open": [e for e in r["open"] if e != f"tool_start:Calling {content or 'tool'}"]}
    if kind == "error":
        return {**r, "n_errors": r["n_errors"] + 1, "error": content}
    return r


def _responses_state(key, pdfs, state):
    """The chain for one thread: frames of the text so far (R1), then every event into its response."""
    rest, msg, now = (*state.get[:2], json.loads(state.get[2])) if state.exists else ("", 0, FRESH)
    events, rest = _messages(rest + "".join(_in_order(pdfs, "chunk_no")["chunk"]))
    out = {}
    for kind, content in events:
        if kind == "meta":  # the head of the next response
            out[msg] = now
            msg, now = msg + 1, FRESH
        else:
            now = _apply(now, kind, content)
    out[msg] = now
    state.update((rest, msg, json.dumps(now)))
    yield pd.DataFrame([(key[0], m, *(r[c] for c in ("text", "n_tokens", "n_errors", "error", "n_hints", "open")))
                        for m, r in out.items()], columns=RESPONSE_COLS)


def responses_stream(chunks: DataFrame) -> DataFrame:
    """R1 + W7 + R2 + R3 streaming: chunks (thread_id, chunk_no, chunk) -> the state of every response an event
    reached, a row each per micro-batch.  A ``meta`` event starts the thread's next response.  One stateful operator
    holds the chain (Spark allows a streaming query only one of this kind); its state is the text after the last
    frame end and the response the thread is in."""
    return chunks.groupBy("thread_id").applyInPandasWithState(
        _responses_state, RESPONSES, "rest string, msg long, response string", "append", "NoTimeout")


def chat_stream(chunks: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Q6: R1 -> W7 -> R2 / R3 as one streaming query; of every response the state of its last micro-batch."""
    rows = run_batches(responses_stream(chunks), path, checkpoint, mode="append")
    return latest(rows, ["thread_id", "msg"], RESPONSE_COLS)


def usage_stream(calls_stream: DataFrame) -> DataFrame:
    """Running usage totals per run as calls arrive (streaming aggregation)."""
    return calls_stream.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"))


def run_to_table(stream_df: DataFrame, checkpoint: str, mode: str = "update", keys: list[str] | None = None) -> DataFrame:
    """Run a streaming query over all available input into a table beside the stream's checkpoint; of every
    key (``update``) or of the whole (``complete``) the latest micro-batch counts."""
    rows, cols = run_batches(stream_df, f"{checkpoint}-table", checkpoint, mode), stream_df.columns
    if mode == "complete":
        return rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0]).select(cols)
    return latest(rows, keys, cols)
