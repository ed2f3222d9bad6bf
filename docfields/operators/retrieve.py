"""Retrieval: X18/X19/U2/T3/W5 packing, J7 matching, P2-P4 filters, T1/T2, J13, W6.

Packing (``compress``) runs entirely inside one row per document with
higher-order functions: chunking, scoring, top-k and the running budget need no
explode and no shuffle.  Matching (J7) avoids the nested loop of the reference:
candidate (message, name) pairs come from two equi-joins -- shared keyword
tokens and a character 3-gram anchor for whole-name containment -- then are
scored and the unique best per message is kept with a window.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfields.functions import text as T

BUDGET = 8000
CHUNK = 1800
OVERLAP = 250
TOP_K = 4
MIN_TAIL = 200
QGRAM = 3


def cut_chunks(text: Column, budget: int = BUDGET, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """X19 + X12 of a text that ``compress`` will have to pack: its chunks (c) with their keywords (w); shorter ones: none."""
    cut = F.transform(T.chunks(text, size, overlap), lambda c: F.struct(c.alias("c"), T.keyword_tokens(c).alias("w")))
    return F.when(F.length(text) > budget, cut)


def compress(text: Column, question_tokens: Column, budget: int = BUDGET, size: int = CHUNK,
             overlap: int = OVERLAP, k: int = TOP_K, cut: Column | None = None) -> Column:
    """X18 + X19 + U2 + T3 + W5 for one text: short texts unchanged; no question
    keywords -> head and tail; else the top-k chunks by keyword overlap (ties by
    index), in index order, packed to the budget.  ``cut``: the text's ``cut_chunks``, made once for many questions."""
    if cut is not None:
        scored = F.transform(cut, lambda x, i: F.struct(
            (-T.keyword_overlap(x["w"], question_tokens)).alias("neg"), i.alias("idx"), x["c"].alias("c")))
    else:
        scored = F.transform(T.chunks(text, size, overlap), lambda c, i: F.struct(
            (-T.keyword_overlap(T.keyword_tokens(c), question_tokens)).alias("neg"), i.alias("idx"), c.alias("c")))
    top = F.slice(F.array_sort(scored), 1, k)
    in_order = F.array_sort(F.transform(top, lambda x: F.struct(x["idx"].alias("idx"), x["c"].alias("c"))))
    init = F.struct(F.lit(0).alias("total"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("parts"))

    def step(st, x):
        ln = F.length(x["c"])
        fits = st["total"] + ln <= budget
        rem = F.lit(budget) - st["total"]
        return F.when(st["done"], st).when(fits, F.struct(
            (st["total"] + ln).alias("total"), F.lit(False).alias("done"),
            F.concat(st["parts"], F.array(x["c"])).alias("parts"))
        ).otherwise(F.struct(
            F.when(rem > MIN_TAIL, F.lit(budget)).otherwise(st["total"]).alias("total"), F.lit(True).alias("done"),
            F.when(rem > MIN_TAIL, F.concat(st["parts"], F.array(F.substring(x["c"], 1, rem)))).otherwise(st["parts"]).alias("parts")))

    packed = F.aggregate(in_order, init, step)["parts"]
    packed_text = F.when(F.size(packed) == 0, F.substring(text, 1, budget)).otherwise(F.array_join(packed, T.PACK_MARK))
    return (F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(""))
            .when(F.length(text) <= budget, text)
            .when(F.size(question_tokens) == 0, T.head_tail(text, budget))
            .otherwise(packed_text))


# ----------------------------------------------------------------------------- J7
def match_messages(messages: DataFrame, names: DataFrame, msg_keys: list[str]) -> DataFrame:
    """Per message the workspace whose name matches best.

    score = 100 + len(name) when the normalized name is a substring of the normalized
    message, else the number of name tokens (length > 2, repeats count) present in
    the message; the unique best positive score wins, a tie gives NULL.
    messages: (msg_keys..., text); names: (workspace_id, name).
    Returns (msg_keys..., workspace_id, score) for every message.
    """
    m = messages.select(*msg_keys, T.normalize_name("text").alias("nm"))
    n = names.select("workspace_id", T.normalize_name("name").alias("nn")).where(F.length("nn") > 0)

    # candidates through shared tokens (name tokens with repeats; message token set)
    m_tok = m.select(*msg_keys, F.explode(F.array_distinct(F.split("nm", " "))).alias("tok"))
    n_tok = n.select("workspace_id", "nn", F.explode(F.filter(F.split("nn", " "), lambda t: F.length(t) > 2)).alias("tok"))
    by_tok = m_tok.join(n_tok, "tok").groupBy(*msg_keys, "workspace_id", "nn").agg(F.count(F.lit(1)).alias("tok_score"))

    # candidates through containment.  A name of three words or more shows an inner word as a whole word of the
    # message; a shorter one shows its first characters (messages are cut up only for lengths some name has)
    words = F.split("nn", " ")
    inner = F.aggregate(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), F.lit(""),
                        lambda a, t: F.when(F.length(t) > F.length(a), t).otherwise(a))
    anchors = n.select("workspace_id", "nn", inner.alias("tok"), F.least(F.length("nn"), F.lit(QGRAM)).alias("q"),
                       F.substring("nn", 1, QGRAM).alias("g"))
    parts = [m_tok.join(anchors.where(F.length("tok") > 0).drop("q", "g"), "tok").drop("tok")]
    for qv in range(1, QGRAM + 1):
        short = anchors.where((F.length("tok") == 0) & (F.col("q") == qv)).select("workspace_id", "nn", "g")
        g = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.length("nm") - qv, F.lit(-1))),
                                         lambda i: F.substring("nm", i + 1, qv)))
        mg = m.where(short.agg(F.count(F.lit(1))).scalar() > 0).select(
            *msg_keys, F.explode(F.filter(g, lambda s: F.length(s) == qv)).alias("g"))
        parts.append(mg.join(short, "g").drop("g"))
    cand_sub = parts[0]
    for p in parts[1:]:
        cand_sub = cand_sub.unionByName(p)
    # the candidates fetch their message's text once
    by_sub = cand_sub.distinct().join(m, msg_keys).where(F.col("nm").contains(F.col("nn"))).select(
        *msg_keys, "workspace_id", "nn").distinct().withColumn("sub", F.lit(True))

    cand = by_tok.join(by_sub, [*msg_keys, "workspace_id", "nn"], "full_outer")
    score = F.when(F.coalesce("sub", F.lit(False)), 100 + F.length("nn")).otherwise(F.coalesce("tok_score", F.lit(0)))
    cand = cand.select(*msg_keys, "workspace_id", score.cast("bigint").alias("score")).where(F.col("score") > 0)
    w = Window.partitionBy(*msg_keys)
    best = cand.withColumn("best", F.max("score").over(w)).where(F.col("score") == F.col("best")) \
        .groupBy(*msg_keys).agg(F.count(F.lit(1)).alias("n_best"), F.first("workspace_id").alias("wid"),
                                F.max("score").alias("score"))
    best = best.select(*msg_keys, F.when(F.col("n_best") == 1, F.col("wid")).alias("workspace_id"),
                       F.when(F.col("n_best") == 1, F.col("score")).alias("score"))
    return messages.select(*msg_keys).join(best, msg_keys, "left")


# ----------------------------------------------------------------------------- P2 / P3 / P4
def search(df: DataFrame, q: str, cols: list[str]) -> DataFrame:
    """Case-insensitive substring on any of the columns (nulls never match)."""
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.coalesce(F.lower(F.col(c)).contains(q.lower()), F.lit(False))
    return df.where(cond)


def search_haystack(df: DataFrame, q: str, name: str = "name", date: str = "event_date") -> DataFrame:
    """Trimmed query as a substring of lower(name + ' ' + date-or-''); a blank query returns all."""
    q = q.strip()
    if not q:
        return df
    hay = F.lower(F.concat(F.coalesce(F.col(name), F.lit("")), F.lit(" "),
                           F.coalesce(F.col(date).cast("string"), F.lit(""))))
    return df.where(hay.contains(q.lower()))


def apply_scope(df: DataFrame, requested: DataFrame | None, allowed: DataFrame | None,
                key: str = "workspace_id") -> DataFrame:
    """Requested ids intersected with allowed ids; allowed ids when nothing is
    requested; no filter when neither.  An empty intersection gives no rows (D1)."""
    out = df
    if requested is not None:
        out = out.join(requested.select(key).distinct(), key, "left_semi")
    if allowed is not None:
        out = out.join(allowed.select(key).distinct(), key, "left_semi")
    return out


def clamp_limit(n: int | None, default: int = 20, lo: int = 1, hi: int = 100) -> int:
    return min(max(default if n is None else int(n), lo), hi)


def list_workspaces(ws: DataFrame, limit: int | None = 20) -> DataFrame:
    """Newest first, ``min(max(n, 1), 100)`` rows (the limit is the feature)."""
    return ws.orderBy(F.col("created_at").desc(), F.col("workspace_id")).limit(clamp_limit(limit))


def latest_docs(docs: DataFrame, scope: DataFrame | None, n: int = 6) -> DataFrame:
    """Documents of the scope by upload date desc, ``min(n, 20)`` over the whole scope."""
    d = docs if scope is None else docs.join(scope.select("workspace_id").distinct(), "workspace_id", "left_semi")
    return d.orderBy(F.col("upload_date").desc(), F.col("doc_id").desc()).limit(min(n, 20))


def latest_docs_per_scope(docs: DataFrame, scopes: DataFrame, scope_key: str, n: int = 6) -> DataFrame:
    """T2 batch form: per scope (e.g. one chat request) the latest ``min(n, 20)`` documents."""
    newest = [F.col("upload_date").desc(), F.col("doc_id").desc()]
    # only the latest of a workspace can be among the latest of a scope, so no scope meets all documents
    own = docs.withColumn("rn", F.row_number().over(Window.partitionBy("workspace_id").orderBy(*newest))) \
        .where(F.col("rn") <= min(n, 20)).drop("rn")
    j = own.join(scopes.select(scope_key, "workspace_id"), "workspace_id")
    w = Window.partitionBy(scope_key).orderBy(*newest)
    return j.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= min(n, 20))


def scope_tables(docs_with_tables: DataFrame, scope: DataFrame) -> DataFrame:
    """Tables of the documents of a scope."""
    d = docs_with_tables.join(scope.select("workspace_id").distinct(), "workspace_id", "left_semi")
    return d.where(F.coalesce(F.size("tables"), F.lit(0)) > 0)


def retain(messages: DataFrame, thread: str, order: str, max_tokens: int = 4500, keep: int = 16) -> DataFrame:
    """When a thread reaches ``max_tokens`` (X8 estimate), keep only its latest
    ``keep`` messages; otherwise all."""
    w_all = Window.partitionBy(thread)
    w_desc = Window.partitionBy(thread).orderBy(F.col(order).desc())
    d = messages.withColumn("tokens", T.token_estimate("text")) \
        .withColumn("thread_tokens", F.sum("tokens").over(w_all)) \
        .withColumn("pos_from_end", F.row_number().over(w_desc))
    return d.where((F.col("thread_tokens") < max_tokens) | (F.col("pos_from_end") <= keep))
