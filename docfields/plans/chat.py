"""Q4 retrieve: J7 -> P4 -> T2 -> X12/X19/U2 -> T3 -> W5, for all chat messages at once, and the three
retrieval functions a chat calls (V5): workspaces, excerpts of documents, tables of documents."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.functions import text as T
from docfields.operators import retrieve as R
from docfields.session import cut_lineage


def retrieve_for_messages(messages: DataFrame, names: DataFrame, docs: DataFrame,
                          n_docs: int = 6, budget: int = R.BUDGET) -> DataFrame:
    """messages: (conv_id, turn, text); names: (workspace_id, name) with workspace_id
    castable to the documents' key; docs: (doc_id, workspace_id, upload_date, text).

    Each message resolves its workspace (J7), takes that workspace's latest
    ``n_docs`` documents (T2 per scope) and packs every document against the
    message's keywords (X19/U2/T3/W5).  Messages without a unique match get none.
    """
    matched = R.match_messages(messages.select("conv_id", "turn", "text"), names, ["conv_id", "turn"]) \
        .where(F.col("workspace_id").isNotNull())
    scopes = matched.select(F.struct("conv_id", "turn").alias("msg"), F.col("workspace_id").cast("string").alias("workspace_id"))
    picked = R.latest_docs_per_scope(docs.select("doc_id", "workspace_id", "upload_date"), scopes, "msg", n_docs)
    q = messages.select(F.struct("conv_id", "turn").alias("msg"), T.keyword_tokens("text").alias("qt"))
    # a picked text is fetched and cut once, however many messages ask it
    picked = cut_lineage(picked)
    texts = docs.select("doc_id", "text").join(picked.select("doc_id").distinct(), "doc_id", "left_semi").withColumn(
        "cut", R.cut_chunks(F.col("text"), budget))
    j = picked.join(q, "msg").join(texts, "doc_id")
    return j.select(F.col("msg.conv_id").alias("conv_id"), F.col("msg.turn").alias("turn"), "workspace_id", "doc_id",
                    R.compress(F.col("text"), F.col("qt"), budget=budget, cut=F.col("cut")).alias("excerpt"))


# ----------------------------------------------------------------------------- V5
def workspaces_list(ws: DataFrame, limit: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """The newest workspaces a user may see; the limit is kept between 1 and 100, 20 by default."""
    return R.list_workspaces(R.apply_scope(ws, None, allowed), limit)


def documents_context(docs: DataFrame, question: str = "", max_docs: int = 6, requested: DataFrame | None = None,
                      allowed: DataFrame | None = None, budget: int = R.BUDGET) -> DataFrame:
    """V5: the latest documents of the requested and allowed workspaces (at most 20) with an excerpt packed for
    the question and the length of the whole text.  docs: (doc_id, workspace_id, name, upload_date, text).
    The documents are picked without their texts; those are fetched for the few picked."""
    head = R.apply_scope(docs.select("doc_id", "workspace_id", "name", "upload_date"), requested, allowed)
    picked = R.latest_docs(head, None, max_docs)
    words = T.keyword_tokens(F.lit(question))
    text = F.coalesce(F.col("text"), F.lit(""))
    return picked.join(docs.select("doc_id", text.alias("text")), "doc_id").select(
        "doc_id", "workspace_id", "name", "upload_date", R.compress(F.col("text"), words, budget=budget).alias("excerpt"),
        F.length("text").alias("text_length"))


def documents_tables(docs: DataFrame, max_docs: int = 6, requested: DataFrame | None = None,
                     allowed: DataFrame | None = None) -> DataFrame:
    """The nested tables of the latest documents of the requested and allowed workspaces; documents
    without tables give none.  docs: (doc_id, workspace_id, name, upload_date, tables)."""
    head = R.apply_scope(docs.select("doc_id", "workspace_id", "upload_date"), requested, allowed)
    picked = R.latest_docs(head, None, max_docs)
    return R.scope_tables(docs.select("doc_id", "workspace_id", "name", "tables"), picked).join(picked.select("doc_id"), "doc_id", "left_semi")
