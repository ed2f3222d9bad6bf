"""Q2 generate: P7 -> N4 (tables first) -> X20 (text) / X22 (runs) -> A6 -> S8.

Replacement pairs are per workspace (derived from its fields and the user's values), so they reach
each document through an equi-join on workspace_id.  Table edits only touch tables, replacements only text,
so both sides are made apart and meet by document.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.functions import text as T
from docfields.operators import edits as E
from docfields.operators import tables as TB
from docfields.operators.lifecycle import write_documents
from docfields.session import cut_lineage, dealt_by_some_keys, finished_shuffles_go
from docfields.sources.arrivals import shared_folder


def workspace_pairs(fields: DataFrame, user_values: DataFrame) -> DataFrame:
    """P7 in the order the user sees it: (workspace_id, seq, old, new), by field, then by reference."""
    pairs = E.effective_replacements(fields, user_values)
    return pairs.join(fields.select("workspace_id", "field_key", F.col("seq").alias("fseq")), ["workspace_id", "field_key"]) \
        .select("workspace_id", F.struct("fseq", "ref_pos").alias("seq"), F.col("ref").alias("old"), "new")


def _replace_text(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """X20 on whole texts: (doc_id, text, n_text)."""
    def step(st, p):
        t = st["text"]
        return F.struct(F.replace(t, p["old"], p["new"]).alias("text"),
                        (st["count"] + T.count_nonoverlapping(t, p["old"])).alias("count"))

    init = F.struct(F.col("text").alias("text"), F.lit(0).cast("bigint").alias("count"))
    out = E.attach_candidate_pairs(docs, pairs, "workspace_id", F.col("text")).withColumn(
        "st", F.when(F.size("pairs") > 0, F.aggregate("pairs", init, step)).otherwise(init))
    return out.select("doc_id", F.col("st.text").alias("text"), F.col("st.count").alias("n_text"))


def _replace_runs(docs: DataFrame, runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """X22 on the runs of paragraphs: (doc_id, paragraphs ARRAY<STRUCT<para_idx, runs>>, text, n_text)."""
    done = E.replace_runs(runs, pairs, key="workspace_id", owners=docs)
    return done.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("para_idx", "runs"))).alias("paragraphs"),
        F.sum("count").alias("n_text")).select(
        "doc_id", "paragraphs",
        F.array_join(F.transform("paragraphs", lambda p: F.array_join(p["runs"], "")), "\n").alias("text"), "n_text")


def generate(docs: DataFrame, fields: DataFrame, user_values: DataFrame, runs: DataFrame | None = None,
             cells: DataFrame | None = None, table_edits: DataFrame | None = None) -> DataFrame:
    """docs: (doc_id, workspace_id, name, text) -> the edited documents: doc_id, workspace_id, name, text,
    ``paragraphs`` (edited runs; null without runs), ``tables`` (nested, N1; null without cells) and
    ``total_replacements`` (A6: replacements in the text plus applied table edits).

    runs: (doc_id, para_idx, run_idx, text): a document that has runs is edited in them (X22) and its text is
    their paragraphs; any other one is edited as a whole (X20).  An empty paragraph without runs is left out
    of ``paragraphs``.  cells and table_edits as in N4."""
    pairs = workspace_pairs(fields, user_values)
    kind = "array<struct<para_idx:int,runs:array<string>>>"
    if runs is None:
        edited = _replace_text(docs, pairs).withColumn("paragraphs", F.lit(None).cast(kind))
    else:
        pairs = cut_lineage(pairs)
        # the documents without runs by their keys alone, so that no text is exchanged for it (a null key finds no edited text below)
        bare = docs.select("doc_id").distinct().join(runs.select("doc_id").distinct(), "doc_id", "left_anti")
        bare.write.parquet(path := shared_folder(docs.sparkSession, "bare"))
        plain = docs.join(docs.sparkSession.read.schema(bare.schema).parquet(path), "doc_id", "left_semi")
        edited = _replace_runs(docs, runs, pairs).unionByName(
            _replace_text(plain, pairs).withColumn("paragraphs", F.lit(None).cast(kind)))
    # the hint: edited texts need no sort to meet their names
    out = docs.select("doc_id", "workspace_id", "name").hint("shuffle_hash").join(edited, "doc_id", "left")
    none = F.lit(0).cast("bigint")
    if cells is not None:
        done = E.apply_cell_edits(cells, table_edits) if table_edits is not None else cells.withColumn("n_applied", none)
        done = done.withColumn("display", T.cell_text("paras"))
        counts = done.groupBy("doc_id").agg(F.sum("n_applied").alias("n_cells"))
        out = out.join(TB.assemble_tables(done), "doc_id", "left").join(counts, "doc_id", "left")
    else:
        out = out.withColumn("tables", F.lit(None).cast("string")).withColumn("n_cells", none)
    total = (F.coalesce("n_text", none) + F.coalesce("n_cells", none)).cast("bigint")
    return out.select("doc_id", "workspace_id", "name", "text", "paragraphs", "tables", total.alias("total_replacements"))


def generate_to(path: str, docs: DataFrame, *args, **kwargs) -> DataFrame:
    """``generate`` into the S8 sink, one folder a workspace, and read back from it."""
    with finished_shuffles_go(docs.sparkSession), dealt_by_some_keys(docs.sparkSession):
        out = generate(docs, *args, **kwargs)
        write_documents(out, path, compression="zstd")
    return out.sparkSession.read.schema(out.schema).parquet(path)
