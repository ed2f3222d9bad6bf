"""Nested document tables: N1-N3, S9, A11, A12, S3.

Working form is the long ``cells(doc_id, table_index, row, col, paras, display)``;
the nested form is ``tables ARRAY<STRUCT<index, rows, columns, preview, paragraphs>>``
per document.  Lists are always rebuilt with ``array_sort(collect_list(struct(pos, ..)))``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.functions import text as T


def assemble_tables(cells: DataFrame) -> DataFrame:
    """Long cells -> nested tables per document (original index kept, empty dropped).
    Three groupBy levels: row, table, document; each list bounded by its table."""
    rows = cells.groupBy("doc_id", "table_index", "row").agg(
        F.array_sort(F.collect_list(F.struct("col", "display", "paras"))).alias("cells"))
    tables = rows.groupBy("doc_id", "table_index").agg(
        F.array_sort(F.collect_list(F.struct("row", "cells"))).alias("rows"))
    tables = tables.select(
        "doc_id", "table_index",
        F.transform("rows", lambda r: F.transform(r["cells"], lambda c: c["display"])).alias("preview"),
        F.transform("rows", lambda r: F.transform(r["cells"], lambda c: c["paras"])).alias("paragraphs"),
    ).where(F.size("preview") > 0)
    per_doc = tables.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("table_index").alias("index"),
        F.size("preview").alias("rows"),
        F.size(F.get("preview", 0)).alias("columns"),
        F.col("preview").alias("preview"),
        F.col("paragraphs").alias("paragraphs")))).alias("tables"))
    return per_doc


def explode_tables(docs: DataFrame) -> DataFrame:
    """Nested tables -> long cells; jagged rows allowed."""
    t = docs.select("doc_id", F.explode("tables").alias("t"))
    r = t.select("doc_id", F.col("t.index").alias("table_index"),
                 F.posexplode(F.arrays_zip(F.col("t.preview").alias("p"), F.col("t.paragraphs").alias("g"))).alias("row", "rz"))
    c = r.select("doc_id", "table_index", "row",
                 F.posexplode(F.arrays_zip(F.col("rz.p").alias("d"), F.col("rz.g").alias("ps"))).alias("col", "cz"))
    return c.select("doc_id", "table_index", F.col("row").cast("int"), F.col("col").cast("int"),
                    F.col("cz.ps").alias("paras"), F.col("cz.d").alias("display"))


def workspace_tables(docs: DataFrame) -> DataFrame:
    """All tables of all documents of a workspace with their file name, one row per table."""
    t = docs.select("workspace_id", "doc_id", "name", F.explode("tables").alias("t"))
    return t.select("workspace_id", "doc_id", "name", F.col("t.index").alias("table_index"),
                    F.col("t.rows").alias("rows"), F.col("t.columns").alias("columns"))


def table_dimensions(docs: DataFrame) -> DataFrame:
    """rows = number of rows, columns = cells in the first row; shown as rows-1 x columns."""
    t = docs.select("doc_id", F.explode("tables").alias("t"))
    return t.select("doc_id", F.col("t.index").alias("table_index"),
                    F.size("t.preview").alias("rows"), F.size(F.get("t.preview", 0)).alias("columns"),
                    F.concat((F.size("t.preview") - 1).cast("string"), F.lit(" x "),
                             F.coalesce(F.size(F.get("t.preview", 0)), F.lit(0)).cast("string")).alias("shown"))


def tables_found(docs: DataFrame) -> DataFrame:
    """Per document the number of tables and the characters of text."""
    return docs.select("doc_id", F.coalesce(F.size("tables"), F.lit(0)).alias("tables_found"),
                       F.coalesce(F.length("text"), F.lit(0)).alias("text_length"))


def render_table(tables_col, fmt: str = "tsv"):
    """S9 on one nested table struct: TSV (header joined by tab, body cells with newline
    shown as '\\n', every row ends with a newline) or HTML (escape & < >; newline ->
    <br> in body cells only)."""
    t = F.col(tables_col) if isinstance(tables_col, str) else tables_col
    header = F.get(t["preview"], 0)
    body = F.slice(t["preview"], 2, 1 << 30)
    if fmt == "tsv":
        head = F.concat(F.array_join(header, "\t"), F.lit("\n"))
        rows = F.transform(body, lambda r: F.concat(F.array_join(
            F.transform(r, lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit("\\n"))), "\t"), F.lit("\n")))
        return F.concat(head, F.array_join(rows, ""))
    th = F.array_join(F.transform(header, lambda c: F.concat(F.lit("<th>"), T.html_escape(c), F.lit("</th>"))), "")
    trs = F.array_join(F.transform(body, lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(
        r, lambda c: F.concat(F.lit("<td>"), F.replace(T.html_escape(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit("<br>")),
                              F.lit("</td>"))), ""), F.lit("</tr>"))), "")
    return F.concat(F.lit("<table><thead><tr>"), th, F.lit("</tr></thead><tbody>"), trs, F.lit("</tbody></table>"))
