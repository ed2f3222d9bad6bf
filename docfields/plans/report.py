"""Q3 report: P1 -> J6 -> X27 -> V3 -> A14 -> V4 -> J12 -> U4 -> W2 -> A13 -> A9 -> S7, for all workspaces at once.

Values stay long (workspace, column, value) until the pivot.  V3 and V4 are the default rules or a user's
callable (``report.context_resolver``, ``report.document_resolver``).  The values are written once
(checkpoint), as V3 may be a model: A14, V4 and the pivot read them.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.operators import report as RP
from docfields.session import cut_lineage


def build_report(ws: DataFrame, docs: DataFrame, fields: DataFrame, columns: DataFrame, cols: list[str], *,
                 resolver: Callable = RP.resolve_default, doc_resolver: Callable = RP.resolve_from_docs) -> dict[str, DataFrame]:
    """ws: the workspaces of the range (P1); columns: (name, description, order); cols: their names in order.

    Returns ``skipped`` (workspaces without documents), ``outcomes`` (valid, resolved from documents, or
    unresolved, with the columns still missing), ``sheet`` (wide rows: valid ones first, then resolved
    ones, numbered through) and ``widths``."""
    with_docs, skipped = RP.split_by_docs(ws, docs)
    values = cut_lineage(RP.report_values(with_docs, fields, columns, resolver))
    first = RP.split_resolved(values)
    missing = first.where(F.col("outcome") == "unresolved").select("workspace_id", F.explode("unresolved_columns").alias("column"))
    found = doc_resolver(docs, missing).where(F.col("value").isNotNull())
    partial = values.join(missing.select("workspace_id").distinct(), "workspace_id", "left_semi")
    filled = cut_lineage(RP.fill_rows(partial, found))
    second = RP.split_resolved(filled).withColumn("outcome", F.when(F.col("outcome") == "valid", "resolved").otherwise(F.col("outcome")))
    outcomes = cut_lineage(first.where(F.col("outcome") == "valid").unionByName(second))
    # U4, then W2 over valid and resolved rows
    valid = outcomes.where(F.col("outcome") == "valid").select("workspace_id", "created_at")
    resolved = outcomes.where(F.col("outcome") == "resolved").select("workspace_id", "created_at")
    rows = RP.append_resolved(valid, resolved)
    numbered = RP.number_rows(rows, [F.col("src_rank"), F.col("created_at").desc(), F.col("workspace_id")], col="s_no")
    kept = values.join(missing.select("workspace_id").distinct(), "workspace_id", "left_anti").unionByName(filled.select(values.columns))
    long = kept.join(numbered.select("workspace_id", "s_no"), "workspace_id").withColumn(
        "value", F.when(F.col("column") == "S.No", F.col("s_no").cast("string")).otherwise(F.col("value")))
    sheet = cut_lineage(RP.pivot_report(long.select("workspace_id", "column", "value"), cols))
    return {"skipped": skipped, "outcomes": outcomes, "sheet": sheet, "widths": RP.width_profile(sheet, cols)}
