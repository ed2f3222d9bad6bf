"""Q1 discover: P5 -> V1 -> U1 / U3 -> A1 -> W1 -> V2/J5 -> J4 -> A3 (X28 makes the request text of V1).

One Spark job graph for all workspaces at once.  Shuffles: A1 by
(workspace, field_key) after per-reference pre-aggregation; J5 by reference;
J4 equi-joins locations to (workspace, reference) pairs.  J1 inside J4 needs no
shuffle of documents when the reference list is broadcast (size-checked).

The per-document fields are extracted once and cut (checkpoint in the shared folder),
as are the merged fields; texts are read again only by J1 and by the sums of A3.  Which documents a
field came from stays a long table (``lineage``): no row grows with the corpus.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from docfields.operators import fields as FLD
from docfields.operators import locate as L
from docfields.session import cut_lineage


def discover(docs: DataFrame, *, extractor: Callable | None = None, instructions: str = "",
             consolidate: bool = True, consolidator: Callable | None = None,
             strategy: str = "auto", paras: DataFrame | None = None) -> dict[str, DataFrame]:
    """docs: (workspace_id, doc_id, name, text); paras: (doc_id, para_idx, text), see J4.  Returns a dict with
    ``doc_fields``, ``fields`` (ranked, with frequency), ``lineage``, ``locations`` and ``stats``."""
    processed = FLD.discovery_input(docs)
    if extractor is None:
        doc_fields = cut_lineage(FLD.extract_fields_rules(processed))
    else:
        doc_fields = cut_lineage(FLD.extract_fields_udf(processed, extractor, instructions))
    fields = cut_lineage(FLD.merge_fields(doc_fields, sources=False))
    lineage = FLD.field_lineage(doc_fields)
    if consolidate:
        fields, lineage = FLD.reattach_lineage_long(FLD.canonical_fields(fields, consolidator), fields, lineage)
        fields = cut_lineage(fields)
    ranked = FLD.rank_fields(fields)
    with_freq, locations = L.field_locations_long(ranked, lineage, docs, paras, strategy=strategy)
    stats = FLD.discovery_stats(processed, fields, locations)
    return {"doc_fields": doc_fields, "fields": with_freq, "lineage": lineage, "locations": locations, "stats": stats}
