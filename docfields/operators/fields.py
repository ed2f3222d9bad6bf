"""Field discovery and merging: V1, V2, U1, U3, A1, A2, A3, W1, J5, J11, M11, S6.

Data shapes:
  doc_fields(workspace_id, doc_id, seq, field_key, label, refs ARRAY<STRING>)
      one row per (document, field); ``seq`` gives first-seen order.
  fields(workspace_id, field_key, label, refs, source_docs ARRAY<BIGINT>, doc_frequency, seq)
"""
from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from docfields.functions import text as T
from docfields.session import cut_lineage

# Default deterministic extraction rules (key, label, Java/RE2-compatible pattern).
DEFAULT_RULES = (
    ("email", "Email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("phone", "Phone", r"\+?[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}"),
    ("url", "Url", r"https?://[^\s)\]]+"),
    ("iso_date", "Date", r"[0-9]{4}-[0-9]{2}-[0-9]{2}"),
    ("money", "Amount", r"[$€£][0-9][0-9,]*(?:\.[0-9]{2})?"),
    ("license", "License", r"(?m)^[^\n]*(?:[Cc]opyright|[Ll]icen[cs]e)[^\n]*"),
)
# Literals one of which a match must contain: the regex runs only where one occurs.
RULE_PREFILTERS = {
    "email": ("@",), "phone": ("(",), "url": ("://",), "iso_date": ("-",),
    "money": ("$", "€", "£"), "license": ("opyright", "icen"),
}
MIN_CHARS = 50
MODEL_WINDOW_CHARS = 8000
FUZZY_THRESHOLD = 85
RULE_SLOTS = 16
UDF_SLOTS = 1 << 20
SEQ = "decimal(30,0)"


# ----------------------------------------------------------------------------- P5 / V1
def discovery_input(docs: DataFrame, min_chars: int = MIN_CHARS, max_chars: int | None = None) -> DataFrame:
    """P5: drop documents under ``min_chars``; optionally cut to ``max_chars`` (the
    model-call budget; rule-based extraction reads whole texts)."""
    d = docs.where(F.length("text") >= min_chars)
    if max_chars:
        d = d.withColumn("text", F.substring("text", 1, max_chars))
    return d


def _seq(slots: int, slot):
    """First-seen order: document, then place in the document; a decimal, so that any 64-bit id fits."""
    return (F.col("doc_id").cast("decimal(20,0)") * F.lit(slots).cast("decimal(8,0)") + slot.cast("decimal(8,0)")).cast(SEQ)


def extract_fields_rules(docs: DataFrame, rules=DEFAULT_RULES) -> DataFrame:
    """V1 default: native ``regexp_extract_all`` per rule; exact de-duplication in
    first-seen order; only non-empty fields are emitted.  docs: (workspace_id, doc_id, text)."""
    def extract(key, pat):
        found = F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit(pat), 0))
        pre = RULE_PREFILTERS.get(key)
        if not pre:
            return found
        cond = F.lit(False)
        for lit in pre:
            cond = cond | F.col("text").contains(lit)
        return F.when(cond, found).otherwise(F.array().cast("array<string>"))

    structs = [
        F.struct(
            F.lit(i).alias("slot"), F.lit(key).alias("field_key"), F.lit(label).alias("label"),
            extract(key, pat).alias("refs"),
        )
        for i, (key, label, pat) in enumerate(rules)
    ]
    ex = docs.select("workspace_id", "doc_id", F.inline(F.array(*structs)))
    return ex.where(F.size("refs") > 0).select(
        "workspace_id", "doc_id", _seq(max(RULE_SLOTS, len(structs)), F.col("slot")).alias("seq"),
        "field_key", "label", "refs")


def extract_fields_udf(docs: DataFrame, extractor: Callable, instructions: str = "", fuzzy: bool = True,
                       window_chars: int = MODEL_WINDOW_CHARS, overlap: int = 250) -> DataFrame:
    """V1 with a user callable ``extractor(name, text, instructions) -> str | dict``.

    The callable sees every overlapping window (X19) of the whole text, so that nothing behind a
    model's budget is lost; it only returns an answer, an error counts as none.  The rest is Spark:
    the JSON is cut out (X14), a ``$schema`` answer is read through its ``properties``, and the fields
    of a document's windows are united in order (U1), then thinned fuzzily (U3)."""
    instructions = instructions.strip()

    @F.pandas_udf(Ty.StringType())
    def answer(name: pd.Series, text: pd.Series) -> pd.Series:
        def ask(n, t):
            try:
                got = extractor(n, t, instructions)
            except Exception:  # noqa: BLE001 - a failing window gives no fields
                return None
            return got if got is None or isinstance(got, str) else json.dumps(got)
        return pd.Series([ask(n, t) for n, t in zip(name, text)], dtype=object)

    keys = ["workspace_id", "doc_id"]
    windows = docs.select(*keys, "name", F.posexplode(T.chunks("text", window_chars, overlap)).alias("win", "part"))
    top = F.from_json(T.json_object_text(answer("name", "part")), "map<string,string>")
    entries = windows.select(*keys, "win", top.alias("m")).select(*keys, "win", F.posexplode(
        F.when(F.map_contains_key("m", F.lit("$schema")), F.from_json(F.col("m")["properties"], "map<string,string>"))
        .otherwise(F.col("m"))).alias("pos", "field_key", "val"))
    v = F.from_json("val", "struct<label:string, references:array<string>>")
    found = entries.where(F.col("val").startswith("{")).select(
        *keys, "field_key", F.struct("win", "pos").alias("at"), v["label"].alias("label"),
        F.filter(F.coalesce(v["references"], F.array().cast("array<string>")), lambda r: r.isNotNull()).alias("refs"))
    # one document's answers: its windows bound the size
    per_doc = found.groupBy(*keys, "field_key").agg(
        F.min("at").alias("at"), F.min_by("label", "at").alias("label"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "refs"))),
                                               lambda x: x["refs"]))).alias("refs"))
    if fuzzy:
        from docfields.operators.fuzzy import fuzzy_dedupe_col

        per_doc = per_doc.withColumn("refs", fuzzy_dedupe_col("refs", FUZZY_THRESHOLD))
    slot = F.row_number().over(Window.partitionBy(*keys).orderBy("at")) - 1
    return per_doc.select(*keys, _seq(UDF_SLOTS, slot).alias("seq"), "field_key", "label", "refs")


# ----------------------------------------------------------------------------- A1 / A2 / W1
def merge_fields(doc_fields: DataFrame, keys: list[str] | None = None, sources: bool = True) -> DataFrame:
    """A1: per (workspace, field_key): first-seen label (even if null), first-seen-order
    distinct union of references, doc_frequency = documents having the key, ordered
    distinct source documents, seq = first appearance.

    References are pre-aggregated per (field, reference) before the per-field
    collect, so a hot field spreads its work over its references and the final
    list per field is bounded by its distinct references.  The list of source documents grows with the
    corpus: ``sources=False`` leaves it out, ``field_lineage`` holds the same as long rows.
    """
    keys = keys or ["workspace_id"]
    per_ref = (
        doc_fields.select(*keys, "field_key", "seq", F.posexplode("refs").alias("pos", "ref"))
        .groupBy(*keys, "field_key", "ref")
        .agg(F.min(F.struct("seq", "pos")).alias("first"))
    )
    refs = per_ref.groupBy(*keys, "field_key").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("first", "ref"))), lambda x: x["ref"]).alias("refs"))
    base = doc_fields.groupBy(*keys, "field_key").agg(
        F.min_by("label", "seq").alias("label"),
        F.count(F.lit(1)).alias("doc_frequency"),
        F.min("seq").alias("seq"),
        *([F.transform(F.array_sort(F.collect_list(F.struct("seq", "doc_id"))), lambda x: x["doc_id"]).alias("source_docs")]
          if sources else []),
    )
    out = base.join(refs, [*keys, "field_key"], "left")
    return out.select(*keys, "field_key", "label",
                      F.coalesce("refs", F.array().cast("array<string>")).alias("refs"),
                      *([F.array_distinct("source_docs").alias("source_docs")] if sources else []), "doc_frequency", "seq")


def field_lineage(doc_fields: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A1's source documents as long rows: (keys, field_key, doc_id, at), ``at`` gives their order."""
    keys = keys or ["workspace_id"]
    return doc_fields.groupBy(*keys, "field_key", "doc_id").agg(F.min("seq").alias("at"))


def sources_of(fields: DataFrame, lineage: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """fields with ``source_docs``, the ordered list that an output asks for."""
    keys = [*(keys or ["workspace_id"]), "field_key"]
    lists = lineage.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "doc_id"))),
                                                   lambda x: x["doc_id"]).alias("source_docs"))
    return fields.join(lists, keys, "left").withColumn(
        "source_docs", F.coalesce("source_docs", F.array().cast("array<bigint>")))


def section_frequency(processed_docs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A2: number of document schemas merged (documents processed) per workspace."""
    keys = keys or ["workspace_id"]
    return processed_docs.groupBy(*keys).agg(F.count_distinct("doc_id").alias("section_doc_frequency"))


def rank_fields(fields: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Importance order by (doc_frequency, number of references) desc; ties keep
    first-seen order."""
    keys = keys or ["workspace_id"]
    w = Window.partitionBy(*keys).orderBy(F.col("doc_frequency").desc(), F.size("refs").desc(), F.col("seq").asc())
    return fields.withColumn("rank", F.row_number().over(w))


def ordered_union(a, b):
    """``dict.fromkeys(a + b)``."""
    return F.array_distinct(F.concat(a, b))


# ----------------------------------------------------------------------------- V2 / J5
def consolidate_default(fields: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """V2 default: raw fields sharing a normalized key or a reference form one canonical
    field (connected components by iterated min-label propagation over a bipartite
    field-token graph).  Canonical key = key of the first-seen member; references =
    ordered union of the members' references; label = first member's label.

    Each round takes the smallest label among neighbours, then follows the label of that
    member (pointer jumping), until nothing changes: rounds grow with the logarithm of a
    chain rather than its length.  Lineage is cut with ``checkpoint()`` into the shared
    checkpoint folder so the loop survives executor loss.
    """
    from docfields.session import ensure_checkpoint_dir

    keys = keys or ["workspace_id"]
    f = fields.select(*keys, "field_key", "label", "refs", "seq")
    # edges: field -> token (normalized key, each reference)
    edges = f.select(*keys, "field_key", F.explode(F.array_union(
        F.array(F.concat(F.lit("k:"), T.normalize_key("field_key"))),
        F.transform("refs", lambda r: F.concat(F.lit("r:"), r)))).alias("tok")).distinct()
    ensure_checkpoint_dir(fields.sparkSession)
    edges = edges.checkpoint()
    label = f.select(*keys, "field_key", F.col("seq").alias("comp"))
    seqs = label.withColumnRenamed("comp", "seq").checkpoint()
    while True:
        tok_min = edges.join(label, [*keys, "field_key"]).groupBy(*keys, "tok").agg(F.min("comp").alias("tcomp"))
        new = edges.join(tok_min, [*keys, "tok"]).groupBy(*keys, "field_key").agg(F.min("tcomp").alias("comp"))
        new = new.join(label.withColumnRenamed("comp", "old"), [*keys, "field_key"]) \
            .select(*keys, "field_key", F.least("comp", "old").alias("comp"), "old")
        head = seqs.join(new, [*keys, "field_key"]).groupBy(*keys, F.col("seq").alias("comp")).agg(
            F.min("comp").alias("jump"))
        new = new.join(head, [*keys, "comp"], "left").select(
            *keys, "field_key", F.least("comp", "jump").alias("comp"), "old").checkpoint()
        changed = new.where(F.col("comp") != F.col("old")).limit(1).count()
        label = new.select(*keys, "field_key", "comp")
        if changed == 0:
            break
    members = f.join(label, [*keys, "field_key"])
    per_ref = members.select(*keys, "comp", "seq", F.posexplode("refs").alias("pos", "ref")) \
        .groupBy(*keys, "comp", "ref").agg(F.min(F.struct("seq", "pos")).alias("first"))
    refs = per_ref.groupBy(*keys, "comp").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("first", "ref"))), lambda x: x["ref"]).alias("refs"))
    head = members.groupBy(*keys, "comp").agg(
        F.min_by("field_key", "seq").alias("field_key"), F.min_by("label", "seq").alias("label"),
        F.min("seq").alias("seq"))
    return head.join(refs, [*keys, "comp"], "left").select(
        *keys, "field_key", "label", F.coalesce("refs", F.array().cast("array<string>")).alias("refs"), "seq")


def reattach_lineage(canonical: DataFrame, raw: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """For each canonical field, all raw fields sharing >= 1 reference: ordered
    distinct union of their source documents, their count as doc_frequency (D16: the
    count of raw fields), and n_source_docs.  A missing label falls back to X4."""
    keys = keys or ["workspace_id"]
    c_refs = canonical.select(*keys, F.col("field_key").alias("canon_key"), F.explode("refs").alias("ref")).distinct()
    r_refs = raw.select(*keys, F.col("field_key").alias("raw_key"), F.explode("refs").alias("ref")).distinct()
    pairs = c_refs.join(r_refs, [*keys, "ref"]).select(*keys, "canon_key", "raw_key").distinct()
    info = raw.select(*keys, F.col("field_key").alias("raw_key"), F.col("seq").alias("raw_seq"), "source_docs")
    agg = pairs.join(info, [*keys, "raw_key"]).groupBy(*keys, "canon_key").agg(
        F.count(F.lit(1)).alias("doc_frequency"),
        F.array_distinct(F.flatten(F.transform(
            F.array_sort(F.collect_list(F.struct("raw_seq", "source_docs"))), lambda x: x["source_docs"]))
        ).alias("source_docs"),
    )
    out = canonical.withColumnRenamed("field_key", "canon_key").join(agg, [*keys, "canon_key"], "left")
    lbl = F.when(F.coalesce(F.length("label"), F.lit(0)) > 0, F.col("label")).otherwise(T.label_from_key("canon_key"))
    return out.select(
        *keys, F.col("canon_key").alias("field_key"), lbl.alias("label"), "refs",
        F.coalesce("source_docs", F.array().cast("array<bigint>")).alias("source_docs"),
        F.coalesce("doc_frequency", F.lit(0)).cast("bigint").alias("doc_frequency"),
        F.size(F.coalesce("source_docs", F.array().cast("array<bigint>"))).cast("bigint").alias("n_source_docs"),
        "seq")


def reattach_lineage_long(canonical: DataFrame, raw: DataFrame, lineage: DataFrame,
                          keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """J5 on long lineage: (canonical fields with doc_frequency and n_source_docs, their lineage as long rows).
    raw: (keys, field_key, refs, seq); lineage: ``field_lineage`` of the raw fields."""
    keys = keys or ["workspace_id"]
    c_refs = canonical.select(*keys, F.col("field_key").alias("canon_key"), F.explode("refs").alias("ref")).distinct()
    r_refs = raw.select(*keys, F.col("field_key").alias("raw_key"), F.col("seq").alias("raw_seq"),
                        F.explode("refs").alias("ref")).distinct()
    pairs = cut_lineage(c_refs.join(r_refs, [*keys, "ref"]).select(*keys, "canon_key", "raw_key", "raw_seq").distinct())
    own = lineage.withColumnRenamed("field_key", "raw_key")
    long = cut_lineage(pairs.join(own, [*keys, "raw_key"]).groupBy(*keys, F.col("canon_key").alias("field_key"), "doc_id").agg(
        F.min(F.struct("raw_seq", "at")).alias("at")))
    counts = pairs.groupBy(*keys, F.col("canon_key").alias("field_key")).agg(F.count(F.lit(1)).alias("doc_frequency"))
    docs = long.groupBy(*keys, "field_key").agg(F.count(F.lit(1)).alias("n_source_docs"))
    lbl = F.when(F.coalesce(F.length("label"), F.lit(0)) > 0, F.col("label")).otherwise(T.label_from_key("field_key"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    out = canonical.select(*keys, "field_key", "label", "refs", "seq").join(counts, [*keys, "field_key"], "left").join(
        docs, [*keys, "field_key"], "left")
    return out.select(*keys, "field_key", lbl.alias("label"), "refs", zero("doc_frequency"), zero("n_source_docs"), "seq"), long


def canonical_fields(fields: DataFrame, consolidator: Callable | None = None, keys: list[str] | None = None) -> DataFrame:
    """V2 without J5: the default grouping, or a user's ``consolidator``."""
    keys = keys or ["workspace_id"]
    if consolidator is None:
        return consolidate_default(fields, keys)
    schema = f"{', '.join(k + ' string' for k in keys)}, field_key string, label string, refs array<string>, seq {SEQ}"
    return fields.select(*keys, "field_key", "label", "refs", F.col("seq").cast(SEQ).alias("seq")).groupBy(*keys).applyInPandas(
        consolidator, schema)


def consolidate(fields: DataFrame, consolidator: Callable | None = None, keys: list[str] | None = None) -> DataFrame:
    """V2: canonical fields then J5.  ``consolidator(pdf) -> pdf`` (per workspace, via
    ``applyInPandas``) replaces the default grouping when given; it receives the raw
    fields of one workspace (field_key, label, refs, seq) and returns canonical ones."""
    keys = keys or ["workspace_id"]
    return reattach_lineage(canonical_fields(fields, consolidator, keys), fields, keys)


# ----------------------------------------------------------------------------- J11 / M11 / S6
def overlay_refs(discovered: DataFrame, edited: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Saved per-field reference lists replace discovered ones, key by key."""
    keys = keys or ["workspace_id"]
    e = edited.select(*keys, "field_key", F.col("refs").alias("edited_refs"))
    j = discovered.join(e, [*keys, "field_key"], "full_outer")
    return j.withColumn("refs", F.coalesce("edited_refs", "refs")).drop("edited_refs")


def apply_field_edits(fields: DataFrame, edits: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Ordered edit log per field, folded natively.

    edits: (keys..., field_key, seq, op, ref, new_ref, label) with op in
    add | remove | rename | delete | create | set_label.  ``create`` derives the key
    from ``label`` (lower, whitespace runs to '_') and starts the field anew, an existing
    one too: the label as given, no references; a blank label is ignored.  set_label:
    trimmed, blank ignored.  add: trimmed blank or existing ignored, the value is
    prepended; rename: to the trimmed new value; remove: drops it.
    """
    keys = keys or ["workspace_id"]
    named = F.length(T.py_strip(F.coalesce("label", F.lit("")))) > 0
    e = edits.where(~F.col("op").isin("create", "set_label") | named).withColumn("field_key", F.when(F.col("op") == "create", T.new_field_key("label"))
                         .otherwise(F.col("field_key")))
    logs = e.groupBy(*keys, "field_key").agg(F.array_sort(F.collect_list(
        F.struct("seq", "op", "ref", "new_ref", "label"))).alias("log"))
    f = fields.select(*keys, "field_key", "label", "refs", "seq", F.lit(True).alias("exists"))
    j = f.join(logs, [*keys, "field_key"], "full_outer")
    init = F.struct(
        F.coalesce("exists", F.lit(False)).alias("exists"), F.col("label").alias("label"),
        F.coalesce("refs", F.array().cast("array<string>")).alias("refs"))

    def step(st, x):
        op = x["op"]
        t = T.py_strip(x["ref"])
        add_ok = (F.length(t) > 0) & ~F.array_contains(st["refs"], t)
        refs = (
            F.when((op == "add") & add_ok, F.concat(F.array(x["ref"]), st["refs"]))
            .when(op == "remove", F.array_remove(st["refs"], x["ref"]))
            .when((op == "rename") & (F.length(T.py_strip(x["new_ref"])) > 0),
                  F.transform(st["refs"], lambda r: F.when(r == x["ref"], T.py_strip(x["new_ref"])).otherwise(r)))
            .when(op == "create", F.array().cast("array<string>"))
            .otherwise(st["refs"]))
        exists = F.when(op == "delete", F.lit(False)).when(op == "create", F.lit(True)).otherwise(st["exists"])
        label = F.when(op == "create", x["label"]).when((op == "set_label") & st["exists"], T.py_strip(x["label"])) \
            .otherwise(st["label"])
        return F.struct(exists.alias("exists"), label.alias("label"), refs.alias("refs"))

    folded = j.withColumn("st", F.when(F.col("log").isNull(), init).otherwise(F.aggregate("log", init, step)))
    return folded.where("st.exists").select(
        *keys, "field_key", F.col("st.label").alias("label"), F.col("st.refs").alias("refs"),
        F.coalesce("seq", F.element_at("log", 1)["seq"]).alias("seq"))


def carry_replacements(values: DataFrame, edits: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The user's replacement values follow the renames of their references, in edit order.  A renamed
    reference takes its old value along, or its new name where it had none (or a blank one); a value the new name
    already had gives way.  values: (keys, field_key, ref, value); edits as in ``apply_field_edits``."""
    keys = [*(keys or ["workspace_id"]), "field_key"]
    renames = edits.where((F.col("op") == "rename") & (F.length(T.py_strip(F.coalesce("new_ref", F.lit("")))) > 0)) \
        .groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "ref", T.py_strip("new_ref").alias("new")))).alias("log"))
    # one field's references bound the map
    held = values.where(F.col("ref").isNotNull()).groupBy(*keys).agg(F.map_from_entries(F.collect_list(
        F.struct("ref", "value"))).alias("held"))
    start = F.coalesce("held", F.create_map().cast("map<string,string>"))

    def step(st, e):
        old = F.element_at(F.map_filter(st, lambda k, v: k == e["ref"]), e["ref"])
        kept = F.map_filter(st, lambda k, v: (k != e["ref"]) & (k != e["new"]))
        value = F.when(F.coalesce(F.length(old), F.lit(0)) > 0, old).otherwise(e["new"])
        return F.when(e["ref"].eqNullSafe(e["new"]), st).otherwise(F.map_concat(kept, F.create_map(e["new"], value)))

    j = held.join(renames, keys, "full_outer")
    done = F.when(F.col("log").isNull(), start).otherwise(F.aggregate("log", start, step))
    return j.select(*keys, F.explode(done).alias("ref", "value"))


def read_fields(df: DataFrame, json_col: str = "schema_json", keys: list[str] | None = None) -> DataFrame:
    """A stored schema JSON ``{"field": {"label":..., "references": [...]}}`` (also
    nested under schema.document_fields.fields) -> long fields.  Parsed to
    MAP<STRING,STRING> first so one odd entry does not null the whole value.  Lists of the user under
    ``fieldReferences`` stand in for the discovered ones, key by key; a key that only they have comes last,
    without a label."""
    keys = keys or ["workspace_id"]
    j = F.col(json_col)
    inner = F.coalesce(F.get_json_object(j, "$.schema.document_fields.fields"), j)
    m = F.coalesce(F.from_json(inner, "map<string,string>"), F.create_map().cast("map<string,string>"))
    own = F.coalesce(F.from_json(F.get_json_object(j, "$.fieldReferences"), "map<string,array<string>>"),
                     F.create_map().cast("map<string,array<string>>"))
    d = df.select(*keys, F.map_filter(m, lambda k, v: v.startswith("{")).alias("m"), own.alias("own"))
    v = F.from_json("val", "struct<label:string, references:array<string>>")
    found = d.select(*keys, "own", F.posexplode("m").alias("pos", "field_key", "val")).select(
        *keys, "field_key", v["label"].alias("label"),
        F.coalesce(F.try_element_at("own", F.col("field_key")), v["references"], F.array().cast("array<string>")).alias("refs"),
        F.col("pos").cast("bigint").alias("seq"))
    rest = d.select(*keys, F.size("m").alias("n"), F.posexplode(F.map_filter(
        "own", lambda k, r: ~F.map_contains_key(F.col("m"), k) & r.isNotNull())).alias("pos", "field_key", "refs"))
    return found.unionByName(rest.select(*keys, "field_key", F.lit(None).cast("string").alias("label"), "refs",
                                         (F.col("n") + F.col("pos")).cast("bigint").alias("seq")))


# ----------------------------------------------------------------------------- A3
def discovery_stats(processed: DataFrame, fields: DataFrame, locations: DataFrame,
                    keys: list[str] | None = None) -> DataFrame:
    """A3: per workspace docs_processed, total_fields, total_locations,
    sections_created (1 when any field), total_chars_processed."""
    keys = keys or ["workspace_id"]
    d = processed.groupBy(*keys).agg(F.count(F.lit(1)).alias("docs_processed"),
                                     F.sum(F.length("text")).cast("bigint").alias("total_chars_processed"))
    f = fields.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_fields"))
    loc = locations.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_locations"))
    out = d.join(f, keys, "left").join(loc, keys, "left")
    return out.select(
        *keys, "docs_processed",
        F.coalesce("total_fields", F.lit(0)).cast("bigint").alias("total_fields"),
        F.coalesce("total_locations", F.lit(0)).cast("bigint").alias("total_locations"),
        F.when(F.coalesce("total_fields", F.lit(0)) > 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("sections_created"),
        "total_chars_processed")
