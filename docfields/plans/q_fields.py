"""Queries for the fields group (V1, A1, A2, W1, J4, J5, A3, J11, M11, S6, U1, U3, V2) and Q1."""
from __future__ import annotations

from pyspark.sql import functions as F

from docfields.operators import fields as FLD
from docfields.operators import locate as L
from docfields.operators.fuzzy import fuzzy_dedupe_col, fuzzy_dedupe_table
from docfields.plans.discover import discover
from docfields.plans.registry import register
from docfields.session import cut_lineage
from docfields.sources import fixtures as FX


def doc_fields(spark, sf_dir):
    return FLD.extract_fields_rules(FLD.discovery_input(FX.documents(spark, sf_dir, keyed=False)))


def merged_fields(spark, sf_dir, cut=True):
    """A1 of the default rules; cut (extracted once) where a query reads it more than once."""
    m = FLD.merge_fields(cut_lineage(doc_fields(spark, sf_dir)) if cut else doc_fields(spark, sf_dir))
    return cut_lineage(m) if cut else m


def _rule_sql(i, key, label, pat):
    pat = pat.replace("'", "''")
    ex = f"regexp_extract_all(text, '{pat}')"
    return (f"SELECT source AS workspace_id, doc_id, doc_id * {FLD.RULE_SLOTS} + {i} AS seq, '{key}' AS field_key, "
            f"'{label}' AS label, list_filter({ex}, lambda x, i: list_position({ex}, x) = i) AS refs "
            f"FROM documents WHERE length(text) >= {FLD.MIN_CHARS}")


DOC_FIELDS_SQL = "dfx AS (SELECT * FROM (" + "\n  UNION ALL ".join(
    _rule_sql(i, k, lb, p) for i, (k, lb, p) in enumerate(FLD.DEFAULT_RULES)) + ") WHERE len(refs) > 0)"

MERGED_SQL = DOC_FIELDS_SQL + """,
ex AS (SELECT workspace_id, field_key, seq, unnest(refs) AS ref, generate_subscripts(refs, 1) AS pos FROM dfx),
fr AS (SELECT workspace_id, field_key, ref, min(seq * 1000000 + pos) AS first FROM ex GROUP BY ALL),
fr_list AS (SELECT workspace_id, field_key, list(ref ORDER BY first) AS refs FROM fr GROUP BY ALL),
base AS (SELECT workspace_id, field_key, arg_min(label, seq) AS label, count(*) AS doc_frequency, min(seq) AS seq,
                list(doc_id ORDER BY seq) AS source_docs FROM dfx GROUP BY ALL),
merged AS (SELECT b.workspace_id, b.field_key, b.label, coalesce(r.refs, []) AS refs, b.source_docs,
                  b.doc_frequency, b.seq
           FROM base b LEFT JOIN fr_list r USING (workspace_id, field_key))"""


def _flat(df):
    """Lists to text for the value hash."""
    return df.withColumn("refs", F.array_join("refs", " | ")) \
        .withColumn("source_docs", F.array_join(F.col("source_docs").cast("array<string>"), ","))


FLAT_SQL = "array_to_string(refs, ' | ') AS refs, array_to_string(list_transform(source_docs, lambda x: CAST(x AS VARCHAR)), ',') AS source_docs"


@register("V1_extract_rules", f"""WITH {DOC_FIELDS_SQL}
SELECT workspace_id, doc_id, seq, field_key, label, array_to_string(refs, ' | ') AS refs FROM dfx""")
def v1_extract_rules(spark, sf_dir):
    """V1 default rules (email, phone, url, ISO date, money, license line) per document."""
    return doc_fields(spark, sf_dir).withColumn("refs", F.array_join("refs", " | ")).withColumn("seq", F.col("seq").cast("bigint"))


@register("A1_merge_fields", f"""WITH {MERGED_SQL}
SELECT workspace_id, field_key, label, {FLAT_SQL}, doc_frequency, seq FROM merged""")
def a1_merge_fields(spark, sf_dir):
    """A1: merge per-document fields per workspace (first-seen label and order)."""
    return _flat(merged_fields(spark, sf_dir, cut=False)).withColumn("seq", F.col("seq").cast("bigint"))


@register("A2_section_frequency", """
SELECT source AS workspace_id, count(DISTINCT doc_id) AS section_doc_frequency FROM documents
WHERE length(text) >= 50 GROUP BY source""")
def a2_section_frequency(spark, sf_dir):
    """A2: number of document schemas merged per workspace."""
    return FLD.section_frequency(FLD.discovery_input(FX.documents(spark, sf_dir)))


@register("U1_ordered_union", f"""WITH {DOC_FIELDS_SQL}
SELECT a.doc_id, a.field_key AS key_a, b.field_key AS key_b,
       array_to_string(list_filter(list_concat(a.refs, b.refs),
           lambda x, i: list_position(list_concat(a.refs, b.refs), x) = i), ' | ') AS refs
FROM dfx a JOIN dfx b ON a.doc_id = b.doc_id AND a.seq < b.seq""")
def u1_ordered_union(spark, sf_dir):
    """Ordered union of two fields' lists within each document."""
    d = doc_fields(spark, sf_dir)
    a = d.select("doc_id", F.col("seq").alias("sa"), F.col("field_key").alias("key_a"), F.col("refs").alias("ra"))
    b = d.select("doc_id", F.col("seq").alias("sb"), F.col("field_key").alias("key_b"), F.col("refs").alias("rb"))
    j = a.join(b, "doc_id").where(F.col("sa") < F.col("sb"))
    return j.select("doc_id", "key_a", "key_b", F.array_join(FLD.ordered_union(F.col("ra"), F.col("rb")), " | ").alias("refs"))


@register("W1_rank_fields", f"""WITH {MERGED_SQL}
SELECT workspace_id, field_key, row_number() OVER (PARTITION BY workspace_id
         ORDER BY doc_frequency DESC, len(refs) DESC, seq) AS rank
FROM merged""")
def w1_rank_fields(spark, sf_dir):
    """Field importance rank per workspace."""
    return FLD.rank_fields(merged_fields(spark, sf_dir, cut=False)).select("workspace_id", "field_key", "rank")


LINEAGE_SQL = MERGED_SQL + """,
cr AS (SELECT DISTINCT workspace_id, field_key AS canon_key, unnest(refs) AS ref FROM merged),
rr AS (SELECT DISTINCT workspace_id, field_key AS raw_key, unnest(refs) AS ref FROM merged),
pairs AS (SELECT DISTINCT cr.workspace_id, canon_key, raw_key FROM cr JOIN rr USING (workspace_id, ref)),
src AS (SELECT p.workspace_id, p.canon_key, m.seq AS raw_seq, unnest(m.source_docs) AS doc_id,
               generate_subscripts(m.source_docs, 1) AS k
        FROM pairs p JOIN merged m ON m.workspace_id = p.workspace_id AND m.field_key = p.raw_key),
srcf AS (SELECT workspace_id, canon_key, doc_id, min(raw_seq * 1000000 + k) AS o FROM src GROUP BY ALL),
agg AS (SELECT p.workspace_id, p.canon_key, count(*) AS doc_frequency FROM pairs p GROUP BY ALL),
srcl AS (SELECT workspace_id, canon_key, list(doc_id ORDER BY o) AS source_docs FROM srcf GROUP BY ALL),
lineage AS (
  SELECT m.workspace_id, m.field_key, m.label, m.refs, coalesce(s.source_docs, []) AS source_docs,
         coalesce(a.doc_frequency, 0) AS doc_frequency, len(coalesce(s.source_docs, [])) AS n_source_docs, m.seq
  FROM merged m LEFT JOIN agg a ON a.workspace_id = m.workspace_id AND a.canon_key = m.field_key
  LEFT JOIN srcl s ON s.workspace_id = m.workspace_id AND s.canon_key = m.field_key)"""


@register("J5_lineage", f"""WITH {LINEAGE_SQL}
SELECT workspace_id, field_key, label, {FLAT_SQL}, doc_frequency, n_source_docs FROM lineage""")
def j5_lineage(spark, sf_dir):
    """Lineage of merged fields through shared references (canonical = merged)."""
    m = merged_fields(spark, sf_dir)
    out = FLD.reattach_lineage(m.select("workspace_id", "field_key", "label", "refs", "seq"), m)
    return _flat(out).drop("seq")


def _field_freq_sql(fields_cte: str) -> str:
    return f"""lines AS (
  SELECT source AS workspace_id, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
fref AS (SELECT workspace_id, field_key, unnest(refs) AS ref, source_docs FROM {fields_cte}),
occ AS (
  SELECT f.workspace_id, f.field_key,
         len([i for i in range(0, length(l.line) - length(f.ref) + 1)
              if substring(l.line, i + 1, length(f.ref)) = f.ref]) AS n
  FROM fref f JOIN lines l ON l.workspace_id = f.workspace_id AND contains(l.line, f.ref)
  WHERE length(f.ref) > 0 AND NOT contains(f.ref, chr(10))
    AND (len(f.source_docs) = 0 OR list_contains(f.source_docs, l.doc_id))),
freq AS (SELECT workspace_id, field_key, sum(n) AS frequency FROM occ GROUP BY ALL)"""


@register("J4_field_locations", f"""WITH {MERGED_SQL},
{_field_freq_sql("merged")}
SELECT m.workspace_id, m.field_key, CAST(coalesce(f.frequency, 0) AS BIGINT) AS frequency
FROM merged m LEFT JOIN freq f USING (workspace_id, field_key)""")
def j4_field_locations(spark, sf_dir):
    """Frequency of each merged field over its source documents."""
    m = merged_fields(spark, sf_dir)
    out, _ = L.field_locations(m, FX.documents(spark, sf_dir))
    return out.select("workspace_id", "field_key", "frequency")


@register("J4_field_locations_paras", f"""WITH {MERGED_SQL},
{_field_freq_sql("merged")},
para AS (SELECT f.workspace_id, f.field_key, count(*) AS n FROM fref f JOIN lines l
  ON l.workspace_id = f.workspace_id AND contains(l.line, f.ref)
  WHERE length(f.ref) > 0 AND (len(f.source_docs) = 0 OR list_contains(f.source_docs, l.doc_id)) GROUP BY ALL)
SELECT m.workspace_id, m.field_key, CAST(coalesce(f.frequency, 0) AS BIGINT) AS in_lines, coalesce(p.n, 0) AS in_paragraphs,
       CAST(coalesce(f.frequency, 0) AS BIGINT) + coalesce(p.n, 0) AS frequency
FROM merged m LEFT JOIN freq f USING (workspace_id, field_key) LEFT JOIN para p USING (workspace_id, field_key)""")
def j4_field_locations_paras(spark, sf_dir):
    """J4 with separate paragraph text (J3 rows added), on long lineage."""
    d = cut_lineage(doc_fields(spark, sf_dir))
    docs = FX.documents(spark, sf_dir)
    paras = docs.select("doc_id", F.posexplode_outer(F.split("text", "\n", -1)).alias("para_idx", "text")).where(
        F.col("para_idx").isNotNull())
    fields, locs = L.field_locations_long(cut_lineage(FLD.merge_fields(d, sources=False)), FLD.field_lineage(d), docs, paras)
    per = locs.groupBy("workspace_id", "field_key").agg(F.count_if(F.col("part") == "line").alias("in_lines"),
                                                        F.count_if(F.col("part") == "paragraph").alias("in_paragraphs"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return fields.join(per, ["workspace_id", "field_key"], "left").select(
        "workspace_id", "field_key", none("in_lines"), none("in_paragraphs"), "frequency")


@register("A3_discovery_stats", f"""WITH {MERGED_SQL},
{_field_freq_sql("merged")},
d AS (SELECT source AS workspace_id, count(*) AS docs_processed, sum(length(text)) AS total_chars_processed
      FROM documents WHERE length(text) >= 50 GROUP BY ALL),
f AS (SELECT workspace_id, count(*) AS total_fields FROM merged GROUP BY ALL),
l AS (SELECT workspace_id, sum(frequency) AS total_locations FROM freq GROUP BY ALL)
SELECT d.workspace_id, docs_processed, coalesce(total_fields, 0) AS total_fields,
       CAST(coalesce(total_locations, 0) AS BIGINT) AS total_locations,
       CASE WHEN coalesce(total_fields, 0) > 0 THEN 1 ELSE 0 END AS sections_created,
       CAST(total_chars_processed AS BIGINT) AS total_chars_processed
FROM d LEFT JOIN f USING (workspace_id) LEFT JOIN l USING (workspace_id)""")
def a3_discovery_stats(spark, sf_dir):
    """A3: per-workspace discovery statistics (without consolidation)."""
    out = discover(FX.documents(spark, sf_dir), consolidate=False)
    return out["stats"]


@register("Q1_discover", f"""WITH {LINEAGE_SQL},
{_field_freq_sql("lineage")},
ranked AS (SELECT *, row_number() OVER (PARTITION BY workspace_id
             ORDER BY doc_frequency DESC, len(refs) DESC, seq) AS rank FROM lineage)
SELECT r.workspace_id, r.field_key, r.label, {FLAT_SQL}, r.doc_frequency, r.n_source_docs, r.rank,
       CAST(coalesce(f.frequency, 0) AS BIGINT) AS frequency
FROM ranked r LEFT JOIN freq f USING (workspace_id, field_key)""")
def q1_discover(spark, sf_dir):
    """Q1 flagship: discover -> merge -> consolidate (default V2) -> lineage -> rank -> locate."""
    out = discover(FX.documents(spark, sf_dir))
    f = FLD.sources_of(out["fields"], out["lineage"])
    return _flat(f.select("workspace_id", "field_key", "label", "refs", "source_docs", "doc_frequency",
                          "n_source_docs", "rank", "frequency"))


@register("Q1_locations", f"""WITH {LINEAGE_SQL},
{_field_freq_sql("lineage")}
SELECT workspace_id, field_key, CAST(sum(n) AS BIGINT) AS n_locations FROM occ GROUP BY ALL""")
def q1_locations(spark, sf_dir):
    """Q1 locations, counted per field (the full location rows come from J1/J4)."""
    out = discover(FX.documents(spark, sf_dir))
    return out["locations"].groupBy("workspace_id", "field_key").agg(F.count(F.lit(1)).alias("n_locations"))


@register("J11_overlay_refs", f"""WITH {MERGED_SQL},
edited AS (SELECT workspace_id, field_key, list_reverse(refs) AS refs FROM merged WHERE field_key = 'email'
           UNION ALL SELECT workspace_id, 'custom', ['x', 'y'] FROM merged WHERE field_key = 'phone')
SELECT coalesce(m.workspace_id, e.workspace_id) AS workspace_id, coalesce(m.field_key, e.field_key) AS field_key,
       array_to_string(coalesce(e.refs, m.refs), ' | ') AS refs
FROM merged m FULL OUTER JOIN edited e ON m.workspace_id = e.workspace_id AND m.field_key = e.field_key""")
def j11_overlay_refs(spark, sf_dir):
    """Saved reference lists replace discovered ones key by key."""
    m = merged_fields(spark, sf_dir)
    edited = m.where(F.col("field_key") == "email").select("workspace_id", "field_key", F.reverse("refs").alias("refs")) \
        .unionByName(m.where(F.col("field_key") == "phone").select(
            "workspace_id", F.lit("custom").alias("field_key"), F.array(F.lit("x"), F.lit("y")).alias("refs")))
    out = FLD.overlay_refs(m.select("workspace_id", "field_key", "refs"), edited)
    return out.select("workspace_id", "field_key", F.array_join("refs", " | ").alias("refs"))


def _edits(spark, m):
    """Edit log derived from merged fields: add / rename / remove / create / set_label / delete."""
    e1 = m.select("workspace_id", "field_key", F.lit(1).cast("bigint").alias("seq"), F.lit("add").alias("op"),
                  F.lit("  new ref ").alias("ref"), F.lit(None).cast("string").alias("new_ref"),
                  F.lit(None).cast("string").alias("label"))
    e2 = m.select("workspace_id", "field_key", F.lit(2).cast("bigint"), F.lit("rename"), F.element_at("refs", 1),
                  F.lit(" renamed "), F.lit(None).cast("string"))
    e3 = m.where(F.col("field_key") == "phone").select(
        "workspace_id", "field_key", F.lit(3).cast("bigint"), F.lit("remove"), F.element_at("refs", -1),
        F.lit(None).cast("string"), F.lit(None).cast("string"))
    e4 = m.where(F.col("field_key") == "email").select(
        "workspace_id", F.lit(None).cast("string"), F.lit(4).cast("bigint"), F.lit("create"),
        F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("Contact  Person"))
    e5 = m.where(F.col("field_key") == "license").select(
        "workspace_id", "field_key", F.lit(5).cast("bigint"), F.lit("delete"), F.lit(None).cast("string"),
        F.lit(None).cast("string"), F.lit(None).cast("string"))
    e6 = m.select("workspace_id", "field_key", F.lit(6).cast("bigint"), F.lit("add"), F.lit("  new ref "),
                  F.lit(None).cast("string"), F.lit(None).cast("string"))
    e7 = m.where(F.col("field_key") == "email").select(
        "workspace_id", F.lit("contact_person"), F.lit(7).cast("bigint"), F.lit("add"), F.lit("someone"),
        F.lit(None).cast("string"), F.lit(None).cast("string"))
    none = F.lit(None).cast("string")
    # a trimmed label, a blank one (ignored), a blank create (ignored), a create over an existing key
    e8 = m.where(F.col("field_key") == "email").select(
        "workspace_id", "field_key", F.lit(8).cast("bigint"), F.lit("set_label"), none, none, F.lit("  E-mail "))
    e9 = m.where(F.col("field_key") == "email").select(
        "workspace_id", "field_key", F.lit(9).cast("bigint"), F.explode(F.array(F.lit("set_label"), F.lit("create"))),
        none, none, F.lit("   "))
    odd = m.where((F.col("field_key") == "phone") & (F.col("doc_frequency") % 2 == 1))
    e10 = odd.select("workspace_id", F.lit(None).cast("string"), F.lit(10).cast("bigint"), F.lit("create"), none, none,
                     F.lit("PHONE"))
    e11 = odd.select("workspace_id", "field_key", F.lit(11).cast("bigint"), F.lit("add"), F.lit("p1"), none, none)
    return e1.union(e2).union(e3).union(e4).union(e5).union(e6).union(e7).union(e8).union(e9).union(e10).union(e11)


@register("M11_field_edits", f"""WITH {MERGED_SQL},
s1 AS (SELECT workspace_id, field_key, label, doc_frequency, refs[1] AS first_ref, refs[-1] AS last_ref,
              list_prepend('  new ref ', list_prepend('  new ref ', refs)) AS refs FROM merged),
s2 AS (SELECT workspace_id, field_key, label, doc_frequency, last_ref,
              list_transform(refs, lambda r: CASE WHEN r = first_ref THEN 'renamed' ELSE r END) AS refs FROM s1),
s3 AS (SELECT workspace_id, field_key,
              CASE WHEN field_key = 'email' THEN 'E-mail' WHEN field_key = 'phone' AND doc_frequency % 2 = 1 THEN 'PHONE'
                   ELSE label END AS label,
              CASE WHEN field_key = 'phone' AND doc_frequency % 2 = 1 THEN ['p1']
                   WHEN field_key = 'phone' THEN list_filter(refs, lambda r: r <> last_ref) ELSE refs END AS refs
       FROM s2),
s5 AS (SELECT * FROM s3 WHERE field_key <> 'license'
       UNION ALL SELECT DISTINCT workspace_id, 'contact_person', 'Contact  Person', ['someone'] FROM merged WHERE field_key = 'email')
SELECT workspace_id, field_key, label, array_to_string(refs, ' | ') AS refs FROM s5""")
def m11_field_edits(spark, sf_dir):
    """Ordered field edit log folded over the reference lists."""
    m = merged_fields(spark, sf_dir)
    out = FLD.apply_field_edits(m, _edits(spark, m))
    return out.select("workspace_id", "field_key", "label", F.array_join("refs", " | ").alias("refs"))


@register("S6_read_fields", f"""WITH {MERGED_SQL}
SELECT workspace_id, field_key, label, array_to_string(refs, ' | ') AS refs FROM merged""")
def s6_read_fields(spark, sf_dir):
    """Stored schema JSON (all references) -> long fields (odd entries skipped)."""
    m = merged_fields(spark, sf_dir)
    entry = F.to_json(F.create_map("field_key", F.struct("label", F.col("refs").alias("references"))))
    j = F.concat(F.lit('{"schema": {"document_fields": {"fields": '), F.expr("left(e, length(e) - 1)"), F.lit(', "bad": 3}}}}'))
    stored = m.select("workspace_id", entry.alias("e")).select("workspace_id", j.alias("schema_json"))
    out = FLD.read_fields(stored)
    return out.select("workspace_id", "field_key", "label", F.array_join("refs", " | ").alias("refs"))


@register("S6_read_fields_overlay", f"""WITH {MERGED_SQL}
SELECT workspace_id, field_key, label, array_to_string(CASE WHEN field_key = 'email' THEN list_reverse(refs) ELSE refs END, ' | ') AS refs
FROM merged UNION ALL SELECT workspace_id, 'custom_' || field_key, NULL, 'x | y' FROM merged WHERE field_key = 'phone'""")
def s6_read_fields_overlay(spark, sf_dir):
    """S6 with the user's saved lists: they replace the discovered ones, new keys come with them."""
    m = merged_fields(spark, sf_dir)
    entry = F.to_json(F.create_map("field_key", F.struct("label", F.col("refs").alias("references"))))
    own = F.when(F.col("field_key") == "email", F.to_json(F.create_map("field_key", F.reverse("refs")))) \
        .when(F.col("field_key") == "phone", F.lit('{"custom_phone": ["x", "y"]}')).otherwise(F.lit("{}"))
    j = F.concat(F.lit('{"schema": {"document_fields": {"fields": '), F.col("e"), F.lit('}}, "fieldReferences": '), F.col("own"), F.lit("}"))
    out = FLD.read_fields(m.select("workspace_id", entry.alias("e"), own.alias("own")).select("workspace_id", j.alias("schema_json")))
    return out.select("workspace_id", "field_key", "label", F.array_join("refs", " | ").alias("refs"))


@register("M11_carry_replacements", f"""WITH {MERGED_SQL},
pex AS (SELECT workspace_id, field_key, refs[1] AS top, unnest(refs) AS ref, generate_subscripts(refs, 1) - 1 AS pos FROM merged),
uv AS (SELECT *, CASE WHEN field_key = 'email' AND pos % 2 = 0 THEN upper(ref) WHEN field_key = 'license' THEN '' ELSE 'v' || pos END AS value
       FROM pex WHERE field_key <> 'phone' OR pos > 0)
SELECT workspace_id, field_key, ref, value FROM uv WHERE ref <> top
UNION ALL SELECT m.workspace_id, m.field_key, 'renamed', CASE WHEN length(coalesce(u.value, '')) > 0 THEN u.value ELSE 'renamed' END
FROM merged m LEFT JOIN uv u ON u.workspace_id = m.workspace_id AND u.field_key = m.field_key AND u.ref = m.refs[1]""")
def m11_carry_replacements(spark, sf_dir):
    """The replacement values of a field follow the rename of its first reference."""
    m = merged_fields(spark, sf_dir)
    ex = m.select("workspace_id", "field_key", F.posexplode("refs").alias("pos", "ref"))
    value = F.when((F.col("field_key") == "email") & (F.col("pos") % 2 == 0), F.upper("ref")).when(
        F.col("field_key") == "license", F.lit("")).otherwise(F.concat(F.lit("v"), F.col("pos").cast("string")))
    values = ex.where((F.col("field_key") != "phone") | (F.col("pos") > 0)).select("workspace_id", "field_key", "ref", value.alias("value"))
    return FLD.carry_replacements(values, _edits(spark, m))


@register("U3_fuzzy_dedupe")
def u3_fuzzy_dedupe(spark, sf_dir):
    """Fuzzy de-duplication (ratio >= 85) of each document field's references."""
    d = doc_fields(spark, sf_dir)
    out = d.select("doc_id", "field_key", F.size("refs").alias("n_refs"), fuzzy_dedupe_col("refs").alias("kept"))
    return out.select("doc_id", "field_key", "n_refs", F.size("kept").alias("n_kept"), F.array_join("kept", " | ").alias("kept"))


@register("U3_fuzzy_corpus")
def u3_fuzzy_corpus(spark, sf_dir):
    """U3 over all documents: of each field of a workspace the references that resemble (ratio >= 85) none kept
    before them, in the order of A1."""
    refs = doc_fields(spark, sf_dir).select("workspace_id", "field_key", "seq", F.posexplode("refs").alias("pos", "ref"))
    out = fuzzy_dedupe_table(refs.withColumn("at", F.struct("seq", "pos")), FLD.FUZZY_THRESHOLD, ["workspace_id", "field_key"], "at")
    return out.select("workspace_id", "field_key", "ref", F.col("at.seq").cast("bigint").alias("seq"))


V2_SQL = MERGED_SQL + """,
tok AS (SELECT DISTINCT workspace_id, field_key, unnest(list_prepend('k:' || translate(lower(field_key), ' -', '__'), list_transform(refs, lambda r: 'r:' || r))) AS tok FROM merged),
near AS (SELECT DISTINCT a.workspace_id, a.field_key AS a, b.field_key AS b FROM tok a JOIN tok b USING (workspace_id, tok)),
reach AS (SELECT workspace_id, field_key AS a, field_key AS b FROM merged
          UNION SELECT r.workspace_id, r.a, n.b FROM reach r JOIN near n ON n.workspace_id = r.workspace_id AND n.a = r.b),
comp AS (SELECT r.workspace_id, r.a AS field_key, min(m.seq) AS comp FROM reach r JOIN merged m
         ON m.workspace_id = r.workspace_id AND m.field_key = r.b GROUP BY ALL),
mem AS (SELECT m.*, c.comp FROM merged m JOIN comp c USING (workspace_id, field_key)),
mref AS (SELECT workspace_id, comp, ref, min(struct_pack(s := seq, p := pos)) AS o FROM (
  SELECT workspace_id, comp, seq, unnest(refs) AS ref, generate_subscripts(refs, 1) AS pos FROM mem) GROUP BY ALL),
canon AS (SELECT workspace_id, comp, arg_min(field_key, seq) AS field_key, arg_min(label, seq) AS label FROM mem GROUP BY ALL),
crefs AS (SELECT workspace_id, comp, list(ref ORDER BY o) AS refs FROM mref GROUP BY ALL),
cf AS (SELECT c.workspace_id, c.field_key, c.label, coalesce(r.refs, []) AS refs FROM canon c LEFT JOIN crefs r USING (workspace_id, comp)),
ce AS (SELECT DISTINCT workspace_id, field_key, unnest(refs) AS ref FROM cf),
re AS (SELECT DISTINCT workspace_id, field_key AS raw_key, unnest(refs) AS ref FROM merged),
shared AS (SELECT DISTINCT workspace_id, field_key, raw_key FROM ce JOIN re USING (workspace_id, ref)),
src2 AS (SELECT s.workspace_id, s.field_key, m.seq AS raw_seq, unnest(m.source_docs) AS doc_id, generate_subscripts(m.source_docs, 1) AS k
         FROM shared s JOIN merged m ON m.workspace_id = s.workspace_id AND m.field_key = s.raw_key),
srcl2 AS (SELECT workspace_id, field_key, list(doc_id ORDER BY o) AS source_docs FROM (
  SELECT workspace_id, field_key, doc_id, min(struct_pack(r := raw_seq, k := k)) AS o FROM src2 GROUP BY ALL) GROUP BY ALL),
cnt AS (SELECT workspace_id, field_key, count(*) AS doc_frequency FROM shared GROUP BY ALL),
v2 AS (SELECT cf.*, coalesce(source_docs, []) AS source_docs, coalesce(doc_frequency, 0) AS doc_frequency
       FROM cf LEFT JOIN srcl2 USING (workspace_id, field_key) LEFT JOIN cnt USING (workspace_id, field_key))"""


@register("V2_consolidate", f"""WITH RECURSIVE {V2_SQL}
SELECT workspace_id, field_key, label, {FLAT_SQL}, doc_frequency, len(source_docs) AS n_source_docs FROM v2""")
def v2_consolidate(spark, sf_dir):
    """V2 default: connected components over shared normalized keys and references."""
    m = merged_fields(spark, sf_dir)
    return _flat(FLD.consolidate(m)).drop("seq")
