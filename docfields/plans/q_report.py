"""Queries for reports (P1, J6, A7, J10, A15, V3, V4, X27, X28, A8, A9, A13, A14, W2, S7) and Q3."""
from __future__ import annotations

from pyspark.sql import functions as F

from docfields.operators import report as RP
from docfields.plans.q_fields import MERGED_SQL, merged_fields
from docfields.plans.registry import register
from docfields.plans.report import build_report
from docfields.sources.arrivals import shared_folder
from docfields.sources import fixtures as FX
from docfields.sources.fixtures import with_sql
from docfields.sources.tables import read_table

START, END = "1995-01-01", "1995-12-31"
WS_START, WS_END = "2024-01-01", "2024-01-20"

#: The report as SQL, by name: workspaces of the range, values by workspace and column, outcome by workspace.
REPORT_SQL = f"""{with_sql("docs", "workspaces", "report_columns")},
{MERGED_SQL},
in_range AS (SELECT *, workspace_id IN (SELECT workspace_id FROM docs) AS has_docs FROM workspaces
  WHERE CASE WHEN event_date IS NULL THEN CAST(created_at AS DATE) ELSE event_date END BETWEEN DATE '{WS_START}' AND DATE '{WS_END}'),
asked AS (SELECT *, name IN ('S.No', 'Event Name', 'Event Date') AS given FROM report_columns),
col_words AS (SELECT DISTINCT name, w FROM (
  SELECT name, unnest(regexp_extract_all(lower(name || ' ' || coalesce(description, '')), '[a-z0-9_]+')) AS w FROM asked WHERE NOT given)
  WHERE length(w) > 2),
field_words AS (SELECT DISTINCT workspace_id, field_key, seq, value, w FROM (
  SELECT workspace_id, field_key, seq, refs[1] AS value,
         unnest(regexp_extract_all(lower(replace(field_key, '_', ' ') || ' ' || coalesce(label, '')), '[a-z0-9_]+')) AS w FROM merged)
  WHERE length(w) > 2),
shared AS (SELECT workspace_id, name, field_key, seq, value, count(*) AS n FROM col_words JOIN field_words USING (w) GROUP BY ALL),
best AS (SELECT workspace_id, name, value FROM shared
  QUALIFY row_number() OVER (PARTITION BY workspace_id, name ORDER BY n DESC, seq) = 1),
vals AS (SELECT r.workspace_id, r.created_at, a.name AS "column", a."order" AS col_order, a.given,
    CASE a.name WHEN 'S.No' THEN NULL WHEN 'Event Name' THEN r.name
         WHEN 'Event Date' THEN strftime(coalesce(CAST(r.event_date AS TIMESTAMP), r.created_at), '%Y-%m-%d') ELSE b.value END AS value
  FROM in_range r CROSS JOIN asked a LEFT JOIN best b ON b.workspace_id = r.workspace_id AND b.name = a.name
  WHERE r.has_docs),
outcomes AS (SELECT workspace_id, created_at,
    coalesce(string_agg("column", ', ' ORDER BY col_order) FILTER (WHERE NOT given AND value IS NULL), '') AS unresolved,
    CASE WHEN bool_or(NOT given AND value IS NULL) THEN 'unresolved' ELSE 'valid' END AS outcome
  FROM vals GROUP BY ALL),
numbered AS (SELECT workspace_id, CAST(row_number() OVER (ORDER BY created_at DESC, workspace_id) AS VARCHAR) AS s_no
  FROM outcomes WHERE outcome = 'valid'),
sheet AS (SELECT workspace_id, "column", CASE "column" WHEN 'S.No' THEN s_no ELSE value END AS value, CAST(s_no AS INTEGER) AS pos
  FROM vals JOIN numbered USING (workspace_id))"""


@register("P1_J6_report_range", f"""{with_sql("orders_ws")},
r AS (SELECT * FROM orders_ws WHERE event_date BETWEEN DATE '{START}' AND DATE '{END}'
      OR (event_date IS NULL AND created_at BETWEEN TIMESTAMP '{START} 00:00:00' AND TIMESTAMP '{END} 23:59:59'))
SELECT workspace_id, name, CASE WHEN workspace_id IN (SELECT l_orderkey FROM lineitem) THEN 1 ELSE 0 END AS has_docs FROM r""")
def p1_j6_report_range(spark, sf_dir):
    """P1 + J6: workspaces in the date range, split into with / without documents."""
    ws = RP.workspaces_in_range(FX.orders_ws(spark, sf_dir), START, END)
    docs = FX.orders_ws_documents(spark, sf_dir)
    return RP.flag_docs(ws, docs).select("workspace_id", "name", F.col("has_docs").cast("bigint").alias("has_docs"))


@register("A7_doc_counts", """SELECT l_orderkey AS workspace_id, count(*) AS n_docs FROM lineitem GROUP BY 1""")
def a7_doc_counts(spark, sf_dir):
    """Documents per workspace (orders' line items)."""
    return RP.doc_counts(FX.orders_ws_documents(spark, sf_dir))


@register("J10_column_hints", """
WITH last AS (SELECT p_type AS name, arg_max(p_name, p_partkey) AS description FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL),
req AS (SELECT CASE WHEN p_partkey % 5 = 0 THEN p_type || '?' ELSE p_type END AS name, p_partkey AS pos FROM part)
SELECT req.name, req.pos, last.description FROM req LEFT JOIN last USING (name)""")
def j10_column_hints(spark, sf_dir):
    """Requested columns (part types, some unknown) with the last configured hint of that name."""
    p = read_table(spark, sf_dir, "part")
    cfg = p.where(F.col("p_partkey") % 2 == 0).select(
        F.col("p_type").alias("name"), F.col("p_name").alias("description"), F.col("p_partkey").alias("order"))
    name = F.when(F.col("p_partkey") % 5 == 0, F.concat("p_type", F.lit("?"))).otherwise(F.col("p_type"))
    return RP.column_hints(p.select(name.alias("name"), F.col("p_partkey").alias("pos")), cfg)


@register("A15_concat_docs", f"""{with_sql("docs")},
picks AS (SELECT workspace_id || '/' || CAST(doc_id // 16 AS VARCHAR) AS workspace_id, doc_id, -doc_id AS pos FROM docs)
SELECT p.workspace_id, sha256(string_agg(d.text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY p.pos)) AS digest,
       count(*) AS n_docs
FROM picks p JOIN docs d USING (doc_id) WHERE length(d.text) > 0 GROUP BY ALL""")
def a15_concat_docs(spark, sf_dir):
    """The documents of every request concatenated in the requested order.  A request names up to 16
    documents of a workspace; together the requests name all."""
    d = FX.documents(spark, sf_dir)
    request = F.concat("workspace_id", F.lit("/"), F.expr("doc_id div 16").cast("string"))
    picks = d.select(request.alias("workspace_id"), "doc_id", (-F.col("doc_id")).alias("pos"))
    ctx = RP.concat_docs(d, picks)
    n = picks.join(d.select("doc_id", "text"), "doc_id").where(F.length("text") > 0).groupBy("workspace_id") \
        .agg(F.count(F.lit(1)).alias("n_docs"))
    return ctx.select("workspace_id", F.sha2("context", 256).alias("digest")).join(n, "workspace_id")


def _report(spark, sf_dir):
    ws = RP.workspaces_in_range(FX.workspaces(spark, sf_dir), WS_START, WS_END)
    docs = FX.documents(spark, sf_dir)
    with_docs, skipped = RP.split_by_docs(ws, docs)
    fields = merged_fields(spark, sf_dir)
    values = RP.report_values(with_docs, fields, FX.report_columns(spark))
    outcomes = RP.split_resolved(values)
    return ws, docs, skipped, values, outcomes


@register("Q3_report", f"""{REPORT_SQL}
SELECT workspace_id,
       max(value) FILTER (WHERE "column" = 'S.No') AS "S.No",
       max(value) FILTER (WHERE "column" = 'Event Name') AS "Event Name",
       max(value) FILTER (WHERE "column" = 'Event Date') AS "Event Date",
       max(value) FILTER (WHERE "column" = 'Contact Email') AS "Contact Email",
       max(value) FILTER (WHERE "column" = 'Contact Phone') AS "Contact Phone",
       max(value) FILTER (WHERE "column" = 'License') AS "License"
FROM sheet GROUP BY workspace_id""")
def q3_report(spark, sf_dir):
    """Q3: P1 -> J6 -> V3 -> A14 -> W2 -> A13 over the workspaces of a date range."""
    return _wide(spark, sf_dir)


def _wide(spark, sf_dir):
    ws, docs, skipped, values, outcomes = _report(spark, sf_dir)
    valid = outcomes.where(F.col("outcome") == "valid").select("workspace_id", "created_at")
    numbered = RP.number_rows(valid, [F.col("created_at").desc(), F.col("workspace_id")], col="s_no")
    long = values.join(numbered.select("workspace_id", "s_no"), "workspace_id") \
        .withColumn("value", F.when(F.col("column") == "S.No", F.col("s_no").cast("string")).otherwise(F.col("value")))
    cols = [n for n, _ in FX.REPORT_COLUMNS]
    return RP.pivot_report(long.select("workspace_id", "column", "value"), cols)


@register("A8_outcome_summary", f"""{REPORT_SQL}
SELECT outcome, count(*) AS n FROM outcomes GROUP BY outcome
UNION ALL SELECT 'skipped', count(*) FILTER (WHERE NOT has_docs) FROM in_range""")
def a8_outcome_summary(spark, sf_dir):
    """Valid / unresolved / skipped counts for the report range."""
    ws, docs, skipped, values, outcomes = _report(spark, sf_dir)
    return RP.outcome_summary(outcomes, skipped)


@register("A14_unresolved", f"""{REPORT_SQL}
SELECT workspace_id, outcome, unresolved FROM outcomes""")
def a14_unresolved(spark, sf_dir):
    """Unresolved columns per workspace of the report."""
    _, _, _, _, outcomes = _report(spark, sf_dir)
    return outcomes.select("workspace_id", "outcome", F.array_join("unresolved_columns", ", ").alias("unresolved"))


@register("V4_resolve_from_docs", f"""{REPORT_SQL},
hits AS (SELECT v.workspace_id, v."column", d.doc_id,
    regexp_extract(d.text, '(?im)^[ \\t]*' || v."column" || '[ \\t]*:[ \\t]*(.+)$', 1) AS hit
  FROM vals v JOIN docs d USING (workspace_id) WHERE NOT v.given AND v.value IS NULL),
found AS (SELECT workspace_id, "column", PYSTRIP(arg_min(hit, doc_id)) AS hit FROM hits WHERE hit <> '' GROUP BY ALL)
SELECT v.workspace_id, v."column", coalesce(f.hit, v.value) AS value
FROM vals v JOIN outcomes o USING (workspace_id) LEFT JOIN found f ON f.workspace_id = v.workspace_id AND f."column" = v."column"
WHERE o.outcome = 'unresolved'""")
def v4_resolve_from_docs(spark, sf_dir):
    """V4 + J12 + U4: unresolved columns filled from 'Column: value' lines of the documents."""
    ws, docs, skipped, values, outcomes = _report(spark, sf_dir)
    unresolved = outcomes.where(F.col("outcome") == "unresolved").select(
        "workspace_id", F.explode("unresolved_columns").alias("column"))
    resolved = RP.resolve_from_docs(docs, unresolved)
    partial = values.join(unresolved.select("workspace_id").distinct(), "workspace_id", "left_semi")
    filled = RP.fill_rows(partial.select("workspace_id", "column", "value"), resolved.where(F.col("value").isNotNull()))
    return filled


@register("A9_width_profile", f"""{REPORT_SQL}
SELECT a.name AS "column", CAST(least(greatest(length(a.name), coalesce(max(length(s.value)), 0)) + 2, 50) AS BIGINT) AS width
FROM asked a LEFT JOIN sheet s ON s."column" = a.name AND s.pos <= 10 GROUP BY a.name""")
def a9_width_profile(spark, sf_dir):
    """Column widths of the report sheet."""
    return RP.width_profile(_wide(spark, sf_dir), [n for n, _ in FX.REPORT_COLUMNS])


X27_SQL = f"""WITH {MERGED_SQL},
lines AS (SELECT source AS workspace_id, doc_id, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_start
  FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
fref AS (SELECT workspace_id, field_key, unnest(refs) AS ref, source_docs FROM merged),
occ AS (SELECT f.workspace_id, f.field_key, l.doc_id, l.line_start + strpos(l.line, f.ref) AS place,
               substring(PYSTRIP(l.line), 1, 100) AS cut
  FROM fref f JOIN lines l ON l.workspace_id = f.workspace_id AND contains(l.line, f.ref)
  WHERE length(f.ref) > 0 AND list_contains(f.source_docs, l.doc_id)),
said AS (SELECT workspace_id, field_key, c, min(struct_pack(d := doc_id, a := place)) AS o FROM (SELECT *, PYSTRIP(cut) AS c FROM occ)
  WHERE length(c) > 0 GROUP BY ALL),
ctx AS (SELECT workspace_id, field_key, string_agg(c, '; ' ORDER BY o) AS ctx FROM (
  SELECT *, row_number() OVER (PARTITION BY workspace_id, field_key ORDER BY o) AS i FROM said) WHERE i <= 3 GROUP BY ALL),
block AS (SELECT m.workspace_id, m.seq, 'Field: ' || coalesce(m.label, m.field_key) || ' (Key: ' || m.field_key || ')'
    || CASE WHEN len(m.refs) > 0 THEN chr(10) || '  Values: ' || array_to_string(m.refs[1:5], ', ') ELSE '' END
    || CASE WHEN c.ctx IS NOT NULL THEN chr(10) || '  Context: ' || c.ctx ELSE '' END AS b
  FROM merged m LEFT JOIN ctx c USING (workspace_id, field_key)),
context AS (SELECT workspace_id, string_agg(b, chr(10) || chr(10) ORDER BY seq) AS context FROM block GROUP BY ALL)
SELECT workspace_id, length(context) AS n_chars, sha256(context) AS digest FROM context"""


@register("X27_field_context", X27_SQL)
def x27_field_context(spark, sf_dir):
    """Distilled field context per workspace (values and context lines)."""
    from docfields.operators import locate as L

    fields = merged_fields(spark, sf_dir)
    _, locs = L.field_locations(fields, FX.documents(spark, sf_dir))
    ctx = RP.field_context(fields, locs)
    return ctx.select("workspace_id", F.length("context").alias("n_chars"), F.sha2("context", 256).alias("digest"))


# ---------------------------------------------------------------- callables, the whole report and its sink
NAMES = [n for n, _ in FX.REPORT_COLUMNS]


def pick_by_words(requests):
    """A resolver without a model: of the fields in the context, the first value of the one that shares most
    words with the column's name and hint."""
    import re

    words = lambda t: {w for w in re.findall("[a-z0-9_]+", t.lower()) if len(w) > 2}
    out = []
    for request in requests:
        fields = re.findall(r"Field: (.*) \(Key: (.*)\)\n  Values: (.*)", request.context)
        answer = {}
        for name, hint in request.columns:
            asked = words(f"{name} {hint or ''}")
            shared = [(len(asked & words(f"{key.replace('_', ' ')} {label}")), value) for label, key, value in fields]
            best = max(shared, key=lambda x: x[0], default=(0, None))
            answer[name] = best[1].split(", ")[0] if best[0] else None
        out.append(answer)
    return out


def _contexts(spark, sf_dir, fields):
    """X27 without context lines: one value a field, so that commas inside a value don't matter."""
    one = fields.withColumn("refs", F.slice(F.transform("refs", lambda r: F.split_part(r, F.lit(", "), F.lit(1))), 1, 1))
    none = spark.createDataFrame([], "workspace_id string, field_key string, context_line string, doc_id long, char_start int")
    return RP.field_context(one, none)


@register("V3_resolver_callable", f"""{REPORT_SQL}
SELECT workspace_id, "column", CASE WHEN "column" IN ('S.No', 'Event Name', 'Event Date') THEN value
       ELSE PYSTRIP(split_part(split_part(value, chr(10), 1), ', ', 1)) END AS value FROM vals""")
def v3_resolver_callable(spark, sf_dir):
    """V3 with a caller's function, in bounded batches, on the distilled context of each workspace."""
    ws = RP.workspaces_in_range(FX.workspaces(spark, sf_dir), WS_START, WS_END)
    with_docs, _ = RP.split_by_docs(ws, FX.documents(spark, sf_dir))
    fields = merged_fields(spark, sf_dir)
    resolver = RP.context_resolver(_contexts(spark, sf_dir, fields), pick_by_words)
    return RP.report_values(with_docs, fields, FX.report_columns(spark), resolver).select("workspace_id", "column", "value")


def _with_lines(docs):
    """Every fifth document states a phone number and a licence on lines of their own, every tenth an address."""
    n = F.col("doc_id")
    line = F.concat(F.lit("\nContact Phone: +1 "), n.cast("string"), F.lit("\nLicense:  L-"), n.cast("string"), F.lit(" "),
                    F.when(n % 10 == 0, F.concat(F.lit("\nContact Email: p"), n.cast("string"), F.lit("@x.org"))).otherwise(F.lit("")))
    return docs.withColumn("text", F.when(n % 5 == 0, F.concat("text", line)).otherwise(F.col("text")))


def _first_date(fields):
    """Fields of even workspaces only, so that some rows of the report need their documents."""
    return fields.where(F.substring("workspace_id", 4, 10).cast("int") % 2 == 0)


FULL_SQL = REPORT_SQL.replace("FROM merged)", "FROM merged WHERE CAST(substring(workspace_id, 4, 10) AS INTEGER) % 2 = 0)", 1) + """,
lined AS (SELECT workspace_id, doc_id, CASE WHEN doc_id % 5 = 0 THEN text || chr(10) || 'Contact Phone: +1 ' || doc_id || chr(10)
    || 'License:  L-' || doc_id || ' ' || CASE WHEN doc_id % 10 = 0 THEN chr(10) || 'Contact Email: p' || doc_id || '@x.org' ELSE '' END
    ELSE text END AS text FROM docs),
hits AS (SELECT v.workspace_id, v."column", d.doc_id,
    regexp_extract(d.text, '(?im)^[ \t]*' || v."column" || '[ \t]*:[ \t]*(.+)$', 1) AS hit
  FROM vals v JOIN lined d USING (workspace_id) WHERE NOT v.given AND v.value IS NULL),
found AS (SELECT workspace_id, "column", PYSTRIP(arg_min(hit, doc_id)) AS hit FROM hits WHERE hit <> '' GROUP BY ALL),
whole AS (SELECT v.*, o.outcome AS was, coalesce(f.hit, v.value) AS had FROM vals v JOIN outcomes o USING (workspace_id)
  LEFT JOIN found f ON f.workspace_id = v.workspace_id AND f."column" = v."column"),
final AS (SELECT workspace_id, created_at, was, CASE WHEN bool_or(NOT given AND had IS NULL) THEN 'unresolved'
    WHEN any_value(was) = 'unresolved' THEN 'resolved' ELSE 'valid' END AS outcome,
    coalesce(string_agg("column", ', ' ORDER BY col_order) FILTER (WHERE NOT given AND had IS NULL), '') AS missing
  FROM whole GROUP BY workspace_id, created_at, was),
place AS (SELECT workspace_id, row_number() OVER (ORDER BY was <> 'valid', created_at DESC, workspace_id) AS s_no
  FROM final WHERE outcome <> 'unresolved'),
page AS (SELECT workspace_id, "column", CASE WHEN "column" = 'S.No' THEN CAST(s_no AS VARCHAR) ELSE had END AS value, s_no
  FROM whole JOIN place USING (workspace_id))"""


def _full(spark, sf_dir):
    ws = RP.workspaces_in_range(FX.workspaces(spark, sf_dir), WS_START, WS_END)
    return build_report(ws, _with_lines(FX.documents(spark, sf_dir)), _first_date(merged_fields(spark, sf_dir)),
                        FX.report_columns(spark), NAMES)


@register("Q3_report_sink", f"""{FULL_SQL}
SELECT max(value) FILTER (WHERE "column" = 'S.No') AS "S.No",
       max(value) FILTER (WHERE "column" = 'Event Name') AS "Event Name",
       max(value) FILTER (WHERE "column" = 'Event Date') AS "Event Date",
       max(value) FILTER (WHERE "column" = 'Contact Email') AS "Contact Email",
       max(value) FILTER (WHERE "column" = 'Contact Phone') AS "Contact Phone",
       max(value) FILTER (WHERE "column" = 'License') AS "License"
FROM page GROUP BY workspace_id""")
def q3_report_sink(spark, sf_dir):
    """Q3 in full: P1 -> J6 -> V3 -> A14 -> V4 -> J12 -> U4 -> W2 -> A13 -> S7, read back from the sheet."""
    path = shared_folder(spark, "report")
    RP.write_report(_full(spark, sf_dir)["sheet"], NAMES, path, title=f"Report {WS_START} to {WS_END}")
    return RP.read_report(spark, NAMES, path)


@register("Q3_report_outcomes", f"""{FULL_SQL}
SELECT workspace_id, outcome, missing FROM final
UNION ALL SELECT workspace_id, 'skipped', '' FROM in_range WHERE NOT has_docs""")
def q3_report_outcomes(spark, sf_dir):
    """Q3: what became of every workspace of the range: valid, resolved from documents, unresolved, skipped."""
    out = _full(spark, sf_dir)
    done = out["outcomes"].select("workspace_id", "outcome", F.array_join("unresolved_columns", ", ").alias("missing"))
    return done.unionByName(out["skipped"].select("workspace_id", F.lit("skipped").alias("outcome"), F.lit("").alias("missing")))


@register("Q3_report_widths", f"""{FULL_SQL}
SELECT a.name AS "column", CAST(least(greatest(length(a.name), coalesce(max(length(s.value)), 0)) + 2, 50) AS BIGINT) AS width
FROM asked a LEFT JOIN page s ON s."column" = a.name AND s.s_no <= 10 GROUP BY a.name""")
def q3_report_widths(spark, sf_dir):
    """Q3: A9 over the final sheet."""
    return _full(spark, sf_dir)["widths"]


REQUEST = "Find the recurring fields of one document.\nFile: {name}\nInstructions: {instructions}\nColumns:\n{columns}\n\n{text}\n"


@register("X28_request_text", f"""{with_sql("docs", "report_columns")},
cols AS (SELECT string_agg('- ' || name || CASE WHEN length(coalesce(description, '')) > 0 THEN ' (Hint: ' || description || ')' ELSE '' END,
                           chr(10) ORDER BY "order") AS lines FROM report_columns),
r AS (SELECT doc_id, 'Find the recurring fields of one document.' || chr(10) || 'File: ' || PYSTRIP(name) || chr(10) || 'Instructions: '
        || CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'keep ' || workspace_id END || chr(10) || 'Columns:' || chr(10) || PYSTRIP(lines)
        || chr(10) || chr(10) || PYSTRIP(coalesce(text, '')) || chr(10) AS request FROM docs, cols)
SELECT doc_id, length(request) AS n_chars, sha256(request) AS digest FROM r""")
def x28_request_text(spark, sf_dir):
    """The request of every document: file name, trimmed instructions, column lines with hints, text."""
    asked = FX.report_columns(spark).agg(F.array_sort(F.collect_list(F.struct("order", "name", "description")))).scalar()
    said = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("  keep "), "workspace_id", F.lit(" \n")))
    d = FX.documents(spark, sf_dir).withColumn("asked", asked)
    text = RP.build_request(REQUEST, name=F.col("name"), instructions=said, columns=RP.hint_lines("asked"), text=F.col("text"))
    return d.select("doc_id", F.length(text).alias("n_chars"), F.sha2(text, 256).alias("digest"))
