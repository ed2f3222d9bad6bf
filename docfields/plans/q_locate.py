"""Queries for the locate group (J1-J4, J9, X23, W8) and Q5 highlight."""
from __future__ import annotations

from pyspark.sql import functions as F

from docfields.operators import locate as L
from docfields.plans.registry import register
from docfields.session import cut_lineage
from docfields.sources import fixtures as FX
from docfields.sources.fixtures import with_sql

# DuckDB helper CTEs shared by the locate oracles.
LINES_SQL = """lines AS (
  SELECT doc_id, line_index, line,
         coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_index
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_start
  FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_index,
               unnest(string_split(text, chr(10))) AS line FROM {src}))"""

LINE_TYPE_SQL = """CASE WHEN starts_with(PYSTRIP(line), '|') THEN 'table_row'
       WHEN regexp_matches(line, '^#{1,6}[\\s\\x0B\\x{85}\\p{Z}]') THEN 'header'
       WHEN starts_with(PYSTRIP(line), '- ') OR starts_with(PYSTRIP(line), '* ') THEN 'list_item'
       WHEN starts_with(PYSTRIP(line), '>') THEN 'blockquote' ELSE 'paragraph' END"""


def _locations_sql(refs_cte: str, src: str = "documents", extra_ctes: tuple = ()) -> str:
    return f"""{with_sql(refs_cte, *extra_ctes)},
{LINES_SQL.format(src=src)},
m AS (
  SELECT l.doc_id, r.ref_id, r.ref, l.line_index, l.line, l.line_start,
         unnest([i for i in range(0, length(l.line) - length(r.ref) + 1)
                 if substring(l.line, i + 1, length(r.ref)) = r.ref]) AS pos
  FROM lines l JOIN {refs_cte} r ON contains(l.line, r.ref)
  WHERE length(r.ref) > 0 AND NOT contains(r.ref, chr(10)))
SELECT doc_id, ref_id, ref, {LINE_TYPE_SQL} AS line_type,
       line_index, line_start + pos AS char_start, line_start + pos + length(ref) AS char_end,
       pos AS line_char_start, pos + length(ref) AS line_char_end,
       substring(PYSTRIP(line), 1, 100) AS context_line
FROM m"""


@register("J1_locate", _locations_sql("refs"))
def j1_locate(spark, sf_dir):
    """J1 form (a): documents x refs (broadcast, size-checked) -> all locations."""
    return L.locate(FX.documents(spark, sf_dir), FX.refs(spark, sf_dir), strategy="broadcast")


@register("J1_locate_anchor", _locations_sql("refs"))
def j1_locate_anchor(spark, sf_dir):
    """J1 form (b): the same result through the anchor equi-join."""
    return L.locate(FX.documents(spark, sf_dir), FX.refs(spark, sf_dir), strategy="anchor")


@register("J1_locate_many", _locations_sql("refs_many"))
def j1_locate_many(spark, sf_dir):
    """J1 on the large reference list (one per document) with the anchor-token form."""
    return L.locate(FX.documents(spark, sf_dir, keyed=False), FX.refs_many(spark, sf_dir), strategy="anchor")


J1_FREQ_SQL = f"""SELECT ref_id, line_type, count(*) AS frequency FROM ({_locations_sql("refs")}) GROUP BY ref_id, line_type"""


@register("J1_frequency", J1_FREQ_SQL)
def j1_frequency(spark, sf_dir):
    """Flagship slice: where and how often each reference occurs, per line type."""
    locs = L.locate(FX.documents(spark, sf_dir), FX.refs(spark, sf_dir))
    return locs.groupBy("ref_id", "line_type").agg(F.count(F.lit(1)).alias("frequency"))


@register("X1_line_types", _locations_sql("refs", src="marked_docs", extra_ctes=("marked_docs",)))
def x1_line_types(spark, sf_dir):
    """J1 on documents whose lines carry markdown prefixes (exercises X1)."""
    return L.locate(FX.marked_documents(spark, sf_dir), FX.refs(spark, sf_dir))


J2_SQL = f"""{with_sql("refs")},
{LINES_SQL.format(src="(SELECT doc_id, lower(text) AS text FROM documents)")},
raw AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_index,
               unnest(string_split(text, chr(10))) AS raw_line FROM documents),
m AS (
  SELECT l.doc_id, r.ref_id, r.ref, lower(r.ref) AS lref, l.line_index, l.line, l.line_start,
         unnest([i for i in range(0, length(l.line) - length(r.ref) + 1)
                 if substring(l.line, i + 1, length(r.ref)) = lower(r.ref)]) AS pos
  FROM lines l JOIN refs r ON contains(l.line, lower(r.ref))
  WHERE length(r.ref) > 0 AND NOT contains(r.ref, chr(10)))
SELECT m.doc_id, ref_id, ref, 'paragraph' AS line_type, m.line_index,
       line_start + pos AS char_start, line_start + pos + length(ref) AS char_end,
       pos AS line_char_start, pos + length(ref) AS line_char_end,
       substring(raw.raw_line, 1, 100) AS context_line
FROM m JOIN raw ON raw.doc_id = m.doc_id AND raw.line_index = m.line_index"""


@register("J2_locate_ci", J2_SQL)
def j2_locate_ci(spark, sf_dir):
    """Case-insensitive locate (type paragraph, raw context)."""
    return L.locate_ci(FX.documents(spark, sf_dir), FX.refs(spark, sf_dir))


J3_SQL = f"""{with_sql("refs")},
paras AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS para_idx,
                 unnest(string_split(text, chr(10))) AS text FROM documents)
SELECT doc_id, para_idx, ref_id, ref, 'paragraph' AS line_type,
       strpos(p.text, ref) - 1 AS char_start, strpos(p.text, ref) - 1 + length(ref) AS char_end
FROM paras p JOIN refs r ON contains(p.text, r.ref)
WHERE length(r.ref) > 0 AND NOT contains(r.ref, chr(10))"""


@register("J3_locate_first", J3_SQL)
def j3_locate_first(spark, sf_dir):
    """First match per (paragraph, reference)."""
    d = FX.documents(spark, sf_dir)
    paras = d.select("doc_id", F.posexplode_outer(F.split("text", "\n", -1)).alias("para_idx", "text")).where(
        F.col("para_idx").isNotNull())
    return L.locate_first(paras, FX.refs(spark, sf_dir))


W8_SQL = f"""WITH {LINES_SQL.format(src="documents")}
SELECT doc_id, line_index, line_start, length(line) AS line_length FROM lines"""


@register("W8_line_offsets", W8_SQL)
def w8_line_offsets(spark, sf_dir):
    """Start offset and length of every line of every document."""
    lines = L.explode_lines(FX.documents(spark, sf_dir))
    return lines.select("doc_id", "line_index", "line_start", F.length("line").alias("line_length"))


TWICE_SQL = """locs AS (SELECT * FROM one UNION ALL BY NAME SELECT * REPLACE (ref_id + 1000000 AS ref_id) FROM one WHERE ref_id % 3 = 0)"""


def _refs_twice(spark, sf_dir):
    """Every third reference stands in the list twice, so that some locations are equal intervals."""
    r = FX.refs(spark, sf_dir)
    return r.unionByName(r.where(F.col("ref_id") % 3 == 0).withColumn("ref_id", F.col("ref_id") + 1000000))


J9_SQL = f"""WITH one AS ({_locations_sql("refs")}),
{TWICE_SQL},
k AS (SELECT *, max(char_end) OVER (PARTITION BY doc_id ORDER BY char_start, char_end DESC, ref_id, line_index
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_max FROM locs)
SELECT doc_id, ref_id, ref, char_start, char_end FROM k WHERE prev_max IS NULL OR prev_max < char_end"""


@register("J9_drop_contained", J9_SQL)
def j9_drop_contained(spark, sf_dir):
    """Keep locations not covered by another location of the same document."""
    locs = L.locate(FX.documents(spark, sf_dir), _refs_twice(spark, sf_dir))
    return L.drop_contained(locs).select("doc_id", "ref_id", "ref", "char_start", "char_end")


J9_STRICT_SQL = f"""WITH one AS ({_locations_sql("refs")}),
{TWICE_SQL},
k AS (SELECT *, max(char_end) OVER (PARTITION BY doc_id ORDER BY char_start, char_end DESC, ref_id, line_index
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_max,
             count(*) OVER (PARTITION BY doc_id, char_start, char_end) AS dup FROM locs)
SELECT doc_id, ref_id, ref, char_start, char_end FROM k WHERE (prev_max IS NULL OR prev_max < char_end) AND dup = 1"""


@register("J9_drop_contained_strict", J9_STRICT_SQL)
def j9_drop_contained_strict(spark, sf_dir):
    """J9 strict (D4): equal intervals remove each other, as the reference does."""
    locs = L.locate(FX.documents(spark, sf_dir), _refs_twice(spark, sf_dir))
    return L.drop_contained(locs, strict=True).select("doc_id", "ref_id", "ref", "char_start", "char_end")


@register("Q5_highlight", f"""WITH locs AS ({J2_SQL}),
k AS (SELECT *, max(char_end) OVER (PARTITION BY doc_id ORDER BY char_start, char_end DESC, ref_id, line_index
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_max FROM locs),
marks AS (SELECT doc_id, list(struct_pack(s := CAST(char_start AS BIGINT), e := CAST(char_end AS BIGINT), t := ref, acc := '') ORDER BY char_start DESC, char_end, ref) AS ms
          FROM k WHERE prev_max IS NULL OR prev_max < char_end GROUP BY ALL),
done AS (SELECT doc_id, list_reduce(list_prepend(struct_pack(s := CAST(0 AS BIGINT), e := CAST(0 AS BIGINT), t := '', acc := text), ms),
    lambda a, x: struct_pack(s := x.s, e := x.e, t := '', acc := CASE WHEN x.s >= 0 AND x.e <= length(a.acc) AND x.s < x.e
      THEN substring(a.acc, 1, x.s) || '<mark>' || x.t || '</mark>' || substring(a.acc, x.e + 1) ELSE a.acc END)).acc AS h
  FROM marks JOIN documents USING (doc_id))
SELECT doc_id, length(h) AS n_chars, sha256(h) AS digest FROM done""")
def q5_highlight(spark, sf_dir):
    """Q5: J2 -> J9 -> X23 (marked-up text per document holding a match)."""
    docs = FX.documents(spark, sf_dir)
    locs = L.locate_ci(docs, FX.refs(spark, sf_dir))
    kept = cut_lineage(L.drop_contained(locs).select("doc_id", "char_start", "char_end", "ref"))
    hl = L.highlight(docs.join(kept.select("doc_id").distinct(), "doc_id", "left_semi"), kept)
    return hl.select("doc_id", F.length("highlighted").alias("n_chars"),
                     F.sha2("highlighted", 256).alias("digest"))
