"""Queries for scalar functions (X*, S4, P8) over the given tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from docfields.functions import text as T
from docfields.plans.registry import register
from docfields.sources import fixtures as FX
from docfields.sources.tables import read_spread, read_table
from docfields.sources.fixtures import with_sql


def _docs(spark, sf_dir):
    return FX.documents(spark, sf_dir)


def _digest(c):
    return F.sha2(c, 256)


# ---------------------------------------------------------------- S4 markdown clean-up
S4_INPUT = "text || chr(10) || chr(10) || chr(10) || '![logo](img/a.png) tail' || chr(10) || chr(10) || chr(10) || chr(10) || ' end  '"


@register("S4_clean_markdown", f"""
SELECT doc_id, length(c) AS n_chars, sha256(c) AS digest FROM (
  SELECT doc_id, PYSTRIP(regexp_replace(regexp_replace({S4_INPUT}, '!\\[[^\\]]*]\\([^)]*\\)', '', 'g'),
                                        '\\n{{3,}}', chr(10) || chr(10), 'g')) AS c
  FROM documents)""")
def s4_clean_markdown(spark, sf_dir):
    """Drop image links, squeeze blank lines, strip -- on text with injected markup."""
    d = read_spread(spark, sf_dir, "documents", "doc_id")
    inp = F.concat(F.col("text"), F.lit("\n\n\n![logo](img/a.png) tail\n\n\n\n end  "))
    c = T.clean_markdown(inp)
    return d.select("doc_id", F.length(c).alias("n_chars"), _digest(c).alias("digest"))


# ---------------------------------------------------------------- X2 / X3 / X4 / X5 / X6
X2_INPUT = "'“' || text || '” — ‘a’ – …' || chr(160) || 'x'"


@register("X2_fold_punctuation", f"""
SELECT doc_id, translate({X2_INPUT}, '“”‘’–—' || chr(160) || '…', '""''''--' || ' ' || '.') AS folded FROM documents""")
def x2_fold(spark, sf_dir):
    """Curly quotes, dashes, no-break space, ellipsis folded to ASCII."""
    d = read_table(spark, sf_dir, "documents")
    inp = F.concat(F.lit("“"), F.col("text"), F.lit("” — ‘a’ – … x"))
    return d.select("doc_id", T.fold_punctuation(inp).alias("folded"))


@register("X3_normalize_key", """
SELECT p_partkey, translate(lower(p_name), ' -', '__') AS key,
       regexp_replace(lower(p_name || '  new' || chr(9) || 'Field'), '\\s+', '_', 'g') AS new_key
FROM part""")
def x3_normalize_key(spark, sf_dir):
    """Key normalization and the create-field form."""
    p = read_table(spark, sf_dir, "part")
    return p.select("p_partkey", T.normalize_key("p_name").alias("key"),
                    T.new_field_key(F.concat("p_name", F.lit("  new\tField"))).alias("new_key"))


INITCAP_SQL = "array_to_string(list_transform(string_split(lower({0}), ' '), lambda w: upper(substring(w, 1, 1)) || substring(w, 2)), ' ')"


@register("X4_label_from_key", f"""
SELECT p_partkey, {INITCAP_SQL.format("replace(translate(lower(p_name), ' -', '__'), '_', ' ')")} AS label,
       replace(translate(lower(p_name), ' -', '__'), '_', ' ') AS display
FROM part""")
def x4_label_from_key(spark, sf_dir):
    """Label from key (initcap, D8) and the display form."""
    p = read_table(spark, sf_dir, "part")
    key = T.normalize_key("p_name")
    return p.select("p_partkey", T.label_from_key(key).alias("label"), T.display_key(key).alias("display"))


@register("X5_safe_filename", """
SELECT p_partkey, regexp_replace(p_name || ' é/ü(1).docx', '[^\\p{L}\\p{N}._-]', '_', 'g') AS safe_name FROM part""")
def x5_safe_filename(spark, sf_dir):
    """File-name sanitizing (Unicode letters and digits stay)."""
    p = read_table(spark, sf_dir, "part")
    return p.select("p_partkey", T.safe_filename(F.concat("p_name", F.lit(" é/ü(1).docx"))).alias("safe_name"))


@register("X6_storage_path", f"""{with_sql("docs", "workspaces")}
SELECT d.doc_id,
       concat_ws('/', w.user_id, d.workspace_id, CAST(d.doc_id AS VARCHAR), regexp_replace(d.name, '[^\\p{{L}}\\p{{N}}._-]', '_', 'g')) AS path,
       concat_ws('/', w.user_id, d.workspace_id, CAST(d.doc_id AS VARCHAR), regexp_replace(d.name, '[^\\p{{L}}\\p{{N}}._-]', '_', 'g')) || '_template' AS template_path
FROM docs d JOIN workspaces w ON d.workspace_id = w.workspace_id""")
def x6_storage_path(spark, sf_dir):
    """Storage path and the template variant (first segment reused)."""
    d = _docs(spark, sf_dir)
    w = FX.workspaces(spark, sf_dir)
    j = d.join(w.select("workspace_id", "user_id"), "workspace_id")
    path = T.storage_path("user_id", "workspace_id", "doc_id", "name")
    return j.select("doc_id", path.alias("path"),
                    T.template_path(path, "workspace_id", "doc_id", "name").alias("template_path"))


X7_INPUT = "CASE WHEN page_id % 2 = 0 THEN 'https://x/folders/' || CAST(page_id AS VARCHAR) || '?u=' || url ELSE '  ' || url || ' ' END"


@register("X7_folder_id", f"""
SELECT page_id, CASE WHEN regexp_extract({X7_INPUT}, 'folders/([a-zA-Z0-9_-]+)', 1) <> ''
                     THEN regexp_extract({X7_INPUT}, 'folders/([a-zA-Z0-9_-]+)', 1)
                     ELSE PYSTRIP({X7_INPUT}) END AS folder_id
FROM pages""")
def x7_folder_id(spark, sf_dir):
    """Folder id after 'folders/', else the stripped input."""
    p = read_table(spark, sf_dir, "pages")
    inp = F.when(F.col("page_id") % 2 == 0,
                 F.concat(F.lit("https://x/folders/"), F.col("page_id").cast("string"), F.lit("?u="), F.col("url"))
                 ).otherwise(F.concat(F.lit("  "), F.col("url"), F.lit(" ")))
    return p.select("page_id", T.folder_id(inp).alias("folder_id"))


@register("X8_token_estimate", """
SELECT conv_id, turn, length(text) // 4 + 1 AS tokens FROM conversations""")
def x8_token_estimate(spark, sf_dir):
    """Fallback token estimate per message."""
    c = read_table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", T.token_estimate("text").alias("tokens"))


def bpe_counter():
    """A caller's tokenizer: byte-level BPE of a public vocabulary file."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda texts: [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


@register("X8_token_count")
def x8_token_count(spark, sf_dir):
    """X8 with a caller's tokenizer: tokens of every message."""
    c = read_spread(spark, sf_dir, "conversations", "conv_id")
    return c.select("conv_id", "turn", T.token_count("text", bpe_counter).alias("tokens"),
                    T.token_estimate("text").alias("estimate"))


KW_SQL = """kw AS (
  SELECT doc_id, tok, min(p) AS p FROM (
    SELECT doc_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS p
    FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-zA-Z0-9_]+') AS toks FROM documents))
  WHERE length(tok) > 2 GROUP BY doc_id, tok)"""


@register("X12_keyword_tokens", f"""WITH {KW_SQL}
SELECT d.doc_id, coalesce(n, 0) AS n_keywords, coalesce(keywords, '') AS keywords
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(tok, ' ' ORDER BY p) AS keywords
                            FROM kw GROUP BY doc_id) k ON d.doc_id = k.doc_id""")
def x12_keyword_tokens(spark, sf_dir):
    """Distinct keyword tokens per document, in first-seen order."""
    d = read_spread(spark, sf_dir, "documents", "doc_id")
    k = T.keyword_tokens("text")
    return d.select("doc_id", F.size(k).cast("bigint").alias("n_keywords"), F.array_join(k, " ").alias("keywords"))


@register("X13_normalize_name", """
SELECT conv_id, turn, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS norm FROM conversations""")
def x13_normalize_name(spark, sf_dir):
    """Lower, non-alphanumerics to single spaces, trimmed."""
    c = read_table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", T.normalize_name("text").alias("norm"))


X14_INPUT = "CASE WHEN event_id % 4 = 0 THEN 'no json here' ELSE 'Answer: ' || props || chr(10) || ' done.' END"


@register("X14_json_object", f"""
SELECT event_id, json_extract_string(j, '$.k') AS k FROM (
  SELECT event_id, nullif(regexp_extract({X14_INPUT}, '(?s)\\{{.*\\}}', 0), '') AS j FROM events)""")
def x14_json_object(spark, sf_dir):
    """JSON object cut from free text (first '{' to last '}'), then parsed."""
    e = read_table(spark, sf_dir, "events")
    inp = F.when(F.col("event_id") % 4 == 0, F.lit("no json here")).otherwise(
        F.concat(F.lit("Answer: "), F.col("props"), F.lit("\n done.")))
    j = T.json_object_text(inp)
    return e.select("event_id", F.from_json(j, "map<string,string>")["k"].alias("k"))


@register("X15_report_date", f"""{with_sql("orders_ws")}
SELECT workspace_id,
       CASE WHEN coalesce(CAST(event_date AS VARCHAR), CAST(created_at AS VARCHAR)) IS NULL THEN ''
            WHEN length(coalesce(CAST(event_date AS VARCHAR), CAST(created_at AS VARCHAR))) = 10
                 THEN coalesce(CAST(event_date AS VARCHAR), CAST(created_at AS VARCHAR))
            ELSE substring(coalesce(CAST(event_date AS VARCHAR), CAST(created_at AS VARCHAR)), 1, 10) END AS event_date_text,
       CASE WHEN event_date IS NULL THEN '' ELSE strftime(event_date, '%d-%m-%Y') END AS display_date
FROM orders_ws""")
def x15_report_date(spark, sf_dir):
    """X15 report date text and X16 dd-mm-yyyy display form."""
    o = FX.orders_ws(spark, sf_dir)
    return o.select("workspace_id", T.report_date("event_date", "created_at").alias("event_date_text"),
                    F.coalesce(F.date_format("event_date", "dd-MM-yyyy"), F.lit("")).alias("display_date"))


@register("X16_labels", f"""{with_sql("workspaces")}
SELECT workspace_id,
       'Consolidated Report: ' || {INITCAP_SQL.format("CAST(CAST(created_at AS DATE) AS VARCHAR) || '_to_' || CAST(coalesce(event_date, CAST(created_at AS DATE)) AS VARCHAR)")} AS title,
       'Report_' || CAST(CAST(created_at AS DATE) AS VARCHAR) || '_to_' || CAST(coalesce(event_date, CAST(created_at AS DATE)) AS VARCHAR)
         || '_' || strftime(created_at, '%Y%m%d') || '.xlsx' AS file_name
FROM workspaces""")
def x16_labels(spark, sf_dir):
    """Report title (range title-cased) and file name with run date."""
    w = FX.workspaces(spark, sf_dir)
    rng = F.concat(F.to_date("created_at").cast("string"), F.lit("_to_"),
                   F.coalesce("event_date", F.to_date("created_at")).cast("string"))
    return w.select(
        "workspace_id",
        F.concat(F.lit("Consolidated Report: "), F.initcap(rng)).alias("title"),
        F.concat(F.lit("Report_"), rng, F.lit("_"), F.date_format("created_at", "yyyyMMdd"), F.lit(".xlsx")).alias("file_name"),
    )


@register("X17_shorten", """
SELECT doc_id,
       CASE WHEN length(text) > 220 THEN substring(text, 1, 220) || '...' ELSE text END AS hint,
       CASE WHEN length(name) > 25 THEN substring(name, 1, 25) || '...' ELSE name END AS short_name
FROM (SELECT doc_id, text, 'document_' || CAST(doc_id AS VARCHAR) || '_' || source || '_final.docx' AS name FROM documents)""")
def x17_shorten(spark, sf_dir):
    """Cut to 220 (+...) and 25 (+...)."""
    d = read_table(spark, sf_dir, "documents")
    name = F.concat(F.lit("document_"), F.col("doc_id").cast("string"), F.lit("_"), F.col("source"), F.lit("_final.docx"))
    return d.select("doc_id", T.shorten("text", 220).alias("hint"), T.shorten(name, 25).alias("short_name"))


@register("X18_head_tail", """
SELECT doc_id, length(c) AS n_chars, sha256(c) AS digest FROM (
  SELECT doc_id, CASE WHEN length(text) <= 8000 THEN text
                      ELSE substring(text, 1, 4000) || chr(10) || chr(10) || '[...truncated for context window...]'
                           || chr(10) || chr(10) || substring(text, length(text) - 3999, 4000) END AS c
  FROM documents)""")
def x18_head_tail(spark, sf_dir):
    """Head and tail of long texts around a marker (no-keyword question)."""
    d = read_spread(spark, sf_dir, "documents", "doc_id")
    c = T.head_tail("text", 8000)
    return d.select("doc_id", F.length(c).alias("n_chars"), _digest(c).alias("digest"))


@register("X19_chunks", """
SELECT doc_id, chunk_idx, s AS chunk_start, length(substring(text, s + 1, 1800)) AS chunk_len,
       sha256(substring(text, s + 1, 1800)) AS digest
FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 1800, 0) + 1, 1550)) AS s,
             generate_subscripts(range(0, greatest(length(text) - 1800, 0) + 1, 1550), 1) - 1 AS chunk_idx
      FROM documents WHERE length(text) > 0
      UNION ALL
      SELECT doc_id, text, s, chunk_idx FROM (
        SELECT doc_id, text, greatest(length(text) - 1800, 0) AS rest,
               (CAST(ceil((length(text) - 1800) / 1550.0) AS BIGINT)) * 1550 AS s,
               CAST(ceil((length(text) - 1800) / 1550.0) AS BIGINT) AS chunk_idx FROM documents)
      WHERE rest > 0 AND rest % 1550 <> 0)""")
def x19_chunks(spark, sf_dir):
    """Overlapping chunks (1800 / 250) of every document."""
    d = read_spread(spark, sf_dir, "documents", "doc_id")
    ex = d.select("doc_id", "text", F.posexplode(T.chunk_starts(F.length("text"))).alias("chunk_idx", "s"))
    ch = F.substring("text", F.col("s") + 1, 1800)
    return ex.select("doc_id", "chunk_idx", F.col("s").alias("chunk_start"), F.length(ch).alias("chunk_len"),
                     _digest(ch).alias("digest"))


REPL_SQL = "replace(replace(replace(text, 'the', 'THE'), 'THE re', 'there'), 'and', '')"


@register("X20_replace_all", f"""
SELECT doc_id, length(c) AS n_chars, sha256(c) AS digest FROM (SELECT doc_id, {REPL_SQL} AS c FROM documents)""")
def x20_replace_all(spark, sf_dir):
    """Ordered replacement pairs, each applied to the result of the last."""
    d = read_spread(spark, sf_dir, "documents", "doc_id")
    from docfields.operators.edits import attach_pairs

    j = attach_pairs(d, FX.replacements(spark))
    c = T.replace_all("text", "pairs")
    return j.select("doc_id", F.length(c).alias("n_chars"), _digest(c).alias("digest"))


@register("X21_replace_ci", """
SELECT doc_id, length(c) AS n_chars, sha256(c) AS digest
FROM (SELECT doc_id, regexp_replace(text, '(?i)the', 'ThE$', 'g') AS c FROM documents)""")
def x21_replace_ci(spark, sf_dir):
    """Case-insensitive, non-overlapping replacement ('the' -> 'ThE$')."""
    d = read_spread(spark, sf_dir, "documents", "doc_id")
    c = T.replace_ci("text", F.lit("the"), F.lit("ThE$"))
    return d.select("doc_id", F.length(c).alias("n_chars"), _digest(c).alias("digest"))


@register("X26_html_escape", """
SELECT conv_id, turn, replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped
FROM (SELECT conv_id, turn, '<b>' || text || ' & </b>' AS t FROM conversations)""")
def x26_html_escape(spark, sf_dir):
    """HTML escape of '&', '<', '>' in that order."""
    c = read_table(spark, sf_dir, "conversations")
    t = F.concat(F.lit("<b>"), F.col("text"), F.lit(" & </b>"))
    return c.select("conv_id", "turn", T.html_escape(t).alias("escaped"))


@register("X29_cell_text", f"""{with_sql("cells")}
SELECT doc_id, table_index, row, col, display FROM cells""")
def x29_cell_text(spark, sf_dir):
    """Cell text = stripped non-blank paragraphs joined by newline."""
    c = FX.cells(spark, sf_dir)
    return c.select("doc_id", "table_index", "row", "col", T.cell_text("paras").alias("display"))


X30_INPUT = """CASE WHEN event_id % 3 = 0 THEN '"plain ' || event_type || '"'
     WHEN event_id % 3 = 1 THEN '["a-", {"text": "' || event_type || '"}, {"content": "c"}, 7, {"text": 5, "content": "n"}]'
     ELSE '[{"content": "' || event_type || '"}, "-z"]' END"""


@register("X30_multipart_text", f"""
SELECT event_id,
  CASE WHEN json_type(CAST(j AS JSON)) = 'ARRAY' THEN
       array_to_string(list_filter(list_transform(CAST(j AS JSON[]), lambda x:
           CASE WHEN json_type(x) = 'VARCHAR' THEN x ->> '$'
                WHEN json_type(x) = 'OBJECT' THEN
                     CASE WHEN json_type(x, '$.text') = 'VARCHAR' THEN x ->> '$.text'
                          WHEN json_type(x, '$.content') = 'VARCHAR' THEN x ->> '$.content' END END),
           lambda s: s IS NOT NULL), '')
       WHEN json_type(CAST(j AS JSON)) = 'VARCHAR' THEN CAST(j AS JSON) ->> '$'
       ELSE '' END AS content
FROM (SELECT event_id, {X30_INPUT} AS j FROM events)""")
def x30_multipart_text(spark, sf_dir):
    """Multi-part message content to text."""
    e = read_table(spark, sf_dir, "events")
    et = F.col("event_type")
    j = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('"plain '), et, F.lit('"'))) \
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit('["a-", {"text": "'), et,
                                                   F.lit('"}, {"content": "c"}, 7, {"text": 5, "content": "n"}]'))) \
        .otherwise(F.concat(F.lit('[{"content": "'), et, F.lit('"}, "-z"]')))
    return e.select("event_id", T.multipart_text(j).alias("content"))


P8_INPUT = """text || CASE WHEN turn % 3 = 0 THEN ' @' || role WHEN turn % 3 = 1 THEN ' x@y' ELSE '' END"""


@register("P8_mention_query", f"""
SELECT conv_id, turn,
       CASE WHEN regexp_matches({P8_INPUT}, '(?:^|\\s)@([^\\s@]*)$') THEN regexp_extract({P8_INPUT}, '(?:^|\\s)@([^\\s@]*)$', 1) END AS mention,
       ltrim(regexp_replace(regexp_replace({P8_INPUT}, '(?:^|\\s)@([^\\s@]*)$', ' '), '\\s+', ' ', 'g')) AS stripped
FROM conversations""")
def p8_mention_query(spark, sf_dir):
    """Trailing '@' mention query, and the text with the mention removed."""
    c = read_table(spark, sf_dir, "conversations")
    inp = F.concat(F.col("text"), F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" @"), F.col("role")))
                   .when(F.col("turn") % 3 == 1, F.lit(" x@y")).otherwise(F.lit("")))
    return c.select("conv_id", "turn", T.mention_query(inp).alias("mention"), T.strip_mention(inp).alias("stripped"))
