"""Registered queries of the operators: ``QUERIES`` and, where SQL can express one, ``ORACLES``."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docfields.llm.common import read
from docfields.llm.embedding_dedup import embedding_links
from docfields.llm.fim import fim_digest
from docfields.llm.mixing import mixing_table
from docfields.llm.packing import pack_documents
from docfields.llm.quality import quality_verdicts
from docfields.llm.simhash import simhash_components
from docfields.llm.substring_dedup import substring_digest
from docfields.llm.suffix_dedup import suffix_digest
from docfields.llm.suffix_tree import lm_scores
from docfields.llm.token_ids import token_id_digest
from docfields.llm.toxicity import toxicity_scores
from docfields.llm.warc import warc_round_trip
from docfields.llm.whitening import whitened_components


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_id_digest(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digest(read(spark, sf_dir, "documents"), 35)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2048)


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    out = simhash_components(read(spark, sf_dir, "documents"), shingle=4, budget=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(read(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_verdicts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", "score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_digest(read(spark, sf_dir, "documents"), 400)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_table(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(read(spark, sf_dir, "embeddings"), threshold=0.98)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_digest(read(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_components(read(spark, sf_dir, "embeddings"), 8)


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_token_ids, op2_substring_dedup, op3_packing, op4_simhash_dedup, op5_warc, op6_quality_rules, op7_toxicity,
    op8_suffix_dedup, op9_mixing, op10_embedding_dedup, op11_fill_in_middle, op12_whitening, op13_lm_scoring)}

ORACLES = {
    "op2_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS body
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
rep AS (SELECT doc_id, i FROM win WHERE body IN (SELECT body FROM win GROUP BY body HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM rep, range(0, 35) t(o)),
word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS body, count(*) AS n
         FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(body, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""",
    "op5_warc": """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
                  sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS low FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> low THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> low THEN low END AS refers_to, CAST(NULL AS VARCHAR) AS error
FROM f
""",
    "op11_fill_in_middle": r"""
WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS us,
                  sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (SELECT *, CAST(len(us) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(us) + 1) AS c1,
             CAST('0x' || h[9:16] AS BIGINT) % (len(us) + 1) AS c2, CAST('0x' || h[25:32] AS BIGINT) % 100 AS o FROM u),
f AS (SELECT doc_id, n, t, CASE WHEN t = '' OR regexp_matches(t, '<P>|<S>|<M>') THEN 'plain' WHEN o < 50 THEN 'spm' ELSE 'psm' END AS form,
             array_to_string(us[1:least(c1, c2)], '') AS p, array_to_string(us[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
             array_to_string(us[greatest(c1, c2) + 1:], '') AS s FROM d)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM f
""",
}
