"""Corpus pipeline: quality rules, SimHash near-dedup, suffix-array dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``.  ``run`` writes each stage to the shared folder and hands the reread table on.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.llm.common import read, write_table
from docfields.llm.mixing import mix_documents
from docfields.llm.packing import pack_documents
from docfields.llm.quality import keep_quality
from docfields.llm.simhash import keep_representatives
from docfields.llm.suffix_dedup import remove_repeated_bytes


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the likelihood ratio go."""
    return keep_quality(docs, read(spark, sf_dir, "labels"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays."""
    return keep_representatives(docs, shingle=4, budget=4)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by a repeated 400-byte string go; n_chars follows."""
    out = remove_repeated_bytes(docs, 400)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in out.columns else out


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document appears as often as its rate says."""
    return mix_documents(docs, read(spark, sf_dir, "labels"), MIX)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a packed sequence."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048)


#: Target shares of the tokens: what the quality rules left of the low domain goes.
MIX = {"clean": 0.95, "low": 0.0, "toxic": 0.05}

STAGES = [("quality_rules", quality_rules), ("simhash_dedup", simhash_dedup),
          ("suffix_array_dedup", suffix_array_dedup), ("mixing", mixing), ("packing", packing)]

#: The likelihood ratio, the tokenizer and the fingerprints have no SQL form; tests/llm checks the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
