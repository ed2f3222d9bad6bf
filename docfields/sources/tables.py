"""Scans of the given parquet tables (S1/S2 build on these).

Only the columns a query selects are read: Catalyst prunes the parquet
``ReadSchema`` and pushes filters into the scan, so readers return the plain
DataFrame and callers project.
"""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

DEFAULT_SF_DIR = "/root/testdata/sf0.01"


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def spread(df: DataFrame, *keys: str, target: int | None = None) -> DataFrame:
    """Hash-partition ``df`` by ``keys`` only when it has fewer partitions than the
    session's parallelism (e.g. a single-row-group parquet file).  On large inputs the
    scan already yields many splits and this is a no-op, so no extra shuffle is added.
    Partitioning by the document key also lets later per-document windows and
    aggregations reuse it."""
    spark = df.sparkSession
    target = target or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, *keys) if keys else df.repartition(target)


def read_spread(spark: SparkSession, sf_dir: str, name: str, *keys: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, name), *keys)
