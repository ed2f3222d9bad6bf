"""Registry of named queries: a Spark callable ``(spark, sf_dir) -> DataFrame`` and,
where SQL can express it, the DuckDB oracle text over the raw tables.

Output conventions (so the oracle value-hash compares): integral columns are
BIGINT, dates and timestamps are text, lists are joined to text or exploded.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from docfields.sources.fixtures import oracle

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def finish(df: DataFrame) -> DataFrame:
    """Normalize output types: ints -> bigint, dates -> 'yyyy-MM-dd', timestamps -> text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (Ty.IntegerType, Ty.ShortType, Ty.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, Ty.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (Ty.TimestampType, Ty.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, Ty.BooleanType):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark, sf_dir):
            return finish(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return run
    return deco
