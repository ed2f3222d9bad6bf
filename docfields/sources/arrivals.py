"""Tables replayed as streams: ordered arrivals of files, and result tables that survive repeated batches."""
from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from docfields.session import ensure_checkpoint_dir

ROWS_PER_FILE = 500_000
BYTES_PER_FILE = 128 << 20


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return os.path.join(ensure_checkpoint_dir(spark), f"{tag}-{uuid.uuid4().hex}")


def _row_bytes(schema: Ty.StructType):
    """About the bytes of a row: what its texts hold, 8 for any other column."""
    texts = [F.coalesce(F.octet_length(c.name), F.lit(0)) for c in schema if isinstance(c.dataType, (Ty.StringType, Ty.BinaryType))]
    return sum(texts, F.lit(8 * (len(schema) - len(texts)))).cast("long")


def write_arrivals(df: DataFrame, order: str, key: str, path: str, arrivals: int) -> int:
    """Write ``df`` as ``arrivals`` successive groups of files, cut by equal ranges of the integer column
    ``order``.  All rows of one ``key`` of an arrival lie in one file, in order, so a stream that takes the
    files as they came sees every key in order.  A file has about ``ROWS_PER_FILE`` rows or ``BYTES_PER_FILE`` bytes at most,
    whatever comes first.  Returns the files an arrival has at most."""
    low, high = df.agg(F.min(order), F.max(order)).first()
    if low is None:
        df.write.mode("append").parquet(path)
        return 1
    edge = [low + (high + 1 - low) * i // arrivals for i in range(arrivals + 1)]
    number = sum(((F.col(order) >= e).cast("int") for e in edge[1:-1]), F.lit(0))
    # a row an arrival; by name, since a single arrival's number is a literal, which GROUP BY takes for a position
    sizes = df.select(number.alias("number"), _row_bytes(df.schema).alias("bytes")).groupBy("number").agg(
        F.count(F.lit(1)), F.sum("bytes")).collect()
    files = max(max(-(-n // ROWS_PER_FILE), -(-size // BYTES_PER_FILE)) for _, n, size in sizes)
    for a, z in zip(edge, edge[1:]):
        part = df.where((F.col(order) >= a) & (F.col(order) < z))
        part.repartition(files, key).sortWithinPartitions(key, order).write.mode("append").parquet(path)
    return files


def arrival_stream(df: DataFrame, order: str, key: str, arrivals: int, tag: str) -> DataFrame:
    """``df`` as a stream of ``arrivals`` micro-batches or a few more."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, f"arrivals-{tag}")
    files = write_arrivals(df, order, key, path, arrivals)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def batch_table(spark: SparkSession, schema: Ty.StructType, path: str) -> DataFrame:
    """All rows below ``path``, with the number of the micro-batch that wrote them."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/batch=-1")
    return spark.read.schema(Ty.StructType([*schema.fields, Ty.StructField("batch", Ty.LongType())])).parquet(path)


def latest(rows: DataFrame, keys: list[str], cols: list[str], order: str = "batch") -> DataFrame:
    """Of every key the row of the greatest ``order``."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("row")).select("row.*")


def run_batches(stream_df: DataFrame, path: str, checkpoint: str, mode: str = "update") -> DataFrame:
    """Run a stream over all that has arrived (``availableNow``).  Micro-batch n overwrites the folder
    ``batch=n``, so a batch that is repeated after a failure changes nothing.  Returns the rows with ``batch``."""
    q = (stream_df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
         .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return batch_table(stream_df.sparkSession, stream_df.schema, path)
