"""Mergeable counts of a stream of rows: histograms and presence counters that grow with every batch.

Every batch's counts lie under the batch's own number and are written over if the
batch comes again, so a restart counts nothing twice. What a batch writes has a row
for each key, however many rows came.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Counts of some rows: keys and sums that may be added up.
Counts = Callable[[DataFrame], DataFrame]


def write_batch(counts: Counts, path: str) -> Callable[[DataFrame, int], None]:
    """What a stream does with each batch: its counts, in place of any that the batch left before."""

    def write(rows: DataFrame, batch: int) -> None:
        counted = counts(rows).withColumn("batch", F.lit(batch).cast("bigint"))
        counted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return write


def count_stream(rows: DataFrame, counts: Counts, path: str, checkpoint: str) -> StreamingQuery:
    """Start counting what has come to the stream ``rows`` since ``checkpoint``; the query ends when all of it is counted."""
    return rows.writeStream.foreachBatch(write_batch(counts, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """``keys`` and the sums of all other columns over the batches so far."""
    table = spark.read.parquet(path)
    return table.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in table.columns if c not in (*keys, "batch")])


def compact(spark: SparkSession, path: str, keys: list[str], to: str) -> None:
    """Write the sums of all batches so far as one table at ``to``, which ``merged`` reads like any other."""
    merged(spark, path, keys).withColumn("batch", F.lit(-1).cast("bigint")).write.partitionBy("batch").parquet(to)
