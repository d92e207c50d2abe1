"""Streams into graph state. Each micro-batch is summed and written under its number, so a batch that runs again
overwrites itself; state is the merge of all batches' sums. Sums merge in any order, so late and unordered input needs
no watermark and gives the same state as one batch over everything.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import identity, merge


def into_batches(stream: DataFrame, summed: Callable[[DataFrame], DataFrame], path: str, once: bool = True):
    """Start a query that writes summed(batch) to path/batch=<number>; once: what is there now, then stop."""

    def put(batch: DataFrame, number: int) -> None:
        summed(batch).write.mode("overwrite").parquet(f"{path}/data/batch={number}")

    out = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/progress")
    return (out.trigger(availableNow=True) if once else out).start()


def batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/data").drop("batch")


def merged_properties(stream: DataFrame, path: str) -> DataFrame:
    """(tenant_id, uid, field, kind, s, n) after all writes that the stream holds now."""
    spark = stream.sparkSession
    into_batches(stream, merge.partial_properties, path).awaitTermination()
    return merge.finished(merge.merge_partials(batches(spark, path)))


def session_bounds(stream: DataFrame, path: str) -> DataFrame:
    """Sessions after all rows (key, t, created) that the stream holds now."""
    spark = stream.sparkSession
    into_batches(stream, identity.buckets, path).awaitTermination()
    return identity.session_bounds(batches(spark, path).groupBy("key", "t").agg(F.max("created").alias("created")))


def compacted(spark: SparkSession, path: str, out: str, again: Callable[[DataFrame], DataFrame]) -> None:
    """All batches' sums summed again (merge.merge_partials, or a maximum of buckets), as batch 0 of a new folder."""
    again(batches(spark, path)).write.mode("overwrite").parquet(f"{out}/data/batch=0")
