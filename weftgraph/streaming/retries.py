"""Records that fail, tried again in a stream once a fixed delay is over.

Each micro-batch has a time, which never goes back and is written before anything else, so a batch that runs again has
the time that it had. What fails in a batch is written under its number as it came, bytes and all, with one try more; it
comes again with the first batch whose time is the delay or more after that of the batch it failed in. As times never
go back, these are whole batches that follow each other: a batch notes how far they were taken, and the next goes on
from there. So a failed record is tried again once for each failure, no table of open retries is searched, and a batch
reads only what is due. A batch that runs again takes the same records and overwrites what it wrote.

There is no most number of tries. What is not due when the stream stops is pending, and due in a later run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.streaming.hits import _there

_CLOCK = "at bigint, taken bigint"


def _clock(spark: SparkSession, path: str, number: int) -> tuple[int | None, int]:
    """The time of a batch in ms, and the first batch whose failures were not taken by it or before."""
    folder = f"{path}/clock/batch={number}"
    return tuple(spark.read.schema(_CLOCK).parquet(folder).first()) if _there(spark, folder) else (None, 0)


def _ticked(batch: DataFrame, number: int, path: str, delay_ms: int, now: Column) -> tuple[int, int, int]:
    """(time of the batch, first batch whose failures it takes, first that it does not take), the same when it runs again."""
    spark = batch.sparkSession
    before, first = _clock(spark, path, number - 1)
    folder = f"{path}/clock/batch={number}"
    if not _there(spark, folder):
        at = batch.agg(F.max(now)).first()[0]
        at = max((x for x in (at, before) if x is not None), default=None)
        taken = first
        while at is not None and taken < number and (failed := _clock(spark, path, taken)[0]) is not None and failed + delay_ms <= at:
            taken += 1
        spark.createDataFrame([(at, taken)], _CLOCK).coalesce(1).write.mode("overwrite").parquet(folder)
    at, taken = _clock(spark, path, number)
    return at, first, taken


def step(batch: DataFrame, number: int, handle: Callable[[DataFrame], DataFrame], path: str, delay_ms: int, now: Column) -> None:
    """Try the batch's records, and those that are due again; see run."""
    spark = batch.sparkSession
    at, first, taken = _ticked(batch, number, path, delay_ms, now)
    rows = batch.withColumn("retry_count", F.lit(0))
    if first < taken:
        rows = rows.unionByName(spark.read.schema(rows.schema).parquet(*[f"{path}/failed/batch={i}" for i in range(first, taken)]))
    done = f"{path}/tried/batch={number}"
    handle(rows).withColumn("tried_ms", F.lit(at).cast("bigint")).write.mode("overwrite").parquet(done)
    failed = spark.read.parquet(done).where("error is not null").select(*[c for c in rows.columns if c != "retry_count"], (F.col("retry_count") + 1).alias("retry_count"))
    failed.write.mode("overwrite").parquet(f"{path}/failed/batch={number}")


def run(records: DataFrame, handle: Callable[[DataFrame], DataFrame], path: str, delay_ms: int, now: Column | None = None, once: bool = True):
    """Start a query that tries records, and those that failed again after delay_ms; once: what is there now, then stop.

    handle: rows with retry_count to the same rows with error (string, null where the record is done). now: a record's
    time in ms, whose maximum is its batch's; the clock's, unless given.
    """
    if delay_ms <= 0:
        raise ValueError("the delay must be above 0")
    now = F.unix_millis(F.current_timestamp()) if now is None else now
    out = records.writeStream.foreachBatch(lambda batch, number: step(batch, number, handle, path, delay_ms, now)).option("checkpointLocation", f"{path}/progress")
    return (out.trigger(availableNow=True) if once else out).start()


def tried(spark: SparkSession, path: str) -> DataFrame:
    """All tries: the records' columns, retry_count, error, tried_ms, batch."""
    return spark.read.option("basePath", f"{path}/tried").parquet(f"{path}/tried/batch=*")


def pending(spark: SparkSession, path: str, number: int) -> DataFrame:
    """Records that failed up to a batch and were not tried again by it."""
    taken = _clock(spark, path, number)[1]
    return spark.read.parquet(*[f"{path}/failed/batch={i}" for i in range(taken, number + 1)])
