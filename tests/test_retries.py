"""Retries of a stream: delays, replayed batches, what is pending."""

import pytest
from pyspark.sql import functions as F

from weftgraph.streaming import retries


def _handle(rows):
    """Records named bad fail always, those named once fail once."""
    bad = (F.col("kind") == "bad") | ((F.col("kind") == "once") & (F.col("retry_count") == 0))
    return rows.withColumn("error", F.when(bad, F.concat(F.lit("no "), "kind")))


BATCHES = [[(1, 10, "ok"), (2, 12, "once")], [(3, 15, "bad")], [(4, 22, "ok")], [], [(5, 21, "once")], [(6, 40, "ok")]]


def _run(spark, path, again=()):
    for number, rows in enumerate(BATCHES):
        df = spark.createDataFrame(rows, "id int, t bigint, kind string").withColumn("raw", F.encode(F.lit("\x00ÿ"), "UTF-8"))
        for _ in range(2 if number in again else 1):
            retries.step(df, number, _handle, path, 10, F.col("t"))
    return sorted((r.id, r.retry_count, r.tried_ms, r.error, r.batch) for r in retries.tried(spark, path).collect())


WANT = [(1, 0, 12, None, 0), (2, 0, 12, "no once", 0), (2, 1, 22, None, 2), (3, 0, 15, "no bad", 1), (3, 1, 40, "no bad", 5), (4, 0, 22, None, 2), (5, 0, 22, "no once", 4), (5, 1, 40, None, 5), (6, 0, 40, None, 5)]


@pytest.mark.parametrize("again", [(), range(6)])
def test_failed_records_come_again_after_the_delay(spark, tmp_path, again):
    """Also where every batch runs twice, time stands still, or a batch is empty."""
    assert _run(spark, str(tmp_path), again) == WANT
    left = retries.pending(spark, str(tmp_path), 5).collect()
    assert [(r.id, r.retry_count, bytes(r.raw)) for r in left] == [(3, 2, "\x00ÿ".encode())]


def test_a_driver_lost_after_the_clock_was_written(spark, tmp_path):
    """The batch that runs again keeps its time and takes what it took."""
    path = str(tmp_path)
    rows = spark.createDataFrame([(1, 10, "once")], "id int, t bigint, kind string")
    retries.step(rows, 0, _handle, path, 10, F.col("t"))
    later = spark.createDataFrame([(2, 20, "ok")], "id int, t bigint, kind string")

    def lost(_):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        retries.step(later, 1, lost, path, 10, F.col("t"))
    retries.step(later, 1, _handle, path, 10, F.lit(99).cast("bigint"))
    assert sorted((r.id, r.retry_count, r.tried_ms) for r in retries.tried(spark, path).collect()) == [(1, 0, 10), (1, 1, 20), (2, 0, 20)]


def test_no_delay(spark, tmp_path):
    with pytest.raises(ValueError):
        retries.run(spark.range(1), _handle, str(tmp_path), 0)
