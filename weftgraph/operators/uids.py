"""A persistent dictionary of keys to uids: dense numbers from 1 on, no two keys with one, each key's for ever.

A run finds its new keys by an anti-join with the dictionary, deals them into buckets by a hash, numbers them within
their bucket and adds what the buckets before hold: a prefix sum over counts, a row a bucket. The numbers depend on the
keys alone, not on how rows are split over tasks. They count once the run's version is committed (sources.versions): a
run that stops before leaves no trace, and one that is repeated after finds no new keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.session import written
from weftgraph.sources.versions import Manifest, Versions

BUCKET_ROWS = 1_000_000
_TABLE, _PART = "uids", "all"
_SCHEMA = "key string, uid bigint"


def _of(store: Versions, version: Manifest) -> DataFrame:
    folders = version.folders(_TABLE)
    return store.spark.read.schema(_SCHEMA).parquet(*map(store.full, folders)) if folders else store.spark.createDataFrame([], _SCHEMA)


def dictionary(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(key, uid) of all keys of a version, the latest unless given."""
    store = Versions(spark, path)
    return _of(store, store.at(version))


def numbered(keys: DataFrame, n: int, after: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(key, uid): n different keys with the numbers from after + 1 on."""
    buckets = 1 + n // bucket_rows
    dealt = keys.select("key", F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"))
    before = F.sum("count").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    # A row a bucket, of a million keys each.
    starts = dealt.groupBy("bucket").count().select("bucket", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("key"))
    return dealt.withColumn("place", place).join(starts, "bucket").select("key", (F.lit(after) + F.col("before") + F.col("place")).cast("bigint").alias("uid"))


def extend(keys: DataFrame, path: str, bucket_rows: int = BUCKET_ROWS) -> int:
    """Add the keys (key) that the dictionary below `path` has not; the number of the version that has them all. Null keys go."""
    store = Versions(keys.sparkSession, path)
    base = store.latest()
    new = keys.select(F.col("key").cast("string").alias("key")).where("key is not null").distinct()
    new = written(new.join(_of(store, base).select("key"), "key", "left_anti"), "new-keys")
    n = new.count()
    if not n:
        return base.number
    last = int(base.facts.get("last", 0))
    folder = store.folder(_TABLE)
    numbered(new, n, last, bucket_rows).write.parquet(store.full(folder))
    return store.commit(base, {_TABLE: {_PART: [*base.folders(_TABLE), folder]}}, {"last": last + n}).number


def compact(spark: SparkSession, path: str) -> int:
    """The same dictionary in one folder, as a new version."""
    store = Versions(spark, path)
    base = store.latest()
    if len(base.folders(_TABLE)) < 2:
        return base.number
    folder = store.folder(_TABLE)
    _of(store, base).repartitionByRange("key").sortWithinPartitions("key").write.parquet(store.full(folder))
    return store.commit(base, {_TABLE: {_PART: [folder]}}, base.facts).number


def with_uids(rows: DataFrame, key: str, path: str, version: int | None = None) -> DataFrame:
    """rows with the uid of their key; null where the dictionary has none."""
    own = dictionary(rows.sparkSession, path, version).select(F.col("key").alias(key), "uid")
    return rows.join(own, key, "left")
