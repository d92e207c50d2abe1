"""Snapshots of a work queue and of registry logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VISIBILITY_MS = 10_000


def next_visible(queue: DataFrame, now: Column) -> DataFrame:
    """The oldest enqueued, visible row of each plugin, as the next reader would get it; a pre-aggregated minimum."""
    open_ = queue.where((F.col("status") == "enqueued") & (F.col("visible_after") <= now))
    rest = [c for c in queue.columns if c not in ("plugin_id", "creation_time", "execution_key")]
    least = open_.groupBy("plugin_id").agg(F.min(F.struct("creation_time", "execution_key", *rest)).alias("r")).select("plugin_id", "r.*")
    return least.withColumn("try_count", F.col("try_count") + 1).withColumn("visible_after", now + VISIBILITY_MS)


def acknowledged(queue: DataFrame, acks: DataFrame, now: Column) -> DataFrame:
    """queue with the statuses of acks (execution_key, new_status); a processed row keeps its last_updated."""
    merged = queue.join(acks, "execution_key", "left")
    updated = F.when(F.col("new_status").isNull() | (F.col("status") == "processed"), F.col("last_updated")).otherwise(now)
    return merged.withColumn("last_updated", updated).withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def depth(queue: DataFrame) -> DataFrame:
    """(plugin_id, event_source_id, n) of enqueued rows."""
    return queue.where("status = 'enqueued'").groupBy("plugin_id", "event_source_id").agg(F.count("*").alias("n"))


def dominant_source(queue: DataFrame) -> DataFrame:
    """(plugin_id, n, dominant): enqueued rows and their most frequent source, the least of several."""
    by = depth(queue)
    return by.groupBy("plugin_id").agg(F.sum("n").alias("n"), F.min(F.struct((-F.col("n")).alias("m"), "event_source_id"))["event_source_id"].alias("dominant"))


def latest_deployment(log: DataFrame) -> DataFrame:
    """The newest row of each plugin in an append-only log (id, plugin_id, ...)."""
    rest = [c for c in log.columns if c != "plugin_id"]
    return log.groupBy("plugin_id").agg(F.max_by(F.struct(*rest), "id").alias("r")).select("plugin_id", "r.*")


def plugins_where(registry: DataFrame, tenant: str | None = None, event_source: str | None = None, plugin: str | None = None) -> DataFrame:
    """Registry rows of a tenant, of an event source, or of one plugin; any of them left out asks for all."""
    for name, value in (("tenant_id", tenant), ("event_source_id", event_source), ("plugin_id", plugin)):
        if value is not None:
            registry = registry.where(F.col(name) == value)
    return registry
