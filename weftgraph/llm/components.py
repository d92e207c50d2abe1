"""Connected components of a graph of ids, as rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import shared


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest id reachable, for every node of edges (a, b).

    Each round every node takes the least label around it, then its label's own label, so paths halve. Rounds are
    written to the shared folder; the driver only learns whether anything changed.
    """
    both = edges.select("a", "b").where("a <> b").union(edges.select("b", "a").where("a <> b")).distinct()
    both = shared.written(both, "cc-edges")
    rows = both.count()
    labels = shared.written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "cc-labels", rows)
    while True:
        around = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(around, "node").select("node", F.least("component", "near").alias("via"), F.col("component").alias("old"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("far"))
        new = lower.join(jump, "via", "left").select("node", F.least("via", "far").alias("component"), "old")
        new = shared.written(new, "cc-labels", rows)
        shared.dropped(labels)
        labels = new.select("node", "component")
        if new.where("component <> old").isEmpty():
            shared.dropped(both)
            return labels
