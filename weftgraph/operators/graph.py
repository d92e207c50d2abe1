"""A tenant's property graph as DataFrames: one wide table per node type, one table per edge name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """nodes: type -> (uid, properties...); edges: forward name -> (src, dst), distinct; reverse: name -> opposite name.

    Only forward edges are kept; a reverse name reads the same table with its ends swapped.
    """

    tenant: str
    nodes: dict[str, DataFrame]
    edges: dict[str, DataFrame]
    reverse: dict[str, str]

    def __post_init__(self):
        object.__setattr__(self, "reverse", {**self.reverse, **{v: k for k, v in self.reverse.items()}})

    def of_type(self, node_type: str) -> DataFrame:
        if node_type not in self.nodes:
            raise KeyError(f"no node type {node_type}")
        return self.nodes[node_type]

    def edge(self, name: str) -> DataFrame:
        if name in self.edges:
            return self.edges[name]
        if (back := self.reverse.get(name)) in self.edges:
            return self.edges[back].select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        raise KeyError(f"no edge {name}")

    def properties(self, uids: DataFrame, node_type: str, name: str) -> DataFrame:
        """Property scan for a set of uids: (uid, value), present values only."""
        return self.of_type(node_type).join(uids.select("uid").distinct(), "uid", "left_semi").select("uid", F.col(name).alias("value")).where("value is not null")

    def adjacent(self, uids: DataFrame, name: str) -> DataFrame:
        """Adjacency scan for a set of uids: (src, dst); a uid without the edge has no row."""
        return self.edge(name).join(uids.select(F.col("uid").alias("src")).distinct(), "src", "left_semi")
