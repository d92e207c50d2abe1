"""Matching of cyclic patterns, one role at a time.

A role that several bound ones point to is bound by intersecting their neighbour lists, all at once: each row takes its
candidates from the shortest of the lists and looks them up in the others. So a row makes no more rows than its shortest
list holds, a cycle is never closed after the fact, and what is made stays within the bound of the largest output that
relations of these sizes can have; joining two relations at a time, a hub makes the square of its neighbours.

Lists longer than CUT are dealt out in parts, and rows that take their candidates from one are sent to all its parts, so
no task holds a hub's whole list; looking up goes by pairs of nodes, which a hub does not crowd.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.graph import Graph
from weftgraph.plans.pattern import Pattern

CUT = 100_000


@dataclass(frozen=True)
class Step:
    """A role to bind, and the edges to bound ones: (edge, bound role, whether it leads from the bound one)."""

    role: str
    edges: tuple[tuple[str, str, bool], ...]


def steps(pattern: Pattern, root: str) -> list[Step]:
    """Roles after the root in the order in which they are bound: always one with the most edges to bound ones."""
    bound, out = [root], []
    while len(bound) < len(pattern.roles):
        def edges_of(role: str) -> tuple:
            return tuple((e, a, True) for a, e, b in pattern.edges if b == role and a in bound) + tuple((e, b, False) for a, e, b in pattern.edges if a == role and b in bound)

        role = max((r for r in pattern.roles if r not in bound), key=lambda r: len(edges_of(r)))
        out.append(Step(role, edges_of(role)))
        bound.append(role)
    return out


def lists(graph: Graph, step: Step, allowed: DataFrame) -> list[DataFrame]:
    """For each edge of a step (node, next): neighbours of nodes that may be bound there, those in allowed (uid)."""
    out = []
    for edge, _, forward in step.edges:
        e = graph.edge(edge)
        pairs = e.select(F.col("src" if forward else "dst").alias("node"), F.col("dst" if forward else "src").alias("next"))
        out.append(pairs.join(allowed.select(F.col("uid").alias("next")), "next", "left_semi").select("node", "next"))
    return out


def _tagged(neighbours: list[DataFrame]) -> DataFrame:
    """(list, node, next) of all lists."""
    return reduce(DataFrame.unionByName, [d.select(F.lit(i).alias("list"), "node", "next") for i, d in enumerate(neighbours)])


def bound(rows: DataFrame, step: Step, neighbours: list[DataFrame], cut: int = CUT) -> DataFrame:
    """rows with a column for the step's role: of each, every node that all its lists hold."""
    every = _tagged(neighbours)
    sizes = every.groupBy("list", "node").agg(F.count("*").alias("size"))
    for i, (_, role, _) in enumerate(step.edges):
        # A node without a list has no match, so the join drops its rows.
        own = sizes.where(F.col("list") == i).select(F.col("node").alias(role), F.col("size").alias(f"_size_{i}"))
        rows = rows.join(own, role)
    n = len(step.edges)
    columns = [c for c in rows.columns if not c.startswith("_size_")]
    least = F.least(*[F.col(f"_size_{i}") for i in range(n)]) if n > 1 else F.col("_size_0")
    which = F.coalesce(*[F.when(F.col(f"_size_{i}") == least, F.lit(i)) for i in range(n)])
    node = reduce(lambda rest, i: F.when(F.col("_list") == i, F.col(step.edges[i][1])).otherwise(rest), range(n), F.lit(None).cast("bigint"))
    taken = rows.select(*columns, which.alias("_list"), F.ceil(least / cut).cast("int").alias("_parts")).withColumn("_node", node)
    taken = taken.select("*", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part")).drop("_parts")
    # Few nodes are that crowded: all edges over the cut at most.
    crowded = sizes.where(F.col("size") > cut).select("list", "node", F.ceil(F.col("size") / cut).cast("int").alias("parts"))
    dealt = every.join(crowded, ["list", "node"], "left")
    dealt = dealt.select(F.col("list").alias("_list"), F.col("node").alias("_node"), F.col("next").alias(step.role), F.coalesce(F.pmod(F.xxhash64("next"), F.col("parts")).cast("int"), F.lit(0)).alias("_part"))
    out = taken.join(dealt, ["_list", "_node", "_part"])
    for i, (_, role, _) in enumerate(step.edges if n > 1 else ()):
        out = out.join(neighbours[i].select(F.col("node").alias(role), F.col("next").alias(step.role)), [role, step.role], "left_semi")
    return out.select(*columns, step.role)


def bindings(graph: Graph, pattern: Pattern, root: str, candidates: dict[str, DataFrame], watch: Callable[[str, DataFrame], None] | None = None) -> DataFrame:
    """One row per match, a column per role, from candidates (uid) for each role. watch: is told the rows after each role."""
    out = candidates[root].select(F.col("uid").alias(root))
    for edge in (e for a, e, b in pattern.edges if a == b == root):
        out = out.join(graph.edge(edge).where("src = dst").select(F.col("src").alias(root)), root, "left_semi")
    for step in steps(pattern, root):
        out = bound(out, step, lists(graph, step, candidates[step.role]))
        for edge in (e for a, e, b in pattern.edges if a == b == step.role):
            out = out.join(graph.edge(edge).where("src = dst").select(F.col("src").alias(step.role)), step.role, "left_semi")
        if watch:
            watch(step.role, out)
    return out.select(*pattern.roles)
