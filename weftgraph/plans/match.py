"""Pattern matching as joins: candidates by role, semi-join reduction, bindings, views.

A match binds every role to a node so that every pattern edge is a graph edge; two roles may bind the same node. An edge
is satisfied by any neighbour that satisfies the rest, whatever the order. Where only roots, nodes or edges are asked
for, branches are semi-joins and never multiply each other. Patterns with cycles are bound role by role (multiway).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.predicates import node_column
from weftgraph.operators.graph import Graph
from weftgraph.plans import multiway
from weftgraph.plans.pattern import Node, Pattern
from weftgraph.plans.walk import walk
from weftgraph.session import written

_UID = "bigint"


def compiled(graph: Graph, node: Node | Pattern) -> Pattern:
    return node if isinstance(node, Pattern) else node.pattern(graph.reverse)


def candidate(graph: Graph, pattern: Pattern, role: str) -> DataFrame:
    """(uid) of nodes that pass the role's own filters; the filters reach the scan of its type."""
    r = pattern.roles[role]
    return graph.of_type(r.node_type).where(node_column(r.properties, r.uids)).select(F.col("uid").cast(_UID).alias("uid"))


def nodes(graph: Graph, node: Node) -> DataFrame:
    """One role alone: (uid, the filtered properties)."""
    r = next(iter(node.pattern(graph.reverse).roles.values()))
    return graph.of_type(r.node_type).where(node_column(r.properties, r.uids)).select("uid", *r.properties)


def _step(graph: Graph, edge: str, forward: bool, parent: str, child: str) -> DataFrame:
    e = graph.edge(edge)
    return e.select(F.col("src" if forward else "dst").alias(parent), F.col("dst" if forward else "src").alias(child))


def along(graph: Graph, tree: list[tuple[str, str, str, bool]]):
    """For walk: rows to rows with one role more, by an edge of the tree."""

    def across(rows: DataFrame, i: int, a: str, b: str) -> DataFrame:
        parent, edge, child, forward = tree[i]
        return rows.join(_step(graph, edge, forward, parent, child), a)

    return across


def reduced(graph: Graph, pattern: Pattern, root: str) -> dict[str, DataFrame]:
    """Candidates that have all their children, from the leaves of the spanning tree up."""
    cand = {r: candidate(graph, pattern, r) for r in pattern.roles}
    for parent, edge, child, forward in reversed(pattern.tree(root)[0]):
        has = _step(graph, edge, forward, "uid", "_child").join(cand[child].withColumnRenamed("uid", "_child"), "_child", "left_semi").select("uid")
        cand[parent] = cand[parent].join(has, "uid", "left_semi")
    return cand


def bindings(graph: Graph, node: Node | Pattern, root: str | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """One row per match, a column per role. seeds (uid): the only nodes the root may be.

    Where a role has several children, candidates are reduced first, so that no branch multiplies what another one drops.
    """
    pattern = compiled(graph, node)
    root = root or pattern.root
    tree, rest = pattern.tree(root)
    if rest:
        cand = {r: candidate(graph, pattern, r) for r in pattern.roles}
        if seeds is not None:
            cand[root] = cand[root].join(seeds.select("uid").distinct(), "uid", "left_semi")
        return multiway.bindings(graph, pattern, root, cand)
    parents = [parent for parent, *_ in tree]
    branches = len(set(parents)) < len(parents)
    cand = reduced(graph, pattern, root) if branches else {r: candidate(graph, pattern, r) for r in pattern.roles}
    first = cand[root]
    if seeds is not None:
        first = first.join(seeds.select("uid").distinct(), "uid", "left_semi")
    out = first.select(F.col("uid").alias(root))
    for parent, edge, child, forward in tree:
        out = out.join(_step(graph, edge, forward, parent, child).join(cand[child].withColumnRenamed("uid", child), child, "left_semi"), parent)
    return out.select(*pattern.roles)


def roots(graph: Graph, node: Node | Pattern, seeds: DataFrame | None = None) -> DataFrame:
    """(uid) of nodes that can be the root of a match."""
    pattern = compiled(graph, node)
    if pattern.tree()[1]:
        return bindings(graph, pattern, seeds=seeds).select(F.col(pattern.root).alias("uid")).distinct()
    out = reduced(graph, pattern, pattern.root)[pattern.root]
    return out if seeds is None else out.join(seeds.select("uid").distinct(), "uid", "left_semi")


def from_uid(graph: Graph, node: Node | Pattern, seeds: DataFrame) -> DataFrame:
    """Matches whose root is one of the seeds."""
    return bindings(graph, node, seeds=seeds)


def with_uid(graph: Graph, node: Node | Pattern, seeds: DataFrame, one_per_seed: bool = False) -> DataFrame:
    """Matches that hold a seed in any role: (seed, role_no, a column per role).

    one_per_seed: the first by role and bindings, for each seed.
    """
    pattern = compiled(graph, node)
    roles = list(pattern.roles)
    tree, rest = pattern.tree()
    if rest:
        parts = [bindings(graph, pattern, role, seeds).select(F.lit(i).alias("role_no"), *roles) for i, role in enumerate(roles)]
        out = reduce(DataFrame.unionByName, parts)
    else:
        own = written(seeds.select("uid").distinct(), "seeds")
        starts = {r: own.select(F.col("uid").alias(r), F.lit(i).alias("_start")) for i, r in enumerate(roles)}
        check = lambda rows, role: rows.join(candidate(graph, pattern, role).withColumnRenamed("uid", role), role, "left_semi")
        out = walk(pattern.root, tree, roles, starts, check, along(graph, tree), []).withColumnRenamed("_start", "role_no")
    seed = F.coalesce(*[F.when(F.col("role_no") == i, F.col(r)) for i, r in enumerate(roles)])
    out = out.select(seed.alias("seed"), "role_no", *roles)
    if not one_per_seed:
        return out
    # A pre-aggregated minimum, so a seed with very many matches meets in no single task.
    least = out.groupBy("seed").agg(F.min(F.struct("role_no", *pattern.roles)).alias("m"))
    return least.select("seed", "m.*")


def first(graph: Graph, node: Node | Pattern, n: int = 1000) -> DataFrame:
    """(uid): the n least roots of the whole graph."""
    return roots(graph, node).orderBy("uid").limit(n)


def count(graph: Graph, node: Node | Pattern) -> DataFrame:
    """(n): how many nodes can be the root."""
    return roots(graph, node).agg(F.count("*").alias("n"))


def contains(graph: Graph, node: Node | Pattern, seeds: DataFrame) -> DataFrame:
    """(seed, found): whether a match holds the seed."""
    found = with_uid(graph, node, seeds, True).select("seed", F.lit(True).alias("found"))
    return seeds.select(F.col("uid").alias("seed")).distinct().join(found, "seed", "left").select("seed", F.coalesce("found", F.lit(False)).alias("found"))


def _reach(graph: Graph, pattern: Pattern, seeds: DataFrame | None) -> tuple[dict[str, DataFrame], list[DataFrame]]:
    """Per role (root, uid), per pattern edge (root, src, edge, dst): the nodes and edges of each root's matches."""
    tree, rest = pattern.tree()
    if rest:
        b = bindings(graph, pattern, seeds=seeds)
        reach = {r: b.select(F.col(pattern.root).alias("root"), F.col(r).alias("uid")).distinct() for r in pattern.roles}
        pairs = [b.select(F.col(pattern.root).alias("root"), F.col(x).alias("src"), F.lit(edge).alias("edge"), F.col(y).alias("dst")).distinct() for x, edge, y in pattern.edges]
        return reach, pairs
    cand = reduced(graph, pattern, pattern.root)
    top = cand[pattern.root] if seeds is None else cand[pattern.root].join(seeds.select("uid").distinct(), "uid", "left_semi")
    reach, pairs = {pattern.root: top.select(F.col("uid").alias("root"), "uid")}, []
    for parent, edge, child, forward in tree:
        step = _step(graph, edge, forward, "uid", "next").join(cand[child].withColumnRenamed("uid", "next"), "next", "left_semi")
        pair = reach[parent].join(step, "uid")
        reach[child] = pair.select("root", F.col("next").alias("uid")).distinct()
        pairs.append(pair.select("root", F.col("uid" if forward else "next").alias("src"), F.lit(edge).alias("edge"), F.col("next" if forward else "uid").alias("dst")))
    return reach, pairs


def view_nodes(graph: Graph, node: Node | Pattern, seeds: DataFrame | None = None) -> DataFrame:
    """(root, uid, node_type): the nodes of each root's matches."""
    pattern = compiled(graph, node)
    reach, _ = _reach(graph, pattern, seeds)
    return reduce(DataFrame.unionByName, [d.withColumn("node_type", F.lit(pattern.roles[r].node_type)) for r, d in reach.items()]).distinct()


def view_edges(graph: Graph, node: Node | Pattern, seeds: DataFrame | None = None) -> DataFrame:
    """(root, src, edge, dst): the edges of each root's matches, both directions."""
    pattern = compiled(graph, node)
    _, pairs = _reach(graph, pattern, seeds)
    if not pairs:
        return graph.of_type(pattern.roles[pattern.root].node_type).sparkSession.createDataFrame([], "root bigint, src bigint, edge string, dst bigint")
    forward = reduce(DataFrame.unionByName, pairs)
    names = F.create_map(*[F.lit(x) for e in sorted({e for _, e, _ in pattern.edges}) for x in (e, graph.reverse[e])])
    back = forward.select("root", F.col("dst").alias("src"), names[F.col("edge")].alias("edge"), F.col("src").alias("dst"))
    return forward.unionByName(back).distinct()


def view_properties(graph: Graph, node: Node | Pattern, seeds: DataFrame | None = None) -> DataFrame:
    """(root, uid, node_type, name, value): the filtered properties of the nodes of each root's matches, as text; present ones only."""
    pattern = compiled(graph, node)
    reach, _ = _reach(graph, pattern, seeds)
    parts = []
    for r, d in reach.items():
        role = pattern.roles[r]
        if role.properties:
            entries = F.array(*[F.struct(F.lit(p).alias("name"), F.col(p).cast("string").alias("value")) for p in role.properties])
            own = graph.of_type(role.node_type).select("uid", F.explode(entries).alias("p")).where("p.value is not null")
            parts.append(d.join(own, "uid").select("root", "uid", F.lit(role.node_type).alias("node_type"), "p.name", "p.value"))
    if not parts:
        return graph.of_type(pattern.roles[pattern.root].node_type).sparkSession.createDataFrame([], "root bigint, uid bigint, node_type string, name string, value string")
    return reduce(DataFrame.unionByName, parts).distinct()


def grouped_views(graph: Graph, node: Node | Pattern, seeds: DataFrame | None = None) -> DataFrame:
    """(root, nodes, edges): one row per root. Only for roots of bounded neighbourhoods; view_* scale to any.

    nodes: (uid, node_type, properties: map of the filtered ones); edges: (src, edge, dst).
    """
    props = view_properties(graph, node, seeds).groupBy("root", "uid", "node_type").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("name", "value")))).alias("properties"))
    whole = view_nodes(graph, node, seeds).join(props, ["root", "uid", "node_type"], "left")
    properties = F.coalesce("properties", F.create_map().cast("map<string,string>"))
    n = whole.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("uid", "node_type", properties.alias("properties"))), lambda x, y: F.when(x["uid"] < y["uid"], -1).when(x["uid"] > y["uid"], 1).otherwise(0)).alias("nodes"))
    e = view_edges(graph, node, seeds).groupBy("root").agg(F.array_sort(F.collect_set(F.struct("src", "edge", "dst"))).alias("edges"))
    return n.join(e, "root", "left")


def node_of(views: DataFrame, uid: Column) -> DataFrame:
    """(root, node) of grouped views: the node of that uid, null where the view has none."""
    return views.select("root", F.get(F.filter("nodes", lambda n: n["uid"] == uid), F.lit(0)).alias("node"))


def edges_of(views: DataFrame, uid: Column, edge: str) -> DataFrame:
    """(root, neighbors) of grouped views: where an edge leads from that uid."""
    return views.select("root", F.transform(F.filter("edges", lambda e: (e["src"] == uid) & (e["edge"] == edge)), lambda e: e["dst"]).alias("neighbors"))


def neighbors(graph: Graph, uids: DataFrame, edge: str, node: Node) -> DataFrame:
    """(uid, neighbor): a view's nodes expanded along an edge to neighbours that match `node` and what hangs on it."""
    step = _step(graph, edge, True, "uid", "neighbor")
    return uids.select("uid").distinct().join(step, "uid").join(roots(graph, node).withColumnRenamed("uid", "neighbor"), "neighbor", "left_semi").select("uid", "neighbor")
