"""Merges as laws, and patterns against brute force on small random graphs."""

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.functions.predicates import Eq, Gt
from weftgraph.operators import merge
from weftgraph.operators.graph import Graph
from weftgraph.plans import match
from weftgraph.plans.pattern import Node

KINDS = ["max_int", "min_int", "immutable_int", "immutable_string"]
WRITE = st.tuples(st.integers(1, 3), st.sampled_from(KINDS), st.integers(-5, 5), st.integers(0, 4), st.integers(0, 9))


def rows_of(writes):
    return [("t", uid, kind, kind, str(n) if kind.endswith("string") else None, None if kind.endswith("string") else n, ingested, event) for uid, kind, n, ingested, event in writes]


def merged(spark, *groups):
    parts = [merge.partial_properties(spark.createDataFrame(rows_of(g), merge.WRITES)) for g in groups]
    out = parts[0]
    for p in parts[1:]:
        out = merge.merge_partials(out.unionByName(p))
    return {(r.uid, r.field): (r.s, r.n) for r in merge.finished(out).collect()}


def by_hand(writes):
    out = {}
    for uid, kind in {(w[0], w[1]) for w in writes}:
        own = [w for w in writes if w[:2] == (uid, kind)]
        first = min(own, key=lambda w: (w[3], w[4], str(w[2]) if kind.endswith("string") else w[2]))[2]
        n = {"max": max(w[2] for w in own), "min": min(w[2] for w in own)}.get(kind[:3], first)
        out[uid, kind] = (str(n), None) if kind.endswith("string") else (None, n)
    return out


@settings(max_examples=12, deadline=None)
@given(st.lists(WRITE, min_size=1, max_size=14), st.randoms(use_true_random=False))
def test_merges_commute_and_repeat(spark, writes, rnd):
    """Any order, any split, any part of it twice: one state."""
    want = by_hand(writes)
    shuffled = rnd.sample(writes, len(writes))
    k = rnd.randrange(len(writes) + 1)
    assert merged(spark, writes) == want
    assert merged(spark, shuffled[:k], shuffled[k:], shuffled[: k // 2]) == want
    assert merged(spark, shuffled[k:], shuffled[:k]) == want


def test_changes_are_exact(spark):
    old, new = [(1, "max_int", 3, 0, 0), (2, "max_int", 3, 0, 0)], [(1, "max_int", 2, 1, 1), (2, "max_int", 9, 1, 1), (3, "min_int", 1, 1, 1)]
    parts = [merge.partial_properties(spark.createDataFrame(rows_of(g), merge.WRITES)) for g in (old, new)]
    assert {(r.uid, r.field) for r in merge.merge_state(*parts)[1].collect()} == {(2, "max_int"), (3, "min_int")}


def random_graph(spark, seed):
    """Two node types, edges with cycles and to oneself."""
    rnd = random.Random(seed)
    a, b = [(i, rnd.randrange(3)) for i in range(1, 7)], [(i, rnd.randrange(3)) for i in range(11, 17)]
    knows = {(rnd.choice(a)[0], rnd.choice(a)[0]) for _ in range(12)}
    owns = {(rnd.choice(a)[0], rnd.choice(b)[0]) for _ in range(10)}
    links = {(rnd.choice(b)[0], rnd.choice(b)[0]) for _ in range(8)}
    frame = lambda rows, names: spark.createDataFrame(sorted(rows), names)
    g = Graph("t", {"A": frame(a, "uid long, x long"), "B": frame(b, "uid long, x long")}, {n: frame(e, "src long, dst long") for n, e in (("knows", knows), ("owns", owns), ("links", links))}, {"knows": "known_by", "owns": "owned_by", "links": "linked_by"})
    edges = {"knows": knows, "owns": owns, "links": links}
    edges |= {r: {(y, x) for x, y in edges[e]} for e, r in (("knows", "known_by"), ("owns", "owned_by"), ("links", "linked_by"))}
    return g, {"A": dict(a), "B": dict(b)}, edges


B2 = Node("B", "b2")
PATTERNS = [
    Node("A", "a").to("knows", Node("A", "a2").where("x", Gt(0))),
    Node("A", "a").to("owns", Node("B", "b").to("links", B2)).to("knows", Node("A", "c")),
    Node("A", "a").to("owns", B2).to("knows", Node("A", "c").where("x", Eq(1)).where("x", Eq(2)).to("owns", B2)),
    Node("A", "a").to("knows", Node("A", "a")),
    Node("A", "a").to("knows", Node("A", "c").to("knows", Node("A", "d").to("knows", Node("A", "a")))),
    Node("B", "b").where("x", ~Eq(0)).to("owned_by", Node("A", "a")).to("linked_by", Node("B", "e")).to("links", Node("B", "f")),
]


def brute(pattern, nodes, edges):
    names = list(pattern.roles)

    def fits(role, uid):
        x = nodes[pattern.roles[role].node_type][uid]
        return all(any(all(_holds(f, x) for f in call) for call in calls) for calls in pattern.roles[role].properties.values())

    choices = [[u for u in nodes[pattern.roles[r].node_type] if fits(r, u)] for r in names]
    return {b for b in itertools.product(*choices) if all((b[names.index(p)], b[names.index(q)]) in edges[e] for p, e, q in pattern.edges)}


def _holds(f, x):
    held = x == f.value if isinstance(f, Eq) else x > f.value
    return held != f.negated


@pytest.mark.parametrize("i", range(len(PATTERNS)))
@pytest.mark.parametrize("seed", [0, 1])
def test_patterns_by_brute_force(spark, i, seed):
    g, nodes, edges = random_graph(spark, seed)
    pattern = match.compiled(g, PATTERNS[i])
    want = brute(pattern, nodes, edges)
    names = list(pattern.roles)
    assert {tuple(r) for r in match.bindings(g, pattern).select(*names).collect()} == want
    root = names.index(pattern.root)
    assert {r.uid for r in match.roots(g, pattern).collect()} == {b[root] for b in want}
    seeds = spark.createDataFrame([(u,) for u in (1, 2, 3, 11, 12, 99)], "uid long")
    got = {tuple(r) for r in match.with_uid(g, pattern, seeds).select("seed", "role_no", *names).collect()}
    assert got == {(b[k], k, *b) for b in want for k in range(len(names)) if b[k] in (1, 2, 3, 11, 12)}
    found = {r.seed: r.found for r in match.contains(g, pattern, seeds).collect()}
    assert found == {u: any(u in b for b in want) for u in (1, 2, 3, 11, 12, 99)}
    views = {(r.root, r.uid) for r in match.view_nodes(g, pattern, seeds).select("root", "uid").collect()}
    assert views == {(b[root], u) for b in want if b[root] in (1, 2, 3, 11, 12) for u in b}


def test_views_hold_true_edges_with_filtered_properties(spark):
    g, nodes, edges = random_graph(spark, 3)
    pattern = match.compiled(g, PATTERNS[2])
    want = brute(pattern, nodes, edges)
    names = list(pattern.roles)
    got = {(r.root, r.src, r.edge, r.dst) for r in match.view_edges(g, pattern).collect()}
    fwd = {(b[0], b[names.index(p)], e, b[names.index(q)]) for b in want for p, e, q in pattern.edges}
    assert got == fwd | {(r, y, g.reverse[e], x) for r, x, e, y in fwd}
    props = {(r.root, r.uid, r.name, r.value) for r in match.view_properties(g, pattern).collect()}
    assert props == {(b[0], b[names.index("c")], "x", str(nodes["A"][b[names.index("c")]])) for b in want}
    v = match.grouped_views(g, pattern)
    for r in match.node_of(v, F.col("root")).collect():
        assert r.node.uid == r.root
