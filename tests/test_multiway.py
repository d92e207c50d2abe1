"""Cyclic patterns against brute force, and how many rows they make on the way."""

import random

import pytest

from weftgraph.operators.graph import Graph
from weftgraph.plans import match, multiway
from weftgraph.plans.pattern import Node

REVERSE = {"knows": "known_by", "likes": "liked_by"}


def graph(spark, nodes, knows, likes=()):
    people = spark.createDataFrame([(u, u % 3) for u in nodes], "uid long, age long")
    edges = {n: spark.createDataFrame(sorted(set(e)), "src long, dst long") for n, e in (("knows", knows), ("likes", likes))}
    return Graph("t", {"Person": people}, edges, REVERSE)


def brute(pattern, nodes, edges):
    """All matches by trying every node for every role in turn."""
    has = {n: set(e) for n, e in edges.items()}
    has |= {back: {(b, a) for a, b in has[n]} for n, back in REVERSE.items()}
    found = [{}]
    for role in pattern.roles:
        found = [{**f, role: u} for f in found for u in nodes]
        found = [f for f in found if all(a not in f or b not in f or (f[a], f[b]) in has[e] for a, e, b in pattern.edges)]
    return sorted(tuple(f.values()) for f in found)


TRIANGLE = Node("Person", "a").to("knows", Node("Person", "b").to("knows", Node("Person", "c"))).to("knows", Node("Person", "c"))
DIAMOND = Node("Person", "a").to("knows", Node("Person", "b").to("likes", Node("Person", "d"))).to("knows", Node("Person", "c").to("likes", Node("Person", "d")))
SQUARE_WITH_TAIL = Node("Person", "a").to("knows", Node("Person", "b").to("knows", Node("Person", "c").to("knows", Node("Person", "d").to("knows", Node("Person", "a"))))).to("likes", Node("Person", "e"))
SELF = Node("Person", "a").to("knows", Node("Person", "a")).to("knows", Node("Person", "b").to("likes", Node("Person", "a")))


@pytest.mark.parametrize("node", [TRIANGLE, DIAMOND, SQUARE_WITH_TAIL, SELF])
@pytest.mark.parametrize("seed", [0])
def test_random_graphs(spark, monkeypatch, node, seed):
    monkeypatch.setattr(multiway.bound, "__defaults__", (3,))
    rnd = random.Random(seed)
    nodes = list(range(1, 15))
    edges = {n: [(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(45)] for n in ("knows", "likes")}
    edges["knows"] += [(1, u) for u in nodes]
    g = graph(spark, nodes, **edges)
    got = sorted(map(tuple, match.bindings(g, node).collect()))
    assert got == brute(node.pattern(g.reverse), nodes, edges)
    seeds = spark.createDataFrame([(1,), (4,)], "uid long")
    assert sorted(map(tuple, match.bindings(g, node, seeds=seeds).collect())) == [r for r in got if r[0] in (1, 4)]


def test_a_hub_makes_no_squares(spark):
    """One node that knows, and is known by, a thousand others: two edges at a time would make a million rows."""
    n = 1000
    rnd = random.Random(3)
    nodes = range(n + 1)
    knows = [(0, u) for u in range(1, n + 1)] + [(u, 0) for u in range(1, n + 1)] + [(rnd.randrange(1, n), rnd.randrange(1, n)) for _ in range(n)]
    knows = sorted({(a, b) for a, b in knows if a != b})
    g = graph(spark, nodes, knows)
    pattern = match.compiled(g, TRIANGLE)
    made = {}
    cand = {r: match.candidate(g, pattern, r) for r in pattern.roles}
    out = multiway.bindings(g, pattern, "a", cand, lambda role, rows: made.update({role: rows.count()}))
    has = set(knows)
    after = {}
    for a, b in knows:
        after.setdefault(a, []).append(b)
    want = sorted((a, b, c) for a, b in knows for c in after.get(b, ()) if (a, c) in has)
    assert sorted(map(tuple, out.collect())) == want
    degree = {u: len(after.get(u, ())) for u in nodes}
    squares = sum(degree[b] for _, b in knows)
    bound = len(knows) ** 1.5
    assert squares > 10**6 > bound and all(m <= bound for m in made.values())
    # What is looked up is a row for each member of the shorter list.
    assert sum(min(degree[a], degree[b]) for a, b in knows) < bound / 10


def test_order_of_roles(spark):
    g = graph(spark, [1], [(1, 1)])
    order = [s.role for s in multiway.steps(match.compiled(g, SQUARE_WITH_TAIL), "a")]
    assert order[0] in "bd" and order.index("c") < 3 and len(order) == 4
    assert [len(s.edges) for s in multiway.steps(match.compiled(g, TRIANGLE), "a")] == [1, 2]
