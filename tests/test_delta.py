"""Matches with seeds in any role, and matches that a change makes and ends, against whole runs."""

import random
import re

import pytest

from weftgraph.functions.predicates import Gt
from weftgraph.operators.graph import Graph
from weftgraph.plans import catalog_matches as cm
from weftgraph.plans import delta, match, walk
from weftgraph.plans.pattern import Node
from weftgraph.sources import fixture

REVERSE = {"knows": "known_by", "likes": "liked_by"}


def graph(spark, people, knows, likes):
    nodes = {"Person": spark.createDataFrame(people, "uid long, age long")}
    return Graph("t", nodes, {n: spark.createDataFrame(sorted(e), "src long, dst long") for n, e in (("knows", knows), ("likes", likes))}, REVERSE)


def changed(rnd, people, edges):
    """Another age for some, some gone, some new; edges that went and came."""
    new = [(u, a if rnd.random() < 0.7 else rnd.randrange(3)) for u, a in people if rnd.random() < 0.9] + [(50 + rnd.randrange(9), 1)]
    ids = [u for u, _ in people] + [50, 53]
    return sorted(set(new)), {n: {e for e in es if rnd.random() < 0.8} | {(rnd.choice(ids), rnd.choice(ids)) for _ in range(6)} for n, es in edges.items()}


CHAIN = Node("Person", "a").to("knows", Node("Person", "b").to("likes", Node("Person", "c")))
STAR = Node("Person", "a").to("knows", Node("Person", "b")).to("liked_by", Node("Person", "c").to("known_by", Node("Person", "d")))
TRIANGLE = Node("Person", "a").to("knows", Node("Person", "b").to("likes", Node("Person", "c"))).to("knows", Node("Person", "c"))
SELF = Node("Person", "a").to("knows", Node("Person", "a")).to("likes", Node("Person", "b"))
ONE = Node("Person", "a")


def filtered(node):
    return node.where("age", Gt(0))


@pytest.mark.parametrize("node", [ONE, CHAIN, STAR, TRIANGLE, SELF], ids=["one", "chain", "star", "triangle", "self"])
@pytest.mark.parametrize("seed", [0])
def test_change_equals_difference_of_whole_runs(spark, node, seed):
    rnd = random.Random(seed)
    people = [(u, rnd.randrange(3)) for u in range(1, 13)]
    edges = {n: {(rnd.randrange(1, 13), rnd.randrange(1, 13)) for _ in range(25)} for n in REVERSE}
    edges["knows"].add((1, 1))
    after, new_edges = changed(rnd, people, edges)
    node = filtered(node)
    old, new = graph(spark, people, **edges), graph(spark, after, **new_edges)
    was, now = ({tuple(r) for r in match.bindings(g, node).collect()} for g in (old, new))
    got = sorted(map(tuple, delta.matches(delta.GraphDelta.between(old, new), node).collect()))
    assert got == sorted([(1, *m) for m in now - was] + [(-1, *m) for m in was - now])
    assert got or node is ONE


def test_nothing_changed(spark):
    g = graph(spark, [(1, 1)], {(1, 1)}, {(1, 1)})
    assert delta.matches(delta.GraphDelta(g), CHAIN).collect() == []
    assert delta.matches(delta.GraphDelta.between(g, g), CHAIN).collect() == []


@pytest.mark.parametrize("node", [ONE, CHAIN, STAR, TRIANGLE], ids=["one", "chain", "star", "triangle"])
def test_seeds_in_any_role(spark, node):
    rnd = random.Random(7)
    people = [(u, rnd.randrange(3)) for u in range(1, 13)]
    g = graph(spark, people, **{n: {(rnd.randrange(1, 13), rnd.randrange(1, 13)) for _ in range(25)} for n in REVERSE})
    seeds = [2, 5, 99, 5]
    every = [tuple(r) for r in match.bindings(g, filtered(node)).collect()]
    want = sorted((m[i], i, *m) for m in every for i in range(len(m)) if m[i] in seeds)
    got = match.with_uid(g, filtered(node), spark.createDataFrame([(s,) for s in seeds], "uid long"))
    assert sorted(map(tuple, got.collect())) == want


def test_work_follows_the_change(spark, sf, monkeypatch):
    """What the walk writes between its steps is in proportion to the changes, not to the graph."""
    g = fixture.graph(spark, sf)
    made = []
    plain = walk.written
    monkeypatch.setattr(walk, "written", lambda rows, name: (lambda out: made.append(out.count()) or out)(plain(rows, name)))

    def total(orders):
        made.clear()
        changes = g.edge("placed_by").where(f"src % 1000 < {orders}")
        delta.matches(delta.GraphDelta(g, edges={"placed_by": changes.selectExpr("src", "dst", "true AS added")}), cm.CHAIN).count()
        return sum(made)

    few, more = total(2), total(200)
    assert 0 < few < more / 20 and more < 2000


def scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    initial = plan.partition("== Initial Plan ==")[0] if "== Final Plan ==" in plan else plan
    return len(re.findall(r"Scan parquet", initial))


def test_plans_read_a_table_twice_at_most(spark, sf):
    """The last step of q_with_uid: its parts before are written, each with two reads of an edge and a role at most."""
    seen = []
    g = fixture.graph(spark, sf)
    count = {"candidate": 0, "step": 0}
    plain = match.candidate, match._step
    try:
        match.candidate = lambda *a: (count.update(candidate=count["candidate"] + 1), plain[0](*a))[1]
        match._step = lambda *a: (count.update(step=count["step"] + 1), plain[1](*a))[1]
        seen.append(match.with_uid(g, cm._LOCAL, cm._mixed(spark, sf)))
    finally:
        match.candidate, match._step = plain
    roles, edges = 3, 2
    assert count["candidate"] <= 2 * roles - 1 and count["step"] <= 2 * edges
    assert scans(seen[0]) <= 4
