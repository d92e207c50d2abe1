"""Users' functions: what they build, and what becomes of what they raise."""

from compare import assert_same, duck

from weftgraph.operators import generators, user_code
from weftgraph.operators.graph import Graph
from weftgraph.plans import catalog
from weftgraph.plans.pattern import Node


def described(spark, describe, texts):
    logs = spark.createDataFrame([("t", i, x) for i, x in enumerate(texts)], "tenant_id string, event_id long, log_event string")
    return user_code.generated(logs, describe)


def test_subgraphs_and_quarantine(spark):
    def describe(text, event):
        a = event.node("a", "A", {"x": text, "none": None}, {"n": len(text)})
        if text == "twice":
            event.node("a", "A")
        if text == "loose":
            event.edge(a, "to", "9:b")
        if text == "number":
            event.node("b", "B", numbers={"n": "many"})
        if text != "alone":
            event.edge(a, "to", event.node("b", "B"))

    made = described(spark, describe, ["ok", None, "twice", "loose", "number", "alone"]).cache()
    errors = {r.event_id: r.error for r in user_code.failed(made).collect()}
    assert errors.keys() == {1, 2, 3, 4} and errors[1].startswith("TypeError: ") and errors[2] == "ValueError: two nodes are a" and errors[3] == "ValueError: an edge to has no node 9:b" and errors[4].startswith("ValueError: invalid literal")
    good = user_code.good(made)
    nodes = {r.node_key: (r.node_type, r.strings, r.numbers) for r in generators.nodes_of(good).collect()}
    assert nodes == {"0:a": ("A", {"x": "ok"}, {"n": 2}), "0:b": ("B", {}, {}), "5:a": ("A", {"x": "alone"}, {"n": 5})}
    assert [(r.src_key, r.edge, r.dst_key) for r in generators.edges_of(good).collect()] == [("0:a", "to", "0:b")]
    made.unpersist()


def test_events_without_a_subgraph_and_empty_tables(spark):
    made = described(spark, lambda text, event: None, ["x"])
    assert made.count() == 1 and user_code.good(made).count() == user_code.failed(made).count() == 0
    assert described(spark, lambda text, event: None, ["x"]).where("false").count() == 0
    long = described(spark, lambda text, event: [][len("x" * 5) :][0] if text else (_ for _ in ()).throw(RuntimeError("y" * 9000)), [None]).first()
    assert long.error.startswith("RuntimeError: yyy") and len(long.error) == 2000


def test_matches_are_judged_one_by_one(spark):
    people = spark.createDataFrame([(1, 5), (2, None), (3, 0)], "uid long, age long")
    g = Graph("t", {"Person": people}, {"knows": spark.createDataFrame([(1, 2)], "src long, dst long")}, {"knows": "known_by"})
    query = Node("Person", "a").to("knows", Node("Person", "b"))
    seen = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 1), (1, 99)], "a long, b long")
    judge = lambda m: None if m["b"]["age"] is None else (m["a"]["uid"], {"ratio": 10 // m["b"]["age"]})
    rows = {(r.a, r.b): (r.score, r.context, r.error) for r in user_code.judged(user_code.UserAnalyzer("u", query, judge, {"b": ["age"]}), seen, g).collect()}
    assert rows == {(2, 3): (None, None, rows[2, 3][2]), (3, 1): (3, {"ratio": "2"}, None), (1, 1): (1, {"ratio": "2"}, None)}
    assert rows[2, 3][2].startswith("ZeroDivisionError: ")
    plain = user_code.judged(user_code.UserAnalyzer("v", query, lambda m: len(m)), seen, g)
    assert [(r.analyzer, r.score, r.context) for r in plain.where("a = 2").collect()] == [("v", 2, {})]


def test_of_writes_by_one_event_the_first_in_the_file_counts(spark, sf, tmp_path):
    con = duck(sf)
    con.execute(f"COPY (SELECT * FROM part WHERE p_partkey < 4) TO '{tmp_path}/part.parquet'")
    # Part 1 has two lines of one event, O first; part 2's first event has no status, part 3's lines have no event.
    rows = "(7, 1, 1, 'O'), (7, 1, 1, 'F'), (1, 2, 1, NULL), (2, 2, 1, 'F'), (NULL, 3, 1, 'O')"
    con.execute(f"COPY (SELECT l_orderkey::BIGINT AS l_orderkey, l_partkey::BIGINT AS l_partkey, l_linenumber::INTEGER AS l_linenumber, l_linestatus FROM (VALUES {rows}) v(l_orderkey, l_partkey, l_linenumber, l_linestatus)) TO '{tmp_path}/lineitem.parquet'")
    assert assert_same(catalog.QUERIES["m_extended_types"](spark, str(tmp_path)), duck(str(tmp_path)), catalog.ORACLES["m_extended_types"]) == 24
