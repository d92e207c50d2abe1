"""Queries of graph patterns: unseeded, seeded, counted, as views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.predicates import Contains, Eq, Gt, Lt, StartsWith
from weftgraph.operators import analyzers, merge
from weftgraph.operators.graph import Graph
from weftgraph.plans import delta, match
from weftgraph.plans.pattern import Node
from weftgraph.plans.registry import query
from weftgraph.sources import fixture
from weftgraph.sources.fixture import graph, uid_sql

_LOW = ("5-LOW", "4-NOT SPECIFIED")
CHAIN = (
    Node("Customer", "customer")
    .where("c_mktsegment", Eq("BUILDING"))
    .where("c_mktsegment", Eq("MACHINERY"))
    .to("orders", Node("Order", "order").where("o_orderpriority", *[~Eq(x) for x in _LOW]).to("contains_part", Node("Part", "part").where("p_name", Contains("widget"))))
)
_C, _O, _P, _S, _N, _R = (uid_sql(t, k) for t, k in (("Customer", "c_custkey"), ("Order", "o_orderkey"), ("Part", "p_partkey"), ("Supplier", "s_suppkey"), ("Nation", "n_nationkey"), ("Region", "r_regionkey")))
_CHAIN_FROM = """customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND o_orderpriority <> '5-LOW' AND o_orderpriority <> '4-NOT SPECIFIED' AND contains(p_name, 'widget')"""
_CHAIN_SQL = f"SELECT DISTINCT {_C} AS customer, {_O} AS \"order\", {_P} AS part FROM {_CHAIN_FROM}"


@query(_CHAIN_SQL)
def flagship_suspicious_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.bindings(graph(spark, sf_dir), CHAIN)


@query(f"SELECT {_C} AS customer, {_N} AS nation FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_name = 'NATION_3'")
def q_chain_1hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.bindings(graph(spark, sf_dir), Node("Customer", "customer").to("in_nation", Node("Nation", "nation").where("n_name", Eq("NATION_3"))))


@query(f"SELECT {_C} AS customer, {_N} AS nation, {_R} AS region FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_mktsegment = 'FURNITURE' AND starts_with(r_name, 'A')")
def q_chain_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = Node("Region", "region").where("r_name", StartsWith("A"))
    return match.bindings(graph(spark, sf_dir), Node("Customer", "customer").where("c_mktsegment", Eq("FURNITURE")).to("in_nation", Node("Nation", "nation").to("in_region", region)))


@query(
    f"""SELECT DISTINCT {_N} AS nation, {_C} AS customer, {_O} AS "order", {_S} AS supplier FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE o_orderpriority = '1-URGENT' AND s_acctbal < 3000"""
)
def q_chain_3hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Node("Order", "order").where("o_orderpriority", Eq("1-URGENT")).to("supplied_by", Node("Supplier", "supplier").where("s_acctbal_cents", Lt(300000)))
    return match.bindings(graph(spark, sf_dir), Node("Nation", "nation").to("customers", Node("Customer", "customer").to("orders", order)))


@query(
    f"""SELECT DISTINCT {_O} AS "order", {_C} AS customer, {_P} AS part, {_S} AS supplier FROM orders JOIN customer ON c_custkey = o_custkey
JOIN (SELECT DISTINCT l_orderkey AS a, l_partkey FROM lineitem) x ON a = o_orderkey JOIN part ON p_partkey = l_partkey
JOIN (SELECT DISTINCT l_orderkey AS b, l_suppkey FROM lineitem) y ON b = o_orderkey JOIN supplier ON s_suppkey = l_suppkey
WHERE o_orderstatus = 'F' AND c_mktsegment = 'BUILDING' AND starts_with(p_name, 'red') AND s_acctbal > 5000"""
)
def q_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Node("Order", "order").where("o_orderstatus", Eq("F"))
    order = order.to("placed_by", Node("Customer", "customer").where("c_mktsegment", Eq("BUILDING")))
    order = order.to("contains_part", Node("Part", "part").where("p_name", StartsWith("red")))
    return match.bindings(graph(spark, sf_dir), order.to("supplied_by", Node("Supplier", "supplier").where("s_acctbal_cents", Gt(500000))))


@query(
    f"""SELECT DISTINCT {_O} AS "order", {_C} AS customer, {_N} AS nation, {_S} AS supplier FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = n_nationkey WHERE o_orderstatus = 'P'"""
)
def q_shared_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order's customer and supplier share one nation."""
    nation = Node("Nation", "nation")
    order = Node("Order", "order").where("o_orderstatus", Eq("P")).to("placed_by", Node("Customer", "customer").to("in_nation", nation))
    return match.bindings(graph(spark, sf_dir), order.to("supplied_by", Node("Supplier", "supplier").to("based_in", nation)))


_TRIANGLE = """(SELECT DISTINCT l_orderkey AS ao, l_partkey AS ap FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey AS bo, l_suppkey AS bs FROM lineitem) b ON ao = bo
JOIN (SELECT DISTINCT l_suppkey AS cs, l_partkey AS cp FROM lineitem) c ON bs = cs AND ap = cp"""


@query(f"SELECT {uid_sql('Order', 'ao')} AS \"order\", {uid_sql('Part', 'ap')} AS part, {uid_sql('Supplier', 'bs')} AS supplier FROM {_TRIANGLE} JOIN orders ON o_orderkey = ao JOIN part ON p_partkey = ap JOIN supplier ON s_suppkey = bs WHERE o_orderpriority = '1-URGENT'")
def q_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a part and of a supplier that offers it."""
    supplier = Node("Supplier", "supplier")
    order = Node("Order", "order").where("o_orderpriority", Eq("1-URGENT")).to("contains_part", Node("Part", "part").to("offered_by", supplier))
    return match.bindings(graph(spark, sf_dir), order.to("supplied_by", supplier))


@query(
    f"""WITH o AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), s AS (SELECT s_nationkey, s_suppkey, l_partkey FROM o JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey AND starts_with(p_name, 'red'))
SELECT {_N} AS nation, {uid_sql('Supplier', 'a.s_suppkey')} AS one, {uid_sql('Supplier', 'b.s_suppkey')} AS other, {uid_sql('Part', 'a.l_partkey')} AS part
FROM s a JOIN s b ON a.s_nationkey = b.s_nationkey AND a.l_partkey = b.l_partkey JOIN nation ON n_nationkey = a.s_nationkey"""
)
def q_diamond_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of suppliers of one nation that offer the same part: every supplier offers a share of all parts."""
    part = Node("Part", "part").where("p_name", StartsWith("red"))
    one, other = (Node("Supplier", n).to("offers", part) for n in ("one", "other"))
    return match.bindings(graph(spark, sf_dir), Node("Nation", "nation").to("suppliers", one).to("suppliers", other))


_NATION_SEEDS = f"SELECT {_N} AS uid FROM nation WHERE n_regionkey = 2"


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.table(spark, sf_dir, "nation").where("n_regionkey = 2").select(fixture.uid("Nation", "n_nationkey").alias("uid"))


_LOCAL = Node("Nation", "nation").to("customers", Node("Customer", "customer").where("c_mktsegment", Eq("BUILDING"))).to("in_region", Node("Region", "region"))
_LOCAL_SQL = f"SELECT {_N} AS nation, {_C} AS customer, {_R} AS region FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_mktsegment = 'BUILDING'"


@query(f"WITH m AS ({_LOCAL_SQL}) SELECT * FROM m WHERE nation IN ({_NATION_SEEDS})")
def q_from_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.from_uid(graph(spark, sf_dir), _LOCAL, _seeds(spark, sf_dir))


_MIXED_SEEDS = f"SELECT {_N} AS uid FROM nation WHERE n_regionkey = 2 UNION SELECT {_C} FROM customer WHERE c_acctbal < 0 UNION SELECT {_R} FROM region WHERE r_regionkey = 1"


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = fixture.table(spark, sf_dir, "customer").where("c_acctbal < 0").select(fixture.uid("Customer", "c_custkey").alias("uid"))
    regions = fixture.table(spark, sf_dir, "region").where("r_regionkey = 1").select(fixture.uid("Region", "r_regionkey").alias("uid"))
    return _seeds(spark, sf_dir).unionByName(customers).unionByName(regions)


_WITH_SQL = f"""WITH m AS ({_LOCAL_SQL}), s AS ({_MIXED_SEEDS}), every AS (
  SELECT uid AS seed, 0 AS role_no, m.* FROM s JOIN m ON m.nation = uid UNION ALL
  SELECT uid, 1, m.* FROM s JOIN m ON m.customer = uid UNION ALL
  SELECT uid, 2, m.* FROM s JOIN m ON m.region = uid)"""


@query(f"{_WITH_SQL} SELECT * FROM every")
def q_with_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.with_uid(graph(spark, sf_dir), _LOCAL, _mixed(spark, sf_dir))


@query(f"{_WITH_SQL} SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY role_no, nation, customer, region) AS k FROM every) WHERE k = 1")
def q_with_uid_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.with_uid(graph(spark, sf_dir), _LOCAL, _mixed(spark, sf_dir), one_per_seed=True)


@query(f"{_WITH_SQL} SELECT uid AS seed, uid IN (SELECT seed FROM every) AS found FROM s")
def q_contains_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.contains(graph(spark, sf_dir), _LOCAL, _mixed(spark, sf_dir))


@query(f"SELECT DISTINCT {_C} AS uid FROM {_CHAIN_FROM} ORDER BY uid LIMIT 100")
def q_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the first hundred, as the operator's `first` asks for."""
    return match.first(graph(spark, sf_dir), CHAIN, 100)


@query(f"SELECT count(DISTINCT c_custkey) AS n FROM {_CHAIN_FROM}")
def q_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.count(graph(spark, sf_dir), CHAIN)


@query(f"WITH m AS ({_CHAIN_SQL}) SELECT DISTINCT customer AS root, customer AS uid, 'Customer' AS node_type FROM m UNION SELECT customer, \"order\", 'Order' FROM m UNION SELECT customer, part, 'Part' FROM m")
def q_view_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.view_nodes(graph(spark, sf_dir), CHAIN)


@query(
    f"""WITH m AS ({_CHAIN_SQL}), e AS (SELECT DISTINCT customer AS root, customer AS a, 'orders' AS f, 'placed_by' AS r, "order" AS b FROM m UNION SELECT customer, "order", 'contains_part', 'in_orders', part FROM m)
SELECT root, a AS src, f AS edge, b AS dst FROM e UNION ALL SELECT root, b, r, a FROM e"""
)
def q_view_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.view_edges(graph(spark, sf_dir), CHAIN)


@query(
    f"""WITH m AS ({_CHAIN_SQL}) SELECT DISTINCT customer AS root, customer AS uid, 'Customer' AS node_type, 'c_mktsegment' AS name, c_mktsegment AS value FROM m JOIN customer ON {_C} = customer
UNION SELECT customer, "order", 'Order', 'o_orderpriority', o_orderpriority FROM m JOIN orders ON {_O} = "order" UNION SELECT customer, part, 'Part', 'p_name', p_name FROM m JOIN part ON {_P} = m.part"""
)
def q_view_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.view_properties(graph(spark, sf_dir), CHAIN)


_VIEWED = f"WITH m AS ({_LOCAL_SQL}), v AS (SELECT * FROM m WHERE nation IN ({_NATION_SEEDS}))"


@query(
    f"""{_VIEWED}, n AS (SELECT DISTINCT nation AS root, nation AS uid, '' AS p FROM v UNION SELECT nation, customer, 'c_mktsegment=BUILDING' FROM v UNION SELECT nation, region, '' FROM v),
e AS (SELECT DISTINCT nation AS root, nation AS a, customer AS b FROM v UNION SELECT nation, nation, region FROM v)
SELECT n.root, string_agg(uid || ':' || p, ',' ORDER BY uid) AS nodes, (SELECT 2 * count(*) FROM e WHERE e.root = n.root) AS n_edges FROM n GROUP BY n.root"""
)
def q_grouped_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of the seeds' matches, a row each: nodes with their filtered properties, edges both ways."""
    v = match.grouped_views(graph(spark, sf_dir), _LOCAL, _seeds(spark, sf_dir))
    text = F.transform("nodes", lambda n: F.concat(n["uid"].cast("string"), F.lit(":"), F.array_join(F.transform(F.map_entries(n["properties"]), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")))
    return v.select("root", F.array_join(text, ",").alias("nodes"), F.size("edges").cast("bigint").alias("n_edges"))


@query(f"{_VIEWED} SELECT nation AS root, nation AS uid, 'Nation' AS node_type, string_agg(customer, ',' ORDER BY customer) AS customers FROM v GROUP BY nation")
def q_view_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In each view, its root's node and where one of its edges leads."""
    v = match.grouped_views(graph(spark, sf_dir), _LOCAL, _seeds(spark, sf_dir))
    to = match.edges_of(v, F.col("root"), "customers").select("root", F.array_join(F.array_sort("neighbors"), ",").alias("customers"))
    return match.node_of(v, F.col("root")).join(to, "root").select("root", "node.uid", "node.node_type", "customers")


@query(f"SELECT DISTINCT {_S} AS uid, {_P} AS neighbor FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey WHERE s_acctbal < 3000 AND contains(p_name, 'gear')")
def q_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return match.neighbors(g, match.nodes(g, Node("Supplier").where("s_acctbal_cents", Lt(300000))), "offers", Node("Part").where("p_name", Contains("gear")))


@query(f"SELECT {_O} AS uid, o_orderstatus AS value FROM orders WHERE o_orderstatus IS NOT NULL AND o_totalprice > 300000")
def q_property_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return g.properties(match.nodes(g, Node("Order").where("o_totalprice_cents", Gt(30000000))), "Order", "o_orderstatus")


@query(f"SELECT {_N} AS src, {_C} AS dst FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
def q_adjacency_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).adjacent(_seeds(spark, sf_dir), "customers")


# Changes of the graph and what analyzers make of them.

_NEW_ORDERS = "o_orderdate >= TIMESTAMP '1996-01-01'"


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders since 1996 as changes: two of their properties, and the edge to their customer."""
    o = fixture.table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.expr("timestamp_ntz '1996-01-01 00:00:00'"))
    own, customer = fixture.uid("Order", "o_orderkey"), fixture.uid("Customer", "o_custkey")
    none = F.lit(None).cast("bigint")
    changes = [F.struct(F.lit("property").alias("kind"), own.alias("uid"), F.lit(p).alias("name"), none.alias("src"), none.alias("dst")) for p in ("o_orderpriority", "o_orderstatus")]
    changes.append(F.struct(F.lit("edge").alias("kind"), none.alias("uid"), F.lit("placed_by").alias("name"), own.alias("src"), customer.alias("dst")))
    return o.select(F.explode(F.array(*changes)).alias("u")).select("u.*")


CHAIN_ANALYZER = analyzers.Analyzer("chain", CHAIN, score=10, lens="customer")
URGENT_ANALYZER = analyzers.Analyzer("urgent", Node("Order", "order").where("o_orderpriority", Eq("1-URGENT")).where("o_orderstatus", Eq("P")).to("placed_by", Node("Customer", "customer")), score=3, lens="customer")

_UPDATES_SQL = f"""SELECT 'property' AS kind, {_O} AS uid, name, CAST(NULL AS BIGINT) AS src, CAST(NULL AS BIGINT) AS dst FROM orders, (VALUES ('o_orderpriority'), ('o_orderstatus')) v(name) WHERE {_NEW_ORDERS}
UNION ALL SELECT 'edge', NULL, 'placed_by', {_O}, {uid_sql("Customer", "o_custkey")} FROM orders WHERE {_NEW_ORDERS}"""


@query(f"SELECT * FROM ({_UPDATES_SQL}) WHERE name IN ('o_orderpriority', 'placed_by')")
def a_relevance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyzers.relevant(_updates(spark, sf_dir), graph(spark, sf_dir), CHAIN)


_SEEDED = f"""m AS ({_CHAIN_SQL}), s AS (SELECT {_O} AS uid FROM orders WHERE {_NEW_ORDERS} UNION SELECT {uid_sql("Customer", "o_custkey")} FROM orders WHERE {_NEW_ORDERS}),
hit AS (SELECT * FROM m WHERE customer IN (SELECT uid FROM s) OR "order" IN (SELECT uid FROM s)),
chain AS (SELECT 'chain' AS analyzer, CAST(10 AS BIGINT) AS score, customer AS lens_uid, md5('chain' || chr(31) || customer || chr(31) || "order" || chr(31) || part) AS idempotency_key, customer, "order", part FROM hit)"""


@query(f"WITH {_SEEDED} SELECT * FROM chain")
def a_incremental_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyzers.run(CHAIN_ANALYZER, _updates(spark, sf_dir), graph(spark, sf_dir)).drop("lens_refs", "time_of_match")


@query(f"""WITH {_SEEDED} SELECT idempotency_key FROM chain WHERE "order" NOT IN (SELECT {_O} FROM orders WHERE o_orderstatus = 'F')""")
def a_idempotent_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits sent twice, of which those on finished orders were published before."""
    g = graph(spark, sf_dir)
    hits = analyzers.run(CHAIN_ANALYZER, _updates(spark, sf_dir), g)
    done = match.nodes(g, Node("Order").where("o_orderstatus", Eq("F"))).select(F.col("uid").alias("order"))
    return analyzers.new_hits(hits.unionByName(hits), hits.join(done, "order", "left_semi")).select("idempotency_key")


@query(
    f"""WITH {_SEEDED}, urgent AS (SELECT {uid_sql("Customer", "o_custkey")} AS lens_uid, {_O} AS k FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'
  AND ({_O} IN (SELECT uid FROM s) OR {uid_sql("Customer", "o_custkey")} IN (SELECT uid FROM s))),
every AS (SELECT 'chain' AS a, 10 AS score, lens_uid, idempotency_key AS k FROM chain UNION ALL SELECT 'urgent', 3, lens_uid, CAST(k AS VARCHAR) FROM urgent)
SELECT lens_uid, CAST(sum(score) AS BIGINT) AS risk, count(DISTINCT a) AS analyzers, count(*) AS hits FROM every GROUP BY lens_uid"""
)
def a_lens_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, u = graph(spark, sf_dir), _updates(spark, sf_dir)
    return analyzers.lens_risk(analyzers.run_many([CHAIN_ANALYZER, URGENT_ANALYZER], u, g))


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _many() -> list[analyzers.Analyzer]:
    """200 analyzers of three shapes: segments' orders by priority and status, priorities' parts by size, segments by nation."""
    out = []
    for segment in _SEGMENTS:
        for priority in _PRIORITIES:
            for status in "FOP":
                order = Node("Order", "order").where("o_orderpriority", Eq(priority)).where("o_orderstatus", Eq(status))
                out.append(analyzers.Analyzer(f"a {segment} {priority} {status}", Node("Customer", "customer").where("c_mktsegment", Eq(segment)).to("orders", order), score=2))
        for nation in range(15):
            out.append(analyzers.Analyzer(f"c {segment} NATION_{nation}", Node("Customer", "who").where("c_mktsegment", Eq(segment)).to("in_nation", Node("Nation", "where").where("n_name", Eq(f"NATION_{nation}"))), score=1, lens="where"))
    for priority in _PRIORITIES:
        for size in range(10):
            part = Node("Part", "part").where("p_size", Gt(5 * size), Lt(5 * size + 6))
            out.append(analyzers.Analyzer(f"b {priority} {size}", Node("Order", "order").where("o_orderpriority", Eq(priority)).to("contains_part", part), score=3, lens="part"))
    return out


def _many_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """_updates, and the segments of customers in debt."""
    none = F.lit(None).cast("bigint")
    customers = fixture.table(spark, sf_dir, "customer").where("c_acctbal < 0")
    segments = customers.select(F.lit("property").alias("kind"), fixture.uid("Customer", "c_custkey").alias("uid"), F.lit("c_mktsegment").alias("name"), none.alias("src"), none.alias("dst"))
    return _updates(spark, sf_dir).unionByName(segments)


@query(
    f"""WITH o AS (SELECT {_O} AS uid FROM orders WHERE {_NEW_ORDERS}), c AS (SELECT {uid_sql("Customer", "o_custkey")} AS uid FROM orders WHERE {_NEW_ORDERS}), d AS (SELECT {_C} AS uid FROM customer WHERE c_acctbal < 0),
a AS (SELECT 'a ' || c_mktsegment || ' ' || o_orderpriority || ' ' || o_orderstatus AS analyzer, 2 AS score, {_C} AS x, {_O} AS y, {_C} AS lens_uid FROM customer JOIN orders ON o_custkey = c_custkey
  WHERE o_orderstatus IN ('F', 'O', 'P') AND ({_O} IN (SELECT uid FROM o) OR {_C} IN (SELECT uid FROM c) OR {_C} IN (SELECT uid FROM d))),
b AS (SELECT DISTINCT 'b ' || o_orderpriority || ' ' || ((p_size - 1) // 5) AS analyzer, 3 AS score, {_O} AS x, {_P} AS y, {_P} AS lens_uid FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
  WHERE p_size BETWEEN 1 AND 50 AND {_O} IN (SELECT uid FROM o)),
n AS (SELECT 'c ' || c_mktsegment || ' ' || n_name AS analyzer, 1 AS score, {_C} AS x, {_N} AS y, {_N} AS lens_uid FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey < 15 AND {_C} IN (SELECT uid FROM d)),
every AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM n)
SELECT analyzer, CAST(score AS BIGINT) AS score, lens_uid, md5(analyzer || chr(31) || x || chr(31) || y) AS idempotency_key FROM every"""
)
def a_many_analyzers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of 200 analyzers in one plan: three walks, whatever their number."""
    hits = analyzers.run_many(_many(), _many_updates(spark, sf_dir), graph(spark, sf_dir))
    return hits.select("analyzer", "score", "lens_uid", "idempotency_key")


# What a change makes and ends: the graph of the tables is the new state.

def _before(spark: SparkSession, sf_dir: str) -> delta.GraphDelta:
    """Every seventh order was urgent, every eleventh part had no widget in its name; line 6 of orders is new, and every fifth order's first lines are gone."""
    g, o, line = graph(spark, sf_dir), fixture.table(spark, sf_dir, "orders"), fixture.table(spark, sf_dir, "lineitem")
    key = lambda t: F.col("uid") - fixture.CODES[t] * 10**12 - 1
    orders, parts = g.of_type("Order").where(key("Order") % 7 == 0), g.of_type("Part").where(key("Part") % 11 == 0)
    before = {"Order": orders.withColumn("o_orderpriority", F.lit("1-URGENT")), "Part": parts.withColumn("p_name", F.replace("p_name", F.lit("widget"), F.lit("thing")))}
    every = line.groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("first"))
    pairs = every.select(fixture.uid("Order", "l_orderkey").alias("src"), fixture.uid("Part", "l_partkey").alias("dst"), "first", "l_orderkey")
    gone = (F.col("first") == 1) & (F.col("l_orderkey") % 5 == 0)
    changes = pairs.where((F.col("first") == 6) | gone).select("src", "dst", (~gone).alias("added"))
    now = dict(g.edges) | {"contains_part": pairs.where(~gone).select("src", "dst")}
    new = Graph(g.tenant, g.nodes, now, g.reverse)
    return delta.GraphDelta(new, {t: d.select("uid") for t, d in before.items()}, before, {"contains_part": changes})


_STATE = """WITH e AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS first FROM lineitem GROUP BY l_orderkey, l_partkey),
new AS (SELECT {c} AS customer, {o} AS "order", {p} AS part FROM customer JOIN orders ON o_custkey = c_custkey JOIN e ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
  WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND o_orderpriority NOT IN ('5-LOW', '4-NOT SPECIFIED') AND contains(p_name, 'widget') AND NOT (first = 1 AND l_orderkey % 5 = 0)),
old AS (SELECT {c} AS customer, {o} AS "order", {p} AS part FROM customer JOIN orders ON o_custkey = c_custkey JOIN e ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
  WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND (o_orderkey % 7 = 0 OR o_orderpriority NOT IN ('5-LOW', '4-NOT SPECIFIED')) AND contains(p_name, 'widget') AND p_partkey % 11 <> 0 AND first <> 6)""".format(c=_C, o=_O, p=_P)


@query(f"{_STATE} SELECT 1 AS sign, * FROM (SELECT * FROM new EXCEPT SELECT * FROM old) UNION ALL SELECT -1, * FROM (SELECT * FROM old EXCEPT SELECT * FROM new)")
def a_delta_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches that changes of values and edges made, and those that they ended."""
    return delta.matches(_before(spark, sf_dir), CHAIN)


# Merges of edges.

@query(
    f"""WITH e AS (SELECT DISTINCT {_N} AS src, 'in_region' AS f, 'nations' AS r, {uid_sql("Region", "n_regionkey")} AS dst FROM nation UNION SELECT {_C}, 'in_nation', 'customers', {uid_sql("Nation", "c_nationkey")} FROM customer
UNION SELECT {_O}, 'placed_by', 'orders', {uid_sql("Customer", "o_custkey")} FROM orders)
SELECT 't0' AS tenant_id, src, f AS edge, dst FROM e UNION ALL SELECT 't0', dst, r, src FROM e"""
)
def m_reverse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    rows = [g.edge(e).select(F.lit(g.tenant).alias("tenant_id"), "src", F.lit(e).alias("edge"), "dst") for e in ("in_region", "in_nation", "placed_by")]
    return merge.add_reverse_edges(rows[0].unionByName(rows[1]).unionByName(rows[2]), fixture.REVERSE)


@query(f"SELECT DISTINCT 't0' AS tenant_id, {uid_sql('Order', 'l_orderkey')} AS src, 'contains_part' AS edge, {uid_sql('Part', 'l_partkey')} AS dst FROM lineitem UNION SELECT DISTINCT 't0', {uid_sql('Part', 'l_partkey')}, 'in_orders', {uid_sql('Order', 'l_orderkey')} FROM lineitem")
def m_edge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item writes its edge again."""
    rows = fixture.table(spark, sf_dir, "lineitem").select(F.lit(fixture.TENANT).alias("tenant_id"), fixture.uid("Order", "l_orderkey").alias("src"), F.lit("contains_part").alias("edge"), fixture.uid("Part", "l_partkey").alias("dst"))
    return merge.add_reverse_edges(rows, fixture.REVERSE)
