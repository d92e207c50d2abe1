"""Queries of what users bring: their own Python, of which one row in ten goes wrong, and their own types."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import assemble, generators, merge, user_code
from weftgraph.plans import match
from weftgraph.plans.catalog_matches import _C, _CHAIN_FROM, _O, _P, CHAIN
from weftgraph.plans.registry import query
from weftgraph.schema import NodeType, Property, Schema, parse
from weftgraph.session import written
from weftgraph.sources import fixture


def _describe(text: str | None, event: user_code.Described) -> None:
    """A user's generator: who did what, from a line of JSON."""
    row = json.loads(text)
    if "user" not in row:
        raise KeyError("user")
    user = event.node("user", "User", {"name": f"u{row['user']}"}, {"events": 1})
    if row["type"] != "error":
        event.edge(user, "did", event.node("act", "Act", {"type": row["type"]}, {"cents": round(row["value"] * 100)}))


@query(
    """SELECT event_id, event_id || ':user' AS node_key, 'User' AS node_type, 'u' || user_id AS text, CAST(1 AS BIGINT) AS number, CASE WHEN event_type <> 'error' THEN event_id || ':act' END AS led_to, CAST(NULL AS VARCHAR) AS error FROM events WHERE event_id % 10 <> 3
UNION ALL SELECT event_id, event_id || ':act', 'Act', event_type, CAST(round(value * 100) AS BIGINT), NULL, NULL FROM events WHERE event_id % 10 <> 3 AND event_type <> 'error'
UNION ALL SELECT event_id, NULL, NULL, NULL, NULL, NULL, 'KeyError: ''user''' FROM events WHERE event_id % 10 = 3"""
)
def g_user_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subgraphs of a user's function, and the events that it raised an error for."""
    e = fixture.table(spark, sf_dir, "events")
    line = F.to_json(F.struct(F.when(F.col("event_id") % 10 != 3, F.col("user_id")).alias("user"), F.col("event_type").alias("type"), F.col("value")))
    made = written(user_code.generated(e.select(F.lit("t0").alias("tenant_id"), "event_id", line.alias("log_event")), _describe), "user-graphs")
    graphs = user_code.good(made)
    n = graphs.select("event_id", "edges", F.explode("nodes").alias("n"))
    to = F.get(F.filter("edges", lambda x: x["src_key"] == F.col("n.node_key")), F.lit(0))["dst_key"]
    nodes = n.select("event_id", "n.node_key", "n.node_type", F.coalesce(F.col("n.strings")["name"], F.col("n.strings")["type"]).alias("text"), F.coalesce(F.col("n.numbers")["events"], F.col("n.numbers")["cents"]).alias("number"), to.alias("led_to"))
    return nodes.unionByName(user_code.failed(made).select("event_id", "error"), allowMissingColumns=True)


def _judge(found: dict[str, dict]) -> tuple[int, dict[str, str]] | None:
    """A user's analyzer: dear orders of small parts; orders whose price ends in 7 are not understood."""
    cents, size = found["order"]["o_totalprice_cents"], found["part"]["p_size"]
    if cents % 10 == 7:
        raise ValueError(f"a price of {cents}")
    return (cents // 10000000, {"size": f"size {size}"}) if cents > 20000000 and size < 30 else None


DEAR = user_code.UserAnalyzer("dear", CHAIN, _judge, {"order": ["o_totalprice_cents"], "part": ["p_size"]})


@query(
    f"""WITH m AS (SELECT DISTINCT {_C} AS customer, {_O} AS "order", {_P} AS part, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, p_size FROM {_CHAIN_FROM})
SELECT 'dear' AS analyzer, cents // 10000000 AS score, 'size ' || p_size AS why, CAST(NULL AS VARCHAR) AS error, customer, "order", part FROM m WHERE cents % 10 <> 7 AND cents > 20000000 AND p_size < 30
UNION ALL SELECT 'dear', NULL, NULL, 'ValueError: a price of ' || cents, customer, "order", part FROM m WHERE cents % 10 = 7"""
)
def a_user_analyzer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a user's function with their context, and the matches that it raised an error for."""
    g = fixture.graph(spark, sf_dir)
    out = user_code.judged(DEAR, match.bindings(g, CHAIN), g)
    return out.select("analyzer", "score", F.col("context")["size"].alias("why"), "error", "customer", "order", "part")


def _line_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item describes its part: its name, the line as a first mention, sizes that lines make smaller or larger."""
    line, part = (fixture.table(spark, sf_dir, n) for n in ("lineitem", "part"))
    # Lines of one number in an order are one event; the one that stands first in its file is the first.
    rows = line.select("*", F.col("_metadata.row_index").alias("position")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    event = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    # A line without a number or an order has no place among the mentions.
    strings = F.create_map(F.lit("p_name"), F.col("p_name"), F.lit("status"), F.when(event.isNotNull(), F.col("l_linestatus")), F.lit("unknown"), F.lit("x"))
    numbers = F.create_map(F.lit("least"), F.col("p_size") - F.col("l_linenumber"), F.lit("most"), F.col("p_size") + F.col("l_linenumber")).cast("map<string,bigint>")
    return rows.select(F.lit("t0").alias("tenant_id"), event.alias("event_id"), "position", fixture.uid("Part", "l_partkey").alias("uid"), F.lit("Part").alias("node_type"), strings.alias("strings"), numbers.alias("numbers"))


#: One type in two pieces of schema text, and the same declared in Python.
_TEXT = """
type Part @node(identity_algorithm: "static") { p_name: String! @static_id  status: String @immutable }
type PartSizes @node(extends: "Part") { least: Int @decrement_only  most: Int @increment_only }
"""
_TYPES = Schema({"Part": NodeType("Part", "static", (Property("p_name", "immutable_string", True, "static_id"), Property("status", "immutable_string"), Property("least", "min_int"), Property("most", "max_int")))})


@query(
    """WITH l AS (SELECT CAST(5000000000001 + l_partkey AS BIGINT) AS uid, p_name, l_linestatus, p_size - l_linenumber AS a, p_size + l_linenumber AS b, l_orderkey * 8 + l_linenumber AS e FROM lineitem JOIN part ON p_partkey = l_partkey),
one AS (SELECT uid, 'p_name' AS field, 'immutable_string' AS kind, min(p_name) AS s, CAST(NULL AS BIGINT) AS n FROM l GROUP BY uid UNION ALL SELECT uid, 'status', 'immutable_string', arg_min(l_linestatus, e), NULL FROM l GROUP BY uid
  UNION ALL SELECT uid, 'least', 'min_int', NULL, CAST(min(a) AS BIGINT) FROM l GROUP BY uid UNION ALL SELECT uid, 'most', 'max_int', NULL, CAST(max(b) AS BIGINT) FROM l GROUP BY uid)
SELECT declared, uid, field, kind, s, n FROM one, (VALUES ('text'), ('python')) v(declared)"""
)
def m_extended_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged properties by the rules of a type that another one extends, and of the same type declared in Python; undeclared ones go."""
    nodes = _line_nodes(spark, sf_dir)
    both = [merge.merge_properties(assemble.property_writes(nodes, types)).select(F.lit(n).alias("declared"), "uid", "field", "kind", "s", "n") for n, types in (("text", parse(_TEXT)), ("python", _TYPES))]
    return both[0].unionByName(both[1])


@query("SELECT event_id, event_id || ':p' AS node_key, event_type AS name, '/bin/' || event_type AS path, least(user_id, event_id % 50) AS pid, CASE WHEN event_type = 'click' THEN CAST(7 AS BIGINT) END AS extra FROM events")
def g_merged_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two descriptions of one node in an event's graph are one node with what either says; of two values the least."""
    e = fixture.table(spark, sf_dir, "events")
    text = lambda **c: F.create_map(*[x for k, v in c.items() for x in (F.lit(k), v.cast("string"))])
    number = lambda **c: F.map_filter(F.create_map(*[x for k, v in c.items() for x in (F.lit(k), v.cast("bigint"))]), lambda _, v: v.isNotNull())
    key = [F.lit("t0").alias("tenant_id"), "event_id", F.concat(F.col("event_id").cast("string"), F.lit(":p")).alias("node_key"), F.lit("Process").alias("node_type")]
    one = e.select(*key, text(name=F.col("event_type")).alias("strings"), number(pid=F.col("user_id")).alias("numbers"))
    other = e.select(*key, text(path=F.concat(F.lit("/bin/"), "event_type")).alias("strings"), number(pid=F.col("event_id") % 50, extra=F.when(F.col("event_type") == "click", F.lit(7))).alias("numbers"))
    merged = generators.merged_nodes(one.unionByName(other))
    return merged.select("event_id", "node_key", F.col("strings")["name"].alias("name"), F.col("strings")["path"].alias("path"), F.col("numbers")["pid"].alias("pid"), F.col("numbers")["extra"].alias("extra"))
