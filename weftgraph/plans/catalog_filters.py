"""Queries of property filters: one role, the whole graph."""

from __future__ import annotations

from weftgraph.functions.predicates import Contains, DistanceLt, EndsWith, Eq, Ge, Gt, Has, Le, Lt, Regex, StartsWith
from weftgraph.plans import match
from weftgraph.plans.pattern import Node
from weftgraph.plans.registry import query
from weftgraph.sources.fixture import graph, uid_sql

_PART = f"SELECT {uid_sql('Part', 'p_partkey')} AS uid"
_CUSTOMER = f"SELECT {uid_sql('Customer', 'c_custkey')} AS uid"
_CENTS = "CAST(round(c_acctbal * 100) AS BIGINT)"


def _filter(name: str, node: Node, sql: str) -> None:
    query(sql, name)(lambda spark, sf_dir: match.nodes(graph(spark, sf_dir), node))


_filter("f_eq", Node("Part").where("p_brand", Eq("Brand#13")), f"{_PART}, p_brand FROM part WHERE p_brand = 'Brand#13'")
_filter("f_contains", Node("Part").where("p_name", Contains("widget")), f"{_PART}, p_name FROM part WHERE contains(p_name, 'widget')")
_filter("f_regex", Node("Part").where("p_name", Regex("^(red|blue) .*t$")), f"{_PART}, p_name FROM part WHERE regexp_matches(p_name, '^(red|blue) .*t$')")
_filter("f_starts_with", Node("Part").where("p_name", StartsWith("small ")), f"{_PART}, p_name FROM part WHERE starts_with(p_name, 'small ')")
_filter("f_ends_with", Node("Part").where("p_name", EndsWith("bolt")), f"{_PART}, p_name FROM part WHERE ends_with(p_name, 'bolt')")
_filter("f_distance_lt", Node("Part").where("p_name", DistanceLt("red bolt", 4)), f"{_PART}, p_name FROM part WHERE levenshtein(p_name, 'red bolt') < 4")
_filter("f_has", Node("Part").where("p_type", Has()), f"{_PART}, p_type FROM part WHERE p_type IS NOT NULL")
_filter("f_not_eq", Node("Part").where("p_type", ~Eq("ECONOMY"), ~Eq("SMALL")), f"{_PART}, p_type FROM part WHERE p_type IS NOT NULL AND p_type <> 'ECONOMY' AND p_type <> 'SMALL'")
_filter(
    "f_dnf",
    Node("Part").where("p_name", StartsWith("red"), EndsWith("gear")).where("p_name", Contains("ring")).where("p_brand", ~Eq("Brand#1")),
    f"{_PART}, p_name, p_brand FROM part WHERE ((starts_with(p_name, 'red') AND ends_with(p_name, 'gear')) OR contains(p_name, 'ring')) AND p_brand <> 'Brand#1'",
)
_filter("f_missing_negated", Node("Customer").where("c_mktsegment", ~Contains("BUILD")), f"{_CUSTOMER}, c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL AND NOT contains(c_mktsegment, 'BUILD')")
_filter("f_int_eq", Node("Part").where("p_size", Eq(15)), f"{_PART}, CAST(p_size AS BIGINT) AS p_size FROM part WHERE p_size = 15")
_filter("f_int_range", Node("Customer").where("c_acctbal_cents", Ge(0), Lt(250000)).where("c_acctbal_cents", Gt(900000), Le(950000)), f"{_CUSTOMER}, {_CENTS} AS c_acctbal_cents FROM customer WHERE ({_CENTS} >= 0 AND {_CENTS} < 250000) OR ({_CENTS} > 900000 AND {_CENTS} <= 950000)")
_filter("f_int_not", Node("Part").where("p_size", ~Gt(10), ~Eq(3)), f"{_PART}, CAST(p_size AS BIGINT) AS p_size FROM part WHERE NOT p_size > 10 AND p_size <> 3")
_filter("f_uid_in", Node("Part").with_uid(5000000000001, 5000000000004, 6000000000001), f"{_PART} FROM part WHERE p_partkey IN (0, 3)")
_filter("f_node_type", Node("Supplier"), f"SELECT {uid_sql('Supplier', 's_suppkey')} AS uid FROM supplier")
_filter("f_empty", Node("Part").none_of("p_name"), f"{_PART}, p_name FROM part WHERE false")

# Over tables with missing values.

_GAPPY_CUSTOMER = "(SELECT * REPLACE (CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS c_mktsegment) FROM customer)"
_GAPPY_PART = "(SELECT * REPLACE (CASE WHEN p_partkey % 5 <> 0 THEN p_size END AS p_size) FROM part)"


def _gappy(name: str, node: Node, sql: str) -> None:
    query(sql, name)(lambda spark, sf_dir: match.nodes(graph(spark, sf_dir, with_gaps=True), node))


_gappy("f_not_has", Node("Customer").where("c_mktsegment", ~Has()), f"{_CUSTOMER}, c_mktsegment FROM {_GAPPY_CUSTOMER} WHERE c_mktsegment IS NULL")
_gappy("f_has_gaps", Node("Customer").where("c_mktsegment", Has()), f"{_CUSTOMER}, c_mktsegment FROM {_GAPPY_CUSTOMER} WHERE c_mktsegment IS NOT NULL")
_gappy("f_not_eq_gaps", Node("Customer").where("c_mktsegment", ~Eq("BUILDING")), f"{_CUSTOMER}, c_mktsegment FROM {_GAPPY_CUSTOMER} WHERE c_mktsegment <> 'BUILDING'")
_gappy("f_has_or_eq_gaps", Node("Customer").where("c_mktsegment", ~Has()).where("c_mktsegment", Eq("BUILDING")), f"{_CUSTOMER}, c_mktsegment FROM {_GAPPY_CUSTOMER} WHERE c_mktsegment IS NULL OR c_mktsegment = 'BUILDING'")
_gappy("f_int_not_gaps", Node("Part").where("p_size", ~Gt(10)), f"{_PART}, CAST(p_size AS BIGINT) AS p_size FROM {_GAPPY_PART} WHERE NOT p_size > 10")
_gappy("f_int_presence_gaps", Node("Part").where("p_size", ~Has()), f"{_PART}, CAST(p_size AS BIGINT) AS p_size FROM {_GAPPY_PART} WHERE p_size IS NULL")
