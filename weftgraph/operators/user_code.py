"""A user's Python for single events and single matches: generators and analyzers that no expression says.

The function sees one event, or one match with the properties that it asked for, and Spark deals the rows out to Arrow
batches. What it raises does not end the job: the row goes to quarantine with the error's text, and so does a subgraph
that does not hold together. User code is the slow path; what DataFrame functions can say belongs into those.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from weftgraph.operators.generators import EDGE, NODE
from weftgraph.operators.graph import Graph
from weftgraph.plans import match
from weftgraph.plans.pattern import Node
from weftgraph.session import ship_package

_MADE = f"tenant_id string, event_id bigint, nodes array<{NODE}>, edges array<{EDGE}>, error string"
_LONGEST_ERROR = 2000


class Described:
    """One event's subgraph, as its function builds it."""

    def __init__(self, tenant_id: str, event_id: int):
        self.tenant_id, self.event_id = tenant_id, event_id
        self.nodes: dict[str, dict] = {}
        self.edges: list[dict] = []

    def node(self, role: str, node_type: str, strings: dict[str, str] | None = None, numbers: dict[str, int] | None = None) -> str:
        """A node, and what edges call it by; a role twice in an event is an error."""
        key = f"{self.event_id}:{role}"
        if key in self.nodes:
            raise ValueError(f"two nodes are {role}")
        bag = lambda values, kind: [(str(k), kind(v)) for k, v in (values or {}).items() if v is not None]
        self.nodes[key] = {"node_key": key, "node_type": str(node_type), "strings": bag(strings, str), "numbers": bag(numbers, int)}
        return key

    def edge(self, src: str, name: str, dst: str) -> None:
        for end in (src, dst):
            if end not in self.nodes:
                raise ValueError(f"an edge {name} has no node {end}")
        self.edges.append({"src_key": src, "edge": str(name), "dst_key": dst})


def _told(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"[:_LONGEST_ERROR]


def generated(logs: DataFrame, describe: Callable[[str | None, Described], None]) -> DataFrame:
    """(tenant_id, event_id, nodes, edges, error) of logs (tenant_id, event_id, log_event).

    describe(text, event) builds the event's subgraph. One without nodes has none; error is null where it went well.
    """
    ship_package(logs.sparkSession)
    schema = to_arrow_schema(_parse_datatype_string(_MADE))

    def one(tenant: str, event_id: int, text: str | None) -> dict:
        out = Described(tenant, event_id)
        try:
            describe(text, out)
        except Exception as e:  # noqa: BLE001, whatever a user's code raises
            return {"tenant_id": tenant, "event_id": event_id, "nodes": None, "edges": None, "error": _told(e)}
        return {"tenant_id": tenant, "event_id": event_id, "nodes": list(out.nodes.values()), "edges": out.edges, "error": None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(*r) for r in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return logs.select("tenant_id", F.col("event_id").cast("bigint"), F.col("log_event").cast("string")).mapInArrow(run, _MADE)


def good(made: DataFrame) -> DataFrame:
    """(tenant_id, event_id, nodes, edges) of generated's rows that have a subgraph."""
    return made.where(F.col("error").isNull() & (F.size("nodes") > 0)).drop("error")


def failed(made: DataFrame) -> DataFrame:
    """(tenant_id, event_id, error) of those that went wrong."""
    return made.where("error is not null").select("tenant_id", "event_id", "error")


@dataclass(frozen=True)
class UserAnalyzer:
    """judge(match) of each match of a query: None if it is no hit, else its score, or (score, context).

    match: by role, its uid and the properties in `needs`, by name; what a node has not is None.
    """

    name: str
    query: Node
    judge: Callable[[dict[str, dict]], int | tuple[int, dict[str, str]] | None]
    needs: dict[str, list[str]] = field(default_factory=dict)


def judged(analyzer: UserAnalyzer, found: DataFrame, graph: Graph) -> DataFrame:
    """(analyzer, score, context, error, a column per role) of matches (a column per role): hits have a score, failures an error, others no row."""
    ship_package(found.sparkSession)
    pattern = match.compiled(graph, analyzer.query)
    roles = list(pattern.roles)
    rows = found
    for role, names in analyzer.needs.items():
        own = graph.of_type(pattern.roles[role].node_type).select(F.col("uid").alias(role), F.struct(*names).alias(f"_{role}"))
        rows = rows.join(own, role, "left")
    needed = [f"_{r}" for r in analyzer.needs]
    rows = rows.select(*roles, *needed)
    schema = f"{', '.join(f'`{r}` bigint' for r in roles)}, score bigint, context map<string,string>, error string"
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    judge, needs = analyzer.judge, analyzer.needs

    def one(row: dict) -> dict | None:
        own = {r: row[r] for r in roles}
        try:
            told = judge({r: {**dict.fromkeys(needs.get(r, ())), **(row.get(f"_{r}") or {}), "uid": row[r]} for r in roles})
            if told is None:
                return None
            score, context = told if isinstance(told, tuple) else (told, {})
            return {**own, "score": int(score), "context": [(str(k), str(v)) for k, v in context.items()], "error": None}
        except Exception as e:  # noqa: BLE001, whatever a user's code raises
            return {**own, "score": None, "context": None, "error": _told(e)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [r for r in map(one, batch.to_pylist()) if r is not None]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.mapInArrow(run, schema).select(F.lit(analyzer.name).alias("analyzer"), "score", "context", "error", *roles)
