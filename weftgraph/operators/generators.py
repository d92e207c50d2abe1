"""From parsed log events to described subgraphs: per event an array of nodes and an array of edges, no shuffle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import parsing as P

NODE = "struct<node_key:string,node_type:string,strings:map<string,string>,numbers:map<string,bigint>>"
EDGE = "struct<src_key:string,edge:string,dst_key:string>"


def _key(role: str) -> Column:
    return F.concat(F.col("event_id").cast("string"), F.lit(f":{role}"))


def node(role: str, node_type: str, strings: dict[str, Column], numbers: dict[str, Column] | None = None) -> Column:
    """A described node; absent values are left out."""
    def bag(values: dict[str, Column], kind: str) -> Column:
        whole = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast(kind))]).cast(f"map<string,{kind}>")
        return F.map_filter(whole, lambda _, v: v.isNotNull())

    return F.struct(_key(role).alias("node_key"), F.lit(node_type).alias("node_type"), bag(strings, "string").alias("strings"), bag(numbers or {}, "bigint").alias("numbers")).cast(NODE)


def edge(src: str, name: str, dst: str) -> Column:
    return F.struct(_key(src).alias("src_key"), F.lit(name).alias("edge"), _key(dst).alias("dst_key")).cast(EDGE)


@dataclass(frozen=True)
class Rule:
    """Which rows of a log have a subgraph, and its nodes and edges; nulls among them are left out."""

    fits: Column
    nodes: list[Column]
    edges: list[Column]


def subgraphs(rows: DataFrame, *rules: Rule) -> DataFrame:
    """(tenant_id, event_id, nodes, edges) of the rows that a rule fits, in one pass; of several rules the first counts."""
    if len(rules) == 1:
        return rows.where(rules[0].fits).select("tenant_id", "event_id", *[F.array_compact(F.array(*x)).cast(f"array<{kind}>").alias(n) for n, x, kind in (("nodes", rules[0].nodes, NODE), ("edges", rules[0].edges, EDGE))])
    fits, nodes, edges = F.lit(False), F.lit(None).cast(f"array<{NODE}>"), F.lit(None).cast(f"array<{EDGE}>")
    for r in reversed(rules):
        fits = F.coalesce(r.fits, F.lit(False)) | fits
        nodes = F.when(r.fits, F.array_compact(F.array(*r.nodes))).otherwise(nodes)
        edges = F.when(r.fits, F.array_compact(F.array(*r.edges))).otherwise(edges)
    return rows.where(fits).select("tenant_id", "event_id", nodes.alias("nodes"), edges.alias("edges"))


def _asset(host: Column) -> Column:
    return node("asset", "Asset", {"asset_id": host, "hostname": host})


def _text(name: str) -> Column:
    return F.col("data")[name]


#: The header's fields that the generators read.
HEADER = ("event_id", "computer")


def _timed(events: DataFrame, *times: str) -> DataFrame:
    """events with times that several nodes of one read, by the name of their field."""
    return P.computed_once(events, **{f"_{n}": P.utc_ms(_text(n)) for n in times})


def _process_create() -> Rule:
    host, t = F.col("system.computer"), F.col("_UtcTime")
    nodes = [
        _asset(host),
        node("parent", "Process", {"asset_id": host, "process_name": P.image_name(_text("ParentImage")), "process_command_line": _text("ParentCommandLine")}, {"process_id": P.integer(_text("ParentProcessId")), "last_seen_timestamp": t}),
        node("child", "Process", {"asset_id": host, "process_name": P.image_name(_text("Image")), "process_command_line": _text("CommandLine")}, {"process_id": P.integer(_text("ProcessId")), "created_timestamp": t}),
        node("exe", "File", {"asset_id": host, "file_path": P.strip_zone(_text("Image"))}, {"last_seen_timestamp": t}),
    ]
    edges = [edge("parent", "process_asset", "asset"), edge("child", "process_asset", "asset"), edge("child", "binary_file", "exe"), edge("asset", "files_on_asset", "exe"), edge("parent", "children", "child")]
    return Rule(F.col("system.event_id") == 1, nodes, edges)


def _file_create() -> Rule:
    host, t = F.col("system.computer"), F.col("_CreationUtcTime")
    nodes = [
        _asset(host),
        node("creator", "Process", {"asset_id": host, "process_name": P.image_name(_text("Image"))}, {"process_id": P.integer(_text("ProcessId")), "last_seen_timestamp": t}),
        node("file", "File", {"asset_id": host, "file_path": P.strip_zone(_text("TargetFilename"))}, {"created_timestamp": t}),
    ]
    return Rule(F.col("system.event_id") == 11, nodes, [edge("creator", "process_asset", "asset"), edge("creator", "created_files", "file"), edge("asset", "files_on_asset", "file")])


def _outbound_connection() -> Rule:
    """Only connections that the host initiated."""
    host, t, protocol = F.col("system.computer"), F.col("_UtcTime"), _text("Protocol")
    src, dst = P.ip(_text("SourceIp")), P.ip(_text("DestinationIp"))
    src_port, dst_port = P.integer(_text("SourcePort")), P.integer(_text("DestinationPort"))
    nodes = [
        _asset(host),
        node("process", "Process", {"asset_id": host}, {"process_id": P.integer(_text("ProcessId")), "last_seen_timestamp": t}),
        node("outbound", "ProcessOutboundConnection", {"asset_id": host, "hostname": host, "ip_address": src, "protocol": protocol}, {"port": src_port, "created_timestamp": t}),
        node("src_ip", "IpAddress", {"ip_address": src}, {"last_seen_timestamp": t}),
        node("dst_ip", "IpAddress", {"ip_address": dst}, {"last_seen_timestamp": t}),
        node("src_port", "IpPort", {"ip_address": src, "protocol": protocol}, {"port": src_port}),
        node("dst_port", "IpPort", {"ip_address": dst, "protocol": protocol}, {"port": dst_port}),
        node("network", "NetworkConnection", {"src_ip_address": src, "dst_ip_address": dst, "protocol": protocol}, {"src_port": src_port, "dst_port": dst_port, "created_timestamp": t}),
        node("ip", "IpConnection", {"src_ip_address": src, "dst_ip_address": dst, "protocol": protocol}, {"created_timestamp": t}),
    ]
    edges = [
        edge("asset", "asset_ip", "src_ip"),
        edge("asset", "asset_processes", "process"),
        edge("process", "created_connections", "outbound"),
        edge("outbound", "connected_over", "src_port"),
        edge("outbound", "connected_to", "dst_port"),
        edge("src_ip", "ip_connections", "ip"),
        edge("dst_ip", "ip_connections", "ip"),
        edge("src_port", "network_connections", "network"),
        edge("dst_port", "network_connections", "network"),
    ]
    return Rule((F.col("system.event_id") == 3) & P.boolean(_text("Initiated")), nodes, edges)


def process_create(events: DataFrame) -> DataFrame:
    return subgraphs(_timed(events, "UtcTime"), _process_create())


def file_create(events: DataFrame) -> DataFrame:
    return subgraphs(_timed(events, "CreationUtcTime"), _file_create())


def outbound_connection(events: DataFrame) -> DataFrame:
    return subgraphs(_timed(events, "UtcTime"), _outbound_connection())


def sysmon(events: DataFrame) -> DataFrame:
    """Every event that has a generator; others give no subgraph."""
    return subgraphs(_timed(events, "UtcTime", "CreationUtcTime"), _process_create(), _file_create(), _outbound_connection())


def _column(name: str) -> Column:
    return F.col("columns")[name]


def _osquery_processes() -> Rule:
    host, name = F.col("host"), F.coalesce(_column("name"), F.lit(""))
    start = P.integer(_column("time"))
    t = F.when(start == -1, F.col("unix_ms")).otherwise(P.in_ms(start))
    path, parent = _column("path"), P.integer(_column("parent"))
    has_file, has_parent = F.coalesce(path != "", F.lit(False)), F.coalesce(parent >= 0, F.lit(False))
    nodes = [
        _asset(host),
        node("child", "Process", {"asset_id": host, "process_name": name}, {"process_id": P.integer(_column("pid")), "created_timestamp": t, "last_seen_timestamp": t}),
        F.when(has_file, node("exe", "File", {"asset_id": host, "file_path": path}, {"last_seen_timestamp": t})),
        F.when(has_parent, node("parent", "Process", {"asset_id": host}, {"process_id": parent, "last_seen_timestamp": t})),
    ]
    edges = [
        F.when(has_file, edge("child", "binary_file", "exe")),
        F.when(has_file, edge("asset", "files_on_asset", "exe")),
        F.when(has_parent, edge("parent", "children", "child")),
        F.when(has_parent, edge("asset", "asset_processes", "parent")),
        edge("asset", "asset_processes", "child"),
    ]
    return Rule(F.col("pack") == "processes", nodes, edges)


def _osquery_files() -> Rule:
    host, t, action = F.col("host"), P.in_ms(P.integer(_column("time"))), _column("action")
    times = {"created_timestamp": F.when(action.isin("CREATED", "MOVED_FROM"), t), "terminated_timestamp": F.when(action.isin("DELETED", "MOVED_TO"), t), "last_seen_timestamp": t}
    return Rule(F.col("pack") == "files", [_asset(host), node("file", "File", {"asset_id": host, "file_path": _column("target_path")}, times)], [edge("asset", "files_on_asset", "file")])


def _osquery_process_files() -> Rule:
    host, t, action = F.col("host"), F.col("unix_ms"), F.col("action")
    other = ~F.coalesce(action.isin("added", "removed"), F.lit(False))
    times = {"created_timestamp": F.when(action == "added", t), "terminated_timestamp": F.when(action == "removed", t), "last_seen_timestamp": F.when(other, t)}
    nodes = [_asset(host), node("process", "Process", {"asset_id": host}, {"process_id": P.integer(_column("pid")), "last_seen_timestamp": t}), node("file", "File", {"asset_id": host, "file_path": _column("path")}, times)]
    edges = [F.when(action == "added", edge("process", "created_files", "file")), F.when(action == "removed", edge("process", "deleted_files", "file")), edge("asset", "files_on_asset", "file"), edge("asset", "asset_processes", "process")]
    return Rule(F.col("pack") == "process-files", nodes, edges)


def osquery_processes(lines: DataFrame) -> DataFrame:
    return subgraphs(lines, _osquery_processes())


def osquery_files(lines: DataFrame) -> DataFrame:
    return subgraphs(lines, _osquery_files())


def osquery_process_files(lines: DataFrame) -> DataFrame:
    return subgraphs(lines, _osquery_process_files())


def osquery(lines: DataFrame) -> DataFrame:
    return subgraphs(lines, _osquery_processes(), _osquery_files(), _osquery_process_files())


#: Generators by event source kind; each takes raw logs (tenant_id, event_id, log_event).
GENERATORS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_generator(name: str, run: Callable[[DataFrame], DataFrame]) -> None:
    """A user's generator: raw logs to (tenant_id, event_id, nodes, edges)."""
    GENERATORS[name] = run


def _builtin() -> None:
    from weftgraph.sources import osquery as osquery_source
    from weftgraph.sources import sysmon as sysmon_source

    register_generator("sysmon", lambda logs: sysmon(sysmon_source.parse(logs, header=HEADER)))
    register_generator("osquery", lambda logs: osquery(osquery_source.parse(logs)))


_builtin()


def nodes_of(graphs: DataFrame) -> DataFrame:
    """(tenant_id, event_id, node_key, node_type, strings, numbers)."""
    return graphs.select("tenant_id", "event_id", F.explode("nodes").alias("n")).select("tenant_id", "event_id", "n.*")


def merged_nodes(nodes: DataFrame) -> DataFrame:
    """nodes_of's rows, those of one node_key as one: of a property that several give, the least value."""
    keys = ["tenant_id", "event_id", "node_key", "node_type"]
    kinds = {"strings": "string", "numbers": "bigint"}

    def entries(bag: str) -> Column:
        values = lambda e: [(e["value"] if k == bag else F.lit(None)).cast(kind).alias(k) for k, kind in kinds.items()]
        return F.transform(F.map_entries(bag), lambda e: F.struct(F.lit(bag).alias("bag"), e["key"].alias("name"), *values(e)))

    bags = nodes.select(*keys, F.explode_outer(F.concat(*[entries(b) for b in kinds])).alias("p"))
    least = bags.groupBy(*keys, "p.bag", "p.name").agg(*[F.min(f"p.{k}").alias(k) for k in kinds])
    return least.groupBy(*keys).agg(*[F.map_from_entries(F.collect_list(F.when(F.col("bag") == k, F.struct("name", k)))).alias(k) for k in kinds])


def edges_of(graphs: DataFrame) -> DataFrame:
    """(tenant_id, event_id, src_key, edge, dst_key), none from a node to itself."""
    return graphs.select("tenant_id", "event_id", F.explode("edges").alias("e")).select("tenant_id", "event_id", "e.*").where("src_key <> dst_key")
