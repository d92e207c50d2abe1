"""Queries from log text to subgraphs and identified graphs, over payloads made of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import parsing as P
from weftgraph.functions.predicates import Eq
from weftgraph.operators import analyzers, assemble, generators, identity
from weftgraph.operators.graph import Graph
from weftgraph.plans.pattern import Node
from weftgraph.plans.registry import key_sql, query
from weftgraph.schema import endpoint_schema
from weftgraph.session import spread, written
from weftgraph.sources import fixture, osquery, sysmon

_MS = "(epoch_us(ts) // 1000)"
_SEC = "CAST(floor(epoch(ts)) AS BIGINT)"
_HOST = "('HOST-' || (user_id % 7))"
_OHOST = "('host-' || (user_id % 7))"
_ASSET = "'asset_id=' || {0} || ';hostname=' || {0}"
_SRC = "('10.0.0.' || (user_id % 250))"
_DST = "93.184.216.34"


def _props(strings: Column, numbers: Column) -> Column:
    """Properties as sorted text, for comparison."""
    both = [F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))) for m in (strings, numbers)]
    return F.array_join(F.array_sort(F.concat(*both)), ";")


def _nodes(graphs: DataFrame) -> DataFrame:
    return generators.nodes_of(graphs).select("event_id", F.element_at(F.split("node_key", ":"), -1).alias("role"), "node_type", _props(F.col("strings"), F.col("numbers")).alias("props"))


def _edges(graphs: DataFrame) -> DataFrame:
    ends = [F.element_at(F.split(c, ":"), -1).alias(c.removesuffix("_key")) for c in ("src_key", "dst_key")]
    return generators.edges_of(graphs).select("event_id", ends[0], "edge", ends[1])


def _sql_nodes(rows: list[tuple[str, str, str] | tuple[str, str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT event_id, '{r[0]}' AS role, '{r[1]}' AS node_type, {r[2]} AS props FROM events WHERE {r[3] if len(r) > 3 else 'true'}" for r in rows)


def _sysmon(spark: SparkSession, sf_dir: str, kind: int | Column) -> DataFrame:
    return sysmon.parse(fixture.sysmon_logs(spread(fixture.table(spark, sf_dir, "events")), kind))


def _osquery(spark: SparkSession, sf_dir: str, pack: str) -> DataFrame:
    return osquery.parse(fixture.osquery_logs(spread(fixture.table(spark, sf_dir, "events")), pack))


_CREATE_NODES = [
    ("asset", "Asset", _ASSET.format(_HOST)),
    ("parent", "Process", f"'asset_id=' || {_HOST} || ';last_seen_timestamp=' || {_MS} || ';process_command_line=svchost -k;process_id=' || (user_id + 1) || ';process_name=svchost.exe'"),
    ("child", "Process", f"'asset_id=' || {_HOST} || ';created_timestamp=' || {_MS} || ';process_command_line=' || event_type || ' & ' || event_id || ';process_id=' || user_id || ';process_name=' || event_type || '.exe'"),
    ("exe", "File", f"'asset_id=' || {_HOST} || ';file_path=C:\\bin\\' || event_type || '.exe;last_seen_timestamp=' || {_MS}"),
]
_CREATE_EDGES = "('parent', 'process_asset', 'asset'), ('child', 'process_asset', 'asset'), ('child', 'binary_file', 'exe'), ('asset', 'files_on_asset', 'exe'), ('parent', 'children', 'child')"
_FILE_NODES = [
    ("asset", "Asset", _ASSET.format(_HOST)),
    ("creator", "Process", f"'asset_id=' || {_HOST} || ';last_seen_timestamp=' || {_MS} || ';process_id=' || user_id || ';process_name=' || event_type || '.exe'"),
    ("file", "File", f"'asset_id=' || {_HOST} || ';created_timestamp=' || {_MS} || ';file_path=C:\\tmp\\f' || event_id"),
]
_FILE_EDGES = "('creator', 'process_asset', 'asset'), ('creator', 'created_files', 'file'), ('asset', 'files_on_asset', 'file')"
_PORT = "(event_id % 60000)"
_OUT_NODES = [
    ("asset", "Asset", _ASSET.format(_HOST)),
    ("process", "Process", f"'asset_id=' || {_HOST} || ';last_seen_timestamp=' || {_MS} || ';process_id=' || user_id"),
    ("outbound", "ProcessOutboundConnection", f"'asset_id=' || {_HOST} || ';created_timestamp=' || {_MS} || ';hostname=' || {_HOST} || ';ip_address=' || {_SRC} || ';port=' || {_PORT} || ';protocol=tcp'"),
    ("src_ip", "IpAddress", f"'ip_address=' || {_SRC} || ';last_seen_timestamp=' || {_MS}"),
    ("dst_ip", "IpAddress", f"'ip_address={_DST};last_seen_timestamp=' || {_MS}"),
    ("src_port", "IpPort", f"'ip_address=' || {_SRC} || ';port=' || {_PORT} || ';protocol=tcp'"),
    ("dst_port", "IpPort", f"'ip_address={_DST};port=443;protocol=tcp'"),
    ("network", "NetworkConnection", f"'created_timestamp=' || {_MS} || ';dst_ip_address={_DST};dst_port=443;protocol=tcp;src_ip_address=' || {_SRC} || ';src_port=' || {_PORT}"),
    ("ip", "IpConnection", f"'created_timestamp=' || {_MS} || ';dst_ip_address={_DST};protocol=tcp;src_ip_address=' || {_SRC}"),
]
_OUT_EDGES = "('asset', 'asset_ip', 'src_ip'), ('asset', 'asset_processes', 'process'), ('process', 'created_connections', 'outbound'), ('outbound', 'connected_over', 'src_port'), ('outbound', 'connected_to', 'dst_port'), ('src_ip', 'ip_connections', 'ip'), ('dst_ip', 'ip_connections', 'ip'), ('src_port', 'network_connections', 'network'), ('dst_port', 'network_connections', 'network')"
_OUT = "event_type = 'click'"


def _sql_edges(edges: str, where: str = "true") -> str:
    return f"SELECT event_id, src, edge, dst FROM events, (VALUES {edges}) v(src, edge, dst) WHERE {where}"


@query(_sql_nodes(_CREATE_NODES))
def g_process_create_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(generators.process_create(_sysmon(spark, sf_dir, 1)))


@query(_sql_edges(_CREATE_EDGES))
def g_process_create_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(generators.process_create(_sysmon(spark, sf_dir, 1)))


@query(_sql_nodes(_FILE_NODES))
def g_file_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(generators.file_create(_sysmon(spark, sf_dir, 11)))


@query(_sql_edges(_FILE_EDGES))
def g_file_create_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(generators.file_create(_sysmon(spark, sf_dir, 11)))


@query(_sql_nodes([(*n, _OUT) for n in _OUT_NODES]))
def g_network_outbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(generators.outbound_connection(_sysmon(spark, sf_dir, 3)))


@query(_sql_edges(_OUT_EDGES, _OUT))
def g_network_outbound_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(generators.outbound_connection(_sysmon(spark, sf_dir, 3)))


_START = f"({_SEC} * 1000)"


@query(
    _sql_nodes(
        [
            ("asset", "Asset", _ASSET.format(_OHOST)),
            ("child", "Process", f"'asset_id=' || {_OHOST} || ';created_timestamp=' || {_START} || ';last_seen_timestamp=' || {_START} || ';process_id=' || user_id || ';process_name=' || event_type"),
            ("exe", "File", f"'asset_id=' || {_OHOST} || ';file_path=/bin/' || event_type || ';last_seen_timestamp=' || {_START}", "event_type <> 'view'"),
            ("parent", "Process", f"'asset_id=' || {_OHOST} || ';last_seen_timestamp=' || {_START} || ';process_id=' || (user_id + 1)", "event_type <> 'error'"),
        ]
    )
)
def g_osquery_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(generators.osquery_processes(_osquery(spark, sf_dir, "processes")))


@query(
    _sql_nodes(
        [
            ("asset", "Asset", _ASSET.format(_OHOST)),
            ("file", "File", f"'asset_id=' || {_OHOST} || CASE WHEN event_type IN ('signup', 'purchase') THEN ';created_timestamp=' || {_START} ELSE '' END || ';file_path=/tmp/' || event_id || ';last_seen_timestamp=' || {_START} || CASE WHEN event_type IN ('click', 'error') THEN ';terminated_timestamp=' || {_START} ELSE '' END"),
        ]
    )
)
def g_osquery_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(generators.osquery_files(_osquery(spark, sf_dir, "files")))


@query(_sql_edges("('asset', 'asset_processes', 'child')") + " UNION ALL " + _sql_edges("('child', 'binary_file', 'exe'), ('asset', 'files_on_asset', 'exe')", "event_type <> 'view'") + " UNION ALL " + _sql_edges("('parent', 'children', 'child'), ('asset', 'asset_processes', 'parent')", "event_type <> 'error'"))
def g_osquery_process_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(generators.osquery_processes(_osquery(spark, sf_dir, "processes")))


@query(_sql_edges("('asset', 'files_on_asset', 'file')"))
def g_osquery_file_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(generators.osquery_files(_osquery(spark, sf_dir, "files")))


@query(
    _sql_nodes(
        [
            ("asset", "Asset", _ASSET.format(_OHOST)),
            ("process", "Process", f"'asset_id=' || {_OHOST} || ';last_seen_timestamp=' || {_START} || ';process_id=' || user_id"),
            ("file", "File", f"'asset_id=' || {_OHOST} || CASE WHEN event_type = 'signup' THEN ';created_timestamp=' || {_START} ELSE '' END || ';file_path=/tmp/' || event_id || CASE WHEN event_type NOT IN ('signup', 'click') THEN ';last_seen_timestamp=' || {_START} ELSE '' END || CASE WHEN event_type = 'click' THEN ';terminated_timestamp=' || {_START} ELSE '' END"),
        ]
    )
)
def g_osquery_process_file_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(generators.osquery_process_files(_osquery(spark, sf_dir, "process-files")))


@query(
    "SELECT event_id, 'asset' AS src, 'files_on_asset' AS edge, 'file' AS dst FROM events UNION ALL SELECT event_id, 'asset', 'asset_processes', 'process' FROM events UNION ALL SELECT event_id, 'process', CASE event_type WHEN 'signup' THEN 'created_files' ELSE 'deleted_files' END, 'file' FROM events WHERE event_type IN ('signup', 'click')"
)
def g_osquery_process_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(generators.osquery_process_files(_osquery(spark, sf_dir, "process-files")))


_KIND = "CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 11 WHEN 'click' THEN 3 WHEN 'purchase' THEN 5 ELSE 99 END"


def _where(nodes: list, where: str) -> str:
    return _sql_nodes([(*n[:3], where) for n in nodes])


@query(" UNION ALL ".join([_where(_CREATE_NODES, "event_type = 'signup'"), _where(_FILE_NODES, "event_type = 'view'"), _where(_OUT_NODES, _OUT)]))
def g_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind of event to its generator, in one pass; kinds without one give nothing."""
    return _nodes(generators.sysmon(_sysmon(spark, sf_dir, F.expr(_KIND))))


@query(" UNION ALL ".join([_sql_edges(_CREATE_EDGES, "event_type = 'signup'"), _sql_edges(_FILE_EDGES, "event_type = 'view'"), _sql_edges(_OUT_EDGES, _OUT)]))
def g_dispatch_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(generators.sysmon(_sysmon(spark, sf_dir, F.expr(_KIND))))


@query("SELECT event_id, 'note' AS role, 'Note' AS node_type, 'text=' || event_type || ';value=' || event_id AS props FROM events")
def g_own_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's generator of one event kind, beside the built-in ones."""
    plain = fixture.table(spark, sf_dir, "events").select(F.lit(fixture.TENANT).alias("tenant_id"), "event_id", F.to_json(F.struct("event_type", "event_id")).alias("log_event"))

    def notes(logs: DataFrame) -> DataFrame:
        j = F.from_json("log_event", "event_type string, event_id bigint")
        return generators.subgraphs(logs, generators.Rule(F.lit(True), [generators.node("note", "Note", {"text": j["event_type"]}, {"value": j["event_id"]})], []))

    generators.register_generator("notes", notes)
    return _nodes(generators.GENERATORS["notes"](plain))


@query(f"SELECT event_id, CASE {_KIND} WHEN 1 THEN 'ProcessCreation' WHEN 11 THEN 'FileCreate' WHEN 3 THEN 'NetworkConnection' WHEN 5 THEN 'ProcessTerminated' ELSE 'Unknown' END AS event_name, {_HOST} AS computer, CAST(9223372036854775808 AS DECIMAL(20,0)) AS keywords, '5770385f-c22a-43e0-bf4c-06f5698ffbd9' AS provider_guid, CASE {_KIND} WHEN 99 THEN 0 ELSE 15 END AS n_fields FROM events")
def x_sysmon_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sysmon(spark, sf_dir, F.expr(_KIND)).select("event_id", "event_name", "system.computer", "system.keywords", "system.provider_guid", F.size("data").alias("n_fields"))


@query(f"SELECT event_id, CASE {_KIND} WHEN 99 THEN 'Unsupported' WHEN 1 THEN 'ProcessCreation' WHEN 11 THEN 'FileCreate' WHEN 3 THEN 'NetworkConnection' ELSE 'ProcessTerminated' END AS payload FROM events")
def x_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sysmon(spark, sf_dir, F.expr(_KIND)).select("event_id", "payload")


@query(
    f"""SELECT event_id, 'Sysmon' AS provider_name, '5770385f-c22a-43e0-bf4c-06f5698ffbd9' AS provider_guid, CAST(1 AS BIGINT) AS kind, CAST(5 AS BIGINT) AS version, CAST(4 AS BIGINT) AS level, CAST(1 AS BIGINT) AS task, CAST(0 AS BIGINT) AS opcode,
CAST(9223372036854775808 AS DECIMAL(20,0)) AS keywords, {_MS} AS time_created, CAST(event_id AS DECIMAL(20,0)) AS event_record_id, 'a-' || event_id AS activity_id, CAST(NULL AS VARCHAR) AS related_activity_id, CAST(user_id AS BIGINT) AS process_id, event_id % 97 AS thread_id,
'Microsoft-Windows-Sysmon/Operational' AS channel, {_HOST} AS computer, 'S-1-5-18' AS user_id FROM events"""
)
def x_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of the header."""
    logs = fixture.sysmon_logs(spread(fixture.table(spark, sf_dir, "events")), 1, whole_header=True)
    return sysmon.parse(logs).select("event_id", "system.*", F.col("system.event_id").alias("kind")).drop("event_id").withColumn("event_id", F.col("event_record_id").cast("bigint"))


_MISSING = "('Version'), ('Level'), ('Task'), ('Opcode'), ('SystemTime'), ('EventRecordID'), ('ProcessID'), ('ThreadID'), ('ProcessGuid'), ('SourceIsIpv6'), ('DestinationIsIpv6')"
_WRONG = """SELECT event_id, 'ProcessId' AS field, 'integer' AS error, '99999999999' AS value FROM events WHERE event_type = 'view'
UNION ALL SELECT event_id, 'SourcePort', 'integer', '65536' FROM events WHERE event_type IN ('view', 'error') UNION ALL SELECT event_id, 'UtcTime', 'time', 'today' FROM events WHERE event_type = 'signup'
UNION ALL SELECT event_id, 'Initiated', 'boolean', 'perhaps' FROM events WHERE event_type = 'purchase' UNION ALL SELECT event_id, 'DestinationIp', 'address', '93.184.216.340' FROM events WHERE event_type = 'purchase'
UNION ALL SELECT event_id, 'Keywords', 'integer', '0x80000000000000001' FROM events WHERE event_type = 'error'"""


@query(f"SELECT event_id, field, error, value, true AS placed FROM ({_WRONG}) UNION ALL SELECT event_id, field, 'missing', NULL, false FROM events, (VALUES {_MISSING}) m(field)")
def x_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections with wrong values by kind of event, and without some fields: what is wrong, and that its place holds the value."""
    logs = fixture.sysmon_logs(spread(fixture.table(spark, sf_dir, "events")), 3).join(fixture.table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")
    changes = [("view", '"ProcessId">', "99999999999"), ("view,error", '"SourcePort">', "65536"), ("signup", '"UtcTime">', "today"), ("purchase", '"DestinationIp">', "93.184.216.340"), ("error", "<Keywords>", "0x80000000000000001")]
    text = F.col("log_event")
    for kinds, mark, value in [*changes, ("purchase", '"Initiated">', "perhaps")]:
        # A pattern that matches nothing where the kind is another.
        text = F.regexp_replace(text, F.when(F.col("event_type").isin(kinds.split(",")), F.lit(f"({mark})[^<]*")).otherwise(F.lit("(?!)")), F.lit(f"$1{value}"))
    found = sysmon.checked(logs.withColumn("log_event", text)).select("event_id", "log_event", F.explode("errors").alias("e"))
    placed = F.coalesce(F.substr("log_event", F.col("e.position"), F.length("e.value")) == F.col("e.value"), F.lit(False))
    return found.select("event_id", "e.field", "e.error", "e.value", placed.alias("placed"))


@query(f"SELECT event_id, 'ProcessCreation' AS event_name, {_HOST} AS computer, event_type || ' & ' || event_id AS command_line FROM events")
def x_first_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of a comment that holds an event, an event, and another one: the first true one counts."""
    events = spread(fixture.table(spark, sf_dir, "events"))
    # Both are made of one row: a join would send every payload around, or broadcast them all.
    both = events.select(F.lit(fixture.TENANT).alias("tenant_id"), "event_id", *[fixture.sysmon_text(k).alias(n) for k, n in ((1, "log_event"), (5, "after"))])
    text = F.concat(F.lit("<!-- <Event><System/></Event> -->\n"), F.regexp_replace("log_event", "<Event>", "<Event xmlns=\"http://schemas.microsoft.com/win/2004/08/events/event\">"), F.lit("\n<!--\n-->"), F.col("after"))
    return sysmon.parse(both.withColumn("log_event", text)).select("event_id", "event_name", "system.computer", F.col("data")["CommandLine"].alias("command_line"))


@query("SELECT event_id, event_type FROM events WHERE event_type <> 'purchase'")
def x_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads cut short, with a forbidden character, without an event, without a computer; purchases are whole."""
    events = fixture.table(spark, sf_dir, "events")
    logs = fixture.sysmon_logs(spread(events), 1).join(events.select("event_id", "event_type"), "event_id")
    kind, text = F.col("event_type"), F.col("log_event")
    broken = F.when(kind == "error", F.substring(text, 1, 120)).when(kind == "view", F.replace(text, F.lit("svchost -k"), F.lit("svchost\x01"))).when(kind == "click", F.lit("no xml")).when(kind == "signup", F.regexp_replace(text, "<Computer>.*</Computer>", "")).otherwise(text)
    return sysmon.rejected(sysmon.parse(logs.withColumn("log_event", broken))).select("event_id", "event_type")


@query(
    """SELECT event_id, CASE event_type WHEN 'signup' THEN event_id WHEN 'click' THEN NULL ELSE -event_id END AS int_value, CASE event_type WHEN 'signup' THEN true WHEN 'view' THEN false END AS bool_value,
CASE event_type WHEN 'signup' THEN '10.0.0.' || (event_id % 256) WHEN 'view' THEN 'fe80::' || (event_id % 10) END AS ip_value, CASE event_type WHEN 'signup' THEN epoch_us(ts) // 1000 WHEN 'view' THEN epoch_us(date_trunc('second', ts)) // 1000 END AS utc_value,
CAST(CASE event_type WHEN 'signup' THEN 9223372036854775808 + event_id WHEN 'view' THEN event_id WHEN 'click' THEN 0 END AS DECIMAL(20,0)) AS hex_value FROM events"""
)
def x_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Well-formed and malformed integers, booleans, addresses, times and hexadecimals: the malformed give null."""
    e, kind = fixture.table(spark, sf_dir, "events"), F.col("event_type")
    n = F.col("event_id").cast("string")
    by = lambda signup, view, click, rest: F.when(kind == "signup", signup).when(kind == "view", view).when(kind == "click", click).otherwise(rest)
    return e.select(
        "event_id",
        P.integer(by(F.concat(F.lit(" "), n, F.lit(" ")), F.concat(F.lit("-"), n), F.concat(n, F.lit("x")), F.concat(F.lit("-"), n))).alias("int_value"),
        P.boolean(by(F.lit("TRUE"), F.lit("false"), F.lit("yes"), F.lit(""))).alias("bool_value"),
        P.ip(by(F.concat(F.lit("10.0.0."), F.col("event_id") % 256), F.concat(F.lit("fe80::"), F.col("event_id") % 10), F.lit("300.1.1.1"), F.lit("host"))).alias("ip_value"),
        P.utc_ms(by(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("2024-13-01 00:00:00.000"), F.lit("yesterday"))).alias("utc_value"),
        P.hex_int(by(F.concat(F.lit("0x8"), F.lpad(F.hex("event_id"), 15, "0")), F.lower(F.hex("event_id")), F.lit("0"), F.lit("0xZZ"))).alias("hex_value"),
    )


# From logs to an identified graph: process creations, of which errors lack a host.

def _described(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    # Nodes and edges both come from the subgraphs, which are written once, as the pipeline's own table of them.
    graphs = written(generators.process_create(_sysmon(spark, sf_dir, 1)), "generated-graphs")
    nodes = generators.nodes_of(graphs)
    # Parents on one host lose their process id, so they have no key.
    broken = (F.col("node_key").endswith(":parent")) & F.col("strings")["asset_id"].isin("HOST-3")
    return nodes.withColumn("numbers", F.when(broken, F.map_filter("numbers", lambda k, _: k != "process_id")).otherwise(F.col("numbers"))), generators.edges_of(graphs)


@query("SELECT 't0' AS tenant_id, event_id, event_id || ':parent' AS node_key, 'Process' AS node_type, 'missing key' AS reason FROM events WHERE user_id % 7 = 3")
def i_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.identify_nodes(_described(spark, sf_dir)[0], endpoint_schema())[1].select("tenant_id", "event_id", "node_key", "node_type", "reason")


@query("SELECT event_id, count(*) AS n FROM events, (VALUES ('asset'), ('parent'), ('child'), ('exe')) v(role) WHERE user_id % 7 <> 3 GROUP BY event_id")
def i_whole_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of events of which none was quarantined."""
    good, bad = identity.identify_nodes(_described(spark, sf_dir)[0], endpoint_schema())
    return identity.whole_events(good, bad).groupBy("event_id").agg(F.count("*").alias("n"))


_LIVES = f"""WITH p AS (SELECT event_id, 'child' AS role, user_id % 7 AS h, user_id AS pid, {_MS} - {_MS} % 100 AS t, true AS c FROM events UNION ALL SELECT event_id, 'parent', user_id % 7, user_id + 1, {_MS} - {_MS} % 100, false FROM events WHERE user_id % 7 <> 3),
f AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR (c AND (CASE WHEN lag(c) OVER w THEN lag(t) OVER w END) IS DISTINCT FROM t) THEN 1 ELSE 0 END AS start FROM p WINDOW w AS (PARTITION BY h, pid ORDER BY t, NOT c, event_id)),
g AS (SELECT *, CAST(sum(start) OVER (PARTITION BY h, pid ORDER BY t, NOT c, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM f),
n AS (SELECT event_id, role, 'Process' AS node_type, {key_sql("'t0'", "'Process'", "'HOST-' || h", "pid")} AS key, session_no FROM g
  UNION ALL SELECT event_id, 'asset', 'Asset', {key_sql("'t0'", "'Asset'", _HOST)}, NULL FROM events
  UNION ALL SELECT event_id, 'exe', 'File', {key_sql("'t0'", "'File'", _HOST, "'C:" + chr(92) + "bin" + chr(92) + "' || event_type || '.exe'")}, 1 FROM events)"""


@query(f"{_LIVES} SELECT * FROM n")
def i_identify_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = identity.identify_nodes(_described(spark, sf_dir)[0], endpoint_schema())
    return good.select("event_id", F.element_at(F.split("node_key", ":"), -1).alias("role"), "node_type", "key", "session_no")


@query(f"{_LIVES} SELECT DISTINCT a.key AS src_key, a.session_no AS src_session, edge, b.key AS dst_key, b.session_no AS dst_session FROM (VALUES {_CREATE_EDGES}) v(src, edge, dst) JOIN n a ON a.role = v.src JOIN n b ON b.role = v.dst AND b.event_id = a.event_id")
def i_identify_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All different edges between resolved nodes; edges of quarantined parents go."""
    nodes, edges = _described(spark, sf_dir)
    good, _ = identity.identify(nodes, endpoint_schema())
    entity = good.select("uid", "key", "session_no").distinct()
    ends = [entity.select(*[F.col(c).alias(n) for c, n in zip(entity.columns, names)]) for names in (("src", "src_key", "src_session"), ("dst", "dst_key", "dst_session"))]
    return identity.identify_edges(edges, good).join(ends[0], "src").join(ends[1], "dst").select("src_key", "src_session", "edge", "dst_key", "dst_session")


# From logs to hits.

_ALLOWED = ("services.exe", "lsass.exe")
_IMAGES = f"""CASE user_id % 4 WHEN 0 THEN 'svchost.exe' ELSE event_type || '.exe' END"""
_PARENTS = """CASE user_id % 3 WHEN 0 THEN 'services.exe' WHEN 1 THEN 'lsass.exe' ELSE 'evil.exe' END"""
NAMED_SVCHOST = analyzers.Analyzer("named-svchost", Node("Process", "process").where("process_name", Eq("svchost.exe")), score=5)
#: One call with all the filters: a parent that is none of those allowed.
SUSPICIOUS_PARENT = analyzers.Analyzer("suspicious-parent", Node("Process", "process").where("process_name", *[~Eq(x) for x in _ALLOWED]).to("children", Node("Process", "child").where("process_name", Eq("svchost.exe"))), score=20, lens="child")


def _endpoint_graph(spark: SparkSession, sf_dir: str) -> tuple[Graph, DataFrame]:
    """The graph of the process logs, and (uid, key, session_no) of its processes."""
    logs = fixture.sysmon_logs(spread(fixture.table(spark, sf_dir, "events")), 1, image=F.expr(_IMAGES), parent=F.expr(_PARENTS))
    graphs = written(generators.process_create(sysmon.parse(logs, header=generators.HEADER)), "generated-graphs")
    nodes, _ = identity.identify_nodes(generators.nodes_of(graphs), endpoint_schema())
    nodes = written(nodes, "identified-nodes")
    edges = written(identity.identify_edges(generators.edges_of(graphs), nodes), "identified-edges")
    return assemble.graph_of(nodes, edges, endpoint_schema(), fixture.TENANT), nodes.where("node_type = 'Process'").select("uid", "key", "session_no").distinct()


_NAMED = f"""WITH p AS (SELECT event_id, 'child' AS role, user_id % 7 AS h, user_id AS pid, {_MS} - {_MS} % 100 AS t, true AS c, {_IMAGES} AS name FROM events UNION ALL SELECT event_id, 'parent', user_id % 7, user_id + 1, {_MS} - {_MS} % 100, false, {_PARENTS} FROM events),
f AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR (c AND (CASE WHEN lag(c) OVER w THEN lag(t) OVER w END) IS DISTINCT FROM t) THEN 1 ELSE 0 END AS start FROM p WINDOW w AS (PARTITION BY h, pid ORDER BY t, NOT c, event_id)),
g AS (SELECT *, CAST(sum(start) OVER (PARTITION BY h, pid ORDER BY t, NOT c, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM f),
n AS (SELECT event_id, role, {key_sql("'t0'", "'Process'", "'HOST-' || h", "pid")} AS key, session_no, name FROM g),
named AS (SELECT key, session_no, arg_min(name, (event_id, name)) AS name FROM n GROUP BY ALL)"""


@query(f"{_NAMED} SELECT 'named-svchost' AS analyzer, CAST(5 AS BIGINT) AS score, key, session_no FROM named WHERE name = 'svchost.exe'")
def a_named_svchost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every process of that name, from logs to hits, with all of the graph as changes."""
    g, entity = _endpoint_graph(spark, sf_dir)
    hits = analyzers.run(NAMED_SVCHOST, assemble.changes(g), g)
    return hits.join(entity, F.col("process") == F.col("uid")).select("analyzer", "score", "key", "session_no")


@query(
    f"""{_NAMED} SELECT DISTINCT 'suspicious-parent' AS analyzer, CAST(20 AS BIGINT) AS score, a.key AS parent_key, a.session_no AS parent_session, b.key AS child_key, b.session_no AS child_session
FROM n a JOIN n b ON b.event_id = a.event_id AND a.role = 'parent' AND b.role = 'child' JOIN named x ON x.key = a.key AND x.session_no = a.session_no JOIN named y ON y.key = b.key AND y.session_no = b.session_no
WHERE x.name NOT IN {_ALLOWED} AND y.name = 'svchost.exe'"""
)
def a_suspicious_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, entity = _endpoint_graph(spark, sf_dir)
    hits = analyzers.run(SUSPICIOUS_PARENT, assemble.changes(g), g)
    ends = [entity.select(F.col("uid").alias(role), F.col("key").alias(f"{name}_key"), F.col("session_no").alias(f"{name}_session")) for role, name in (("process", "parent"), ("child", "child"))]
    return hits.join(ends[0], "process").join(ends[1], "child").select("analyzer", "score", "parent_key", "parent_session", "child_key", "child_session")
