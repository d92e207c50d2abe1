"""Queries of graph state: merges, identity, queues, registries, streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import analyzers, identity, merge, queues, uids
from weftgraph.plans.registry import key_sql, query
from weftgraph.schema import parse
from weftgraph.session import shared_path
from weftgraph.sources import fixture
from weftgraph.sources.fixture import uid_sql
from weftgraph.streaming import pipeline

_U = uid_sql("UserSession", "user_id")
_CENTS = "CAST(round(value * 100) AS BIGINT)"


def _writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.event_writes(fixture.table(spark, sf_dir, "events"))


def _merged(where: str = "true") -> str:
    group = f"FROM events WHERE {where} GROUP BY user_id"
    return f"""SELECT 't0' AS tenant_id, {_U} AS uid, 'high_cents' AS field, 'max_int' AS kind, CAST(NULL AS VARCHAR) AS s, max({_CENTS}) AS n {group}
UNION ALL SELECT 't0', {_U}, 'low_cents', 'min_int', NULL, min({_CENTS}) {group}
UNION ALL SELECT 't0', {_U}, 'first_event', 'immutable_string', arg_min(event_type, (ts, event_id)), NULL {group}"""


@query(_merged())
def m_merge_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_properties(_writes(spark, sf_dir))


def _one(name: str, field: str, column: str) -> None:
    query(f"SELECT uid, {column} FROM ({_merged()}) WHERE field = '{field}'", name)(lambda spark, sf_dir: merge.merge_properties(_writes(spark, sf_dir).where(F.col("field") == field)).select("uid", column))


_one("m_max", "high_cents", "n")
_one("m_min", "low_cents", "n")
_one("m_immutable_first", "first_event", "s")


@query(f"SELECT DISTINCT 't0' AS tenant_id, {_U} AS uid, 'first_event' AS field FROM events WHERE event_type = 'error' AND user_id IN (SELECT user_id FROM events WHERE event_type <> 'error')")
def m_type_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors write the first event as a number, everything else as text."""
    rows = _writes(spark, sf_dir).where("field = 'first_event'")
    return merge.conflicts(rows.withColumn("kind", F.when(F.col("s") == "error", "immutable_int").otherwise(F.col("kind"))))


_EARLY = "ts < TIMESTAMP '2024-01-16'"


@query(f"WITH o AS ({_merged(_EARLY)}), w AS ({_merged()}) SELECT w.tenant_id, w.uid, w.field FROM w LEFT JOIN o ON o.uid = w.uid AND o.field = w.field WHERE o.s IS DISTINCT FROM w.s OR o.n IS DISTINCT FROM w.n")
def m_change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second half of the month changes in the state after the first."""
    events = fixture.table(spark, sf_dir, "events")
    half = F.expr("timestamp_ntz '2024-01-16 00:00:00'")
    old, new = (merge.partial_properties(fixture.event_writes(events.where(w))) for w in (F.col("ts") < half, ~(F.col("ts") < half)))
    return merge.merge_state(old, new)[1]


@query(f"SELECT 't0' AS tenant_id, {uid_sql('Order', 'o_orderkey')} AS uid, 'Order' AS node_type FROM orders UNION SELECT 't0', {uid_sql('Customer', 'o_custkey')}, 'Customer' FROM orders")
def m_node_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that every order writes for itself and its customer, and some for a node that is none."""
    o = fixture.table(spark, sf_dir, "orders")
    rows = [o.select(F.lit(fixture.TENANT).alias("tenant_id"), uid.alias("uid"), F.lit(t).alias("node_type")) for t, uid in (("Order", fixture.uid("Order", "o_orderkey")), ("Customer", fixture.uid("Customer", "o_custkey")), ("Order", F.lit(0).cast("bigint")))]
    return merge.node_types(rows[0].unionByName(rows[1]).unionByName(rows[2]))


@query("SELECT 't0' AS tenant_id, 'Kind' AS node_type, event_type AS entity, CAST(1 AS BIGINT) AS uids FROM events GROUP BY event_type UNION ALL SELECT 't0', 'User', '' || user_id, 1 FROM events GROUP BY user_id")
def m_create_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node for each different kind and user: one uid each, no uid of two, none 0."""
    e = fixture.table(spark, sf_dir, "events")
    entity = lambda t, c: e.select(F.lit(fixture.TENANT).alias("tenant_id"), F.lit(t).alias("node_type"), F.col(c).cast("string").alias("entity"))
    made = merge.create_nodes(entity("Kind", "event_type").unionByName(entity("User", "user_id"))).where("uid <> 0")
    return made.join(identity.clashes(made), "uid", "left_anti").groupBy("tenant_id", "node_type", "entity").agg(F.count_distinct("uid").alias("uids"))


_OLD = "o_orderdate < TIMESTAMP '1996-01-01'"


@query(
    f"""WITH o AS ({_merged(_EARLY)}), w AS ({_merged()}) SELECT 'property' AS kind, w.uid, w.field AS name, CAST(NULL AS BIGINT) AS src, CAST(NULL AS BIGINT) AS dst FROM w LEFT JOIN o ON o.uid = w.uid AND o.field = w.field WHERE o.s IS DISTINCT FROM w.s OR o.n IS DISTINCT FROM w.n
UNION ALL SELECT 'edge', NULL, 'placed_by', {uid_sql('Order', 'o_orderkey')}, {uid_sql('Customer', 'o_custkey')} FROM orders WHERE NOT {_OLD}"""
)
def m_change_feed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of properties and of edges, as analyzers take them; edges that were there are written again."""
    events, o = fixture.table(spark, sf_dir, "events"), fixture.table(spark, sf_dir, "orders")
    half = F.expr("timestamp_ntz '2024-01-16 00:00:00'")
    old, new = (merge.partial_properties(fixture.event_writes(events.where(w))) for w in (F.col("ts") < half, ~(F.col("ts") < half)))
    edges = o.select(F.lit(fixture.TENANT).alias("tenant_id"), fixture.uid("Order", "o_orderkey").alias("src"), F.lit("placed_by").alias("edge"), fixture.uid("Customer", "o_custkey").alias("dst"), "o_orderdate")
    return merge.change_feed(old, new, edges.where("o_orderdate < timestamp_ntz '1996-01-01 00:00:00'"), edges.unionByName(edges))


@query("SELECT 't0' AS tenant_id, 'R' || n_regionkey AS node_type, 'nations' AS edge, arg_max(n_name, n_nationkey) AS reverse FROM nation GROUP BY n_regionkey")
def m_latest_edge_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation as versions of edge schemas: the key is the version, the name the reverse edge."""
    rows = fixture.table(spark, sf_dir, "nation").select(F.lit("t0").alias("tenant_id"), F.concat(F.lit("R"), "n_regionkey").alias("node_type"), F.lit("nations").alias("edge"), F.col("n_name").alias("reverse"), F.col("n_nationkey").alias("version"))
    return merge.latest_reverse(rows)


# Identity.

_MS = "(epoch_us(ts) // 1000)"
_BUCKET = f"({_MS} - {_MS} % 100)"


_KEYS = parse("""
type Customer @node(identity_algorithm: "static") { c_name: String! @static_id  c_acctbal_cents: Int! @static_id  c_mktsegment: String! @static_id }
type UserSession @node(identity_algorithm: "session") {
  user_id: UInt! @pseudo_key
  event_type: String! @pseudo_key
  created_ms: UInt! @create_time
  seen_ms: UInt! @last_seen_time
  ended_ms: UInt! @terminate_time
}
""")


def _schema_key(rows: DataFrame, node_type: str, strings: dict[str, Column], numbers: dict[str, Column]) -> Column:
    bag = lambda values, kind: F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast(kind))])
    return identity.identity_key(_KEYS, F.lit("t0"), F.lit(node_type), bag(strings, "string"), bag(numbers, "bigint"))


@query(f"SELECT {uid_sql('Customer', 'c_custkey')} AS uid, {key_sql("'t0'", "'Customer'", 'CAST(round(c_acctbal * 100) AS BIGINT)', 'c_mktsegment', 'c_name')} AS key FROM customer")
def i_static_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys by the schema: static ones in order of their names, whatever the order of declaration."""
    c = fixture.table(spark, sf_dir, "customer")
    key = _schema_key(c, "Customer", {"c_name": F.col("c_name"), "c_mktsegment": F.col("c_mktsegment")}, {"c_acctbal_cents": fixture.cents("c_acctbal")})
    return c.select(fixture.uid("Customer", "c_custkey").alias("uid"), key.alias("key"))


@query(f"SELECT event_id, CASE WHEN event_type <> 'error' THEN {key_sql("'t0'", "'UserSession'", 'user_id', 'event_type')} END AS key FROM events")
def i_pseudo_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo keys as declared; without one of the properties there is no key."""
    e = fixture.table(spark, sf_dir, "events")
    return e.select("event_id", _schema_key(e, "UserSession", {"event_type": F.when(F.col("event_type") != "error", F.col("event_type"))}, {"user_id": F.col("user_id")}).alias("key"))


@query(f"SELECT event_id, {_BUCKET} AS t FROM events")
def i_time_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.table(spark, sf_dir, "events").select("event_id", identity.bucket(fixture.ms("ts")).alias("t"))


_SESSIONS = f"""WITH e AS (SELECT event_id, user_id, {_BUCKET} AS t, event_type = 'signup' AS c FROM events),
f AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR (c AND (CASE WHEN lag(c) OVER w THEN lag(t) OVER w END) IS DISTINCT FROM t) THEN 1 ELSE 0 END AS start FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, NOT c, event_id)),
g AS (SELECT *, CAST(sum(start) OVER (PARTITION BY user_id ORDER BY t, NOT c, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM f)"""
_BOUNDS = f"""{_SESSIONS} SELECT user_id AS key, session_no, min(t) AS create_time, max(t) AS last_time, bool_or(start = 1 AND c) AS is_create_canon, greatest(max(t), min(t) + 101) AS end_time FROM g GROUP BY user_id, session_no"""


@query(f"{_SESSIONS} SELECT event_id, user_id AS key, session_no FROM g")
def i_session_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.attribute(fixture.event_rows(spark, sf_dir)).select("event_id", "key", "session_no")


@query(_BOUNDS)
def i_session_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.session_bounds(identity.buckets(fixture.event_rows(spark, sf_dir)))


@query(f"SELECT event_id, CASE WHEN event_type = 'signup' THEN {_MS} WHEN event_type <> 'error' THEN {_MS} + 1 END AS t, event_type = 'signup' AS created FROM events")
def i_event_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups have a create time, errors none at all, the rest a last-seen time."""
    e = fixture.table(spark, sf_dir, "events")
    t, created = identity.event_time(F.when(F.col("event_type") == "signup", fixture.ms("ts")), F.when(F.col("event_type") != "error", fixture.ms("ts") + 1).otherwise(0))
    return e.select("event_id", t.alias("t"), created.alias("created"))


@query(f"WITH e AS (SELECT event_id, {_MS} AS a, {_MS} + (event_id % 41) - 20 AS b FROM events) SELECT event_id, abs(a - b) < 10 AS same FROM e")
def i_skewed_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of two clocks up to 20 ms apart."""
    e = fixture.table(spark, sf_dir, "events")
    return e.select("event_id", identity.same_time(fixture.ms("ts"), fixture.ms("ts") + F.col("event_id") % 41 - 20).alias("same"))


_EARLY_KEYS = f"SELECT DISTINCT event_type || ' ' || user_id AS key FROM events WHERE {_EARLY}"


@query(
    f"""WITH every AS (SELECT DISTINCT event_type || ' ' || user_id AS key FROM events), early AS ({_EARLY_KEYS}), n AS (SELECT (SELECT count(*) FROM every) AS whole, (SELECT count(*) FROM early) AS first)
SELECT key, CASE WHEN key IN (SELECT key FROM early) THEN CAST(1 AS BIGINT) ELSE n.first + 1 END AS least, CASE WHEN key IN (SELECT key FROM early) THEN n.first ELSE n.whole END AS most, true AS fits, n.whole AS uids FROM every, n"""
)
def i_uid_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs and a repeated one extend one dictionary: each key's uid lies among its run's, which leave no gap and share none."""
    events, path = fixture.table(spark, sf_dir, "events"), shared_path(spark, "uids")
    key = F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("key")
    half = F.expr("timestamp_ntz '2024-01-16 00:00:00'")
    one = uids.extend(events.where(F.col("ts") < half).select(key), path)
    uids.extend(events.select(key), path)
    uids.extend(events.select(key), path)
    first, whole = uids.dictionary(spark, path, one), uids.dictionary(spark, path)
    uids_, last = whole.agg(F.count_distinct("uid"), F.max("uid")).first()
    until = first.agg(F.max("uid")).first()[0]
    early = first.select("key", F.col("uid").alias("was"))
    out, known = whole.join(early, "key", "left"), F.col("was").isNotNull()
    least, most = F.when(known, F.lit(1)).otherwise(F.lit(until + 1)).cast("bigint"), F.when(known, F.lit(until)).otherwise(F.lit(last)).cast("bigint")
    fits = F.col("uid").between(least, most) & F.coalesce(F.col("uid") == F.col("was"), F.lit(True))
    return out.select("key", least.alias("least"), most.alias("most"), fits.alias("fits"), F.lit(uids_).cast("bigint").alias("uids"))


# Work queue and registry.

_NOW = 1704500000000
_QUEUE = f"""WITH q AS (SELECT event_id AS execution_key, event_type AS plugin_id, 's' || (user_id % 10) AS event_source_id,
  CASE WHEN event_type = 'error' THEN 'failed' WHEN value < 3 THEN 'processed' ELSE 'enqueued' END AS status, {_MS} AS creation_time, {_MS} AS last_updated, {_MS} + {_CENTS} * 1000 AS visible_after, CAST(-1 AS INTEGER) AS try_count FROM events)"""


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.queue_rows(fixture.table(spark, sf_dir, "events"))


@query(
    f"""{_QUEUE} SELECT plugin_id, creation_time, execution_key, event_source_id, status, last_updated, {_NOW} + 10000 AS visible_after, try_count + 1 AS try_count
FROM (SELECT *, row_number() OVER (PARTITION BY plugin_id ORDER BY creation_time, execution_key) AS k FROM q WHERE status = 'enqueued' AND visible_after <= {_NOW}) WHERE k = 1"""
)
def w_next_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.next_visible(_queue(spark, sf_dir), F.lit(_NOW))


@query(f"{_QUEUE} SELECT plugin_id, event_source_id, count(*) AS n FROM q WHERE status = 'enqueued' GROUP BY ALL")
def w_queue_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.depth(_queue(spark, sf_dir))


@query(f"{_QUEUE}, c AS (SELECT plugin_id, event_source_id, count(*) AS n FROM q WHERE status = 'enqueued' GROUP BY ALL) SELECT plugin_id, CAST(sum(n) AS BIGINT) AS n, arg_min(event_source_id, (-n, event_source_id)) AS dominant FROM c GROUP BY plugin_id")
def w_dominant_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.dominant_source(_queue(spark, sf_dir))


@query("SELECT event_type AS plugin_id, max(event_id) AS id, arg_max(value < 20, event_id) AS deployed FROM events GROUP BY event_type")
def w_latest_deployment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a deployment log."""
    log = fixture.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("plugin_id"), (F.col("value") < 20).alias("deployed"))
    return queues.latest_deployment(log)


@query(f"{_QUEUE} SELECT execution_key, CASE WHEN plugin_id = 'click' THEN 'processed' ELSE status END AS status, CASE WHEN plugin_id = 'click' AND status <> 'processed' THEN {_NOW} ELSE last_updated END AS last_updated FROM q")
def w_ack_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every click is acknowledged."""
    q = _queue(spark, sf_dir)
    acks = q.where("plugin_id = 'click'").select("execution_key", F.lit("processed").alias("new_status"))
    return queues.acknowledged(q, acks, F.lit(_NOW)).select("execution_key", "status", "last_updated")


_PLUGINS = "SELECT DISTINCT 't' || n_regionkey AS tenant_id, 's' || (n_nationkey % 10) AS event_source_id, n_name AS plugin_id FROM nation"


def _plugins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation as a plugin registry: a tenant per region."""
    n = fixture.table(spark, sf_dir, "nation")
    return n.select(F.concat(F.lit("t"), "n_regionkey").alias("tenant_id"), F.concat(F.lit("s"), F.col("n_nationkey") % 10).alias("event_source_id"), F.col("n_name").alias("plugin_id")).distinct()


def _lookup(name: str, where: str, **asked: str) -> None:
    query(f"SELECT * FROM ({_PLUGINS}) WHERE {where}", name)(lambda spark, sf_dir: queues.plugins_where(_plugins(spark, sf_dir), **asked))


_lookup("w_plugins_for_tenant", "tenant_id = 't2'", tenant="t2")
_lookup("w_plugins_for_source", "event_source_id = 's3'", event_source="s3")
_lookup("w_plugin_get", "plugin_id = 'NATION_7'", plugin="NATION_7")
_lookup("w_plugins_list", "true")


@query(f"WITH p AS ({_PLUGINS}) SELECT event_id, plugin_id FROM events JOIN p ON p.event_source_id = 's' || (user_id % 10)")
def a_generator_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = fixture.table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("s"), F.col("user_id") % 10).alias("event_source_id"))
    return analyzers.dispatch(logs, _plugins(spark, sf_dir), ["event_source_id"]).select("event_id", "plugin_id")


@query(f"WITH p AS ({_PLUGINS}) SELECT o_orderkey, plugin_id FROM orders JOIN p ON p.tenant_id = 't' || (o_custkey % 7)")
def a_analyzer_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of orders to every analyzer of their tenant; two tenants have none."""
    updates = fixture.table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("t"), F.col("o_custkey") % 7).alias("tenant_id"))
    return analyzers.dispatch(updates, _plugins(spark, sf_dir), ["tenant_id"]).select("o_orderkey", "plugin_id")


# Streams, run to the end of what is there.

def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = fixture.table(spark, sf_dir, "events").schema
    # A glob, since a stream's plain path has to be a folder and the table may be one file.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")


@query(_merged())
def t_stream_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.merged_properties(fixture.event_writes(_event_stream(spark, sf_dir)), shared_path(spark, "stream-merge"))


def _file_stream(spark: SparkSession, sf_dir: str, folder: str, times: int = 1) -> DataFrame:
    """events as a stream of many small files in no order of time, each row `times` times."""
    events = fixture.table(spark, sf_dir, "events")
    for _ in range(times):
        events.repartition(12, F.xxhash64("event_id")).write.mode("append").parquet(folder)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 5).parquet(folder)


@query(_merged())
def t_stream_many_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several micro-batches out of order; then all rows are sent again, and the query goes on from its checkpoint."""
    folder, path = shared_path(spark, "stream-files"), shared_path(spark, "stream-merge")
    pipeline.merged_properties(fixture.event_writes(_file_stream(spark, sf_dir, folder)), path)
    return pipeline.merged_properties(fixture.event_writes(_file_stream(spark, sf_dir, folder)), path)


@query(_BOUNDS)
def t_stream_late_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of rows that come in no order of time, each twice, then compacted to one batch."""
    folder, path, out = (shared_path(spark, n) for n in ("stream-files", "stream-identity", "stream-compacted"))
    rows = _file_stream(spark, sf_dir, folder, 2).select(F.col("user_id").alias("key"), fixture.ms("ts").alias("t"), (F.col("event_type") == "signup").alias("created"))
    pipeline.session_bounds(rows, path)
    pipeline.compacted(spark, path, out, lambda b: b.groupBy("key", "t").agg(F.max("created").alias("created")))
    return identity.session_bounds(pipeline.batches(spark, out))


@query(_BOUNDS)
def t_stream_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _event_stream(spark, sf_dir).select(F.col("user_id").alias("key"), fixture.ms("ts").alias("t"), (F.col("event_type") == "signup").alias("created"))
    return pipeline.session_bounds(rows, shared_path(spark, "stream-identity"))
