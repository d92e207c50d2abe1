"""Entity resolution: static keys and lifetimes ("sessions") of entities.

A session of a key starts at its first event, and at each time bucket that holds a creation. A row's session depends on
its (key, bucket) alone, so rows are first summed to buckets; buckets are numbered within slices of time and the slices'
counts prefix-summed. A key of any size is so dealt out over its slices, and the result is the same in any input order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import parsing as P
from weftgraph.schema import Schema
from weftgraph.session import written

BUCKET_MS = 100
SKEW_MS = 10
SLICE_MS = 86_400_000
#: Fixed by the data model: a guessed session ends this long after the event that began it.
FIRST_END_MS = 101


def bucket(t: Column) -> Column:
    """Times in steps of BUCKET_MS, down."""
    return t - F.pmod(t, F.lit(BUCKET_MS))


def same_time(a: Column, b: Column) -> Column:
    return F.abs(a - b) < SKEW_MS


def key_text(parts: list[Column]) -> Column:
    """Parts with their lengths before them, so that no two lists give one text; a null part is a dash."""
    sized = [F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in (p.cast("string") for p in parts)]
    return F.concat(*[F.coalesce(p, F.lit("-")) for p in sized])


def static_key(tenant: Column, node_type: Column, values: list[Column]) -> Column:
    """Hash of the key properties in the schema's order; null where one is missing. A null tenant is one of its own."""
    whole = F.md5(key_text([tenant, node_type, *values]))
    known = F.lit(True)
    for v in values:
        known = known & v.isNotNull()
    return F.when(known, whole)


def uid_of(key: Column) -> Column:
    """A uid from a key: never 0. Keys that share a uid are found by clashes."""
    h = F.xxhash64(key)
    return F.when(key.isNotNull(), F.when(h == 0, F.lit(1)).otherwise(h))


def _of_type(node_type: Column, values: dict[str, Column], kind: str) -> Column:
    """What a table by type says of a node; null where the type is none of them. A constant table, as code for each type would be too long to compile."""
    table = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]).cast(f"map<string,{kind}>")
    return F.try_element_at(table, node_type)


def identity_key(schema: Schema, tenant: Column, node_type: Column, strings: Column, numbers: Column) -> Column:
    """static_key of a described node by its type's schema; null where a key property or the type is unknown."""
    text = lambda t, k: next(p for p in t.properties if p.name == k).kind.endswith("string")
    names = {t.name: F.array(*[F.struct(F.lit(k).alias("name"), F.lit(text(t, k)).alias("text")) for k in t.keys()]) for t in schema.types.values()}
    parts = _of_type(node_type, names, "array<struct<name:string,text:boolean>>")
    values = F.transform(parts, lambda p: F.when(p["text"], F.try_element_at(strings, p["name"])).otherwise(F.try_element_at(numbers, p["name"]).cast("string")))
    return F.md5(F.aggregate(values, key_text([tenant, node_type]), lambda whole, v: F.concat(whole, F.length(v).cast("string"), F.lit(":"), v)))


def lasting(schema: Schema, node_type: Column) -> Column:
    """Whether nodes of the type have lifetimes."""
    return node_type.isin([t.name for t in schema.types.values() if t.identity == "session"])


def lifetime(schema: Schema, node_type: Column, numbers: Column) -> Column:
    """(t, created) of a described node by its type's schema; null where identity is static."""
    names = {t.name: F.struct(F.lit(t.time("create_time")), F.lit(t.time("last_seen_time"))) for t in schema.types.values() if t.identity == "session"}
    own = _of_type(node_type, names, "struct<created:string,seen:string>")
    t, created = event_time(F.try_element_at(numbers, own["created"]), F.try_element_at(numbers, own["seen"]))
    return F.when(own.isNotNull(), F.struct(t.alias("t"), created.alias("created")))


def event_time(created: Column, seen: Column) -> tuple[Column, Column]:
    """(time, is creation); a time of 0 or null is absent, and without both the time is null."""
    has = F.coalesce(created, F.lit(0)) != 0
    return F.when(has, created).when(F.coalesce(seen, F.lit(0)) != 0, seen), has


def buckets(rows: DataFrame) -> DataFrame:
    """(key, t, created) from rows (key, t, created): merges again over any split of the rows."""
    return rows.groupBy("key", bucket(F.col("t")).alias("t")).agg(F.max("created").alias("created"))


def sessions(rows: DataFrame, slice_ms: int = SLICE_MS) -> DataFrame:
    """(key, t, session_no) for each (key, t) of buckets."""
    b = rows.withColumn("slice", F.floor(F.col("t") / slice_ms))
    parts = b.groupBy("key", "slice").agg(F.sum(F.col("created").cast("int")).alias("starts"), F.min("t").alias("first_t"), F.min_by("created", "t").alias("first_created"))
    order = Window.partitionBy("key").orderBy("slice")
    # A key whose first bucket has no creation begins with a guessed session.
    guess = F.first(F.when(F.col("first_created"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.coalesce(F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("key", "slice", (before + guess).alias("offset"))
    running = F.sum(F.col("created").cast("int")).over(Window.partitionBy("key", "slice").orderBy("t"))
    return b.withColumn("running", running).join(offsets, ["key", "slice"]).select("key", "t", (F.col("offset") + F.col("running")).cast("bigint").alias("session_no"))


def attribute(rows: DataFrame, slice_ms: int = SLICE_MS) -> DataFrame:
    """rows (key, t, created, ...) with their bucket and session_no."""
    numbered = sessions(buckets(rows), slice_ms).withColumnRenamed("t", "bucket")
    return rows.withColumn("bucket", bucket(F.col("t"))).join(numbered, ["key", "bucket"])


def session_bounds(b: DataFrame, slice_ms: int = SLICE_MS) -> DataFrame:
    """(key, session_no, create_time, last_time, end_time, is_create_canon) from buckets."""
    numbered = b.join(sessions(b, slice_ms), ["key", "t"])
    out = numbered.groupBy("key", "session_no").agg(F.min("t").alias("create_time"), F.max("t").alias("last_time"), F.min_by("created", "t").alias("is_create_canon"))
    return out.withColumn("end_time", F.greatest("last_time", F.col("create_time") + FIRST_END_MS))


def clashes(named: DataFrame) -> DataFrame:
    """(uid): those that several entities of named (uid, entity) got, told by a pre-aggregated minimum and maximum."""
    return named.groupBy("uid").agg(F.min("entity").alias("a"), F.max("entity").alias("b")).where("a <> b").select("uid")


_ROW = ["tenant_id", "event_id", "node_key", "key", "_t", "_created"]


def _keyed(nodes: DataFrame, schema: Schema) -> DataFrame:
    """nodes with key, _t and _created (-1 and false where identity is static), _session and the reason why one can't be identified."""
    kind, numbers = F.col("node_type"), F.col("numbers")
    keyed = P.computed_once(nodes, key=identity_key(schema, F.col("tenant_id"), kind, F.col("strings"), numbers), _time=lifetime(schema, kind, numbers), _session=lasting(schema, kind))
    reason = F.when(F.col("key").isNull(), "missing key").when(F.col("_session") & F.col("_time.t").isNull(), "no time")
    return keyed.select(*nodes.columns, "key", F.coalesce("_time.t", F.lit(-1)).alias("_t"), F.coalesce("_time.created", F.lit(False)).alias("_created"), "_session", reason.alias("reason"))


def identify(nodes: DataFrame, schema: Schema) -> tuple[DataFrame, DataFrame]:
    """(tenant_id, event_id, node_key, node_type, key, session_no, uid, ...) of described nodes without their properties, written; (uid) of clashes.

    session_no is null where identity is static. Entities that share a uid are among the clashes, and not in the first.
    """
    # Read by the static rows and twice by the lived ones: few columns, however many properties there are.
    keyed = written(_keyed(nodes, schema).where("reason is null").select(*_ROW, "node_type", "_session"), "keyed-nodes")
    own = [*_ROW, "node_type"]
    static = keyed.where("not _session").select(*own, F.lit(None).cast("bigint").alias("session_no"), uid_of(F.col("key")).alias("uid"))
    lived = attribute(keyed.where("_session").withColumns({"t": F.col("_t"), "created": F.col("_created")}))
    lived = lived.select(*own, "session_no", uid_of(F.concat("key", F.lit(":"), F.col("session_no").cast("string"))).alias("uid"))
    named = written(static.unionByName(lived), "identified-nodes")
    shared = written(clashes(named.select("uid", F.concat("key", F.lit(":"), F.coalesce(F.col("session_no").cast("string"), F.lit(""))).alias("entity"))), "uid-clashes")
    return named.join(shared, "uid", "left_anti"), named.join(shared, "uid", "left_semi")


def identify_nodes(nodes: DataFrame, schema: Schema) -> tuple[DataFrame, DataFrame]:
    """(node rows with key, session_no and uid, quarantined rows with a reason) from described nodes, which are read once.

    session_no is null where identity is static. Entities that share a uid are quarantined, all of them. Clashes are
    told from entities, and rows with lifetimes meet their key's buckets alone.
    """
    keyed = written(_keyed(nodes, schema), "keyed-nodes")
    rows = keyed.where("reason is null").select(*nodes.columns, "key", "_t", "_created", "_session")
    still, lived = rows.where("not _session"), rows.where("_session")
    numbered = sessions(buckets(lived.select("key", F.col("_t").alias("t"), F.col("_created").alias("created"))))
    numbered = written(numbered.select("key", F.col("t").alias("_bucket"), "session_no", uid_of(F.concat("key", F.lit(":"), F.col("session_no").cast("string"))).alias("uid")), "numbered-sessions")
    entities = still.select("key", uid_of(F.col("key")).alias("uid"), F.lit("").alias("no")).unionByName(numbered.select("key", "uid", F.col("session_no").cast("string").alias("no"))).distinct()
    shared = written(clashes(entities.select("uid", F.concat("key", F.lit(":"), "no").alias("entity"))), "uid-clashes")
    static = still.select(*nodes.columns, "key", F.lit(None).cast("bigint").alias("session_no"), uid_of(F.col("key")).alias("uid"))
    named = static.unionByName(lived.withColumn("_bucket", bucket(F.col("_t"))).join(numbered, ["key", "_bucket"]).select(*static.columns))
    good, clashed = named.join(shared, "uid", "left_anti").select(*static.columns), named.join(shared, "uid", "left_semi").select(*nodes.columns, F.lit("uid clash").alias("reason"))
    return good, keyed.where("reason is not null").select(*nodes.columns, "reason").unionByName(clashed)


def identify_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tenant_id, src, edge, dst): both ends by their node_key; an edge without one of them, or to itself, goes."""
    m = nodes.select("tenant_id", "node_key", "uid")
    a = m.select("tenant_id", F.col("node_key").alias("src_key"), F.col("uid").alias("src"))
    b = m.select("tenant_id", F.col("node_key").alias("dst_key"), F.col("uid").alias("dst"))
    return edges.join(a, ["tenant_id", "src_key"]).join(b, ["tenant_id", "dst_key"]).where("src <> dst").select("tenant_id", "src", "edge", "dst").distinct()


def whole_events(nodes: DataFrame, quarantined: DataFrame) -> DataFrame:
    """Nodes of events of which no node was quarantined; the others wait for a repair."""
    return nodes.join(quarantined.select("tenant_id", "event_id").distinct(), ["tenant_id", "event_id"], "left_anti")
