"""The driver's tables as a property graph: uid = type code * 10**12 + key + 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.graph import Graph
from weftgraph.session import ship_package

TENANT = "t0"
CODES = {"Region": 1, "Nation": 2, "Customer": 3, "Supplier": 4, "Part": 5, "Order": 6, "UserSession": 7}
REVERSE = {"in_region": "nations", "in_nation": "customers", "based_in": "suppliers", "placed_by": "orders", "contains_part": "in_orders", "supplied_by": "supplies_orders", "offers": "offered_by"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def uid(node_type: str, key: str) -> Column:
    return (F.lit(CODES[node_type] * 10**12 + 1) + F.col(key)).cast("bigint")


def uid_sql(node_type: str, key: str) -> str:
    return f"CAST({CODES[node_type] * 10**12 + 1} + {key} AS BIGINT)"


def cents(name: str) -> Column:
    return F.round(F.col(name) * 100).cast("bigint")


def ms(name: str) -> Column:
    return F.unix_millis(F.col(name).cast("timestamp"))


#: The part of the graph that the store's queries write, as schema text.
GRAPH_SCHEMA = """
# Edges are declared once, on one of their ends.
type Customer @node(identity_algorithm: "static") {
  c_name: String! @static_id
  c_mktsegment: String! @immutable
  c_acctbal_cents: Int! @increment_only
  orders: [Order!] @edge(reverse: "placed_by", reverse_relationship: "ToOne")
}
type Order @node(identity_algorithm: "static") {
  o_orderdate_ms: Int! @static_id
  o_orderstatus: String! @immutable
  o_orderpriority: String! @immutable
  contains_part: [Part!] @edge(reverse: "in_orders", reverse_relationship: "ToMany")
}
type Part @node(identity_algorithm: "static") { p_name: String! @static_id }
type PartSize @node(extends: "Part") { p_size: Int! @decrement_only }
"""


def gaps(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables with missing values: every seventh customer's segment, every fifth part's size."""
    segment = F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("c_mktsegment")
    size = F.when(F.col("p_partkey") % 5 != 0, F.col("p_size")).alias("p_size")
    return t | {"customer": t["customer"].withColumn("c_mktsegment", segment), "part": t["part"].withColumn("p_size", size)}


def graph(spark: SparkSession, sf_dir: str, with_gaps: bool = False) -> Graph:
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    t = gaps(t) if with_gaps else t
    nodes = {
        "Region": t["region"].select(uid("Region", "r_regionkey").alias("uid"), "r_name"),
        "Nation": t["nation"].select(uid("Nation", "n_nationkey").alias("uid"), "n_name"),
        "Customer": t["customer"].select(uid("Customer", "c_custkey").alias("uid"), "c_name", "c_mktsegment", cents("c_acctbal").alias("c_acctbal_cents")),
        "Supplier": t["supplier"].select(uid("Supplier", "s_suppkey").alias("uid"), "s_name", cents("s_acctbal").alias("s_acctbal_cents")),
        "Part": t["part"].select(uid("Part", "p_partkey").alias("uid"), "p_name", "p_brand", "p_type", F.col("p_size").cast("bigint").alias("p_size")),
        "Order": t["orders"].select(uid("Order", "o_orderkey").alias("uid"), "o_orderstatus", "o_orderpriority", cents("o_totalprice").alias("o_totalprice_cents"), ms("o_orderdate").alias("o_orderdate_ms")),
    }

    def edge(name: str, a: str, a_key: str, b: str, b_key: str) -> DataFrame:
        return t[name].where(F.col(a_key).isNotNull() & F.col(b_key).isNotNull()).select(uid(a, a_key).alias("src"), uid(b, b_key).alias("dst"))

    edges = {
        "in_region": edge("nation", "Nation", "n_nationkey", "Region", "n_regionkey"),
        "in_nation": edge("customer", "Customer", "c_custkey", "Nation", "c_nationkey"),
        "based_in": edge("supplier", "Supplier", "s_suppkey", "Nation", "s_nationkey"),
        "placed_by": edge("orders", "Order", "o_orderkey", "Customer", "o_custkey"),
        "contains_part": edge("lineitem", "Order", "l_orderkey", "Part", "l_partkey").distinct(),
        "supplied_by": edge("lineitem", "Order", "l_orderkey", "Supplier", "l_suppkey").distinct(),
        "offers": edge("lineitem", "Supplier", "l_suppkey", "Part", "l_partkey").distinct(),
    }
    return Graph(TENANT, nodes, edges, REVERSE)


def property_writes(nodes: DataFrame, node_type: str, kinds: dict[str, str], tenant: str = TENANT) -> DataFrame:
    """A node table's columns as property writes of the kinds given, present values only."""
    null = {"s": F.lit(None).cast("string"), "n": F.lit(None).cast("bigint")}
    writes = [F.struct(F.lit(p).alias("field"), F.lit(k).alias("kind"), *[(F.col(p) if (c == "s") == k.endswith("string") else v).alias(c) for c, v in null.items()]) for p, k in kinds.items()]
    rows = nodes.select(F.lit(tenant).alias("tenant_id"), "uid", F.explode(F.array(*writes)).alias("w")).select("tenant_id", "uid", "w.*")
    return rows.where("s is not null or n is not null")


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as (key, t, created, event_id): signups are creations, everything else a sighting."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), ms("ts").alias("t"), (F.col("event_type") == "signup").alias("created"), "event_id")


def event_writes(events: DataFrame) -> DataFrame:
    """events as property writes of their user: highest and lowest value, and the first event type."""
    kinds = F.array(
        F.struct(F.lit("high_cents").alias("field"), F.lit("max_int").alias("kind"), F.lit(None).cast("string").alias("s"), cents("value").alias("n")),
        F.struct(F.lit("low_cents").alias("field"), F.lit("min_int").alias("kind"), F.lit(None).cast("string").alias("s"), cents("value").alias("n")),
        F.struct(F.lit("first_event").alias("field"), F.lit("immutable_string").alias("kind"), F.col("event_type").alias("s"), F.lit(None).cast("bigint").alias("n")),
    )
    rows = events.select(F.lit(TENANT).alias("tenant_id"), uid("UserSession", "user_id").alias("uid"), F.explode(kinds).alias("w"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ingested"), "event_id")
    return rows.select("tenant_id", "uid", "w.*", "ingested", "event_id")


def _data(**fields: Column | str) -> Column:
    return F.concat(*[F.concat(F.lit(f'<Data Name="{k}">'), F.lit(v) if isinstance(v, str) else v.cast("string"), F.lit("</Data>")) for k, v in fields.items()])


def sysmon_logs(events: DataFrame, event_id: int | Column, image: Column | None = None, parent: Column | None = None, whole_header: bool = False) -> DataFrame:
    """events as XML payloads (tenant_id, event_id, log_event) of one kind of event, or of a kind by row.

    image, parent: names of the process and its parent.
    """
    return events.select(F.lit(TENANT).alias("tenant_id"), "event_id", sysmon_text(event_id, image, parent, whole_header).alias("log_event"))


def sysmon_text(event_id: int | Column, image: Column | None = None, parent: Column | None = None, whole_header: bool = False) -> Column:
    """The payload of an event, as sysmon_logs has it."""
    time = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")
    kind = F.lit(event_id) if isinstance(event_id, int) else event_id
    host = F.concat(F.lit("HOST-"), F.col("user_id") % 7)
    image = F.concat(F.lit("C:\\bin\\"), F.concat(F.col("event_type"), F.lit(".exe")) if image is None else image)
    data = _data(
        UtcTime=time,
        CreationUtcTime=time,
        ProcessId=F.col("user_id"),
        Image=image,
        CommandLine=F.concat(F.col("event_type"), F.lit(" &amp; "), F.col("event_id")),
        ParentProcessId=F.col("user_id") + 1,
        ParentImage="C:\\Windows\\svchost.exe" if parent is None else F.concat(F.lit("C:\\Windows\\"), parent),
        ParentCommandLine="svchost -k",
        TargetFilename=F.concat(F.lit("C:\\tmp\\f"), F.col("event_id"), F.lit(":Zone.Identifier")),
        Protocol="tcp",
        Initiated=F.when(F.col("event_type") == "click", "true").otherwise("false"),
        SourceIp=F.concat(F.lit("10.0.0."), F.col("user_id") % 250),
        SourcePort=F.col("event_id") % 60000,
        DestinationIp="93.184.216.34",
        DestinationPort="443",
    )
    rest = [F.lit("")]
    if whole_header:
        rest = [F.lit("<Version>5</Version><Level>4</Level><Task>1</Task><Opcode>0</Opcode><TimeCreated SystemTime=\""), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit("\"/><EventRecordID>"), F.col("event_id"), F.lit("</EventRecordID><Correlation ActivityID=\"a-"), F.col("event_id"), F.lit("\"/><Execution ProcessID=\""), F.col("user_id"), F.lit("\" ThreadID=\""), F.col("event_id") % 97]
        rest.append(F.lit("\"/><Channel>Microsoft-Windows-Sysmon/Operational</Channel><Security UserID=\"S-1-5-18\"/>"))
    system = F.concat(F.lit('<System><Provider Name="Sysmon" Guid="{5770385F-C22A-43E0-BF4C-06F5698FFBD9}"/><EventID>'), kind.cast("string"), F.lit("</EventID><Keywords>0x8000000000000000</Keywords>"), *rest, F.lit("<Computer>"), host, F.lit("</Computer></System>"))
    return F.concat(F.lit("<Event>"), system, F.lit("<EventData>"), data, F.lit("</EventData></Event>"))


def osquery_logs(events: DataFrame, pack: str) -> DataFrame:
    """events as JSON payloads (tenant_id, event_id, log_event) of one pack."""
    seconds = F.expr("unix_seconds(cast(ts as timestamp))")
    actions = F.create_map(*[F.lit(x) for p in (("signup", "CREATED"), ("click", "DELETED"), ("view", "OPENED"), ("purchase", "MOVED_FROM"), ("error", "MOVED_TO")) for x in p])
    text = lambda c: c.cast("string")
    columns = {
        "processes": F.struct(text(F.col("user_id")).alias("pid"), F.col("event_type").alias("name"), F.when(F.col("event_type") != "view", F.concat(F.lit("/bin/"), F.col("event_type"))).otherwise("").alias("path"), F.lit("x").alias("cmdline"), F.when(F.col("event_type") == "error", "-1").otherwise(text(F.col("user_id") + 1)).alias("parent"), F.when(F.col("event_type") == "click", "-1").otherwise(text(seconds)).alias("time")),
        "files": F.struct(F.concat(F.lit("/tmp/"), F.col("event_id")).alias("target_path"), actions[F.col("event_type")].alias("action"), text(seconds).alias("time")),
        "process-files": F.struct(F.lit("3").alias("fd"), F.concat(F.lit("/tmp/"), F.col("event_id")).alias("path"), text(F.col("user_id")).alias("pid")),
    }[pack]
    action = F.when(F.col("event_type") == "signup", "added").when(F.col("event_type") == "click", "removed").otherwise("snapshot")
    line = F.struct(F.lit(f"pack_site_{pack}").alias("name"), F.concat(F.lit("host-"), F.col("user_id") % 7).alias("hostIdentifier"), seconds.alias("unixTime"), action.alias("action"), columns.alias("columns"))
    return events.select(F.lit(TENANT).alias("tenant_id"), "event_id", F.to_json(line).alias("log_event"))


def queue_rows(events: DataFrame) -> DataFrame:
    """events as work-queue rows: a plugin per event type, a source per user; errors failed, purchases are processed."""
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("value") < 3, "processed").otherwise("enqueued")
    return events.select(F.col("event_id").alias("execution_key"), F.col("event_type").alias("plugin_id"), F.concat(F.lit("s"), F.col("user_id") % 10).alias("event_source_id"), status.alias("status"), ms("ts").alias("creation_time"), ms("ts").alias("last_updated"), (ms("ts") + cents("value") * 1000).alias("visible_after"), F.lit(-1).alias("try_count"))
