"""Merging property writes and edges into graph state, and what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import identity

#: One property write: text in s, numbers in n; (ingested, event_id) is a total order of writes.
WRITES = "tenant_id string, uid bigint, field string, kind string, s string, n bigint, ingested bigint, event_id bigint"
KEY = ["tenant_id", "uid", "field"]


def _order(writes: DataFrame) -> Column:
    """Which write is first: of several by one event the one that stands first, where writes have a position. No value is no write."""
    place = [c for c in ("position",) if c in writes.columns]
    return F.when(F.col("s").isNotNull() | F.col("n").isNotNull(), F.struct("ingested", "event_id", *place, "s", "n"))


def partial_properties(writes: DataFrame) -> DataFrame:
    """Sums of writes that merge again: (key, kind range, first s and n, their order, most, least).

    Every field is a max, a min or a least by order, so partials of any split of the writes merge to the same state.
    """
    return writes.groupBy(*KEY).agg(F.min("kind").alias("kind"), F.max("kind").alias("kind_max"), F.min(_order(writes)).alias("first"), F.max("n").alias("most"), F.min("n").alias("least"))


def merge_partials(partials: DataFrame) -> DataFrame:
    return partials.groupBy(*KEY).agg(F.min("kind").alias("kind"), F.max("kind_max").alias("kind_max"), F.min("first").alias("first"), F.max("most").alias("most"), F.min("least").alias("least"))


def finished(partials: DataFrame) -> DataFrame:
    """(tenant_id, uid, field, kind, s, n): max and min by kind, the first write where immutable."""
    n = F.when(F.col("kind").startswith("max_"), F.col("most")).when(F.col("kind").startswith("min_"), F.col("least")).otherwise(F.col("first.n"))
    return partials.where("kind = kind_max").select(*KEY, "kind", F.when(F.col("kind").startswith("immutable_"), F.col("first.s")).alias("s"), n.alias("n"))


def merge_properties(writes: DataFrame) -> DataFrame:
    """One value per (tenant, uid, field), whatever the order or repetition of writes; one shuffle, combined map-side."""
    return finished(partial_properties(writes))


def conflicts(writes: DataFrame) -> DataFrame:
    """(tenant_id, uid, field) written with several kinds; merge_properties leaves them out."""
    return partial_properties(writes).where("kind <> kind_max").select(*KEY)


def node_types(nodes: DataFrame) -> DataFrame:
    """(tenant_id, uid, node_type), distinct; uid 0 is not a node."""
    return nodes.where("uid <> 0").select("tenant_id", "uid", "node_type").distinct()


def create_nodes(entities: DataFrame) -> DataFrame:
    """(tenant_id, uid, node_type, entity) from distinct (tenant_id, node_type, entity): uids by hash, so a retry creates the same."""
    key = identity.key_text([F.col("tenant_id"), F.col("node_type"), F.col("entity")])
    return entities.select("tenant_id", "node_type", "entity").distinct().select("tenant_id", identity.uid_of(key).alias("uid"), "node_type", "entity")


def latest_reverse(edge_schemas: DataFrame) -> DataFrame:
    """(tenant_id, node_type, edge, reverse) of the newest schema version."""
    keys = ["tenant_id", "node_type", "edge"]
    return edge_schemas.groupBy(*keys).agg(F.max_by("reverse", "version").alias("reverse"))


def add_reverse_edges(edges: DataFrame, reverse: dict[str, str]) -> DataFrame:
    """(tenant_id, src, edge, dst) with each edge's opposite, distinct, no edge from a node to itself."""
    names = F.create_map(*[F.lit(x) for pair in reverse.items() for x in pair])
    both = F.array(F.struct("src", "edge", "dst"), F.struct(F.col("dst").alias("src"), names[F.col("edge")].alias("edge"), F.col("src").alias("dst")))
    return edges.where("src <> dst").select("tenant_id", F.explode(both).alias("e")).select("tenant_id", "e.*").distinct()


def changed_properties(old: DataFrame, new: DataFrame) -> DataFrame:
    """(tenant_id, uid, field): values that are new or differ from the old state; exact, so nothing redundant passes."""
    o = old.select(*KEY, F.col("s").alias("_s"), F.col("n").alias("_n"))
    return new.join(o, KEY, "left").where(~F.col("s").eqNullSafe(F.col("_s")) | ~F.col("n").eqNullSafe(F.col("_n"))).select(*KEY)


def changed_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    cols = ["tenant_id", "src", "edge", "dst"]
    return new.select(cols).distinct().join(old.select(cols), cols, "left_anti")


def change_feed(old: DataFrame, new: DataFrame, old_edges: DataFrame, new_edges: DataFrame) -> DataFrame:
    """Changes as analyzers take them (kind, uid, name, src, dst), from partials of properties and from edges."""
    none = F.lit(None).cast("bigint")
    properties = merge_state(old, new)[1].select(F.lit("property").alias("kind"), "uid", F.col("field").alias("name"), none.alias("src"), none.alias("dst"))
    return properties.unionByName(changed_edges(old_edges, new_edges).select(F.lit("edge").alias("kind"), none.alias("uid"), F.col("edge").alias("name"), "src", "dst"))


def merge_state(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state, changes) of partials old and new."""
    state = merge_partials(old.unionByName(new))
    return state, changed_properties(finished(old), finished(state))
