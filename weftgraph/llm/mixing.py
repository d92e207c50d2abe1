"""Operator 3, mixing sources to target weights: systematic sampling.

Each source gets a target number of words by its weight, capped at a multiple of what it has, the excess reshared.
Every document then has target / size expected copies. Within its source these are prefix-summed, one random offset
per source is added, and the document is emitted once for each whole number its interval crosses.

The order of the prefix sum is by blocks of about BLOCK_ROWS documents (a hash of the row, as many blocks as the
source's size asks for) and by size within a block, so neighbours have like sizes and a source's words come near its
target. A source of any size is spread over its blocks; only one row per block meets in one order. Equal rows are
counted before they meet and stand next to each other as one.

A null source is a source of its own, after all others. A null text has size 0; a source without words takes nothing
of any target and its documents get no copies. Rows that repeat each count. The offset and the blocks come from
`seed`, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm import shared

BLOCK_ROWS = 512
#: Fixed by the contract: weights of sources in code point order, repeating; share of all words; cap by source.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0


def size_of(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(shared.WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, n_docs) -> with target.

    Water filling in one pass: sources in order of cap / weight; a source is at its cap as long as the level that the
    rest would get is not below it. One row per source is put in order, never one per document.
    """
    everything = Window.partitionBy(F.lit(0))
    ordered = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", w).withColumn("most", F.col("source_size") * cap).withColumn("total", F.sum("source_size").over(everything) * share)
    by_level = Window.partitionBy(F.lit(0)).orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    rows = rows.withColumn("level", level).withColumn("open", F.col("most") > F.col("weight") * F.col("level"))
    final = F.min(F.when(F.col("open"), F.struct(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(everything)["level"]
    return rows.withColumn("final", final).withColumn("target", F.when(F.col("final").isNull(), F.col("most")).otherwise(F.least("most", F.col("weight") * F.col("final")))).select("source", "source_size", "n_docs", "target")


def systematic(docs: DataFrame, size: str, seed: int = 0, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """docs (source, `size`, row: a column that names the row) with source_size, target, rows and copies.

    Rows of one name, source and size are one row of the result: `rows` of them, with `copies` together.
    """
    docs = docs.groupBy("source", size, "row").agg(F.count("*").alias("rows"))
    sizes = docs.groupBy("source").agg(F.sum(F.col(size) * F.col("rows")).alias("source_size"), F.sum("rows").alias("n_docs"))
    goal = targets(sizes, weights, share, cap).withColumnRenamed("source", "goal_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = goal.withColumn("rate", rate).withColumn("blocks", F.ceil(F.col("n_docs") / BLOCK_ROWS))
    rows = docs.join(goal, F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("row", F.lit(seed)), F.col("blocks")))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("source", "block").agg(F.sum("rows").alias("n")).select(F.col("source").alias("s"), F.col("block").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("source", "block").orderBy(size, F.xxhash64("row", F.lit(seed + 1)), "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.sum("rows").over(within))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    offset = F.pmod(F.xxhash64("source", F.lit(seed), F.lit("offset")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    place = F.col("before") + F.col("upto")
    copies = F.floor(offset + F.col("rate") * place) - F.floor(offset + F.col("rate") * (place - F.col("rows")))
    return rows.withColumn("copies", copies.cast("long")).drop("s", "b", "before", "upto", "block", "blocks", "rate", "n_docs")


def _slim(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """What the draw needs of each row; rows with the same id and text share the name `row`."""
    named = docs.select(F.col(id_col).cast("long").alias("row_id"), F.xxhash64(F.col(id_col), text_col).alias("text_key"), F.col(source_col).alias("source"), size_of(text_col).alias("size"))
    return named.select(F.struct("row_id", "text_key").alias("row"), "source", "size")


def mix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row."""
    drawn = systematic(_slim(docs, id_col, text_col, source_col), "size", seed)
    each = drawn.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("place"))
    return each.select(F.col("row.row_id").alias("doc_id"), "size", "source_size", "target", (_share_of_each() * F.col("size")).alias("taken"))


def _share_of_each() -> Column:
    """The copies of the row at `place` among `rows` equal ones that have `copies` together."""
    return F.expr("copies div rows") + F.when(F.col("place") <= F.expr("copies % rows"), 1).otherwise(0)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """The mix itself: each row of docs as often as it was drawn, with docs' columns.

    The draw runs on ids, sizes and sources alone. A row is known by its id and its text's hash, so rows that repeat
    get equal draws summed and dealt out in turn; the texts join once, on that key.
    """
    names = docs.columns
    keyed = docs.select(F.struct(*[F.col(c) for c in names]).alias("doc"), F.xxhash64(F.col(id_col), text_col).alias("text_key"))
    key = ["text_key", "row_id", "source"]
    keyed = keyed.withColumn("row_id", F.col(f"doc.{id_col}").cast("long")).withColumn("source", F.col(f"doc.{source_col}"))
    drawn = systematic(_slim(docs, id_col, text_col, source_col), "size", seed).where("copies > 0")
    draws = drawn.select(F.col("row.text_key").alias("_text_key"), F.col("row.row_id").alias("_row_id"), F.col("source").alias("_source"), "copies", "rows")
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    dealt = keyed.join(draws, on)
    once = dealt.where("rows = 1").withColumn("times", F.col("copies"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))
    often = dealt.where("rows > 1").withColumn("place", place).withColumn("times", _share_of_each())
    both = once.select("doc", "times").unionByName(often.select("doc", "times"))
    return both.where("times > 0").select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy")).select("doc.*")
