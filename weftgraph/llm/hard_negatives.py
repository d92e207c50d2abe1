"""Operator 11, hard negatives by a Voronoi-partitioned kNN join.

Larger inner products are smaller distances once norms are made alike: a row x gets one more coordinate,
sqrt(M - |x|^2) with M the largest squared norm, an anchor q gets 0, and |q - x|^2 = |q|^2 + M - 2 q.x. Rows belong to
the nearest of some pivots, which are rows themselves; a cell's rows are packed in order of their distance to its pivot
into blocks, so that a block is a shell of its cell. Anchors belong to cells too, and are packed into groups.

A search asks for the `k` best rows of one anchor whose scores lie between two limits and whose label is (or isn't) the
anchor's. It runs in two steps:
1. A group meets the blocks of its own cell. Who found `k` rows needs no lower score than the last of them.
2. What is left of a search are distances between two bounds. By the triangle inequality with each pivot, and by the
   plane between two pivots, a block is sent to a group only if one of its rows may lie there for one of the searches.
Each group and some of its blocks are then joined exactly, in whole numbers, and the best of all tasks are ranked.

Positives are a search without limits; each positive's negatives are a search between two shares of its score. How many
rows the bounds spare depends on the data: in many dimensions without clusters it is few, and a search compares all.

Rows without an id, a label or a vector, or with a null, non-finite or enormous entry (vectors.usable; a squared norm of
2**62), take no part. Shorter vectors end in zeros. Rows that repeat wholly count once; rows that share an id but differ
are rows of their own, as anchors too. Ties go by id. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm import shared, vectors

POSITIVES = 5
NEGATIVES = 10
LOW = 30
HIGH = 90
#: There are as many pivots as the root of the number of anchors, up to this; results do not depend on them.
MOST_PIVOTS = 256
SAMPLE = 16
BLOCK_ROWS = 2048
GROUP_ROWS = 4096
#: Blocks next to each other that meet a group in one task.
PIECE_BLOCKS = 16
_SEARCHES = 256
_FAR = 1 << 62
_SLACK = 1e-6
_BLOCKS = "block long, cell int, near double, far double, ids binary, labels binary, x binary"
_FOUND = "anchors long, search int, anchor_id long, score long, vec_id long"
ROWS = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass(frozen=True)
class Space:
    """width: of vectors; most: the largest squared norm; kind: how components are stored; pivots: rows of longs."""

    width: int
    most: int
    kind: str
    pivots: np.ndarray

    @property
    def exact(self) -> type:
        """Doubles hold all sums of products below 2**53, longs all others."""
        return np.float64 if self.most < 1 << 53 else np.int64

    @property
    def slack(self) -> float:
        return _SLACK * max(1.0, float(self.most) ** 0.5)

    def to_pivots(self, x: np.ndarray, are_anchors: bool) -> np.ndarray:
        """Distances of rows to the pivots."""
        p, x = self.pivots.astype(float), x.astype(float)
        own, theirs = np.square(x).sum(axis=1), np.square(p).sum(axis=1)
        height = np.sqrt(np.maximum(self.most - theirs, 0))
        mine = np.zeros(len(x)) if are_anchors else np.sqrt(np.maximum(self.most - own, 0))
        return np.sqrt(np.maximum(own[:, None] + theirs[None, :] - 2 * (x @ p.T) + np.square(mine[:, None] - height[None, :]), 0))

    def between_pivots(self) -> np.ndarray:
        return self.to_pivots(self.pivots, False)

    def unpacked(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, self.kind).reshape(-1, self.width)


def rows_of(embeddings: DataFrame, id_col: str, label_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(vec_id, label, x, norm) of the rows that take part, each once, written, and the dimension."""
    own = embeddings.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & vectors.usable(F.col(vector_col)))
    own = own.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), vectors.whole(F.col(vector_col)).alias("x"))
    norm = F.aggregate("x", F.lit(0.0), lambda total, c: total + c.cast("double") * c.cast("double"))
    rows, width = vectors.padded(own.withColumn("norm", norm).where(F.col("norm") < float(_FAR)))
    return vectors.written_rows(rows.distinct(), "vectors"), width


def space_of(rows: DataFrame, width: int, anchor: Column) -> Space | None:
    """The pivots are rows far apart, of a sample of SAMPLE times as many, the first in order of a hash; None without anchors."""
    most = rows.agg(F.max("norm").alias("norm"), F.max(F.array_max(F.transform("x", F.abs))).alias("component"), F.count_if(anchor).alias("anchors")).first()
    if most.norm is None or not most.anchors:
        return None
    n = int(min(MOST_PIVOTS, np.ceil(most.anchors**0.5)))
    chosen = rows.orderBy(F.xxhash64("vec_id", "label", "x")).limit(n * SAMPLE).select("x").collect()
    kind = next(k for k in ("<i2", "<i4", "<i8") if (most.component or 0) < np.iinfo(k).max)
    # The norm is a sum in doubles: a little more is on the safe side.
    whole = Space(width, int(most.norm * (1 + 1e-9)) + 1, kind, np.unique(np.array([r.x for r in chosen], np.int64).reshape(len(chosen), width), axis=0))
    return replace(whole, pivots=apart(whole, n))


def apart(space: Space, n: int) -> np.ndarray:
    """n of a space's pivots, or all: each the one farthest from those before it."""
    taken = [0]
    away = replace(space, pivots=space.pivots[:1]).to_pivots(space.pivots, False)[:, 0]
    while len(taken) < min(n, len(space.pivots)):
        taken.append(int(away.argmax()))
        away = np.minimum(away, replace(space, pivots=space.pivots[taken[-1:]]).to_pivots(space.pivots, False)[:, 0])
    return space.pivots[taken]


def packed(rows: DataFrame, space: Space, size: int, are_anchors: bool) -> DataFrame:
    """_BLOCKS of up to `size` rows of one cell, in order of their distance to its pivot; one exchange, by ranges."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = space.to_pivots(vectors.matrix(batch.column(2), space.width), are_anchors)
            cell = away.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away[np.arange(len(cell)), cell])], names=["vec_id", "label", "x", "cell", "away"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n, key = TaskContext.get().partitionId() << 32, [], 0, None

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            away = t.column("away").to_numpy()
            x = vectors.matrix(t.column("x").combine_chunks(), space.width).astype(space.kind)
            values = [number, key, away.min(), away.max(), t.column("vec_id").to_numpy().tobytes(), t.column("label").to_numpy().tobytes(), x.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()))], names=["block", "cell", "near", "far", "ids", "labels", "x"])

        for batch in batches:
            cells = batch.column(3).to_numpy()
            lo = 0
            while lo < len(cells):
                if held and (cells[lo] != key or n == size):
                    yield block()
                    number, held, n = number + 1, [], 0
                key = int(cells[lo])
                hi = min(int(np.searchsorted(cells, key, side="right")), lo + size - n)
                held.append(batch.slice(lo, hi - lo))
                n += hi - lo
                lo = hi
        if held:
            yield block()

    found = rows.select("vec_id", "label", "x").mapInArrow(placed, "vec_id long, label long, x array<long>, cell int, away double")
    order = ["cell", "away", "vec_id"]
    return shared.written(found.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _BLOCKS), "vector-blocks")


def asking(groups: DataFrame, searches: DataFrame) -> DataFrame:
    """groups (_BLOCKS, of anchors) with their searches (anchors, search, slot, low, high) as arrays; those that ask."""
    held = searches.groupBy("anchors").agg(F.collect_list(F.struct("search", "slot", "low", "high")).alias("s"))
    columns = [F.col(f"s.{c}").alias(c) for c in ("search", "slot", "low", "high")]
    return groups.join(held, groups.block == held.anchors).select("anchors", "cell", "ids", "labels", "x", *columns)


def reached(asks: DataFrame, space: Space) -> DataFrame:
    """(anchors, cell, own, least, most): cells in which rows may answer a group's searches, if their distance to the pivot lies between the two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = space.between_pivots()
        for batch in batches:
            for anchors, cell, raw, slot, low, high in zip(*(batch.column(i).to_pylist() for i in range(6))):
                q = space.unpacked(raw)
                away = space.to_pivots(q, True)
                whole = np.square(q.astype(float)).sum(axis=1) + space.most
                n = len(space.pivots)
                least, most, open_ = np.full(n, np.inf), np.full(n, -np.inf), np.zeros(n, bool)
                for lo in range(0, len(slot), _SEARCHES):
                    own = np.array(slot[lo : lo + _SEARCHES])
                    far = np.sqrt(np.maximum(whole[own] - 2 * np.array(low[lo : lo + _SEARCHES], float), 0))[:, None]
                    near = np.sqrt(np.maximum(whole[own] - 2 * np.array(high[lo : lo + _SEARCHES], float), 0))[:, None]
                    d = away[own]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        plane = np.where(apart[cell] > 0, (np.square(d) - np.square(d[:, [cell]])) / (2 * apart[cell]), 0)
                    may = plane <= far + space.slack
                    least = np.minimum(least, np.where(may, np.maximum(d - far, near - d), np.inf).min(axis=0))
                    most = np.maximum(most, np.where(may, d + far, -np.inf).max(axis=0))
                    open_ |= may.any(axis=0)
                to = np.flatnonzero(open_)
                columns = [np.full(len(to), anchors), to.astype(np.int32), to == cell, least[to] - space.slack, most[to] + space.slack]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchors", "cell", "own", "least", "most"])

    return asks.select("anchors", "cell", "x", "slot", "low", "high").mapInArrow(run, "anchors long, cell int, own boolean, least double, most double")


def best(score: np.ndarray, ids: np.ndarray, of: np.ndarray, k: int) -> np.ndarray:
    """Indices of the first k of each group in `of`, by falling score, then id; in order of the groups."""
    order = np.lexsort((ids, -score, of))
    head = np.flatnonzero(np.append(True, of[order][1:] != of[order][:-1])) if len(order) else order
    place = np.arange(len(order)) - np.repeat(head, np.diff(np.append(head, len(order))))
    return order[place < k]


class Group:
    """A group's searches and the best rows that they found so far."""

    def __init__(self, space: Space, same: bool, k: int, row: dict):
        self.space, self.same, self.k, self.anchors = space, same, k, row["anchors"]
        self.x = space.unpacked(row["x"])
        self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
        self.search, self.slot, self.low, self.high = (np.array(row[c], np.int64) for c in ("search", "slot", "low", "high"))
        self.floor = self.low.copy()
        self.of, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def meets(self, row: dict) -> None:
        kind = self.space.exact
        x = self.space.unpacked(row["x"])
        ids, labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
        score = (self.x.astype(kind) @ x.astype(kind).T).astype(np.int64)
        if self.same:
            # Only a search for the same label can meet the anchor itself.
            _, mine, theirs = self._shared(ids)
            for i, j in zip(mine, theirs):
                if self.labels[i] == labels[j] and np.array_equal(self.x[i], x[j]):
                    score[i, j] = -_FAR - 1
        found = [(self.of, self.score, self.id)]
        for lo in range(0, len(self.slot), _SEARCHES):
            here = slice(lo, lo + _SEARCHES)
            own = self.slot[here]
            s = score[own]
            fits = (s >= self.floor[here, None]) & (s <= self.high[here, None]) & ((labels[None, :] == self.labels[own][:, None]) == self.same)
            if s.shape[1] > self.k:
                # Those below a search's k-th best of this block are out.
                at = s.shape[1] - self.k
                fits &= s >= np.partition(np.where(fits, s, -_FAR - 1), at, axis=1)[:, [at]]
            of, at = np.nonzero(fits)
            found.append((of + lo, s[of, at], ids[at]))
        of, score, ids = (np.concatenate(c) for c in zip(*found))
        keep = best(score, ids, of, self.k)
        self.of, self.score, self.id = of[keep], score[keep], ids[keep]
        full, last = np.unique(self.of[::-1], return_index=True)
        count = np.bincount(self.of, minlength=len(self.slot))
        last = len(self.of) - 1 - last
        some = count[full] == self.k
        self.floor[full[some]] = self.score[last[some]]

    def _shared(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (id, index of the anchor, index of the row) with the same id."""
        order = np.argsort(self.ids, kind="stable")
        a = np.searchsorted(self.ids[order], ids, side="left")
        b = np.searchsorted(self.ids[order], ids, side="right")
        n = b - a
        at = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return np.repeat(ids, n), order[at], np.repeat(np.arange(len(ids)), n)

    def rows(self) -> pa.RecordBatch:
        n = len(self.of)
        columns = [np.full(n, self.anchors), self.search[self.of].astype(np.int32), self.ids[self.slot[self.of]], self.score, self.id]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchors", "search", "anchor_id", "score", "vec_id"])


def joined(asks: DataFrame, blocks: DataFrame, pairs: DataFrame, space: Space, same: bool, k: int) -> DataFrame:
    """_FOUND: the best rows of each search in each piece, from pairs (anchors, block) of groups and the blocks sent to them."""
    piece = F.xxhash64("anchors", F.shiftright("block", int(np.log2(PIECE_BLOCKS)))).alias("piece")
    dealt = pairs.select("anchors", "block", piece)
    none = F.lit(None).cast("array<long>")
    left = dealt.select("piece", "anchors").distinct().join(asks, "anchors").select("piece", F.lit(0).alias("is_block"), "anchors", "ids", "labels", "x", *[F.col(c).cast("array<long>").alias(c) for c in ("search", "slot", "low", "high")])
    right = dealt.join(blocks, "block").select("piece", F.lit(1).alias("is_block"), "anchors", "ids", "labels", "x", *[none.alias(c) for c in ("search", "slot", "low", "high")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, key = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                if not row["is_block"]:
                    if group is not None:
                        yield group.rows()
                    group, key = Group(space, same, k, row), row["piece"]
                    continue
                if row["piece"] != key:
                    raise ValueError("a block without its group")
                group.meets(row)
        if group is not None:
            yield group.rows()

    return left.unionByName(right).repartition("piece").sortWithinPartitions("piece", "is_block").mapInArrow(run, _FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """found with rank, the first k of each search; Spark limits each task's rows before they meet."""
    order = Window.partitionBy("anchors", "search").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def searched(groups: DataFrame, blocks: DataFrame, searches: DataFrame, space: Space, same: bool, k: int) -> DataFrame:
    """_FOUND and rank: the k best rows of each of searches (anchors, search, slot, low, high); written."""
    shells = blocks.select("block", "cell", "near", "far")

    def step(asks: DataFrame, own: bool) -> DataFrame:
        cells = reached(asks, space).where(F.col("own") == own)
        pairs = shells.join(cells, "cell").where("far >= least and near <= most").select("anchors", "block")
        return joined(asks, blocks, pairs, space, same, k)

    first = shared.written(ranked(step(asking(groups, searches), True), k), "found-near")
    last = first.where(F.col("rank") == k).select("anchors", "search", F.col("score").alias("last"))
    raised = searches.join(last, ["anchors", "search"], "left").withColumn("low", F.greatest("low", F.coalesce("last", "low"))).drop("last")
    asks = shared.written(asking(groups, raised), "asking")
    out = shared.written(ranked(first.drop("rank").unionByName(step(asks, False)), k), "found")
    shared.dropped(first, asks)
    return out


def _share(score: Column, percent: int, up: bool) -> Column:
    """percent of a score, as a whole number, rounded up or down; exact for any long."""
    part = score.cast("decimal(20,0)") * F.lit(percent).cast("decimal(3,0)") * F.lit("0.01").cast("decimal(2,2)")
    return (F.ceil(part) if up else F.floor(part)).cast("long")


def mine(embeddings: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """ROWS: for each anchor and each of its first `positives` rows of the same label the first `negatives` rows of other labels with a score between `low` and `high` percent of the positive's.

    anchor: which rows are anchors, a condition on vec_id.
    """
    spark = embeddings.sparkSession
    shared.arrow_sized(spark)
    rows, width = rows_of(embeddings, id_col, label_col, vector_col)
    space = space_of(rows, width, anchor)
    if space is None:
        return spark.createDataFrame([], ROWS)
    blocks, groups = packed(rows, space, BLOCK_ROWS, False), packed(rows.where(anchor), space, GROUP_ROWS, True)
    slot = F.posexplode(F.sequence(F.lit(1), (F.octet_length("ids") / 8).cast("int"))).alias("slot", "_")
    every = groups.select(F.col("block").alias("anchors"), slot).select("anchors", F.col("slot").alias("search"), "slot", F.lit(-_FAR).alias("low"), F.lit(_FAR).alias("high"))
    near = searched(groups, blocks, every, space, True, positives)
    # A positive is a search: its number holds the anchor's slot and the positive's rank.
    named = near.select("anchors", (F.col("search") * positives + F.col("rank") - 1).alias("search"), F.col("search").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    between = named.select("anchors", "search", "slot", _share(F.col("positive_score"), low, True).alias("low"), _share(F.col("positive_score"), high, False).alias("high")).where("low <= high")
    found = searched(groups, blocks, between, space, False, negatives)
    out = found.join(named.drop("slot"), ["anchors", "search"])
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: Fixed by the contract of op11: which labels are made wrong, and which rows are anchors.
WRONG_EVERY = 7
LABELS = 10
ANCHOR_EVERY = 100


def with_wrong_labels(embeddings: DataFrame) -> DataFrame:
    """embeddings whose label is the next one where vec_id is divisible by WRONG_EVERY."""
    label = F.col("label").cast("long")
    return embeddings.withColumn("label", F.when(F.col("vec_id") % WRONG_EVERY == 0, (label + 1) % LABELS).otherwise(label))


def is_anchor() -> Column:
    return F.col("vec_id") % ANCHOR_EVERY == 0


ORACLE = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, unnest(embedding) AS c, generate_subscripts(embedding, 1) AS i
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
), v AS (
  SELECT vec_id, label, i, CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT) AS x FROM e
  WHERE vec_id NOT IN (SELECT vec_id FROM e WHERE c IS NULL OR NOT isfinite(c))
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(sum(a.x * b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.i = b.i AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 GROUP BY a.vec_id, b.vec_id, a.label = b.label
), p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS k FROM s WHERE same) WHERE k <= 5
), n AS (
  SELECT p.anchor_id, p.other AS positive_id, p.score AS positive_score, s.other AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other) AS k
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= 10
"""
