"""Operator 2, MinHash near-duplicates: tensored banding.

A document is the set of its distinct word shingles. Two small collections of sub-signatures, each of `rows`
minhashes, are computed; table (i, j) is keyed by the pair of the i-th of the first and the j-th of the second. So
`side`**2 tables of 2 * rows minhashes each cost only 2 * rows * side minhash functions. `side` follows from the
similarity and the chance that a pair exactly at it is missed.

Equal sets are one class from the start, so copies meet in no table. A class goes through the shuffle once for each
sub-signature of the first collection, with the whole second one: the tables that share the first half of their keys
are looked up together where it lands. An entry's members hang on its least one. Frequent halves are dealt out over
several tasks and cut into bounded runs, whose least members meet in a second, pre-aggregated step.

Classes that entries connect form a cluster of candidates, and every link in it is told from full sets:
1. A cluster of one block (by texts and by bytes) is compared in one task.
2. A larger one is first taken apart exactly, by prefixes: sets that overlap enough share one of their rarest shingles,
   rarest within the cluster. Clusters chained by what many share, and copies with many edits of their own, fall out.
3. What stays together is compared in rounds. In each, some blocks of members are compared with all members. Those
   found linked to one connected set of them need not meet each other, and the largest such set of a cluster is not
   asked any more; the round's blocks grow eightfold. So a group of near copies costs a few comparisons a member,
   however large it is, and no link is missed: of any two members, both are in that set or one met all others.

Null and wordless texts have no shingles and are linked with nothing. Rows that share a doc_id are one document. Rows
without a doc_id are linked with nothing: component_id is null, kept is true. Other columns are not read. Long texts
are hashed in pieces; their sets are held whole, 8 bytes a shingle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import shared
from weftgraph.llm.components import components

BLOCK_SETS = 96
BLOCK_BYTES = 1 << 20
HOT_ROWS = 20_000
MOST_HOT = 100_000
_PIECE = 1 << 18
_LONG = 1 << 20
_CHUNK = 8192
_GROWTH = 8


@dataclass(frozen=True)
class Likeness:
    """shingle words; links from `percent` of the union on; chance to miss a pair exactly there."""

    shingle: int = 5
    percent: int = 80
    rows: int = 3
    miss: float = 2e-5
    seed: int = 0x5EED

    @property
    def side(self) -> int:
        return math.ceil(math.log(self.miss / 2) / math.log(1 - (self.percent / 100) ** self.rows))


#: Fixed by the contract of op2.
CONTRACT = Likeness(shingle=3, percent=85)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row of UTF-8 bytes, and the rows' ranges of them."""
    out: list[np.ndarray] = []
    for lo, hi, part, at in shared.pieces(data, offs, _PIECE):
        if hi - lo == 1 and len(part) > _LONG:
            out.append(_long_set(part, k))
            continue
        part = shared.lower_ascii(part)
        starts, ends, ranges = shared.word_spans(part, at)
        words = shared.range_hash(shared.prefix_hash(part), starts, ends)
        grams, spans = shared.grams(words, ranges, k)
        for i in range(hi - lo):
            if ranges[i + 1] - ranges[i] >= k:
                out.append(np.unique(grams[spans[i] : spans[i + 1]]))
            else:
                out.append(_short_set(words[ranges[i] : ranges[i + 1]]))
    return np.concatenate([*out, np.zeros(0, np.uint64)]), np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int64)


def _short_set(words: np.ndarray) -> np.ndarray:
    n = len(words)
    return shared.mix(shared.grams(words, np.array([0, n]), n)[0] + np.uint64(n)) if n else words


def _long_set(data: np.ndarray, k: int) -> np.ndarray:
    """The set of one long row, word by word in pieces that end between words."""
    parts, carry, total, lo = [], np.zeros(0, np.uint64), 0, 0
    while lo < len(data):
        hi = shared.next_separator(data, lo + _LONG)
        part = shared.lower_ascii(data[lo:hi])
        starts, ends, _ = shared.word_spans(part, np.array([0, len(part)]))
        words = np.concatenate((carry, shared.range_hash(shared.prefix_hash(part), starts, ends)))
        total += len(starts)
        parts.append(np.unique(shared.grams(words, np.array([0, len(words)]), k)[0]))
        carry = words[max(0, len(words) - (k - 1)) :]
        lo = hi
    return np.unique(np.concatenate(parts)) if total >= k else _short_set(carry)


def minhashes(sets: np.ndarray, ranges: np.ndarray, times: np.uint64, plus: np.uint64) -> np.ndarray:
    """The least value of each row's set, none of them empty."""
    return np.minimum.reduceat(sets * times + plus, ranges[:-1])


def signatures(docs: DataFrame, like: Likeness) -> DataFrame:
    """(doc_id, n_shingles, n_bytes, set_a, set_b, u, v): a 128-bit name of the set, and the two collections.

    u are longs; v are 16 bits each, as they only part what shares a u.
    """
    rng = np.random.default_rng(like.seed)
    count = 2 * like.rows * like.side
    times = rng.integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)
    plus = rng.integers(0, 1 << 63, count, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = shared.buffers(batch.column(1))
            for lo, hi, part, at in shared.pieces(data, offs, _PIECE):
                sets, ranges = shingle_sets(part, at, like.shingle)
                n = np.diff(ranges)
                some = n > 0
                held = np.append(ranges[:-1][some], ranges[-1])
                cols = np.zeros((2 * like.side, hi - lo), np.uint64)
                names = np.zeros((2, hi - lo), np.uint64)
                if len(held) > 1:
                    for t in range(count):
                        cols[t // like.rows, some] = shared.mix(cols[t // like.rows, some] * np.uint64(3) + minhashes(sets, held, times[t], plus[t]))
                    names[0, some] = np.add.reduceat(shared.mix(sets), held[:-1])
                    names[1, some] = np.add.reduceat(shared.mix(sets ^ np.uint64(0x6A09E667F3BCC909)), held[:-1])
                side = np.arange(0, (hi - lo + 1) * like.side, like.side, dtype=np.int32)[: hi - lo + 1]
                u = pa.ListArray.from_arrays(pa.array(side), pa.array(np.ascontiguousarray(cols[: like.side].T).reshape(-1).view(np.int64)))
                v = np.ascontiguousarray((cols[like.side :] >> np.uint64(48)).astype(np.uint16).T)
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(np.diff(at)), *(pa.array(x.view(np.int64)) for x in names), u, pa.array([r.tobytes() for r in v], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "n_bytes", "set_a", "set_b", "u", "v"])

    shared.arrow_sized(docs.sparkSession)
    return docs.mapInArrow(run, "doc_id long, n_shingles long, n_bytes long, set_a long, set_b long, u array<long>, v binary")


def candidate_edges(classes: DataFrame, like: Likeness) -> DataFrame:
    """(a, b): edges that connect the classes (rep, u, v) of each table entry, one or a few a class."""
    spread = -(-HOT_ROWS // 2)
    side = like.side
    halves = classes.select(F.transform("u", lambda x, i: F.xxhash64(x, i)).alias("u"), "rep", "v")
    hot, often = shared.frequent(halves.select("u"), lambda batch: batch.column(0).flatten().to_numpy(), HOT_ROWS, MOST_HOT)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half = batch.column(0).flatten().to_numpy()
            rep = np.repeat(batch.column(1).to_numpy(), side)
            group = half.copy()
            is_hot = np.isin(half, hot)
            parts = -(-often[np.searchsorted(hot, half[is_hot])] // spread)
            salt = shared.mix(rep[is_hot].view(np.uint64)) % np.maximum(parts, 1).astype(np.uint64)
            group[is_hot] = shared.mix(half[is_hot].view(np.uint64) + salt + np.uint64(1)).view(np.int64)
            v = batch.column(2).take(pa.array(np.repeat(np.arange(batch.num_rows), side)))
            yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(rep), pa.array(np.where(is_hot, half, 0), mask=~is_hot), v], names=["group", "rep", "half", "v"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, is_cut in shared.sorted_groups(batches, HOT_ROWS):
            group, rep = t.column(0).to_numpy(), t.column(1).to_numpy()
            # A frequent half's runs, of whatever task, meet again by their least members.
            half = np.where(t.column(2).is_null().to_numpy(), group, t.column(2).fill_null(0).to_numpy())
            part = ~t.column(2).is_null().to_numpy() | is_cut
            v = np.frombuffer(b"".join(t.column(3).to_pylist()), np.uint16).reshape(-1, side)
            again = np.zeros(len(group), bool)
            again[1:] = group[1:] == group[:-1]
            again[:-1] |= again[1:]
            use = np.flatnonzero(again | part)
            if not len(use):
                continue
            group, rep, half, part, v = group[use], rep[use], half[use], part[use], v[use]
            pairs, open_ = [], []
            for j in range(side):
                order = np.lexsort((np.arange(len(use)), v[:, j], group))
                head = np.ones(len(use), bool)
                head[1:] = (group[order[1:]] != group[order[:-1]]) | (v[order[1:], j] != v[order[:-1], j])
                least = order[np.maximum.accumulate(np.where(head, np.arange(len(use)), 0))]
                pairs.append(np.stack((rep[least[~head]], rep[order[~head]]), 1))
                first = order[head]
                first = first[part[first]]
                open_.append(np.stack((half[first], np.full(len(first), j), v[first, j].astype(np.int64), rep[first]), 1))
            a, b = np.unique(np.concatenate(pairs), axis=0).T
            h, slot, value, rep = np.concatenate(open_).T
            columns = [np.concatenate((a, rep)), np.concatenate((b, rep))]
            blank = np.arange(len(a) + len(rep)) < len(a)
            extra = [pa.array(np.concatenate((np.zeros(len(a), np.int64), x)), mask=blank) for x in (h, slot, value)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), *extra], names=["a", "b", "half", "slot", "value"])

    dealt = halves.mapInArrow(entries, "group long, rep long, half long, v binary").repartition("group").sortWithinPartitions("group", "rep")
    met = shared.written(dealt.mapInArrow(meet, "a long, b long, half long, slot long, value long"), "entries")
    second = met.where("half is not null").groupBy("half", "slot", "value").agg(F.min("a").alias("least"), F.collect_set("a").alias("all")).where(F.size("all") > 1)
    edges = met.where("half is null").select("a", "b").unionByName(second.select(F.col("least").alias("a"), F.explode("all").alias("b")))
    # A class hangs on the least class of all its entries, and so do those entries' own least ones: few different edges.
    hung = edges.where("a <> b").groupBy("b").agg(F.min("a").alias("least"), F.collect_set("a").alias("others"))
    return hung.select(F.col("least").alias("a"), F.explode(F.array_append("others", F.col("b"))).alias("b")).where("a <> b").distinct()


def _blocks(count: Column, size: Column) -> Column:
    return F.greatest(F.ceil(count / BLOCK_SETS), F.ceil(size / BLOCK_BYTES), F.lit(1).cast("long"))


def sized(members: DataFrame) -> DataFrame:
    """members (cluster, rep, n_bytes) with `blocks`, how many blocks their cluster fills."""
    sizes = members.groupBy("cluster").agg(_blocks(F.count("*"), F.sum("n_bytes")).alias("blocks"))
    return members.join(sizes, "cluster")


def compared(dealt: DataFrame, like: Likeness) -> DataFrame:
    """(cluster, a, b): for each group of (group, cluster, rep, asks, text) the confirmed links between rows that ask and all rows.

    a is the least of the asking rows that are linked among themselves: where all rows ask, the group's components; else
    what each row is linked to, alike in every group with the same asking rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in shared.sorted_groups(batches):
            group, cluster, rep, asks = (t.column(i).to_numpy() for i in range(4))
            data, offs = shared.buffers(t.column(4))
            edges = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group))
            out = [np.zeros((0, 3), np.int64)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if hi - lo > 1:
                    sets, ranges = shingle_sets(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], like.shingle)
                    own = asks[lo:hi] > 0
                    a, b = links(sets, ranges, own, np.ones(hi - lo, bool), like.percent)
                    roots = least_of_each(rep[lo:hi], a[own[b]], b[own[b]])
                    pairs = np.concatenate((np.stack((roots[a], rep[lo + b]), 1), np.stack((roots, rep[lo:hi]), 1)[own]))
                    pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
                    out.append(np.concatenate((np.full((len(pairs), 1), cluster[lo]), pairs), 1))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(out).T], names=["cluster", "a", "b"])

    plain = dealt.select("group", "cluster", "rep", F.col("asks").cast("long").alias("asks"), "text")
    return plain.repartition("group").sortWithinPartitions("group").mapInArrow(run, "cluster long, a long, b long")


def least_of_each(rep: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each item the least rep of those that the links (a, b) of items connect with it."""
    root = list(range(len(rep)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            low, high = (x, y) if rep[x] <= rep[y] else (y, x)
            root[high] = low
    return rep[[find(x) for x in range(len(rep))]] if len(rep) else rep


def taken_apart(texts: DataFrame, like: Likeness) -> DataFrame:
    """(rep, part) of the members of texts (cluster, rep, text) that share a prefix shingle with another one.

    The order of shingles is by the number of members that hold them, then by hash. Only those that two hold matter:
    a member's others come before them and use up its prefix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = shared.buffers(batch.column(2))
            for lo, hi, part, at in shared.pieces(data, offs, _PIECE):
                sets, ranges = shingle_sets(part, at, like.shingle)
                n = np.diff(ranges)
                need = n - (n * like.percent + 99) // 100 + 1
                for a in range(0, len(sets), 1 << 16):
                    b = min(a + (1 << 16), len(sets))
                    own = np.searchsorted(ranges, np.arange(a, b), side="right") - 1
                    columns = [batch.column(0).slice(lo, hi - lo).to_numpy()[own], batch.column(1).slice(lo, hi - lo).to_numpy()[own], batch.column(3).slice(lo, hi - lo).to_numpy()[own], n[own], need[own], sets[a:b].view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cluster", "rep", "item", "n", "need", "shingle"])

    held = texts.select("cluster", "rep", "text", F.xxhash64("text").alias("item")).mapInArrow(run, "cluster long, rep long, item long, n long, need long, shingle long")
    # Tables that are written join by plain exchanges, of which Spark splits large parts.
    often = shared.written(held.groupBy("cluster", "shingle").agg(F.count("*").alias("often")).where("often > 1"), "shingles")
    ranked = held.join(often.hint("merge"), ["cluster", "shingle"]).groupBy("cluster", "rep", "item", "n", "need").agg(F.array_sort(F.collect_list(F.struct("often", "shingle"))).alias("known"))
    left = F.greatest(F.col("need") - (F.col("n") - F.size("known")), F.lit(0)).cast("int")
    prefix = shared.written(ranked.select("cluster", "rep", F.explode(F.slice("known", F.lit(1), left)).alias("k")).select("cluster", "rep", "k.shingle"), "prefixes")
    least = shared.written(prefix.groupBy("cluster", "shingle").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n"), "least")
    hung = prefix.join(least.hint("merge"), ["cluster", "shingle"]).groupBy("rep").agg(F.min("a").alias("least"), F.collect_set("a").alias("others"))
    edges = hung.select(F.col("least").alias("a"), F.explode(F.array_append("others", F.col("rep"))).alias("b")).where("a <> b").distinct()
    parts = components(edges).select(F.col("node").alias("rep"), F.col("component").alias("part"))
    return parts


def in_rounds(texts: DataFrame, members: DataFrame, like: Likeness) -> DataFrame:
    """(a, b): edges that connect the linked members of clusters of several blocks, from texts (rep, text) and members (cluster, rep, n_bytes), some at least."""
    rows = members.count()
    state = shared.written(members.select("cluster", "rep", "n_bytes", F.lit(False).alias("asked"), F.lit(False).alias("joined")), "round", rows)
    edges: list[DataFrame] = []
    width = 1
    while True:
        pool = ~F.col("asked") & ~F.col("joined")
        waiting = state.groupBy("cluster").agg(
            _blocks(F.count("*"), F.sum("n_bytes")).alias("chunks"),
            _blocks(F.count_if(pool), F.coalesce(F.sum(F.when(pool, F.col("n_bytes"))), F.lit(0))).alias("slots"),
            F.count_if(pool).alias("waiting"),
            F.count_if("joined").alias("most"),
        )
        left = state.join(waiting.where("waiting > 0"), "cluster").withColumn("slot", F.pmod(F.xxhash64("rep", F.lit(width)), F.col("slots")))
        left = shared.written(left.withColumn("asks", pool & (F.col("slot") < width)), "asking", rows)
        if left.isEmpty():
            break
        asking = left.where("asks").select("cluster", "rep", "slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(True).alias("asks"))
        slots = F.least(F.col("slots"), F.lit(width).cast("long"))
        others = left.where("not asked").select("cluster", "rep", F.explode(F.sequence(F.lit(0).cast("long"), slots - 1)).alias("slot"), F.pmod(F.xxhash64("rep"), F.col("chunks")).alias("chunk"), F.lit(False).alias("asks"))
        dealt = asking.unionByName(others).select(F.xxhash64("cluster", "slot", "chunk").alias("group"), "cluster", "rep", "asks")
        found = shared.written(compared(texts.join(dealt.hint("merge"), "rep").select("group", "cluster", "rep", "asks", "text"), like).distinct(), "links", rows)
        edges.append(found.select("a", "b"))
        # The members linked to one group of asking ones need not meet each other: the largest such set of a cluster so far.
        sets = found.groupBy("cluster", "a").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max(F.struct("n", "a")).alias("g")).select("cluster", "g.n", F.col("g.a").alias("root"))
        better = sets.join(waiting.select("cluster", "most"), "cluster").where("n > most").select("cluster", "root")
        linked = found.join(better, (found.cluster == better.cluster) & (found.a == better.root)).select(F.col("b").alias("rep"), F.lit(True).alias("now")).distinct()
        new = state.join(better, "cluster", "left").join(linked, "rep", "left").join(left.where("asks").select("rep", F.lit(True).alias("did")), "rep", "left")
        joined = F.when(F.col("root").isNull(), F.col("joined")).otherwise(F.coalesce("now", F.lit(False)) | (F.col("rep") == F.col("root")))
        new = shared.written(new.select("cluster", "rep", "n_bytes", F.coalesce("did", "asked").alias("asked"), joined.alias("joined")), "round", rows)
        shared.dropped(state, left)
        state, width = new, width * _GROWTH
    shared.dropped(left, state)
    return reduce(DataFrame.unionByName, edges)


def confirm(rows: DataFrame, members: DataFrame, like: Likeness) -> DataFrame:
    """(a, b): edges that connect what confirmed links connect, from rows (doc_id, text) and members (cluster, rep, n_bytes)."""
    members = shared.written(sized(members), "members")
    # Rows that repeat an id and its text are one; the join has brought an id's rows together already.
    texts = rows.join(members.hint("merge"), F.col("doc_id") == F.col("rep")).select("rep", "cluster", "blocks", "text").distinct()
    texts = shared.written(texts, "texts")
    ask = F.lit(True).alias("asks")
    small = compared(texts.where("blocks = 1").select(F.col("cluster").alias("group"), "cluster", "rep", ask, "text"), like).select("a", "b")
    large = texts.where("blocks > 1")
    if large.isEmpty():
        return small
    parts = taken_apart(large, like)
    again = sized(members.where("blocks > 1").select("rep", "n_bytes").join(parts, "rep").select(F.col("part").alias("cluster"), "rep", "n_bytes"))
    again = shared.written(again, "parts", members.count())
    own = large.select("rep", "text").join(again.hint("merge"), "rep")
    small = small.unionByName(compared(own.where("blocks = 1").select(F.col("cluster").alias("group"), "cluster", "rep", ask, "text"), like).select("a", "b"))
    rest = again.where("blocks > 1")
    if rest.isEmpty():
        return small
    return small.unionByName(in_rounds(shared.written(own.where("blocks > 1").select("rep", "text"), "texts"), rest, like))


def links(sets: np.ndarray, ranges: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (left, right) whose sets overlap enough; counted exactly, in chunks of tokens both sides hold."""
    rows = shared.row_of(ranges)
    tokens, ids, often = np.unique(sets, return_inverse=True, return_counts=True)
    use = often[ids] > 1
    rows, ids = rows[use], ids[use]
    order = np.argsort(ids, kind="stable")
    rows, ids = rows[order], ids[order]
    dense = np.cumsum(np.concatenate(([0], (ids[1:] != ids[:-1]).astype(np.int64)))) if len(ids) else ids
    n = len(ranges) - 1
    both = np.zeros((n, n))
    for lo in range(0, int(dense[-1]) + 1 if len(dense) else 0, _CHUNK):
        a, b = np.searchsorted(dense, (lo, lo + _CHUNK))
        m = np.zeros((n, _CHUNK), np.float32)
        m[rows[a:b], dense[a:b] - lo] = 1
        both += m @ m.T
    size = np.diff(ranges)
    union = size[:, None] + size[None, :] - both
    found = (100 * both >= percent * union) & (union > 0) & left[:, None] & right[None, :]
    np.fill_diagonal(found, False)
    return np.nonzero(found)


def near_duplicates(docs: DataFrame, like: Likeness = Likeness(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), shared.text_or_empty(text_col).alias("text"))
    signed = shared.written(signatures(rows, like), "signatures")
    named = signed.where("n_shingles > 0 and doc_id is not null")
    classes = named.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("u", "v", "n_bytes")])
    classes = shared.written(classes, "classes")
    clusters = components(candidate_edges(classes.select("rep", "u", "v"), like)).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    sizes = classes.groupBy("rep").agg(F.sum("n_bytes").alias("n_bytes"))
    linked = components(confirm(rows, clusters.join(sizes, "rep"), like))
    found = classes.select("set_a", "set_b", "rep").join(linked, F.col("rep") == F.col("node"), "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("component"))
    slim = signed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_a")).alias("set_a"), F.when(F.col("n_shingles") > 0, F.col("set_b")).alias("set_b"))
    out = slim.join(found.hint("merge"), ["set_a", "set_b"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, like: Likeness = Likeness(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: of each group of near-duplicates the one with the smallest id, with all its columns.

    Rows without an id stay. Rows that repeat a kept id all stay.
    """
    gone = near_duplicates(docs, like, id_col, text_col).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone.hint("merge"), docs[id_col].cast("long") == F.col("_gone"), "left_anti")


#: DuckDB SQL for near_duplicates with CONTRACT over documents: every pair with a shingle in common.
ORACLE = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')]
    ELSE [] END) AS g
  FROM split
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), reach AS (
  SELECT a AS doc_id, b AS other FROM links
  UNION
  SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a
)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles,
  least(d.doc_id, coalesce(r.least, d.doc_id)) AS component_id,
  d.doc_id <= coalesce(r.least, d.doc_id) AS kept
FROM documents d
LEFT JOIN sizes s ON s.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, min(other) AS least FROM reach GROUP BY doc_id) r ON r.doc_id = d.doc_id
"""
