"""Operator 9, suffix-array dedup: hash-compared suffix sort.

Every byte that a repeated string of LENGTH bytes covers is removed, but for the string's first occurrence in
(doc_id, start) order. Texts are UTF-8 bytes and strings never cross documents.

1. Each window of LENGTH bytes is known by an anchor, its least-hashed run of GRAM bytes. Equal windows have equal
   anchors at equal places, so only windows around anchors that occur again can repeat. One row per anchor goes through
   the shuffle, about one per 35 bytes, with a hash of all bytes its windows touch (its context).
2. An occurrence whose context occurred before claims to equal that first occurrence. Claims that continue each other
   are joined to segments, and every byte of them is compared with the bytes it claims to equal, block by block. Where
   one differs, its anchors' occurrences are all looked at in the next step instead.
3. The first occurrences of an anchor's different contexts go to one task with their bytes. Their suffixes from the
   anchor on are sorted by mergesort. Two suffixes are compared in logarithmic steps: prefix polynomial hashes and
   binary search find their common extension, and the byte after it decides. Neighbours' common extensions then show
   which suffixes share a window's right side; hashes of the left side split them further. Every extension that decides
   something is verified byte by byte; on a hash collision the task starts again with another base.

So nothing is removed for a hash alone. A frequent anchor's occurrences are dealt out over several tasks, each anchor's
rows are taken in runs of at most GROUP_ROWS, and the runs' first occurrences meet in a pre-aggregated second step. An
anchor with more than SORT_ROWS different contexts is too much for one sort: its windows are grouped by all their bytes.

Nulls are empty texts. A null doc_id comes before all others. Rows that share a doc_id come in order of a hash of their
text; rows that also share the text are one document. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import shared

LENGTH = 100
GRAM = 32
GROUP_ROWS = 20_000
SORT_ROWS = 2048
MOST_HOT = 100_000
BLOCK = 256
#: The bits of the hashes that are used; tests use few, so that hashes collide.
KEY_BITS = CONTEXT_BITS = -1
_WINDOW = LENGTH - GRAM + 1
_SEGMENT = 1 << 18
_POS_BITS = 20
_FIRST = -(1 << 63)
_SPANS = "doc long, tie long, start long, stop long"


def segments(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of at most 2**20 bytes: (bytes, offsets, row of each part, its place in the row).

    Long rows are cut so that every window lies in exactly one part.
    """
    sizes = np.diff(offs)
    for lo, hi, part, at in shared.pieces(data, offs, _SEGMENT):
        if hi - lo > 1 or sizes[lo] <= _SEGMENT + LENGTH:
            yield part, at, np.arange(lo, hi), np.zeros(hi - lo, np.int64)
            continue
        for a in range(0, int(sizes[lo]) - LENGTH + 1, _SEGMENT):
            cut = part[a : a + _SEGMENT + LENGTH - 1]
            yield cut, np.array([0, len(cut)]), np.array([lo]), np.array([a])


def anchors(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """One row per anchor and run of windows: its row, place, first and last window, key and context."""
    n = len(data)
    none = {k: np.zeros(0, np.int64) for k in ("row", "at", "first", "last", "key", "context")}
    if n < LENGTH:
        return none
    prefix = shared.prefix_hash(data)
    inverse = shared.powers(n + 1)[1]
    grams = shared.mix((prefix[GRAM:] - prefix[:-GRAM]) * inverse[: n - GRAM + 1])
    low = np.uint64((1 << _POS_BITS) - 1)
    best = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= _WINDOW:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < _WINDOW:
        best = np.minimum(best[: -(_WINDOW - width)], best[_WINDOW - width :])
    at = (best & low).astype(np.int64)
    valid = np.zeros(len(at) + 1, bool)
    step = np.zeros(n + 2, np.int32)
    long = np.diff(offs) >= LENGTH
    np.add.at(step, offs[:-1][long], 1)
    np.add.at(step, offs[1:][long] - LENGTH + 1, -1)
    valid[:-1] = np.cumsum(step)[: len(at)] > 0
    change = np.ones(len(at) + 1, bool)
    change[1:-1] = (at[1:] != at[:-1]) | (valid[1:-1] != valid[:-2])
    edges = np.flatnonzero(change)
    first, last = edges[:-1], edges[1:] - 1
    keep = valid[first]
    first, last = first[keep], last[keep]
    at = at[first]
    context = shared.range_hash(prefix, first, last + LENGTH)
    context = shared.mix(context ^ ((at - first).astype(np.uint64) << np.uint64(8)) ^ (at - last).astype(np.uint64))
    return {"row": np.searchsorted(offs, first, side="right") - 1, "at": at, "first": first, "last": last, "key": grams[at].view(np.int64), "context": context.view(np.int64)}


def _rows_of(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(doc, tie, text) and whether no id repeats: doc orders nulls first; tie is 0 then, else a hash of the text."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST)).alias("doc"), shared.text_or_empty(text_col).alias("text"))
    unique = rows.groupBy("doc").count().where("count > 1").isEmpty()
    return rows.select("doc", (F.lit(0) if unique else F.xxhash64("text")).cast("long").alias("tie"), "text"), unique


def _anchors_of(batch: pa.RecordBatch, column: int) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
    data, offs = shared.buffers(batch.column(column))
    for part, at, row, base in segments(data, offs):
        yield anchors(part, at), at, row, base


def _occurrences(rows: DataFrame, suspect: np.ndarray) -> DataFrame:
    """Every anchor: (group, key, context, doc, tie, place), place packing position, first and last window.

    group is the key, or one of several for a frequent key, which only then stands beside it. Occurrences of suspect
    keys have contexts of their own.
    """
    key_bits, context_bits, spread = np.int64(KEY_BITS), np.int64(CONTEXT_BITS), -(-GROUP_ROWS // 2)
    hot, often = shared.frequent(rows.select("text"), lambda batch: np.concatenate([np.zeros(0, np.int64), *(a["key"] & key_bits for a, *_ in _anchors_of(batch, 0))]), GROUP_ROWS, MOST_HOT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, at, row, base in _anchors_of(batch, 2):
                key, context = a["key"] & key_bits, a["context"] & context_bits
                doc, tie = docs[row[a["row"]]], ties[row[a["row"]]]
                place = base[a["row"]] + a["at"] - at[a["row"]]
                name = shared.mix(doc.view(np.uint64) ^ shared.mix(tie.view(np.uint64) ^ shared.mix(place.view(np.uint64))))
                if len(suspect):
                    context = np.where(np.isin(key, suspect), name.view(np.int64), context)
                is_hot = np.isin(key, hot)
                group = key.copy()
                parts = -(-often[np.searchsorted(hot, key[is_hot])] // spread)
                group[is_hot] = shared.mix(key[is_hot].view(np.uint64) + name[is_hot] % np.maximum(parts, 1).astype(np.uint64) + np.uint64(1)).view(np.int64)
                packed = (place << 16) | ((a["at"] - a["first"]) << 8) | (a["at"] - a["last"])
                yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(key, mask=~is_hot), *(pa.array(x) for x in (context, doc, tie, packed))], names=["group", "key", "context", "doc", "tie", "place"])

    return rows.mapInArrow(run, "group long, key long, context long, doc long, tie long, place long")


_CLAIM, _LOOK, _OPEN = 0, 1, 2


def _meet(occurrences: DataFrame) -> DataFrame:
    """Claims (kind 0) with the place they claim to equal, `shift` bytes on in document src; first occurrences of a
    repeated key's contexts (1); and first occurrences in a part of a key's rows, yet to meet those of other parts (2).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, is_cut in shared.sorted_groups(batches, GROUP_ROWS):
            groups, own, context, doc, tie, place = (t.column(i) for i in range(6))
            part = is_cut | ~own.is_null().to_numpy()
            groups = groups.to_numpy()
            key = np.where(own.is_null().to_numpy(), groups, own.fill_null(0).to_numpy())
            context, doc, tie, place = (x.to_numpy() for x in (context, doc, tie, place))
            group = np.cumsum(np.concatenate(([0], (groups[1:] != groups[:-1]).astype(np.int64))))
            order = np.lexsort((np.arange(len(key)), context, group))
            same = np.zeros(len(key), bool)
            same[1:] = (group[order[1:]] == group[order[:-1]]) & (context[order[1:]] == context[order[:-1]])
            again, first = np.zeros(len(key), bool), np.zeros(len(key), np.int64)
            again[order] = same
            first[order] = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(key))))]
            firsts = np.bincount(group[~again], minlength=group[-1] + 1)
            kind = np.where(again, _CLAIM, np.where(part, _OPEN, _LOOK))
            use = np.flatnonzero(again | part | (firsts[group] > 1))
            at, lead, trail = place >> 16, (place >> 8) & 255, place & 255
            claim = again[use]
            columns = [pa.array(x[use]) for x in (kind, key, doc, tie, at - lead, at - trail + LENGTH, at)]
            columns.append(pa.array(context[use], mask=kind[use] != _OPEN))
            columns += [pa.array(x[first[use]], mask=~claim) for x in (doc, tie)] + [pa.array((at[first] - at)[use], mask=~claim)]
            yield pa.RecordBatch.from_arrays(columns, names=["kind", "key", "doc", "tie", "start", "stop", "anchor", "context", "src", "src_tie", "shift"])

    dealt = occurrences.repartition("group").sortWithinPartitions("group", "doc", "tie", "place")
    return dealt.mapInArrow(run, "kind long, key long, doc long, tie long, start long, stop long, anchor long, context long, src long, src_tie long, shift long")


def _claims_and_looks(met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, doc, tie, start, stop, src, src_tie, shift) of all claims, (key, doc, tie, start, stop, anchor) of all to look at."""
    claim, look = ["key", "doc", "tie", "start", "stop", "src", "src_tie", "shift"], ["key", "doc", "tie", "start", "stop", "anchor"]
    open_ = met.where(F.col("kind") == _OPEN)
    place = F.struct("doc", "tie", "start", "stop", "anchor")
    # Tables that are written join by plain exchanges, of which Spark splits large parts.
    firsts = shared.written(open_.groupBy("key", "context").agg(F.min(place).alias("f")), "firsts")
    later = open_.join(firsts.hint("merge"), ["key", "context"]).where(place != F.col("f"))
    later = later.select("key", "doc", "tie", "start", "stop", F.col("f.doc").alias("src"), F.col("f.tie").alias("src_tie"), (F.col("f.anchor") - F.col("anchor")).alias("shift"))
    several = shared.written(firsts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "several")
    more = firsts.join(several.hint("merge"), "key").select("key", "f.*")
    return met.where(F.col("kind") == _CLAIM).select(*claim).unionByName(later), met.where(F.col("kind") == _LOOK).select(*look).unionByName(more.select(*look))


def _joined_claims(claims: DataFrame) -> DataFrame:
    """Claims as (doc, tie, src, src_tie, shift, start, stop), those that continue each other as one."""
    names = ["doc", "tie", "src", "src_tie", "shift", "start", "stop"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((7, 0), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.concatenate((held, np.stack([c.to_numpy() for c in batch.columns])), axis=1)
            head = np.ones(rows.shape[1], bool)
            head[1:] = (rows[:5, 1:] != rows[:5, :-1]).any(axis=0) | (rows[5, 1:] > rows[6, :-1])
            at = np.flatnonzero(head)
            out = np.concatenate((rows[:6, at], rows[6:, np.append(at[1:], rows.shape[1]) - 1]))
            held = out[:, -1:]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out[:, :-1]], names=names)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=names)

    dealt = claims.select(*names).repartition("doc", "tie").sortWithinPartitions(*names[:6])
    return dealt.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _gathered(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """data[start[i]:stop[i]] of each i as a binary column."""
    size = stop - start
    offs = np.concatenate(([0], np.cumsum(size)))
    index = np.arange(int(offs[-1])) + np.repeat(start - offs[:-1], size)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(data[index])])


_CUTS = "kind long, key long, doc long, tie long, start long, anchor long, src long, src_tie long, block long, place long, bytes binary"
_PIECE_OF, _BLOCK_OF = 3, 4


def _cut(texts: DataFrame) -> DataFrame:
    """Bytes from (doc, tie, text, looks, claims, blocks): contexts to look at (kind 1), pieces of claims by the blocks of
    the documents they claim to equal (3), and those blocks (4)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offs = shared.buffers(batch.column(2))

            def rows(kind: int, row: np.ndarray, start: np.ndarray, stop: np.ndarray, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
                for lo in range(0, len(row), 20_000):
                    r = slice(lo, lo + 20_000)
                    given = {"kind": np.full(len(row[r]), kind), "doc": docs[row[r]], "tie": ties[row[r]], "start": start[r], "bytes": _gathered(data, offs[row[r]] + start[r], offs[row[r]] + stop[r])} | {k: v[r] for k, v in columns.items()}
                    names = [c.split()[0] for c in _CUTS.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(given[n]) if n in given else pa.nulls(len(row[r]), pa.int64()) for n in names], names=names)

            def listed(i: int) -> tuple[np.ndarray, list[np.ndarray]]:
                at = batch.column(i).offsets.to_numpy()
                values = batch.column(i).flatten()
                return np.repeat(np.arange(batch.num_rows), np.diff(at)), [x.to_numpy(zero_copy_only=False) for x in (values.flatten() if pa.types.is_struct(values.type) else [values])]

            row, (key, start, stop, anchor) = listed(3)
            yield from rows(_LOOK, row, start, stop, key=key, anchor=anchor)
            row, (start, stop, src, src_tie, shift) = listed(4)
            block = (start + shift) // BLOCK
            many = (stop + shift - 1) // BLOCK - block + 1
            of = np.repeat(np.arange(len(row)), many)
            block = block[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            lo = np.maximum(start[of] + shift[of], block * BLOCK)
            hi = np.minimum(stop[of] + shift[of], (block + 1) * BLOCK)
            yield from rows(_PIECE_OF, row[of], lo - shift[of], hi - shift[of], src=src[of], src_tie=src_tie[of], block=block, place=lo - block * BLOCK)
            row, (block,) = listed(5)
            there = (block >= 0) & (block * BLOCK < np.diff(offs)[row])
            row, block = row[there], block[there]
            yield from rows(_BLOCK_OF, row, block * BLOCK, np.minimum((block + 1) * BLOCK, np.diff(offs)[row]), src=docs[row], src_tie=ties[row], block=block)

    return texts.mapInArrow(run, _CUTS)


def _cuts(rows: DataFrame, looks: DataFrame, joined: DataFrame) -> DataFrame:
    """The bytes that looks and joined claims need, texts read once."""
    look, claim = F.struct("key", "start", "stop", "anchor"), F.struct("start", "stop", "src", "src_tie", "shift")
    first, last = (F.floor((F.col(c) + F.col("shift") - less) / BLOCK) for c, less in (("start", 0), ("stop", 1)))
    blocks = joined.select(F.col("src").alias("doc"), F.col("src_tie").alias("tie"), F.explode(F.sequence(first, last)).alias("block")).distinct()
    wanted = looks.select("doc", "tie", look.alias("look")).unionByName(joined.select("doc", "tie", claim.alias("claim")), True).unionByName(blocks, True)
    wanted = wanted.groupBy("doc", "tie").agg(F.collect_list("look").alias("looks"), F.collect_list("claim").alias("claims"), F.collect_list("block").alias("blocks"))
    return _cut(rows.join(wanted.hint("merge"), ["doc", "tie"]).select("doc", "tie", "text", "looks", "claims", "blocks"))


def _unlike(cuts: DataFrame, claims: DataFrame) -> np.ndarray:
    """Keys of the claims of which some byte differs from the byte it claims to equal."""
    names = ["src", "src_tie", "block"]
    blocks = cuts.where(F.col("kind") == _BLOCK_OF).select(*names, F.col("bytes").alias("there"))
    pieces = cuts.where(F.col("kind") == _PIECE_OF).select("doc", "tie", "start", *names, "place", "bytes")
    there = F.substring("there", F.col("place").cast("int") + 1, F.length("bytes"))
    bad = pieces.join(blocks.hint("merge"), names, "left").where(F.coalesce(there != F.col("bytes"), F.lit(True)))
    bad = shared.written(bad.select("doc", "tie", F.col("start").alias("lo"), (F.col("start") + F.length("bytes")).alias("hi")), "unlike")
    if bad.isEmpty():
        return np.zeros(0, np.int64)
    return np.array([r.key for r in claims.join(bad, ["doc", "tie"]).where("start < hi and stop > lo").select("key").distinct().collect()], np.int64)


class Suffixes:
    """Suffixes of one buffer: starts and ends in it, ordered within groups."""

    def __init__(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray, base: int):
        self.data, self.start, self.stop = data, start, stop
        n = len(data) + 1
        with np.errstate(over="ignore"):
            powers = np.full(n, base | 1, np.uint64)
            powers[0] = 1
            self.powers = np.multiply.accumulate(powers)
            self.prefix = np.zeros(n, np.uint64)
            # h(i) = h(i - 1) + byte * base**i: ranges at different places compare after scaling both to a common power.
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[:-1], out=self.prefix[1:])
            inverse = np.full(n, pow(base | 1, -1, 1 << 64), np.uint64)
            inverse[0] = 1
            self.inverse = np.multiply.accumulate(inverse)

    def hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.prefix[stop] - self.prefix[start]) * self.inverse[start]

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes a and b, by binary search over prefix hashes."""
        x, y = self.start[a], self.start[b]
        low, high = np.zeros(len(a), np.int64), np.minimum(self.stop[a] - x, self.stop[b] - y)
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.hash(x, x + mid) == self.hash(y, y + mid)
            low = np.where(same, mid, low)
            high = np.where(same, high, mid - 1)
        return low

    def after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffix a comes after b: by the byte after their common extension, then length, then number."""
        n = self.extension(a, b)
        x, y = self.start[a] + n, self.start[b] + n
        end_a, end_b = x >= self.stop[a], y >= self.stop[b]
        last = len(self.data) - 1
        byte_a = np.where(end_a, -1, self.data[np.minimum(x, last)].astype(np.int64))
        byte_b = np.where(end_b, -1, self.data[np.minimum(y, last)].astype(np.int64))
        return (byte_a > byte_b) | ((byte_a == byte_b) & (a > b))

    def order(self, group: np.ndarray) -> np.ndarray:
        """Mergesort, all groups at once: runs double, and each suffix finds its place in its sibling run."""
        n = len(group)
        if not n:
            return np.zeros(0, np.int64)
        begin = np.searchsorted(group, np.arange(group[-1] + 1))
        end = np.append(begin[1:], n)
        order, home, width = np.arange(n), begin[group], 1
        slot = np.arange(n)
        within = slot - home
        most = int((end - begin).max())
        while width < most:
            side = (within // width) & 1
            left = home + (within // (2 * width)) * 2 * width
            sibling = np.where(side == 0, left + width, left)
            low = np.minimum(sibling, end[group])
            high = np.minimum(low + width, end[group])
            first = low.copy()
            while (open_ := np.flatnonzero(low < high)).size:
                mid = (low[open_] + high[open_]) >> 1
                above = self.after(order[slot[open_]], order[mid])
                low[open_] = np.where(above, mid + 1, low[open_])
                high[open_] = np.where(above, high[open_], mid)
            target = left + (within % width) + (low - first)
            merged = np.empty_like(order)
            merged[target] = order
            order = merged
            width *= 2
        return order

    def verified(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> bool:
        """Whether n bytes from each suffix's start agree."""
        return _agree(self.data, self.start[a], self.start[b], n)


def _agree(data: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> bool:
    for lo in range(0, len(x), 8192):
        k = n[lo : lo + 8192]
        i = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
        if not np.array_equal(data[np.repeat(x[lo : lo + 8192], k) + i], data[np.repeat(y[lo : lo + 8192], k) + i]):
            return False
    return True


def repeated_windows(data: np.ndarray, start: np.ndarray, stop: np.ndarray, anchor: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(item, window start in data) of every window that an earlier item of its group has too.

    Item i holds data[start[i]:stop[i]] around its anchor; group ascends and items are in order of occurrence.
    """
    for base in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5):
        found = _repeated_windows(data, start, stop, anchor, group, base)
        if found is not None:
            return found
    raise RuntimeError("hash collisions with every base")


def _repeated_windows(data, start, stop, anchor, group, base):
    suffixes = Suffixes(data, anchor, stop, base)
    order = suffixes.order(group)
    common = np.zeros(len(order), np.int64)
    near = np.flatnonzero(group[order[1:]] == group[order[:-1]]) + 1
    common[near] = suffixes.extension(order[near], order[near - 1])
    if not suffixes.verified(order[near], order[near - 1], common[near]):
        return None
    common[np.setdiff1d(np.arange(len(order)), near)] = -1
    lead, trail = anchor - start, anchor - (stop - LENGTH)
    partner = np.full(len(order), -1)
    items, windows = [], []
    for back in range(_WINDOW - 1, -1, -1):
        # Windows that start `back` bytes before the anchor: runs of suffixes that share the rest, split by what leads.
        run = np.cumsum(common < LENGTH - back)
        has = (lead[order] >= back) & (trail[order] <= back)
        item, run = order[has], run[has]
        if len(item) < 2:
            continue
        left = suffixes.hash(anchor[item] - back, anchor[item])
        by = np.lexsort((item, left, run))
        item, left, run = item[by], left[by], run[by]
        head = np.ones(len(item), bool)
        head[1:] = (run[1:] != run[:-1]) | (left[1:] != left[:-1])
        first = item[np.maximum.accumulate(np.where(head, np.arange(len(item)), 0))]
        again, first = item[~head], first[~head]
        new = partner[again] != first
        if not _agree(data, anchor[again[new]] - back, anchor[first[new]] - back, np.full(int(new.sum()), back)):
            return None
        partner[again] = first
        items.append(again)
        windows.append(anchor[again] - back)
    none = np.zeros(0, np.int64)
    return np.concatenate([*items, none]), np.concatenate([*windows, none])


def merge_spans(item: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of LENGTH bytes as maximal spans: (item, start, stop)."""
    by = np.lexsort((window, item))
    item, window = item[by], window[by]
    head = np.ones(len(item), bool)
    head[1:] = (item[1:] != item[:-1]) | (window[1:] > window[:-1] + LENGTH)
    at = np.flatnonzero(head)
    return item[at], window[at], window[np.append(at[1:], len(item)) - 1] + LENGTH if len(at) else window


def _sort_suffixes(contexts: DataFrame) -> DataFrame:
    """Removed spans from (key, doc, tie, start, anchor, bytes), the different contexts of repeated anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in shared.sorted_groups(batches):
            key, doc, tie, start, anchor = (t.column(i).to_numpy() for i in range(5))
            data, offs = shared.buffers(t.column(5))
            group = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]).astype(np.int64))))
            item, window = repeated_windows(data, offs[:-1], offs[1:], offs[:-1] + anchor - start, group)
            item, a, b = merge_spans(item, window)
            shift = start[item] - offs[item]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[item], tie[item], a + shift, b + shift)], names=["doc", "tie", "start", "stop"])

    return contexts.repartition("key").sortWithinPartitions("key", "doc", "tie", "start").mapInArrow(run, _SPANS)


def _group_windows(contexts: DataFrame) -> DataFrame:
    """What _sort_suffixes returns, for anchors with too many contexts: window by window, each known by all its bytes."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tie, start = (batch.column(i).to_numpy() for i in range(3))
            data, offs = shared.buffers(batch.column(3))
            many = np.diff(offs) - LENGTH + 1
            of = np.repeat(np.arange(batch.num_rows), many)
            back = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            for lo in range(0, len(of), 50_000):
                i, k = of[lo : lo + 50_000], back[lo : lo + 50_000]
                at = offs[i] + k
                yield pa.RecordBatch.from_arrays([_gathered(data, at, at + LENGTH), pa.array(doc[i]), pa.array(tie[i]), pa.array(start[i] + k)], names=["window", "doc", "tie", "start"])

    found = contexts.select("doc", "tie", "start", "bytes").mapInArrow(windows, "window binary, doc long, tie long, start long")
    place = F.struct("doc", "tie", "start")
    firsts = shared.written(found.groupBy("window").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "windows")
    return found.join(firsts.hint("merge"), "window").where(place != F.col("first")).select("doc", "tie", "start", (F.col("start") + LENGTH).alias("stop"))


def removed_spans(rows: DataFrame, unique: bool) -> DataFrame:
    """(doc, tie, spans: array of start, stop) of every document that loses bytes; spans may overlap."""
    once = rows if unique else rows.dropDuplicates(["doc", "tie"])
    suspect = np.zeros(0, np.int64)
    while True:
        met = shared.written(_meet(_occurrences(once, suspect)), "anchors")
        claims, looks = _claims_and_looks(met)
        joined = shared.written(_joined_claims(claims), "claims")
        cuts = shared.written(_cuts(once, looks, joined), "cuts")
        unlike = np.setdiff1d(_unlike(cuts, claims), suspect)
        if not len(unlike):
            break
        suspect = np.concatenate((suspect, unlike))
        shared.dropped(met, joined, cuts)
    shared.dropped(met)
    contexts = cuts.where(F.col("kind") == _LOOK).select("key", "doc", "tie", "start", "anchor", "bytes")
    crowded = shared.written(contexts.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > SORT_ROWS).select("key"), "crowded")
    spans = joined.select("doc", "tie", "start", "stop")
    if crowded.isEmpty():
        spans = spans.unionByName(_sort_suffixes(contexts))
    else:
        spans = spans.unionByName(_sort_suffixes(contexts.join(crowded, "key", "left_anti"))).unionByName(_group_windows(contexts.join(crowded, "key", "left_semi")))
    spans = shared.written(spans, "spans")
    shared.dropped(joined, cuts)
    return spans.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def cut(text: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[bytes, int, int]:
    """(bytes left, bytes removed, maximal runs removed)."""
    step = np.zeros(len(text) + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, stop, -1)
    gone = np.cumsum(step[:-1]) > 0
    runs = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0]))
    return text[~gone].tobytes(), int(gone.sum()), runs


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row."""
    rows, unique = _rows_of(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = shared.buffers(batch.column(1))
            out = []
            for i, (start, stop) in enumerate(_spans_by_row(batch.column(2))):
                left, gone, runs = cut(data[offs[i] : offs[i + 1]], start, stop) if len(start) else (data[offs[i] : offs[i + 1]].tobytes(), 0, 0)
                out.append((gone, runs, hashlib.sha256(left).hexdigest()))
            cols = list(zip(*out)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offs)), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    shared.arrow_sized(docs.sparkSession)
    out = rows.join(removed_spans(rows, unique), ["doc", "tie"], "left").select("doc", "text", "spans").mapInArrow(run, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.select(F.nullif(F.col("doc"), F.lit(_FIRST)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def _spans_by_row(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    at = column.offsets.to_numpy()
    start, stop = (x.to_numpy(zero_copy_only=False) for x in column.values.flatten())
    for a, b in zip(at[:-1], at[1:]):
        yield start[a:b], stop[a:b]


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """docs with repeated strings cut out of their texts, all columns kept; count_col gets the new number of code points.

    A cut may fall inside a code point; what is left of it goes too. Texts that lose nothing, nulls too, stay as they are.
    """
    names = docs.columns
    rows, unique = _rows_of(docs, id_col, text_col)
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST)).alias("_doc"), (F.lit(0) if unique else F.xxhash64(shared.text_or_empty(text_col))).cast("long").alias("_tie")]
    spans = removed_spans(rows, unique).select(F.col("doc").alias("_doc"), F.col("tie").alias("_tie"), F.col("spans").alias("_spans"))
    joined = docs.select("*", *key).join(spans, ["_doc", "_tie"], "left").select(*names, "_spans")
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = shared.buffers(batch.column(at))
            texts = batch.column(at).to_pylist()
            for i, (start, stop) in enumerate(_spans_by_row(batch.column(len(names)))):
                if len(start):
                    texts[i] = cut(data[offs[i] : offs[i + 1]], start, stop)[0].decode(errors="ignore")
            cols = [*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1 : len(names)]]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    out = joined.mapInArrow(run, docs.select(text_col).schema if len(names) == 1 else docs.schema)
    return out.withColumn(count_col, F.length(text_col).cast(docs.schema[count_col].dataType)) if count_col in names else out


#: DuckDB SQL for dedup over documents: every 100-byte string, as hex.
ORACLE = r"""
WITH raw AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents
), windows AS (
  SELECT doc_id, unnest(range(0, greatest(n - 99, 0))) AS i, h FROM raw
), named AS (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS w FROM windows
), repeats AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM named) WHERE k > 1
), marked AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS head FROM repeats
), numbered AS (
  SELECT doc_id, i, sum(head) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM marked
), spans AS (
  SELECT doc_id, span, min(i) AS a, max(i) + 100 AS b FROM numbered GROUP BY doc_id, span
), gaps AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans
), cuts AS (
  SELECT g.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS stop,
    string_agg(substr(r.h, 2 * g.before + 1, 2 * (g.a - g.before)), '' ORDER BY g.a) AS kept
  FROM gaps g JOIN raw r ON r.doc_id = g.doc_id GROUP BY g.doc_id
)
SELECT r.doc_id, CAST(r.n AS BIGINT) AS n_bytes, CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(c.n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(c.kept, '') || substr(r.h, 2 * coalesce(c.stop, 0) + 1))) AS kept_sha256
FROM raw r LEFT JOIN cuts c ON c.doc_id = r.doc_id
"""
