"""Operator 13, language-model scores from a log-frequency Bloom filter.

Training documents are cut into words and runs of up to `order` words; each text begins after a start mark and closes
with an end token. Counts are quantised: below EXACT as they are, then in steps of STEP. A run with quantised count q is
put into the filter q times, as (run, 1) ... (run, q); asked for, it is probed with 1, 2, ... until a probe misses, so
an answer is never below the true level, and above it as rarely as the filter errs. Probabilities are smoothed towards
the next shorter run:

    p(w | h) = (c(hw) + PRIOR * p(w | shorter h)) / (c(h) + PRIOR),   p(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1))

The filter is cut into parts by the hash of a run, so many that a part takes the runs of about PART_BYTES of text; runs
are summed within a batch, packed by part and sent to it in one exchange, where the part's counts are summed and its
bits set. A part has as many bits as its entries need, whatever the corpus's size. Workers get the filter as a
broadcast of at most SHARD_BYTES: a filter beyond that is cut into shards, and documents pass once for each, with the
levels found so far. So the number of passes grows with the corpus and what is broadcast doesn't.

Words' exact counts, which `base_score` needs, are summed by their text in the same exchange. Those with at least one
token in FREQUENT (at most FREQUENT of them, of SHORT bytes or fewer) are broadcast; documents' other words join their
counts by plain exchanges.

A null text is empty and has the end alone. Rows that repeat are scored each. A row without an id is held out. Texts of
any length are taken in pieces that end between words. Without training rows N and V are 0, and a token's probability
is that of an unknown one, 1. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import shared

FOLDS = 5
HELD_OUT = 1
ORDER = 2
PRIOR = 4.0
BITS = 10
PROBES = 5
EXACT = 8
STEP = 1.25
PART_BYTES = 8 << 20
SHARD_BYTES = 160 << 20
FREQUENT = 1 << 20
SHORT = 32
#: Texts are counted in larger pieces than they are scored in, as a run is sent once a piece.
COUNT_BYTES = 2 << 20
PIECE_BYTES = 1 << 20
ROWS = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: What stands for the end of a text among words; no word is empty.
END = b""
_START = 0x2545F4914F6CDD1D
_STEP = 0x9E3779B97F4A7C15
_LOW = np.uint64(32)
_CHUNK = 1 << 16
_COUNTS = "part int, runs binary, counts binary, words string, times binary"
_PARTS = "part int, bits binary, words string, times binary, tokens long, distinct long"
_SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<struct<word:string,n:long>>"


def levels() -> np.ndarray:
    """The least count of each level from 1 on, as far as counts go."""
    out = list(range(1, EXACT))
    while out[-1] < 1 << 62:
        out.append(max(out[-1] + 1, int(out[-1] * STEP)))
    return np.array(out, np.int64)


LEVELS = levels()
#: What a level stands for: the count itself, or the middle of its step; level 0 is a count of 0.
MEANS = np.concatenate(([0.0], (LEVELS + np.append(LEVELS[1:] - 1, LEVELS[-1])) / 2))


def quantised(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEVELS, counts, side="right")


@dataclass
class Symbols:
    """The symbols of a piece of texts, row after row: a start mark or what a cut row carries on, its words, its end.

    names: hashes of `unique`; word: of `unique`, for words and ends; own: words and ends, which are the tokens; fresh: what is no carry;
    place: within the row; runs[k]: hashes of the k + 1 symbols that end here, where the row has so many.
    """

    unique: pa.Array
    names: np.ndarray
    word: np.ndarray
    own: np.ndarray
    fresh: np.ndarray
    rows: np.ndarray
    first: np.ndarray
    place: np.ndarray
    runs: list[np.ndarray]


def pieces(data: np.ndarray, offs: np.ndarray, most: int):
    """(first row, bytes, offsets, whether the first row goes on here, whether the last one does after) in pieces of about `most` bytes."""
    for lo, hi, part, at in shared.pieces(data, offs, most):
        if hi - lo > 1 or len(part) <= most:
            yield lo, part, at, False, False
            continue
        start = 0
        while start < len(part):
            end = shared.next_separator(part, start + most)
            yield lo, part[start:end], np.array([0, end - start]), start > 0, end < len(part)
            start = end


def named(words: pa.Array) -> np.ndarray:
    """A hash of each word."""
    data, offs = shared.buffers(words)
    return shared.range_hash(shared.prefix_hash(data), offs[:-1], offs[1:])


def extended(run: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The hash of a run with one symbol more."""
    return shared.mix(run * np.uint64(0xA24BAED4963EE407) + symbol)


def single(names: np.ndarray) -> np.ndarray:
    """The runs of one symbol each."""
    return extended(np.zeros(len(names), np.uint64), names)


def symbols(part: np.ndarray, at: np.ndarray, goes_on: bool, continues: bool, order: int, carry: list[int]) -> Symbols:
    """The symbols of a piece; carry holds the last ones of a row that goes on, before and after."""
    part = shared.lower_ascii(part)
    starts, ends, ranges = shared.word_spans(part, at)
    size = ends - starts
    to = np.concatenate(([0], np.cumsum(size)))
    packed = part[np.arange(to[-1]) + np.repeat(starts - to[:-1], size)]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(packed)]).dictionary_encode()
    unique = pa.concat_arrays([words.dictionary, pa.array([END], pa.large_binary())])
    hashes = named(unique)
    n = len(at) - 1
    before, after = np.ones(n, np.int64), np.ones(n, bool)
    if goes_on:
        before[0] = len(carry)
    if continues:
        after[-1] = False
    first = np.concatenate(([0], np.cumsum(before + np.diff(ranges) + after)))
    rows = np.repeat(np.arange(n), np.diff(first))
    place = np.arange(first[-1]) - first[rows]
    fresh = np.ones(len(rows), bool)
    own = place >= before[rows]
    is_end = np.zeros(len(rows), bool)
    is_end[first[1:][after] - 1] = True
    word = np.full(len(rows), len(unique) - 1)
    word[own & ~is_end] = words.indices.to_numpy()
    symbol = np.where(own, hashes[word], np.uint64(_START))
    if goes_on:
        symbol[: len(carry)], fresh[: len(carry)] = np.array(carry, np.uint64), False
    runs = []
    for k in range(order):
        run = np.zeros(max(0, len(symbol) - k), np.uint64)
        for j in range(k, -1, -1):
            run = extended(run, symbol[k - j : len(symbol) - j])
        runs.append(np.where(place >= k, np.concatenate((np.zeros(len(symbol) - len(run), np.uint64), run)), np.uint64(0)))
    carry[:] = symbol[first[-2] :][-max(1, order - 1) :].tolist() if continues else []
    return Symbols(unique, hashes, word, own, fresh, rows, first, place, runs)


def part_of(runs: np.ndarray, parts: int) -> np.ndarray:
    """The part of each run, ascending in the run."""
    return ((runs >> _LOW) * np.uint64(parts) >> _LOW).astype(np.int64)


def counted(docs: DataFrame, order: int, parts: int) -> DataFrame:
    """_COUNTS from docs (text): for each batch and part its runs and words with how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[int] = []
        for batch in batches:
            for _, part, at, goes_on, continues in pieces(*shared.buffers(batch.column(0)), COUNT_BYTES):
                s = symbols(part, at, goes_on, continues, order, carry)
                found = np.concatenate([r[s.fresh & (s.place >= k)] if k == 0 else r[s.own & (s.place >= k)] for k, r in enumerate(s.runs)])
                runs, often = np.unique(found, return_counts=True)
                times = np.bincount(s.word[s.own], minlength=len(s.unique))
                name = single(s.names)
                order_ = np.argsort(name)
                order_ = order_[times[order_] > 0]
                words = s.unique.take(pa.array(order_)).to_pylist()
                times = times[order_].astype(np.uint32)
                a, b = np.searchsorted(part_of(runs, parts), np.arange(parts + 1)), np.searchsorted(part_of(name[order_], parts), np.arange(parts + 1))
                often = often.astype(np.uint32)
                use = np.flatnonzero(np.diff(a) > 0)
                columns = [use.astype(np.int32), [runs[a[p] : a[p + 1]].tobytes() for p in use], [often[a[p] : a[p + 1]].tobytes() for p in use], [b"\n".join(words[b[p] : b[p + 1]]).decode() for p in use], [times[b[p] : b[p + 1]].tobytes() for p in use]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.binary()))], names=["part", "runs", "counts", "words", "times"])

    return docs.select("text").mapInArrow(run, _COUNTS)


def cells(runs: np.ndarray, level: int, base: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the bits of (run, level) lie: a 64-bit word of the run's part, and PROBES bits of it."""
    x = shared.mix(runs + np.uint64(level * _STEP & (1 << 64) - 1))
    bits = np.zeros(len(x), np.uint64)
    for i in range(PROBES):
        bits |= np.uint64(1) << (x >> np.uint64(6 * i) & np.uint64(63))
    return base + ((x >> _LOW) * size >> _LOW).astype(np.int64), bits


def filled(runs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bits of one part's runs."""
    level = quantised(counts)
    out = np.zeros(max(1, -(-int(level.sum()) * BITS // 64)), np.uint64)
    for j in range(1, int(level.max(initial=0)) + 1):
        at, bits = cells(runs[level >= j], j, np.int64(0), np.uint64(len(out)))
        np.bitwise_or.at(out, at, bits)
    return out


def built(counts: DataFrame) -> DataFrame:
    """_PARTS: each part's filter, and its words with their exact counts, from counts (_COUNTS)."""

    def finished(part: int, rows: list[tuple]) -> tuple:
        runs, back = np.unique(np.frombuffer(b"".join(r[0] for r in rows), np.uint64), return_inverse=True)
        often = np.bincount(back, np.frombuffer(b"".join(r[1] for r in rows), np.uint32), len(runs)).astype(np.int64)
        words = pa.array([w for r in rows if r[3] for w in r[2].split("\n")], pa.large_string())
        times = np.frombuffer(b"".join(r[3] for r in rows), np.uint32).astype(np.int64)
        own = pa.table({"word": words, "n": times}).group_by("word").aggregate([("n", "sum")])
        n = own.column("n_sum").to_numpy().astype(np.int64)
        return part, filled(runs, often).tobytes(), "\n".join(own.column("word").to_pylist()), n.tobytes(), int(n.sum()), len(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(values: tuple) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.binary(), pa.string(), pa.binary(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=["part", "bits", "words", "times", "tokens", "distinct"])

        key, held = None, []
        for batch in batches:
            for part, *values in zip(*(c.to_pylist() for c in batch.columns)):
                if held and part != key:
                    yield row(finished(key, held))
                    held = []
                key = part
                held.append(values)
        if held:
            yield row(finished(key, held))

    return counts.repartition("part").sortWithinPartitions("part").mapInArrow(run, _PARTS)


def vocabulary(parts: DataFrame) -> DataFrame:
    """(word, c): the exact counts of the words in parts (_PARTS); the end of a text is an empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if times:
                    yield pa.RecordBatch.from_arrays([pa.array(words.split("\n"), pa.string()), pa.array(np.frombuffer(times, np.int64))], names=["word", "c"])

    return parts.select("words", "times").mapInArrow(run, "word string, c long")


@dataclass
class Shard:
    """The filter's parts whose number divided by `shards` leaves `number`: words of bits, and where each part's begin.

    The bits are bytes, which a worker reads in one piece; an array would be read and then copied.
    """

    parts: int
    shards: int
    number: int
    base: np.ndarray
    size: np.ndarray
    bits: bytes

    @property
    def words(self) -> np.ndarray:
        return np.frombuffer(self.bits, np.uint64)

    def levels(self, runs: np.ndarray) -> np.ndarray:
        """The quantised count of each run; 0 where it is unknown, or another shard's."""
        out, words = np.zeros(len(runs), np.uint8), self.words
        for lo in range(0, len(runs), _CHUNK):
            own = runs[lo : lo + _CHUNK]
            part = part_of(own, self.parts)
            use = np.flatnonzero(part % self.shards == self.number) if self.shards > 1 else np.arange(len(own))
            use = use[self.size[part[use] // self.shards] > 0]
            slot = part[use] // self.shards
            base, size, asked = self.base[slot], self.size[slot], own[use]
            for level in range(1, len(LEVELS) + 1):
                if not len(use):
                    break
                at, bits = cells(asked, level, base, size)
                hit = np.flatnonzero(words[at] & bits == bits)
                use, base, size, asked = use[hit], base[hit], size[hit], asked[hit]
                out[lo + use] = level
        return out


    def of(self, s: Symbols) -> np.ndarray:
        """The levels of all runs of s, order x symbols; each different word is asked for once."""
        first = self.levels(single(s.names))[s.word]
        first[~s.own] = self.levels(s.runs[0][~s.own])
        return np.stack([first, *(self.levels(r) for r in s.runs[1:])])


def shard(parts: DataFrame, n_parts: int, shards: int, number: int) -> Shard:
    """One shard of the filter, which the driver holds until it is broadcast; at most SHARD_BYTES."""
    got = parts.where(F.col("part") % shards == number).select("part", "bits").toArrow()
    slot = got.column("part").to_numpy() // shards
    size = np.zeros(-(-n_parts // shards), np.int64)
    base = np.zeros(len(size), np.int64)
    data, offs = shared.buffers(got.column("bits").cast(pa.large_binary()))
    base[slot], size[slot] = offs[:-1] // 8, np.diff(offs) // 8
    return Shard(n_parts, shards, number, base, size.astype(np.uint64), data.tobytes())


@dataclass(frozen=True)
class Corpus:
    """What is known of the training rows: N tokens, V distinct ones, and the frequent words (hashes ascending, texts, counts)."""

    tokens: int
    distinct: int
    hashes: np.ndarray
    words: pa.Array
    counts: np.ndarray

    @property
    def least(self) -> int:
        """A frequent word's count."""
        return max(1, -(-self.tokens // FREQUENT))

    @property
    def whole(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)

    def known(self, unique: pa.Array, names: np.ndarray) -> np.ndarray:
        """The counts of frequent words, -1 for others; a word found by its hash is compared."""
        out = np.full(len(unique), -1, np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, names), len(self.hashes) - 1)
            same = np.flatnonzero(self.hashes[at] == names)
            equal = pa.compute.equal(self.words.take(pa.array(at[same])), unique.take(pa.array(same))).to_numpy(zero_copy_only=False)
            out[same[equal]] = self.counts[at[same[equal]]]
        return out


def corpus(parts: DataFrame) -> Corpus:
    total = parts.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    out = Corpus(total[0], total[1], np.zeros(0, np.uint64), pa.array([], pa.large_binary()), np.zeros(0, np.int64))
    got = vocabulary(parts).where((F.col("c") >= out.least) & (F.octet_length("word") <= SHORT)).toArrow()
    words = got.column("word").cast(pa.large_binary()).combine_chunks()
    hashes = named(words)
    order = np.argsort(hashes)
    return Corpus(total[0], total[1], hashes[order], words.take(pa.array(order)), got.column("c").to_numpy()[order])


def probabilities(s: Symbols, level: np.ndarray, known: Corpus) -> np.ndarray:
    """The smoothed probability of each token of s, from the levels (order x symbols) of its runs."""
    count = MEANS[level]
    p = np.minimum((count[0] + 0.5) / known.whole, 1.0)
    for k in range(1, len(count)):
        context = np.concatenate(([0.0], count[k - 1][:-1]))
        longer = (np.minimum(count[k], context) + PRIOR * p) / (context + PRIOR)
        p = np.where(s.place >= k, longer, p)
    return p[s.own]


class _Sums:
    """What is known of a batch's texts, piece by piece."""

    def __init__(self, n: int):
        self.tokens, self.known, self.base, self.score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        self.rare: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []

    def add(self, lo: int, s: Symbols, level: np.ndarray, known: Corpus) -> None:
        """A piece whose first row is lo."""
        word, row = s.word[s.own], s.rows[s.own]
        n = len(s.first) - 1
        here = slice(lo, lo + n)
        count = known.known(s.unique, s.names)[word]
        often = count >= 0
        self.tokens[here] += np.bincount(row, minlength=n)
        self.score[here] += np.bincount(row, np.log10(probabilities(s, level, known)), n)
        self.known[here] += np.bincount(row[often], minlength=n)
        self.base[here] += np.bincount(row[often], np.log10((count[often] + 0.5) / known.whole), n)
        pairs, times = np.unique(row[~often] * len(s.unique) + word[~often], return_counts=True)
        self.rare.append((lo + pairs // len(s.unique), s.unique.take(pa.array(pairs % len(s.unique))).cast(pa.binary()).cast(pa.string()), times))

    def lists(self) -> pa.Array:
        """The rare words of each row."""
        rows = np.concatenate([np.zeros(0, np.int64), *(r for r, _, _ in self.rare)])
        words = pa.concat_arrays([pa.array([], pa.string()), *(w for _, w, _ in self.rare)])
        times = np.concatenate([np.zeros(0, np.int64), *(t for _, _, t in self.rare)])
        ends = np.searchsorted(rows, np.arange(len(self.tokens) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([words, pa.array(times)], names=["word", "n"]))


def passed(docs: DataFrame, order: int, known, filter_shard, last: bool) -> DataFrame:
    """One pass over docs (doc_id, held_out, text, levels): the levels with this shard's, or after the last one _SCORED.

    known, filter_shard: broadcasts of a Corpus and a Shard. A row's levels are those of its pieces in order, order x
    symbols each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[int] = []
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            n = batch.num_rows
            old, new, sums = batch.column(3).to_pylist(), [b""] * n, _Sums(n)
            for lo, part, at, goes_on, continues in pieces(*shared.buffers(batch.column(2)), PIECE_BYTES):
                s = symbols(part, at, goes_on, continues, order, carry)
                level = filter_shard.value.of(s)
                for i in range(len(at) - 1):
                    here = slice(s.first[i], s.first[i + 1])
                    size = order * (here.stop - here.start)
                    if old[lo + i] is not None:
                        level[:, here] = np.maximum(level[:, here], np.frombuffer(old[lo + i][:size], np.uint8).reshape(order, -1))
                        old[lo + i] = old[lo + i][size:]
                    if not last:
                        new[lo + i] += level[:, here].tobytes()
                if last:
                    sums.add(lo, s, level, known.value)
            if last:
                columns = [pa.array(np.arange(number, number + n)), batch.column(0), batch.column(1), *(pa.array(x) for x in (sums.tokens, sums.known, sums.base, sums.score)), sums.lists()]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"])
                number += n
            else:
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(new, pa.binary())], names=["doc_id", "held_out", "text", "levels"])

    return docs.select("doc_id", "held_out", "text", "levels").mapInArrow(run, _SCORED if last else "doc_id long, held_out boolean, text string, levels binary")


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(True))


def trained(rows: DataFrame, order: int) -> tuple[DataFrame, int]:
    """(_PARTS, their number) of rows (held_out, text), written."""
    learned = rows.where(~F.col("held_out"))
    size = learned.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = 1 + size // PART_BYTES
    return shared.written(built(counted(learned, order, parts)), "lm-parts"), parts


def shards_of(parts: DataFrame, n_parts: int) -> int:
    """How many shards the filter is cut into, so that each is of SHARD_BYTES or less; a part by itself always is."""
    shards = 1
    while True:
        most = parts.groupBy(F.col("part") % shards).agg(F.sum(F.octet_length("bits")).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        if most <= SHARD_BYTES or shards >= n_parts:
            return shards
        shards = min(n_parts, max(shards + 1, -(-shards * most // SHARD_BYTES)))


def scores(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ROWS for every row of docs."""
    spark = docs.sparkSession
    shared.arrow_sized(spark)
    doc_id = F.col(id_col).cast("long")
    rows = docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), shared.text_or_empty(text_col).alias("text"), F.lit(None).cast("binary").alias("levels"))
    parts, n_parts = trained(rows, order)
    known = corpus(parts)
    shards = shards_of(parts, n_parts)
    told = spark.sparkContext.broadcast(known)
    passing = rows
    for number in range(shards):
        own = spark.sparkContext.broadcast(shard(parts, n_parts, shards, number))
        before, passing = passing, shared.written(passed(passing, order, told, own, number == shards - 1), "lm-pass")
        own.destroy()
        if number:
            shared.dropped(before)
    told.destroy()
    return _with_rare(passing, parts, known)


def _with_rare(scored: DataFrame, parts: DataFrame, known: Corpus) -> DataFrame:
    """ROWS from scored (_SCORED), the counts of whose rare words are joined by the words themselves."""
    whole = F.lit(known.whole)
    counts = vocabulary(parts).where((F.col("c") < known.least) | (F.octet_length("word") > SHORT))
    asked = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
    found = asked.join(counts.hint("merge"), "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("n_known"), F.sum(F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 0.5) / whole)).alias("base_score")
    )
    own = scored.select("row", "doc_id", "held_out", "n_tokens", "score", "n_known", "base_score")
    every = own.unionByName(found, allowMissingColumns=True).groupBy("row").agg(*[F.max(c).alias(c) for c in ("doc_id", "held_out", "n_tokens", "score")], *[F.sum(c).alias(c) for c in ("n_known", "base_score")])
    return every.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(known.tokens).cast("long").alias("train_tokens"), "base_score", "score")
