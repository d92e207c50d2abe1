"""Operator 7, quality classifier: a factorisation machine.

Inputs of a score are the text alone: hashed words (relative frequencies in 2**word_bits slots), structure statistics
(rates of symbols, repetition, case, punctuation, compression) as numbers and as bins, and what a reader knows of the
text without reading it (its length, its bytes per character). The model adds to the linear part all pairwise
interactions through rank-`rank` factors, in linear time: half of (sum of v x)**2 - sum of (v x)**2 per factor.

The model is fitted on at most `most_rows` labelled rows, taken by a hash of their ids; this bound is what may meet on
the driver, and the model, of fixed size, goes out with the scoring function. Every text is scored in full.

Held-out rows are those with crc32(doc_id as text) mod 4 = 2; their labels are not read. Null labels and ids do not take
part in fitting; of several labels of one id the largest counts, of several texts the one with the least hash. Without labels of both kinds every score is the share
of label 1 (0.5 without any). Nulls are empty texts and get a score like any other. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import quality_rules, shared

#: Fixed by the contract.
FOLDS, HELD_OUT, CUT = 4, 2, 0.7
BINS = 8
STATS = 17


@dataclass(frozen=True)
class Fit:
    most_rows: int = 8000
    word_bits: int = 14
    rank: int = 8
    epochs: int = 6
    batch: int = 64
    rate: float = 0.08
    decay: float = 2e-5
    seed: int = 11


@dataclass
class Model:
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    edges: np.ndarray
    word_bits: int

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        stats, words = features(data, offs, self.word_bits)
        return 1 / (1 + np.exp(-_machine(self, *_inputs(self, stats, words))))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def features(data: np.ndarray, offs: np.ndarray, word_bits: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows x STATS, (slots, values, the rows' ranges of them)) of rows of UTF-8 bytes."""
    n = len(offs) - 1
    base = quality_rules.base_counts(data, offs)
    starts, ends, ranges = shared.word_spans(data, offs)
    words = shared.range_hash(shared.prefix_hash(data), starts, ends)
    row = shared.row_of(ranges)
    sums = lambda flags: quality_rules._sums(flags, offs)
    size = np.maximum(np.diff(offs), 1).astype(float)
    count = np.maximum(base["n_words"], 1).astype(float)
    kept, first = np.unique(words ^ shared.mix(row.astype(np.uint64) + np.uint64(1)), return_index=True)
    distinct = np.bincount(row[first], minlength=n)
    twin = np.zeros(len(words), bool)
    twin[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    packer = zstandard.ZstdCompressor(level=1, write_content_size=False)
    raw = memoryview(np.ascontiguousarray(data))
    packed = np.array([len(packer.compress(raw[a:b])) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())], float)
    chars = sums((data & 0xC0) != 0x80)
    marks = np.isin(data, np.frombuffer(b".,;:!?\"'()-", np.uint8))
    stats = np.stack(
        [
            np.log1p(base["n_words"]),
            base["word_chars"] / count,
            base["n_symbols"] / count,
            base["n_dup_lines"] / (1 + sums(data == 10)),
            base["n_repeat_words"] / count,
            sums((data >= 65) & (data <= 90)) / size,
            sums((data >= 48) & (data <= 57)) / size,
            sums(~shared._IS_WORD[data]) / size,
            sums(data == 10) / count,
            sums(marks) / count,
            sums(data == 33) / count,
            sums(data == 124) / count,
            distinct / count,
            np.minimum(packed / size, 2),
            np.bincount(row[twin], minlength=n) / count,
            np.diff(offs) / np.maximum(chars, 1),
            np.log1p(chars),
        ],
        1,
    )
    slot, often = np.unique((row.astype(np.int64) << word_bits) | (words >> np.uint64(64 - word_bits)).astype(np.int64), return_counts=True)
    spans = np.searchsorted(slot >> word_bits, np.arange(n + 1))
    norm = np.sqrt(np.bincount(slot >> word_bits, weights=often.astype(float) ** 2, minlength=n))
    return stats, (slot & ((1 << word_bits) - 1), often / norm[slot >> word_bits], spans)


def _inputs(model: Model, stats: np.ndarray, words: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All inputs of each row: slots, values, ranges. Words, then statistics, then their bins."""
    slots, values, spans = words
    n = len(stats)
    numbers = np.clip((stats - model.center) / model.scale, -4, 4) / 4
    bins = (stats[:, :, None] > model.edges[None]).sum(2)
    first = 1 << model.word_bits
    own = np.concatenate((np.broadcast_to(first + np.arange(STATS), (n, STATS)), first + STATS + np.arange(STATS) * BINS + bins), 1)
    x = np.concatenate((numbers, np.full((n, STATS), 0.5)), 1)
    counts = np.diff(spans)
    ranges = np.concatenate(([0], np.cumsum(counts + 2 * STATS)))
    at = np.arange(len(slots)) + np.repeat(np.arange(n) * 2 * STATS, counts)
    out_slots, out_values = np.zeros(ranges[-1], np.int64), np.zeros(ranges[-1])
    out_slots[at], out_values[at] = slots, values
    rest = np.ones(ranges[-1], bool)
    rest[at] = False
    out_slots[rest], out_values[rest] = own.ravel(), x.ravel()
    return out_slots, out_values, ranges


def _machine(model: Model, slots: np.ndarray, values: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    if len(ranges) < 2:
        return np.zeros(0)
    first = ranges[:-1]
    vx = model.factors[slots] * values[:, None]
    total = np.add.reduceat(vx, first)
    return model.bias + np.add.reduceat(model.weights[slots] * values, first) + 0.5 * (total**2 - np.add.reduceat(vx**2, first)).sum(1)


def fit(stats: np.ndarray, words: tuple, labels: np.ndarray, how: Fit) -> Model:
    """AdaGrad on the logistic loss, in shuffled batches."""
    rng = np.random.default_rng(how.seed)
    size = (1 << how.word_bits) + STATS * (1 + BINS)
    share = float(np.clip(labels.mean(), 1e-6, 1 - 1e-6)) if len(labels) else 0.5
    quantiles = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T if len(labels) else np.zeros((STATS, BINS - 1))
    center, scale = (stats.mean(0), stats.std(0) + 1e-6) if len(labels) else (np.zeros(STATS), np.ones(STATS))
    model = Model(float(np.log(share / (1 - share))), np.zeros(size), np.zeros((size, how.rank)), center, scale, quantiles, how.word_bits)
    if len(labels) == 0 or labels.min() == labels.max():
        return model
    model.factors = rng.normal(0, 0.02, (size, how.rank))
    slots, values, ranges = _inputs(model, stats, words)
    seen_w, seen_v, seen_b = np.full(size, 1e-3), np.full((size, how.rank), 1e-3), 1e-3
    for _ in range(how.epochs):
        for rows in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // how.batch)):
            n = ranges[rows + 1] - ranges[rows]
            own = np.concatenate(([0], np.cumsum(n)))
            at = np.arange(own[-1]) + np.repeat(ranges[rows] - own[:-1], n)
            s, x = slots[at], values[at]
            v = model.factors[s]
            total = np.add.reduceat(v * x[:, None], own[:-1])
            raw = model.bias + np.add.reduceat(model.weights[s] * x, own[:-1]) + 0.5 * (total**2 - np.add.reduceat((v * x[:, None]) ** 2, own[:-1])).sum(1)
            error = (1 / (1 + np.exp(-raw)) - labels[rows]) / len(rows)
            e = np.repeat(error, n)
            used, back = np.unique(s, return_inverse=True)
            gw = np.bincount(back, e * x) + how.decay * model.weights[used]
            gv = np.stack([np.bincount(back, (e * x) * (np.repeat(total[:, f], n) - v[:, f] * x)) for f in range(how.rank)], 1) + how.decay * model.factors[used]
            seen_w[used] += gw**2
            seen_v[used] += gv**2
            seen_b += error.sum() ** 2
            model.weights[used] -= how.rate * gw / np.sqrt(seen_w[used])
            model.factors[used] -= how.rate * gv / np.sqrt(seen_v[used])
            model.bias -= how.rate * error.sum() / np.sqrt(seen_b)
    return model


def train(docs: DataFrame, labels: DataFrame, how: Fit = Fit(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from the labelled rows that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("double").alias("label")).where("label_id is not null and label is not null")
    known = known.where(~held_out(F.col("label_id"))).groupBy("label_id").agg(F.max("label").alias("label"))
    # At most most_rows ids and labels: a bound that does not grow, so they may be broadcast.
    chosen = known.orderBy(F.xxhash64("label_id"), "label_id").limit(how.most_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("label_id"), shared.text_or_empty(text_col).alias("text")).join(F.broadcast(chosen), "label_id")
    # One row for an id that repeats, so most_rows also bounds what the driver gets: STATS numbers and at most 2**word_bits slots a row.
    rows = rows.groupBy("label_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("label").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = shared.buffers(batch.column(1))
            for lo, hi, part, at in shared.pieces(data, offs):
                stats, (slots, values, spans) = features(part, at, how.word_bits)
                arrays = [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), *(pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(v)) for o, v in ((np.arange(hi - lo + 1) * STATS, stats.ravel()), (spans, slots.astype(np.int32)), (spans, values.astype(np.float32))))]
                yield pa.RecordBatch.from_arrays(arrays, names=["label_id", "label", "stats", "slots", "values"])

    shared.arrow_sized(docs.sparkSession)
    got = rows.select("label_id", "text", "label").mapInArrow(run, "label_id long, label double, stats array<double>, slots array<int>, values array<float>").toArrow()
    got = got.sort_by([("label_id", "ascending")]).combine_chunks()
    flat = lambda name: got.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    counts = np.array([len(x) for x in got.column("slots")], np.int64)
    stats = flat("stats").reshape(-1, STATS) if got.num_rows else np.zeros((0, STATS))
    words = (flat("slots").astype(np.int64), flat("values").astype(float), np.concatenate(([0], np.cumsum(counts)))) if got.num_rows else (np.zeros(0, np.int64), np.zeros(0), np.zeros(1, np.int64))
    return fit(stats, words, got.column("label").to_numpy(), how)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = shared.buffers(batch.column(1))
            for lo, hi, part, at in shared.pieces(data, offs):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(model.score(part, at))], names=["doc_id", "score"])

    shared.arrow_sized(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), shared.text_or_empty(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, how: Fit = Fit()) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    out = score(docs, train(docs, labels, how))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
