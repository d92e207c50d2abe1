"""Operator 6, quality rules: compression bands.

Each text is compressed with zstandard as a whole and in fixed chunks. Repetitive text compresses far better
than prose, random or encoded data far worse; a document is kept if its ratios lie inside the limits of its
length band. Counts of words, symbols and repetitions stand beside the verdict.

The upper limits lie between the greatest ratio of check_l's 256,410 documents (four languages in Latin script) and
the least of base64 words. Hex digits compress like prose in texts of a few KB, so no limit parts them; a text with
more than half of its word bytes in words of mixed hex digits is not kept.

Every text longer than a chunk is judged by chunks too: one starts at every half chunk and one ends with the text, so
each byte is judged and a block of junk as long as a chunk fills three quarters of some chunk wherever it starts.

Nulls are empty texts: no words, base_failed, not kept. Rows that repeat are judged one by one. Columns other
than the id and the text are not read and cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import shared

#: Fixed by the contract.
SYMBOLS = b"#*$%&|<>"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, chunk_min double, chunk_max double"


@dataclass(frozen=True)
class Bands:
    """Limits of compressed size / size. bands: (least bytes, lowest, highest ratio), the last that fits counts."""

    level: int = 3
    chunk_bytes: int = 4096
    bands: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, 99.0),
        (128, 0.40, 1.02),
        (192, 0.40, 0.905),
        (256, 0.40, 0.85),
        (384, 0.40, 0.81),
        (512, 0.34, 0.76),
        (768, 0.34, 0.73),
        (1024, 0.34, 0.69),
        (1536, 0.34, 0.66),
        (2048, 0.28, 0.64),
        (3072, 0.28, 0.62),
        (4096, 0.28, 0.61),
        (8192, 0.22, 0.58),
        (16384, 0.22, 0.56),
        (32768, 0.18, 0.55),
    )
    chunk_low: float = 0.20
    chunk_high: float = 0.62
    #: Greatest share of word bytes in words of hex digits.
    hex_high: float = 0.5


_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_DIGIT, _IS_HEX = np.zeros(256, bool), np.zeros(256, bool)
_IS_DIGIT[list(b"0123456789")] = True
_IS_HEX[list(b"0123456789abcdefABCDEF")] = True
_LEAST_HEX = 4


def _sums(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offs[1:]] - total[offs[:-1]]


def base_counts(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The contract's counts for rows of UTF-8 bytes."""
    n = len(offs) - 1
    starts, ends, ranges = shared.word_spans(data, offs)
    inside = shared._IS_WORD[data]
    prefix = shared.prefix_hash(data)
    with np.errstate(over="ignore"):
        salt = shared.mix(np.arange(1, n + 1, dtype=np.uint64))
        hashes = shared.range_hash(prefix, starts, ends)
        five, spans = shared.grams(hashes, ranges, 5)
        row = shared.row_of(spans)
        keys = five ^ salt[row]
    order = np.argsort(keys)
    ordered = keys[order]
    same = np.zeros(len(keys), bool)
    if len(keys) > 1:
        eq = ordered[1:] == ordered[:-1]
        same[order[1:][eq]] = True
        same[order[:-1][eq]] = True
    cover = np.zeros(len(starts) + 1, np.int64)
    first = np.flatnonzero(same) + (ranges[:-1] - spans[:-1])[row[same]]
    np.add.at(cover, first, 1)
    np.add.at(cover, first + 5, -1)
    repeated = np.cumsum(cover[:-1]) > 0

    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate((offs[:-1], breaks + 1)))
    line_start = line_start[line_start < len(data)]
    line_end = np.minimum(np.append(line_start[1:], len(data)), len(data))
    line_end = line_end - (data[line_end - 1] == 10) if len(line_start) else line_end
    words = np.concatenate(([0], np.cumsum(inside, dtype=np.int64)))
    wordy = words[line_end] > words[line_start]
    line_start, line_end = line_start[wordy], line_end[wordy]
    line_row = np.searchsorted(offs, line_start, side="right") - 1
    with np.errstate(over="ignore"):
        lines = shared.range_hash(prefix, line_start, line_end) ^ salt[line_row]
    order = np.argsort(lines, kind="stable")
    again = np.zeros(len(lines), bool)
    if len(lines) > 1:
        again[order[1:]] = lines[order[1:]] == lines[order[:-1]]
    return {
        "n_words": np.diff(ranges),
        "word_chars": _sums(inside & ((data & 0xC0) != 0x80), offs),
        "n_symbols": _sums(_IS_SYMBOL[data], offs),
        "n_dup_lines": np.bincount(line_row[again], minlength=n),
        "n_repeat_words": _sums(repeated, ranges),
    }


def _coded(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each byte is of a word of hex digits, decimal ones and letters among them."""
    starts, ends, _ = shared.word_spans(data, offs)
    spans = np.stack((starts, ends), axis=1).ravel()
    size = ends - starts
    digits, hexes = (_sums(kind[data], spans)[::2] for kind in (_IS_DIGIT, _IS_HEX))
    coded = (size >= _LEAST_HEX) & (hexes == size) & (digits > 0) & (digits < size)
    edges = np.zeros(len(data) + 1, np.int8)
    edges[starts[coded]] = 1
    edges[ends[coded]] -= 1
    return np.cumsum(edges[:-1], dtype=np.int8) > 0


def _chunks(a: int, b: int, step: int) -> list[int]:
    """Starts of a row's chunks: every half step, and one that ends where the row does; none if the row fits in one."""
    return [] if b - a <= step else [*range(a, b - step, step // 2), b - step]


def _ratios(data: np.ndarray, offs: np.ndarray, bands: Bands, coded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ratio of whole rows; least and greatest of their chunks (the whole row's where it has none); most hex a chunk."""
    packer = zstandard.ZstdCompressor(level=bands.level, write_content_size=False, write_checksum=False)
    n, step = len(offs) - 1, bands.chunk_bytes
    whole, low, high, hexes = np.ones(n), np.ones(n), np.ones(n), np.zeros(n)
    view = memoryview(np.ascontiguousarray(data))
    hex_upto, word_upto = (np.concatenate(([0], np.cumsum(x, dtype=np.int64))) for x in (coded, shared._IS_WORD[data]))
    for i in range(n):
        a, b = int(offs[i]), int(offs[i + 1])
        if a == b:
            continue
        whole[i] = len(packer.compress(view[a:b])) / (b - a)
        at = _chunks(a, b, step)
        parts = [len(packer.compress(view[x : x + step])) / step for x in at] or [whole[i]]
        low[i], high[i] = min(parts), max(parts)
        if at:
            x = np.array(at)
            hexes[i] = ((hex_upto[x + step] - hex_upto[x]) / np.maximum(word_upto[x + step] - word_upto[x], 1)).max()
    return whole, low, high, hexes


def judge(data: np.ndarray, offs: np.ndarray, bands: Bands) -> dict[str, np.ndarray]:
    out = base_counts(data, offs)
    coded = _coded(data, offs)
    whole, low, high, hexes = _ratios(data, offs, bands, coded)
    size = np.diff(offs)
    band = np.searchsorted([b[0] for b in bands.bands], size, side="right") - 1
    least, most = (np.array([b[k] for b in bands.bands])[band] for k in (1, 2))
    fits = (whole >= least) & (whole <= most)
    fits &= (size <= bands.chunk_bytes) | ((low >= bands.chunk_low) & (high <= bands.chunk_high) & (hexes <= bands.hex_high))
    fits &= _sums(coded, offs) <= bands.hex_high * _sums(shared._IS_WORD[data], offs)
    failed = (out["n_words"] < 10) | (100 * out["n_repeat_words"] > 20 * out["n_words"])
    return out | {"base_failed": failed, "kept": fits & ~failed, "ratio": whole, "chunk_min": low, "chunk_max": high}


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """One row per input row, with SCHEMA's columns; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = shared.buffers(batch.column(1))
            for lo, hi, part, at in shared.pieces(data, offs):
                got = judge(part, at, bands)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(v) for v in got.values())], names=["doc_id", *got])

    shared.arrow_sized(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), shared.text_or_empty(text_col).alias("text")).mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns, judged where they lie.

    The text alone passes through Python; the other columns ride along in the same Arrow batch, so there is no join.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = shared.buffers(batch.column(at))
            good = [judge(part, o, bands)["kept"] for _, _, part, o in shared.pieces(data, offs)]
            if good:
                yield batch.filter(pa.array(np.concatenate(good)))

    shared.arrow_sized(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
