"""Operator 10, BPE encoding and decoding: tree concatenation.

Texts up to `2 * leaf_chars` code points are encoded where they lie. A longer text is cut at code points into
leaves that other tasks encode at the same time; neighbours then meet pairwise, level by level. A join encodes
only a window around the cut: it starts with a few tokens on each side and doubles until the new tokens agree
with both sides at their outer ends, which makes the whole sequence the one the library gives for the whole text.

Token ids travel as packed little-endian unsigned 32-bit integers in a binary column.

Nulls are empty texts with no ids. Rows that repeat, also with the same id, each keep a result. Columns other than
the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import shared

LEAF_CHARS = 16_384
GUARD = 4
#: Parts of up to so many bytes are kept in arrays, by their bytes; up to _CACHED_BYTES in a dict; longer ones not at all.
_KEY_BYTES = 15
_CACHED_BYTES = 48
_SLOT_BITS = 20
#: All kept parts are forgotten once they have more ids or the dict more parts than this.
_KEPT_IDS = 4_000_000
_KEPT_LONG = 200_000
_MOST_PARTS = 1 << 15
_LOW = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(_KEY_BYTES + 1)], np.uint64)
_HIGH = np.array([(1 << 8 * max(n - 8, 0)) - 1 for n in range(_KEY_BYTES + 1)], np.uint64)
#: White space next to more of it, or at the end, may share a token with it; texts without any split safely.
_SHARED_SPACE = re.compile(r"\s(?:\s|\Z)")
_TOGETHER = 100


class Codec:
    """The tokenizers library on one vocabulary, with a bounded cache of the parts that texts split into.

    Between characters other than white space, a space begins a new word of the pre-tokenizer and a line feed is one
    of its own, so a text splits before each and every part has its own ids.

    A short part's bytes and length are two whole numbers, which the rows of a table are compared with, all parts of
    a piece at once. A row is found by a hash and holds the last part that fell on it.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self._special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        #: Rows of (first bytes, other bytes and length, place); a place is a start in _ids and a number of ids.
        self._table = np.zeros((1 << _SLOT_BITS, 3), np.uint64)
        self._long: dict[bytes, int] = {}
        self._ids, self._used = np.zeros(_KEPT_IDS, np.uint32), 0
        vocab = self.library.get_vocab(with_added_tokens=True)
        #: Whether a token begins with a space or a line feed.
        self._starts = np.zeros(max(vocab.values()) + 1, bool)
        self._starts[[i for t, i in vocab.items() if t[:1] in "\u0120\u010a"]] = True
        self._names: list[str] | None = None
        self._pieces: list[bytes] | None = None

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        data, offs = shared.buffers(pa.array(texts, pa.string()))
        whole = [i for i, t in enumerate(texts) if _SHARED_SPACE.search(t) or any(s in t for s in self._special)]
        cut = (data == 0x20) | (data == 0x0A)
        for i in whole:
            cut[offs[i] : offs[i + 1]] = False
        cuts = np.flatnonzero(cut)
        before = np.searchsorted(cuts, offs[:-1])
        begin = np.insert(cuts, before, offs[:-1])
        end = np.append(begin[1:], offs[-1])
        first = before + np.arange(len(texts))
        end[first[whole]] = begin[first[whole]]
        raw, padded = data.tobytes(), np.append(data, np.zeros(16, np.uint8))
        found = [self._parts(raw, padded, begin[lo : lo + _MOST_PARTS], end[lo : lo + _MOST_PARTS]) for lo in range(0, len(begin), _MOST_PARTS)]
        packed = b"".join([ids.tobytes() for ids, _ in found])
        at = 4 * np.concatenate([[0], *[n for _, n in found]]).cumsum()[np.append(first, len(begin))]
        out = [packed[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        for i, ids in zip(whole, self.plain([texts[i] for i in whole])):
            out[i] = np.array(ids, "<u4").tobytes()
        return out

    def _parts(self, raw: bytes, padded: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts raw[begin:end], one after the other, and how many each part has."""
        if self._used > _KEPT_IDS or len(self._long) > _KEPT_LONG:
            self._table[:], self._used = 0, 0
            self._long.clear()
        size = end - begin
        short = size <= _KEY_BYTES
        clipped = np.minimum(size, _KEY_BYTES)
        eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
        low = eight[begin].view("<u8")[:, 0] & _LOW[clipped]
        high = (eight[begin + 8].view("<u8")[:, 0] & _HIGH[clipped]) | (clipped.astype(np.uint64) << np.uint64(56))
        slot = ((low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)) ^ (low >> np.uint64(29))
        slot = ((slot ^ (slot >> np.uint64(32))) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        rows = self._table.take(slot, axis=0)
        # An empty part is like a row never filled: no ids.
        is_known = (rows[:, 0] == low) & (rows[:, 1] == high) & short
        place = rows[:, 2].astype(np.int64)
        place[size == 0] = 0
        missing = np.flatnonzero(~is_known & (size > 0))
        kept = self._used
        if len(missing):
            parts = [raw[a:b] for a, b in zip(begin[missing].tolist(), end[missing].tolist())]
            places = dict.fromkeys(parts)
            new = [p for p in places if p not in self._long]
            places.update((p, self._long[p]) for p in places if p in self._long)
            places.update(self._added([p for p in new if len(p) <= _CACHED_BYTES]))
            kept = self._used
            places.update(self._added([p for p in new if len(p) > _CACHED_BYTES]))
            self._long.update((p, places[p]) for p in new if _KEY_BYTES < len(p) <= _CACHED_BYTES)
            place[missing] = list(map(places.__getitem__, parts))
            missing = missing[short[missing]]
            missing = missing[np.unique(slot[missing], return_index=True)[1]]
            self._table[slot[missing]] = np.stack((low[missing], high[missing], place[missing].astype(np.uint64)), 1)
        count = place & 0xFFFFFFFF
        ends = np.cumsum(count)
        at = np.repeat((place >> 32) - (ends - count), count)
        at += np.arange(len(at))
        ids = self._ids.take(at)
        self._used = kept
        if len(self._ids) > 4 * _KEPT_IDS:
            self._ids = self._ids[: max(kept, _KEPT_IDS)].copy()
        return ids, count

    def _added(self, parts: list[bytes]) -> Iterator[tuple[bytes, int]]:
        """Encode parts and put their ids behind those used: (part, place)."""
        if not parts:
            return iter(())
        led = [p for p in parts if p[:1] in b" \n"]
        own = [p for p in parts if p[:1] not in b" \n"]
        # Joined texts, cut before each token that begins with a space or a line feed.
        texts = [b"".join(led[i : i + _TOGETHER]).decode() for i in range(0, len(led), _TOGETHER)] + [p.decode() for p in own]
        ids = [np.array(x, np.uint32) for x in self.plain(texts)]
        flat = np.concatenate(ids)
        cut = self._starts[flat]
        cut[np.cumsum([0, *map(len, ids[:-1])])] = True
        begin = np.flatnonzero(cut)
        if len(begin) != len(parts):
            raise ValueError("the vocabulary joins what the pre-tokenizer parts")
        if self._used + len(flat) > len(self._ids):
            self._ids = np.concatenate((self._ids[: self._used], np.zeros(len(flat) + _KEPT_IDS // 8, np.uint32)))
        self._ids[self._used : self._used + len(flat)] = flat
        place = (begin + self._used << 32) + np.diff(begin, append=len(flat))
        self._used += len(flat)
        return zip(led + own, place.tolist())

    def decode(self, rows: list[bytes]) -> list[str]:
        return self.library.decode_batch([np.frombuffer(r, "<u4").tolist() for r in rows], skip_special_tokens=False)

    def decimal(self, row: bytes) -> str:
        if self._names is None:
            self._names = [str(i) for i in range(self.library.get_vocab_size(with_added_tokens=True))]
        return ",".join(map(self._names.__getitem__, np.frombuffer(row, "<u4").tolist()))

    def raw(self, ids: np.ndarray) -> bytes:
        """The UTF-8 bytes that ids stand for."""
        if self._pieces is None:
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
            table = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
            n = self.library.get_vocab_size(with_added_tokens=True)
            special = {i: t.content.encode() for i, t in self.library.get_added_tokens_decoder().items()}
            self._pieces = [special[i] if i in special else bytes(table[c] for c in self.library.id_to_token(i) or "") for i in range(n)]
        return b"".join(map(self._pieces.__getitem__, ids.tolist()))

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids of two neighbouring texts' concatenation, from theirs."""
        a = b = 2 * GUARD
        while len(left) and len(right):
            a, b = min(a, len(left)), min(b, len(right))
            window = self.raw(left[len(left) - a :]) + self.raw(right[:b])
            if a < len(left) and (window[0] & 0xC0 == 0x80 or window[:1] == b"'"):
                a += 1
                continue
            if b < len(right) and self.raw(right[b : b + 1])[0] & 0xC0 == 0x80:
                b += 1
                continue
            new = np.array(self.plain([window.decode()])[0], "<u4")
            ga, gb = a // 2, b // 2
            same_left = a == len(left) or np.array_equal(new[:ga], left[len(left) - a :][:ga])
            same_right = b == len(right) or np.array_equal(new[len(new) - gb :], right[b - gb : b])
            if same_left and same_right and (len(new) >= ga + gb or (a == len(left) and b == len(right))):
                return np.concatenate((left[: len(left) - a], new, right[b:]))
            a, b = 2 * a, 2 * b
        return np.concatenate((left, right))


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


_IDS = "doc_id long, ids binary"
_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _encode_rows(docs: DataFrame, path: str, schema: str, digest: bool = False) -> DataFrame:
    """docs' last column is the text; its packed ids, or their digests, take its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            data, offs = shared.buffers(batch.column(batch.num_columns - 1))
            for lo, hi, _, _ in shared.pieces(data, offs):
                part = batch.slice(lo, hi - lo)
                ids = own.encode(part.column(part.num_columns - 1).to_pylist())
                if digest:
                    yield _digest_batch(own, part.column(0), ids)
                else:
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(ids, pa.binary())], names=[*part.schema.names[:-1], "ids"])

    return docs.mapInArrow(run, schema)


def _digest_batch(own: Codec, doc_id: pa.Array, ids: list[bytes]) -> pa.RecordBatch:
    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    cols = [pa.array([len(r) // 4 for r in ids], pa.int64()), pa.array([sha(own.decimal(r)) for r in ids], pa.string()), pa.array([sha(t) for t in own.decode(ids)], pa.string())]
    return pa.RecordBatch.from_arrays([doc_id, *cols], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = LEAF_CHARS, digest: bool = False) -> DataFrame:
    """(doc_id, ids binary) for each row.

    digest: (doc_id, n_tokens, ids_sha256, decoded_sha256) instead, decoded in the worker that holds the ids.
    """
    spark = docs.sparkSession
    shared.arrow_sized(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), shared.text_or_empty(text_col).alias("text"))
    short = _encode_rows(rows.where(F.length("text") <= 2 * leaf_chars), path, _DIGESTS if digest else _IDS, digest)
    # Rows that repeat are encoded once and counted; (doc_id, digest) names a text on its way through the levels.
    leaves = _leaves(rows.where(F.length("text") > 2 * leaf_chars), leaf_chars)
    leaves = shared.written(leaves.groupBy("doc_id", "digest", "node").agg(F.count("*").alias("copies"), F.first("text").alias("text")), "leaves")
    last = leaves.agg(F.max("node")).first()[0]
    if last is None:
        return short
    level = _encode_rows(leaves.select("doc_id", "digest", "copies", "node", "text"), path, "doc_id long, digest string, copies long, node int, ids binary")
    width = last + 1
    while width > 1:
        pairs = level.groupBy("doc_id", "digest", "copies", F.expr("node div 2").cast("int").alias("node")).agg(F.array_sort(F.collect_list(F.struct("node", "ids"))).alias("two"))
        pairs = pairs.select("doc_id", "digest", "copies", "node", F.col("two")[0]["ids"].alias("ids"), F.try_element_at("two", F.lit(2))["ids"].alias("right"))
        level = _join_rows(pairs, path)
        width = -(-width // 2)
    tree = level.select("doc_id", "ids", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("doc_id", "ids")
    return short.unionByName(digests(tree, path) if digest else tree)


def leaf_ends(data: np.ndarray, leaf_chars: int) -> list[int]:
    """Where UTF-8 bytes are cut so that each leaf but the last has so many code points: one pass."""
    ends, seen = [], 0
    for lo in range(0, len(data), shared.PIECE_BYTES):
        first = np.flatnonzero((data[lo : lo + shared.PIECE_BYTES] & 0xC0) != 0x80)
        ends.append(lo + first[(seen + np.arange(len(first))) % leaf_chars == 0])
        seen += len(first)
    return [*np.concatenate(ends).tolist()[1:], len(data)] if ends else []


def _leaves(rows: DataFrame, leaf_chars: int) -> DataFrame:
    """(doc_id, digest, node, text) from (doc_id, text): each text's leaves in order, its sha256 beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = shared.buffers(batch.column(1))
            for i in range(batch.num_rows):
                row = np.ascontiguousarray(data[offs[i] : offs[i + 1]])
                digest, ends = hashlib.sha256(row).hexdigest(), leaf_ends(row, leaf_chars)
                for lo in range(0, len(ends), 64):
                    cuts = [ends[lo - 1] if lo else 0, *ends[lo : lo + 64]]
                    texts = pa.Array.from_buffers(pa.string(), len(cuts) - 1, [None, pa.py_buffer(np.array(cuts, np.int32) - np.int32(cuts[0])), pa.py_buffer(row[cuts[0] : cuts[-1]])])
                    n = len(texts)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1).take(pa.array([0] * n)), pa.array([digest] * n), pa.array(np.arange(lo, lo + n, dtype=np.int32)), texts], names=["doc_id", "digest", "node", "text"])

    return rows.mapInArrow(run, "doc_id long, digest string, node int, text string")


def _join_rows(pairs: DataFrame, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            both = zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())
            ids = [a if b is None else own.join(np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")).astype("<u4").tobytes() for a, b in both]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ids, pa.binary())], names=["doc_id", "digest", "copies", "node", "ids"])

    return pairs.mapInArrow(run, "doc_id long, digest string, copies long, node int, ids binary")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.decode([x or b"" for x in batch.column(1).to_pylist()]), pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded_sha256): encode's rows with the digest of what their ids decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            data, offs = shared.buffers(batch.column(1))
            for lo, hi, _, _ in shared.pieces(data, offs):
                part = batch.slice(lo, hi - lo)
                texts = own.decode([x or b"" for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())], names=["doc_id", "ids", "decoded_sha256"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"{_IDS}, decoded_sha256 string")


def digests(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encode's rows, decoded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            data, offs = shared.buffers(batch.column(1))
            for lo, hi, _, _ in shared.pieces(data, offs):
                yield _digest_batch(own, batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo).to_pylist())

    return tokens.select("doc_id", "ids").mapInArrow(run, _DIGESTS)
