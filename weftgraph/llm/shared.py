"""Pieces the operators share: Arrow text buffers, word kernels, paths and sessions."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.session import ship_package

#: Fixed by the contracts: a word is a run of bytes outside space and tab..carriage return.
SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"

PIECE_BYTES = 1 << 20
FILE_ROWS = 500_000
ARROW_BYTES = 2 << 20

_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SEPARATORS)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def arrow_sized(spark: SparkSession) -> None:
    """Keep Arrow batches small in bytes, so long texts do not add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the cluster's shared folder.

    The folder is the one in spark.checkpoint.dir; where that is unset (tests), the session's own.
    """
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "/tmp/weftgraph-checkpoints"
        os.makedirs(root, exist_ok=True)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    rows: about how many there are at most, where they are short and known; they go to a file for each FILE_ROWS.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    (df if rows is None else df.coalesce(1 + rows // FILE_ROWS)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete what written() wrote, once nothing reads it any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(name: str):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and row offsets into them, without copying; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offs is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(data: np.ndarray, offs: np.ndarray, most: int = PIECE_BYTES):
    """Runs of whole rows of about `most` bytes: (first row, end row, bytes, offsets from 0)."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def _table(batches: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(batches).combine_chunks()


def sorted_groups(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[tuple[pa.Table, bool]]:
    """Batches sorted by their first column (longs), regrouped so that no key's rows are in two tables.

    A key of `most` rows or more is cut, so that a table stays bounded; each of its tables says so by True.
    """
    held: list[pa.RecordBatch] = []
    key, rows, is_cut = 0, 0, False
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        if held or is_cut:
            end = int(np.searchsorted(keys, key, side="right"))
            if end:
                held.append(batch.slice(0, end))
                rows += end
            if end == len(keys):
                if most and rows >= most:
                    yield _table(held), True
                    held, rows, is_cut = [], 0, True
                continue
            if held:
                yield _table(held), is_cut
            held, rows, is_cut = [], 0, False
            batch, keys = batch.slice(end), keys[end:]
        last = int(np.searchsorted(keys, keys[-1]))
        if last:
            yield _table([batch.slice(0, last)]), False
        held, key, rows = [batch.slice(last)], keys[-1], len(keys) - last
    if held:
        yield _table(held), is_cut


def frequent(rows: DataFrame, keys_of: Callable[[pa.RecordBatch], np.ndarray], at_least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The frequent ones of the keys (longs) that keys_of finds in rows, ascending, and how often each was seen at least.

    Only keys that a batch holds twice are counted, so little is shuffled; a key with a share of all rows that matters
    is in every batch. `most` bounds what the driver gets, as a frequent key has more than that part of all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = keys_of(batch)
            found, often = np.unique(flat, return_counts=True)
            twice = often > 1
            key, n = np.append(found[twice], 0), np.append(often[twice], 0)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), pa.array(np.append(np.zeros(len(key) - 1, np.int64), len(flat)))], names=["key", "often", "total"])

    counts = written(rows.mapInArrow(run, "key long, often long, total long").groupBy("key").agg(F.sum("often").alias("often"), F.sum("total").alias("total")), "frequent")
    total = counts.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    got = counts.where(F.col("often") >= max(at_least, -(-total // most))).select("key", "often").toArrow()
    dropped(counts)
    key, often = (got.column(i).to_numpy().astype(np.int64) for i in range(2))
    order = np.argsort(key)
    return key[order], often[order]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    if len(_POWERS.get("b", ())) < n:
        # As long as what is hashed at once, and a quarter: workers keep them.
        size = n + n // 4
        with np.errstate(over="ignore"):
            for key, base in (("b", _BASE), ("i", pow(_BASE, -1, 1 << 64))):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                _POWERS[key] = np.multiply.accumulate(x)
    return _POWERS["b"][:n], _POWERS["i"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = hash of data[:i]; ranges come from range_hash."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range, with its length mixed in."""
    inverse = powers(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and each row's range of words; words never cross rows."""
    inside = _IS_WORD[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    filled = offs[:-1][offs[:-1] < offs[1:]]
    before[filled] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[offs[1:][offs[:-1] < offs[1:]] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def next_separator(data: np.ndarray, at: int) -> int:
    """The first place from `at` on whose byte is in no word, or the end."""
    while at < len(data):
        found = np.flatnonzero(~_IS_WORD[data[at : at + PIECE_BYTES]])
        if len(found):
            return at + int(found[0])
        at += PIECE_BYTES
    return len(data)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def row_of(ranges: np.ndarray) -> np.ndarray:
    """The row of each item, given the rows' ranges of items."""
    return np.repeat(np.arange(len(ranges) - 1), np.diff(ranges))


def grams(hashes: np.ndarray, ranges: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of k words inside a row, and the rows' ranges of them."""
    counts = np.maximum(np.diff(ranges) - k + 1, 0)
    out_ranges = np.concatenate(([0], np.cumsum(counts)))
    total = int(out_ranges[-1])
    if not total:
        return np.zeros(0, np.uint64), out_ranges
    at = np.arange(total) + np.repeat(ranges[:-1] - out_ranges[:-1], counts)
    h = np.zeros(total, np.uint64)
    for j in range(k):
        h = h * np.uint64(0xA24BAED4963EE407) + hashes[at + j]
    return mix(h), out_ranges
