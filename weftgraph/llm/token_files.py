"""Operator 5, token ids in binary files: independent zstandard frames with a trailing seek table.

A file holds data frames (the ids of whole documents, packed as little-endian unsigned 32-bit integers), one index
frame (which document lies where), and a skippable frame with the compressed size, size and checksum of each frame
before it, in zstandard's published seekable format. Any zstandard reader can unpack a file; ours reads the seek
table, the index and only the frames of the documents asked for, and checks each frame it unpacks.

Spark's own writers commit the files, so the output folder can be in any store that Spark writes: a file is one row
of the text writer, whose line separator is the format's closing magic number.

Rows are in ascending doc_id order within and across files, null ids first; rows with the same id follow in order of
their text. An id that many rows have is dealt out by the first letters of their texts, so that it fills many files'
tasks; only rows alike in both stay in one. A null text is empty and has the end id alone. Other columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm import shared
from weftgraph.llm.bpe import codec

#: Fixed by the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

FRAME_BYTES = 256 << 10
FILE_BYTES = 8 << 20
#: Letters of a text that ranges of rows are told apart by: whole texts would be sampled to the driver.
RANGE_LETTERS = 256
_INDEX = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("frame", "<u4"), ("at", "<u4"), ("n", "<u4")])
_HEADER = struct.Struct("<II")


class _File:
    """One file's frames until they are closed into an image."""

    def __init__(self, level: int):
        self.packer, self.frames, self.table, self.index, self.open, self.size = zstandard.ZstdCompressor(level=level), [], [], [], [], 0
        self.filled = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.filled and self.filled + len(ids) > FRAME_BYTES:
            self.flush()
        self.index.append((doc_id or 0, doc_id is not None, len(self.frames), self.filled // 4, len(ids) // 4))
        self.open.append(ids)
        self.filled += len(ids)

    def flush(self) -> None:
        self._frame(b"".join(self.open))
        self.open, self.filled = [], 0

    def _frame(self, raw: bytes) -> None:
        packed = self.packer.compress(raw)
        self.frames.append(packed)
        self.table.append(struct.pack("<III", len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.size += len(packed)

    def image(self, part: int, number: int) -> bytes:
        """The file without its closing magic number."""
        if self.open:
            self.flush()
        self._frame(_HEADER.pack(part, number) + np.array(self.index, _INDEX).tobytes())
        body = b"".join(self.table) + struct.pack("<IB", len(self.frames), CHECKSUM_FLAG)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(body) + 4) + body


class Reader:
    """Random access to one file's bytes."""

    def __init__(self, content: bytes):
        self.content = memoryview(content)
        n, flags, magic = struct.unpack("<IBI", self.content[-9:])
        if magic != SEEKABLE_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError("not a seekable file with checksums")
        at = len(content) - 9 - 12 * n
        if struct.unpack("<II", self.content[at - 8 : at]) != (SKIPPABLE_MAGIC, 12 * n + 9):
            raise ValueError("the seek table is damaged")
        self.table = np.frombuffer(self.content[at : at + 12 * n], "<u4").reshape(n, 3)
        self.starts = np.concatenate(([0], np.cumsum(self.table[:, 0], dtype=np.int64)))
        raw = self.frame(n - 1)
        self.part, self.number = _HEADER.unpack(raw[: _HEADER.size])
        self.index = np.frombuffer(raw[_HEADER.size :], _INDEX)

    def frame(self, k: int) -> bytes:
        packed = self.content[self.starts[k] : self.starts[k + 1]]
        raw = zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(self.table[k, 1]))
        if len(raw) != self.table[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, ids before it in this file, its ids) in order; only frames with wanted documents are unpacked."""
        held, raw, before = -1, b"", 0
        for x in self.index:
            doc_id = int(x["doc_id"]) if x["known"] else None
            if wanted is None or doc_id in wanted:
                if held != x["frame"]:
                    held, raw = int(x["frame"]), self.frame(int(x["frame"]))
                yield doc_id, before, raw[4 * int(x["at"]) : 4 * (int(x["at"]) + int(x["n"]))]
            before += int(x["n"])


def write_token_files(docs: DataFrame, out: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", level: int = 1) -> None:
    """Encode every row and write the files below `out`: one shuffle, by ranges of doc_id and of the texts' beginnings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end, part, number = codec(tokenizer), struct.pack("<I", end_id), TaskContext.get().partitionId(), 0
        file = _File(level)

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file.image(part, number)], pa.binary())], names=["image"])

        for batch in batches:
            data, offs = shared.buffers(batch.column(1))
            for lo, hi, _, _ in shared.pieces(data, offs):
                for doc_id, ids in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), own.encode(batch.column(1).slice(lo, hi - lo).to_pylist())):
                    file.add(doc_id, ids + end)
                    if file.size > FILE_BYTES:
                        yield closed()
                        file, number = _File(level), number + 1
        if file.index:
            yield closed()

    shared.arrow_sized(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), shared.text_or_empty(text_col).alias("text"))
    images = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.substring("text", 1, RANGE_LETTERS)).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(run, "image binary")
    images.select(F.col("image").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", struct.pack("<I", SEEKABLE_MAGIC).decode("latin-1")).option("compression", "none").text(out)


def read_token_files(spark: SparkSession, path: str, payload: Column | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) of every document in the files; start counts all ids before it.

    payload: what is wanted of the ids instead, taken before the files' places are joined. An empty folder gives no rows.
    """
    payload = F.col("ids") if payload is None else payload

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [Reader(x) for x in batch.column(0).to_pylist() if x]
            yield pa.RecordBatch.from_arrays([pa.array([getattr(f, k) for f in files], pa.int64()) for k in ("part", "number")] + [pa.array([int(f.index["n"].sum(dtype=np.int64)) for f in files], pa.int64())], names=["part", "number", "n"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in (Reader(x) for x in batch.column(0).to_pylist() if x):
                docs = list(f.documents())
                n = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f.part] * n, pa.int64()), pa.array([f.number] * n, pa.int64()), pa.array([d[0] for d in docs], pa.int64()), pa.array([d[1] for d in docs], pa.int64()), pa.array([len(d[2]) // 4 for d in docs], pa.int64()), pa.array([d[2] for d in docs], pa.binary())],
                    names=["part", "number", "doc_id", "at", "n_tokens", "ids"],
                )

    shared.arrow_sized(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    # One row per file of FILE_BYTES: the only thing that is put in one order.
    base = files.mapInArrow(lengths, "part long, number long, n long").withColumn("base", F.sum("n").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)))
    found = files.mapInArrow(rows, "part long, number long, doc_id long, at long, n_tokens long, ids binary").select("part", "number", "doc_id", "at", "n_tokens", payload.alias("payload"))
    name = spark.range(0).select(F.lit(b"").alias("ids")).select(payload).columns[0]
    return found.join(base.select("part", "number", "base"), ["part", "number"]).select("doc_id", (F.coalesce("base", F.lit(0)) + F.col("at")).alias("start"), "n_tokens", F.col("payload").alias(name))


def pick(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids) of the documents in wanted (doc_id) alone; of each file only their frames are unpacked.

    An id that several documents share gives all of them; one that is in no file, or null, gives none.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if content:
                    own = Reader(content).index
                    known = np.unique(own["doc_id"][own["known"] > 0])
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(known), pa.string()), pa.array(known)], names=["path", "doc_id"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs = list(Reader(content).documents(set(ids)))
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in docs], pa.int64()), pa.array([len(d[2]) // 4 for d in docs], pa.int64()), pa.array([d[2] for d in docs], pa.binary())], names=["doc_id", "n_tokens", "ids"])

    shared.arrow_sized(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    asked = files.mapInArrow(index, "path string, doc_id long").join(wanted.select(F.col("doc_id").cast("long")).distinct(), "doc_id").groupBy("path").agg(F.collect_list("doc_id").alias("wanted"))
    return files.join(asked, "path").select("content", "wanted").mapInArrow(rows, "doc_id long, n_tokens long, ids binary")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files; Spark's crc32 is the unsigned one."""
    return read_token_files(spark, path, F.crc32("ids").alias("ids_crc32"))
