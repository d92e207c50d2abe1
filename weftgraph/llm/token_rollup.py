"""Operator 8, token counts: delta-maintained rollups.

Totals of documents and tokens by source, language and tokenizer version are sums of signed deltas. An insert adds a
document and its tokens, a delete takes them away, a revision does both: away under what was counted, in under what
counts now. A batch of changes is summed by group before it is stored, so the store grows with batches and groups, not
with documents, and totals are a sum over it.

A batch is committed once. Its sums are written to a folder of their own; then its marker file, named after the batch
and holding the folder's name, is created, which fails where there is one. A batch counts if and only if its marker is
whole, and readers read only folders that markers name. So a batch that is sent again, or by two writers at once, or
after a driver was lost at any step, counts once. A marker that its writer did not finish is none.

compact() writes the sum of the batches there are, a table of their names, and then a numbered marker that names both:
one file turns old to new. Those batches' names stay taken. Of two that compact at once one gets the number. Markers are
read by tasks; the driver gets the folders of the batches since the last sum alone, so it is compaction, not the store's
age, that bounds them. clean() deletes the markers that a sum stands for: the table of names keeps their batches taken.

Versions are counted in two ways: words-1 and bytes4-1 by expressions that SQL has too, byte_bpe_50k by the tokenizer
itself, in one pass over the texts in Python workers that return only the counts. byte_bpe_50k is what to use; the
other two are no tokenizer's counts.

Null sources and languages are groups of their own. A null text has no tokens. Rows that repeat count each time.
Groups whose documents and tokens both come to zero are left out. Columns other than those named are not read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import bpe, shared
from weftgraph.llm.mixing import size_of

GROUP = ["source", "lang", "tokenizer"]
_SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
_NAMES = "batch string"

#: Tokenizer versions that SQL can count: words of the contracts, and four bytes to a token.
VERSIONS = {"words-1": size_of, "bytes4-1": lambda text: F.expr(f"(coalesce(octet_length({text}), 0) + 3) div 4").cast("long")}


#: Tokenizer versions that a vocabulary counts.
VOCABULARIES = {"byte_bpe_50k": "byte_bpe_50k.json"}


def counted(docs: DataFrame, versions: tuple[str, ...] = tuple(VERSIONS), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """(doc_id, source, lang, counts: map of version to tokens) for every row."""
    row = [F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang")]
    encoded = [v for v in versions if v in VOCABULARIES]
    if encoded:
        plain = [VERSIONS[v](text_col).alias(f"n{i}") for i, v in enumerate(versions) if v in VERSIONS]
        docs = _encoded(docs.select(*row, *plain, shared.text_or_empty(text_col).alias("text")), encoded)
        row = ["doc_id", "source", "lang"]
    of = lambda i, v: VERSIONS[v](text_col) if not encoded else F.col(v if v in VOCABULARIES else f"n{i}")
    counts = F.create_map(*[x for i, v in enumerate(versions) for x in (F.lit(v), of(i, v))])
    return docs.select(*row, counts.alias("counts"))


def _encoded(rows: DataFrame, versions: list[str]) -> DataFrame:
    """rows, whose last column is the text, with each version's number of tokens in its place."""
    paths = [public_tokenizers.path(VOCABULARIES[v]) for v in versions]
    kept = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codecs = [bpe.codec(p) for p in paths]
        for batch in batches:
            data, offs = shared.buffers(batch.column(len(kept)))
            for lo, hi, _, _ in shared.pieces(data, offs):
                part = batch.slice(lo, hi - lo)
                texts = part.column(len(kept)).to_pylist()
                counts = [pa.array([len(ids) // 4 for ids in c.encode(texts)], pa.int64()) for c in codecs]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *counts], names=[*kept, *versions])

    shared.arrow_sized(rows.sparkSession)
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), *(f"`{v}` long" for v in versions)])
    return rows.mapInArrow(run, schema)


def _signed(rows: DataFrame, version: str, sign: int) -> DataFrame:
    return rows.select("source", "lang", F.lit(version).alias("tokenizer"), F.lit(sign).cast("long").alias("n_docs"), (F.col("counts")[version] * sign).alias("n_tokens"))


def inserts(rows: DataFrame, version: str) -> DataFrame:
    return _signed(rows, version, 1)


def deletes(rows: DataFrame, version: str) -> DataFrame:
    return _signed(rows, version, -1)


def revisions(rows: DataFrame, old: str, new: str) -> DataFrame:
    return _signed(rows, old, -1).unionByName(_signed(rows, new, 1))


class Rollup:
    """A store of committed batches below `path`, in any file system where a file is created only if there is none."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for folder in ("commits", "sums", "data", "names"):
            self._fs.mkdirs(self._path(folder))

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _written(self, changes: DataFrame) -> str:
        """The changes' sums by group in a new folder that no marker names yet."""
        folder = f"data/{uuid.uuid4().hex}"
        changes.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).write.parquet(f"{self.path}/{folder}")
        return folder

    def _marked(self, marker: str, content: dict) -> bool:
        """Create a marker file; False if there is a whole one."""
        if self._fs.exists(self._path(marker)) and self._marker(marker) is None:
            self._fs.delete(self._path(marker), False)
        try:
            out = self._fs.create(self._path(marker), False)
        except Py4JJavaError as e:
            if self._fs.exists(self._path(marker)):
                return False
            raise e
        out.write(bytearray(f"{json.dumps(content)}\n".encode()))
        out.close()
        return True

    def _marker(self, marker: str) -> dict | None:
        """What a marker says; None if there is none that is whole."""
        if not self._fs.exists(self._path(marker)):
            return None
        file = self._fs.open(self._path(marker))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
        finally:
            file.close()
        return json.loads(text) if text.endswith("\n") else None

    def _last(self) -> tuple[int, dict | None]:
        """The number of sums so far, and what the last whole one's marker says."""
        numbers = sorted((int(s.getPath().getName()) for s in self._fs.listStatus(self._path("sums")) if s.getPath().getName().isdigit()), reverse=True)
        found = ((n, self._marker(f"sums/{n}")) for n in numbers)
        return next(((n, m) for n, m in found if m is not None), (0, None))

    def _commits(self) -> DataFrame:
        """(batch, folder) of all whole markers, read by tasks."""
        raw = self.spark.read.option("ignoreMissingFiles", True).text(f"{self.path}/commits", wholetext=True)
        return raw.where(F.col("value").endswith("\n")).select(F.from_json("value", "batch string, folder string").alias("m")).select("m.*")

    def _names(self, last: dict | None) -> DataFrame:
        """(batch) of the batches that the last sum stands for, in order of name."""
        return self.spark.read.schema(_NAMES).parquet(f"{self.path}/{last['names']}") if last else self.spark.createDataFrame([], _NAMES)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of signed changes; False if one of its name is there already."""
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch's name is letters, digits, - and _")
        marker = f"commits/batch-{batch}"
        if self._marker(marker) is not None or not self._names(self._last()[1]).where(F.col("batch") == batch).isEmpty():
            return False
        folder = self._written(changes)
        done = self._marked(marker, {"batch": batch, "folder": folder})
        if not done:
            self._fs.delete(self._path(folder), True)
        return done

    def _live(self) -> tuple[int, dict | None, list[tuple[str, str]]]:
        """The number of sums so far, the last one, and (batch, folder) of the batches since."""
        number, last = self._last()
        new = self._commits().join(self._names(last), "batch", "left_anti").select("batch", "folder").collect()
        return number, last, sorted(map(tuple, new))

    @staticmethod
    def _folders(last: dict | None, new: list[tuple[str, str]]) -> list[str]:
        return [*([last["folder"]] if last else []), *(f for _, f in new)]

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over all committed batches."""
        return self._sum(self._folders(*self._live()[1:]))

    def _sum(self, folders: list[str]) -> DataFrame:
        paths = [f"{self.path}/{f}" for f in folders]
        rows = self.spark.read.schema(_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], _SCHEMA)
        return rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> bool:
        """Let one sum stand for all batches there are; False if another writer did so meanwhile."""
        number, last, new = self._live()
        folder, names = self._written(self._sum(self._folders(last, new))), f"names/{uuid.uuid4().hex}"
        held = self._names(last).unionByName(self.spark.createDataFrame([(b,) for b, _ in new], _NAMES))
        held.repartitionByRange("batch").sortWithinPartitions("batch").write.parquet(f"{self.path}/{names}")
        done = self._marked(f"sums/{number + 1}", {"folder": folder, "names": names})
        if not done:
            for f in (folder, names):
                self._fs.delete(self._path(f), True)
        return done

    def clean(self) -> None:
        """Delete what does not count, in a store that nobody else reads or writes meanwhile: folders, and markers that a sum stands for."""
        number, last, new = self._live()
        for row in self._commits().join(self._names(last), "batch", "left_semi").select("batch").toLocalIterator():
            self._fs.delete(self._path(f"commits/batch-{row.batch}"), False)
        live = {*self._folders(last, new), *([last["names"]] if last else [])}
        for kind in ("data", "names"):
            for s in self._fs.listStatus(self._path(kind)):
                if f"{kind}/{s.getPath().getName()}" not in live:
                    self._fs.delete(s.getPath(), True)
        for s in self._fs.listStatus(self._path("sums")):
            if s.getPath().getName().isdigit() and int(s.getPath().getName()) < number:
                self._fs.delete(s.getPath(), False)


def _marked(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows that have labels, with toxic and quality."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.coalesce(F.max("toxic"), F.lit(0)).alias("toxic"), F.coalesce(F.max("quality"), F.lit(0)).alias("quality"))
    return shared.written(rows.join(marks, F.col("doc_id") == F.col("label_id")), "marked")


def corpus_rollup(docs: DataFrame, labels: DataFrame, path: str) -> DataFrame:
    """Totals after three batches, two of them sent twice.

    All documents come in under words-1; those that a label calls toxic go; of the rest, those that a label calls good
    are counted again under bytes4-1.
    """
    spark = docs.sparkSession
    rows = shared.written(counted(docs), "counted")
    marked = _marked(rows, labels)
    store = Rollup(spark, path)
    for batch, changes in (
        ("load", inserts(rows, "words-1")),
        ("toxic", deletes(marked.where("toxic = 1"), "words-1")),
        ("load", inserts(rows, "words-1")),
        ("recount", revisions(marked.where("toxic <> 1 and quality = 1"), "words-1", "bytes4-1")),
        ("toxic", deletes(marked.where("toxic = 1"), "words-1")),
    ):
        store.commit(batch, changes)
    return store.totals()


def bpe_rollup(docs: DataFrame, labels: DataFrame, path: str) -> DataFrame:
    """Totals under byte_bpe_50k alone, after three batches, two of them sent twice.

    All documents come in under words-1 and are all counted again by the tokenizer; those that a label calls toxic go.
    """
    rows = shared.written(counted(docs, ("words-1", "byte_bpe_50k")), "counted")
    marked = _marked(rows, labels)
    store = Rollup(docs.sparkSession, path)
    for batch, changes in (
        ("load", inserts(rows, "words-1")),
        ("recount", revisions(rows, "words-1", "byte_bpe_50k")),
        ("load", inserts(rows, "words-1")),
        ("toxic", deletes(marked.where("toxic = 1"), "byte_bpe_50k")),
        ("toxic", deletes(marked.where("toxic = 1"), "byte_bpe_50k")),
    ):
        store.commit(batch, changes)
    return store.totals()


#: DuckDB SQL for corpus_rollup over documents and labels.
ORACLE = r"""
WITH marks AS (
  SELECT doc_id, coalesce(max(toxic), 0) AS toxic, coalesce(max(quality), 0) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), counted AS (
  SELECT d.source, d.lang, coalesce(m.toxic, 0) AS toxic, coalesce(m.quality, 0) AS quality,
    len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+')) AS words,
    (strlen(coalesce(d.text, '')) + 3) // 4 AS bytes4
  FROM documents d LEFT JOIN marks m ON m.doc_id = d.doc_id
), kept AS (
  SELECT source, lang, CASE WHEN quality = 1 THEN 'bytes4-1' ELSE 'words-1' END AS tokenizer,
    CASE WHEN quality = 1 THEN bytes4 ELSE words END AS n
  FROM counted WHERE toxic <> 1
)
SELECT source, lang, tokenizer, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens
FROM kept GROUP BY ALL
"""
