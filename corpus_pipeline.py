"""From raw documents to token ids in five stages; each reads what the one before wrote.

Every stage but the last returns the columns of documents, and extra columns that documents have; columns with the names
of the operators' own do not clash. What stages do with odd rows:

- null, empty and wordless texts fail the quality rules, which keep only texts of ten words and more; later stages by
  themselves link such texts with nothing, cut nothing from them, draw none of them, and give them no ids;
- rows without an id are linked with nothing, come before all others, and keep a null id;
- rows that repeat are judged one by one, link as one document that stays as often as it came, lose their texts' repeats
  once as one document, and are drawn each;
- null languages, sources and counts are values like any other; a null source is a source of its own;
- texts of any length are taken whole; an empty table gives an empty table of the same columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import bpe, mixing, near_dedup, quality_rules, shared, suffix_dedup

TOKENIZER = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, unchanged."""
    return quality_rules.keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates (five words, 0.8)."""
    return near_dedup.keep_one(docs)


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that occur earlier in the corpus."""
    return suffix_dedup.without_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources draws them."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, decoded_sha256): packed token ids of each drawn document, and the digest of what they decode to."""
    path = public_tokenizers.path(TOKENIZER)
    return bpe.round_trip(bpe.encode(docs, path), path)


STAGES = [("quality rules", quality), ("near duplicates", one_of_each), ("suffix array", no_repeats), ("mixing", mixture), ("bpe", tokens)]
#: Compression ratios and token merges have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = shared.written(docs, "pipeline")
    return docs
